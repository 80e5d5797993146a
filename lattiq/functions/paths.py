"""Strings, paths and frame labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_last(s: Column, old: str, new: str) -> Column:
    """Replaces the last occurrence of ``old``; without one, or with an empty ``old``, the string stays."""
    if not old:
        return s
    from_end = F.locate(old[::-1], F.reverse(s))
    start = F.length(s) - from_end - len(old) + 2
    return F.when(from_end == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), start - 1), F.lit(new), F.substr(s, start + len(old))))


def frame_of(label: Column) -> Column:
    """The frame number, a label's last five characters."""
    return F.right(label, F.lit(5)).cast("int")


def barcode_of(label: Column) -> Column:
    return F.substr(label, F.lit(1), F.length(label) - 5)


def zero_padded(n: Column, width: int) -> Column:
    """Never cut short, unlike lpad."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def neighbor_label(label: Column, increment: Column | int) -> Column:
    """The label ``increment`` frames away; null before frame 0."""
    n = frame_of(label) + increment
    return F.when(n >= 0, F.concat(barcode_of(label), zero_padded(n, 5)))


def metadata_frame(label: Column) -> Column:
    """``name-12_f00034`` to ``34-12``: frame, then what follows the last dash of the barcode."""
    parts = F.split(label, "_f")
    return F.concat(F.element_at(parts, -1).cast("int").cast("string"), F.lit("-"), F.element_at(F.split(F.element_at(parts, 1), "-"), -1))


def parent_path(s: Column) -> Column:
    """What stands before the last slash; null without one."""
    return F.when(F.locate("/", s) > 0, F.regexp_extract(s, "^(.*)/[^/]*$", 1))


def base_name(s: Column) -> Column:
    return F.element_at(F.split(s, "/"), -1)


def extension(s: Column) -> Column:
    """In lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(s), r"(\.[^.]*)$", 1))


def in_group(path: Column, keyword: str | None) -> Column:
    """No keyword: every path. One with ``.*`` is a regular expression, any other a part of the path."""
    if keyword is None:
        return F.lit(True)
    return path.rlike(keyword) if ".*" in keyword else F.contains(path, F.lit(keyword))


def channel_path(path0: Column, channel0: str, channel: str) -> Column:
    """The path of a channel beside that of the first one."""
    return replace_last(path0, channel0, channel)
