"""Channels brought together: alignment, singletons, side arrays, labels, and ids resolved to datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.images import padded
from lattiq.operators.positions import with_positions

KEY = ("ds_idx", "im_idx")
#: Parts that are sent to every task; more of them are shuffled, as their size in files does not tell what they take in memory.
MAX_SENT = 10_000
#: Widths of bins are powers of two whose exponents are multiples of this, and the last one.
_STEP, _WIDEST = 4, 63


def catalog(images: DataFrame, by: str = "ds_path") -> DataFrame:
    """One row for each sub-dataset, in path order: ds_idx, path, number of images and offset of its first global id."""
    per = images.groupBy(by).agg(F.count("*").alias("n"))
    return with_positions(per, by, out="ds_idx", sums={"offset": "n"}).select(F.col("ds_idx").cast("int").alias("ds_idx"), by, "n", "offset")


def align(channels: Sequence[DataFrame], keys: Sequence[str] = KEY, check: bool = False) -> DataFrame:
    """Rows that all channels have; with ``check``, a channel of another number of rows is an error."""
    if check:
        counts = [c.count() for c in channels]
        if len(set(counts)) > 1:
            raise ValueError(f"channels have different numbers of images: {counts}")
    out = channels[0]
    for c in channels[1:]:
        out = out.join(c, list(keys), "inner")
    return out


def with_singleton(images: DataFrame, single: DataFrame, key: str = "ds_idx") -> DataFrame:
    """A channel with one image for each sub-dataset meets all of its rows; Spark sends the side around if it is small."""
    return images.join(single, key)


def with_labels(images: DataFrame, labels: DataFrame, keys: Sequence[str] = KEY, label: str = "label") -> DataFrame:
    """Labels where they are; if any sub-dataset has rows without, no row has one. The join is one plan: whether a label is missing is
    counted from the keys, and its result is the same shuffle."""
    joined = images.join(labels, list(keys), "left")
    missing = images.select(*keys).join(labels.where(F.col(label).isNotNull()).select(*keys), list(keys), "left_anti").agg(F.count("*").alias("n"))
    return joined.withColumn(label, F.when(missing.scalar() == 0, F.col(label)))


def with_side_array(images: DataFrame, arrays: DataFrame, column: str, keys: Sequence[str] = KEY, per: Sequence[str] = ()) -> DataFrame:
    """A side array for each row, zeros at the end up to the longest one (of each group, if there is one)."""
    joined = images.join(arrays, list(keys))
    longest = joined.groupBy(*per).agg(F.max(F.size(column)).alias("__n")) if per else joined.agg(F.max(F.size(column)).alias("__n"))
    joined = joined.join(longest, list(per)) if per else joined.withColumn("__n", longest.scalar())
    return joined.withColumn(column, padded(F.col(column), F.col("__n"))).drop("__n")


def resolve_ids(ids: DataFrame, parts: DataFrame, gid: str = "global_idx") -> DataFrame:
    """The sub-dataset (or group, or child) whose range holds each id, and the id's place in it.

    ``parts`` is a catalog, a row for each sub-dataset, and may have as many rows as there are; they meet the ids by an equi-join. A part of
    n ids is put in bins of the least power of sixteen that holds n, of which it touches two at most, and as parts do not overlap and have
    over a sixteenth of a bin, it holds 18 at most. An id looks in its bin of each width that occurs, of which there are 17 at most. Few parts go to every task, many
    are shuffled with the ids. Ids outside of all ranges, and null ids, are left out.
    """
    names = [x for x in parts.columns if x not in ("offset", "n")]
    bits = F.when(F.col("__n") <= 1, 0).otherwise(F.length(F.bin(F.col("__n") - 1)))
    level = F.least(F.ceil(bits / _STEP) * _STEP, F.lit(_WIDEST)).cast("int")
    c = parts.where("n > 0").select(F.col("offset").alias("__offset"), F.col("n").alias("__n"), *[F.col(x).alias(f"__{x}") for x in names]).withColumn("__level", level)
    ends = F.array_distinct(F.array(F.expr("shiftright(__offset, __level)"), F.expr("shiftright(__offset + __n - 1, __level)")))
    c = c.withColumn("__bin", F.explode(ends))
    counts = {r[0]: r[1] for r in c.groupBy("__level").count().collect()}  # 17 numbers at most
    widths = sorted(counts) or [0]
    c = F.broadcast(c) if sum(counts.values()) <= MAX_SENT else c.hint("merge")
    at = F.array(*[F.struct(F.lit(w).alias("w"), F.shiftright(F.col(gid).cast("bigint"), w).alias("b")) for w in widths])
    rows = ids.withColumn("__at", F.explode(at)).withColumns({"__w": F.col("__at.w"), "__b": F.col("__at.b")}).drop("__at")
    within = (F.col(gid) >= F.col("__offset")) & (F.col(gid) < F.col("__offset") + F.col("__n"))
    met = rows.join(c, (F.col("__w") == F.col("__level")) & (F.col("__b") == F.col("__bin")) & within)
    return met.select(*ids.columns, *[F.col(f"__{x}").alias(x) for x in names], (F.col(gid) - F.col("__offset")).alias("im_idx"))


def inspected(ids: DataFrame, catalogue: DataFrame, gid: str = "global_idx") -> DataFrame:
    """For each id its place in its sub-dataset, the sub-dataset's number and path."""
    return resolve_ids(ids, catalogue, gid).select(gid, "im_idx", "ds_idx", "ds_path")
