"""Arrays of any rank as flat columns in row order: index arithmetic over shapes and starts that are constants or columns of a row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Axes = Sequence[int] | Column
"""A number for each axis: constants, or an array column."""


def let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def at(axes: Axes, k: int) -> Column:
    """The number of axis k."""
    return F.element_at(axes, k + 1).cast("int") if isinstance(axes, Column) else (axes[k] if isinstance(axes[k], Column) else F.lit(int(axes[k])))


def size(axes: Axes, rank: int, first: int = 0) -> Column:
    """The product of the axes from ``first`` on: how far apart neighbours on the axis before it lie."""
    if not isinstance(axes, Column) and not any(isinstance(a, Column) for a in axes):
        return F.lit(math.prod(int(a) for a in axes[first:]))
    out = F.lit(1)
    for k in range(first, rank):
        out = out * at(axes, k)
    return out


def crop(data: Column, shape: Axes, target: Sequence[int], start: Axes | None = None, clamp: bool = True) -> Column:
    """A box of an array: ``target`` values on each axis from ``start`` on. A start is moved so that the box stays inside; a box larger
    than the array is null.

    The box is gathered in runs along the last axis that is cut; axes after it are whole and go along.
    """
    rank = len(target)
    start = [0] * rank if start is None else start
    begin = [F.least(F.greatest(at(start, k), F.lit(0)), at(shape, k) - target[k]) if clamp else at(start, k) for k in range(rank)]
    whole = rank  # axes from here on are taken whole, if that is known
    while whole > 1 and not isinstance(shape, Column) and not isinstance(shape[whole - 1], Column) and shape[whole - 1] == target[whole - 1]:
        whole -= 1
    run = math.prod(target[whole - 1 :])
    rows = math.prod(target[: whole - 1])

    def first(i: Column) -> Column:
        """Where the i-th run begins."""
        out = begin[whole - 1] * size(shape, rank, whole)
        below = 1
        for k in range(whole - 2, -1, -1):
            step = F.floor(i / below) % target[k] if k else F.floor(i / below)
            out = out + (begin[k] + step) * size(shape, rank, k + 1)
            below *= target[k]
        return out

    if rows == 1:
        out = F.slice(data, (first(F.lit(0)) + 1).cast("int"), F.lit(run))
    else:
        out = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(data, (first(i) + 1).cast("int"), F.lit(run))))
    fits = F.lit(True)
    for k in range(rank):
        fits = fits & (at(shape, k) >= target[k])
    return F.when(fits, out)


def gathered(data: Column, target: Sequence[int], source) -> Column:
    """An array of shape ``target`` whose value at index (i0, i1, ...) is data's at flat position source(i0, i1, ...)."""

    def one(i: Column) -> Column:
        below, index = 1, []
        for k in range(len(target) - 1, -1, -1):
            index.append((F.floor(i / below) % target[k]).cast("int"))
            below *= target[k]
        return F.element_at(data, (source(*index[::-1]) + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(math.prod(target) - 1)), one)


def flat_index(index: Sequence[Column], shape: Axes) -> Column:
    out = F.lit(0)
    for k, i in enumerate(index):
        out = out * at(shape, k) + i
    return out


def flipped(data: Column, shape: Sequence[int], axes: Sequence[int]) -> Column:
    """Mirrored along the axes."""
    mirror = lambda *i: flat_index([shape[k] - 1 - x if k in axes else x for k, x in enumerate(i)], shape)
    return gathered(data, shape, mirror)


def transposed(data: Column, shape: Sequence[int], order: Sequence[int]) -> Column:
    """Axis k of the result is axis order[k] of the array."""
    back = [list(order).index(k) for k in range(len(shape))]
    return gathered(data, [shape[k] for k in order], lambda *i: flat_index([i[back[k]] for k in range(len(shape))], shape))


def crop_by_channel(data: Column, shape: Sequence[int], target: Sequence[int], starts: Column) -> Column:
    """A box of its own for each channel: ``shape`` and ``target`` are without the channels, which are the last axis, one for each item
    of ``starts`` (an array of starts)."""
    n = F.size(starts)

    def one(i: Column) -> Column:
        c, rest, below, place = i % n, F.floor(i / n), 1, F.lit(0)
        for k in range(len(target) - 1, -1, -1):
            x = F.floor(rest / below) % target[k] + F.get(F.get(starts, c.cast("int")), F.lit(k))
            place = place + x * math.prod(shape[k + 1 :])
            below *= target[k]
        return F.element_at(data, (place * n + c + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), n * math.prod(target) - 1), one)
