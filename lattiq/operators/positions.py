"""Row numbers over a whole table without a window over all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of a hash, at least; a session with more shuffle partitions gets more of them.
_LEAST_CELL_BITS = 12
#: Rows sampled for each range of an order that is no hash, and the most ranges.
_SAMPLED, _MOST_CELLS = 20, 4096


#: Odd multipliers of the low and the high 32 bits of a key.
_LOW, _HIGH = 2654435761, 2246822519
_WORD = 1 << 32


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, for x from 0 to 2**32 - 1: by halves, so that no product leaves 64 bits."""
    low, high = x.bitwiseAND(F.lit(65535)), F.shiftright(x, 16)
    return (low * F.lit(factor) + (high * F.lit(factor)).bitwiseAND(F.lit(65535)) * F.lit(65536)).bitwiseAND(F.lit(_WORD - 1))


def hash_order(key: Column | str, seed: int = 0, times: Column | int = 1, plus: Column | None = None) -> Column:
    """A multiplicative hash (0 to 2**32 - 1) of ``key * times + plus + seed``, the same in any SQL: the library's shuffle order.

    Every 64-bit key has one, negative ones too: the low and the high 32 bits are multiplied each by its own number, and sums
    are modulo 2**32, so nothing overflows. ``times`` and ``plus`` are from 0 to 2**31 - 1. A null key has none.
    """
    key = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    word = F.lit(_WORD - 1)
    h = _times(key.bitwiseAND(word), _LOW) + _times(F.shiftright(key, 32).bitwiseAND(word), _HIGH)
    if not (isinstance(times, int) and times == 1):
        h = h.bitwiseAND(word) * (F.lit(times) if isinstance(times, int) else times)
    if plus is not None:
        h = h.bitwiseAND(word) + _times(plus.cast("bigint"), _LOW)
    return (h + F.lit(seed * _LOW % _WORD)).bitwiseAND(word)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_cell(df: DataFrame, hashed: Column) -> Column:
    """The range of a ``hash_order`` value: its top bits, four ranges a shuffle partition at least."""
    bits = min(32, max(_LEAST_CELL_BITS, math.ceil(math.log2(4 * _partitions(df)))))
    return F.floor(hashed / F.lit(float(1 << (32 - bits)))).cast("bigint")


def range_cell(df: DataFrame, *order: Column | str) -> Column:
    """The range of a row's key among ranges of nearly equal size. The bounds are literals, quantiles of a sample of keys (those
    with the smallest hashes), so however often the column is evaluated, and beside whatever columns, a row keeps its range."""
    n = min(_MOST_CELLS, max(16, 4 * _partitions(df)))
    keys = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    names = keys.columns
    sample = keys.orderBy(F.xxhash64(*names)).limit(_SAMPLED * n).orderBy(*names).collect()  # a bounded number of keys
    picked = sorted({round(len(sample) * i / n) for i in range(1, n)} - {0, len(sample)})
    if not picked:
        return F.lit(0).cast("bigint")
    struct = lambda values: F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(names, values)])
    bounds = [struct(sample[i]) for i in picked]
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    step = max(1, math.isqrt(len(bounds)))  # two short searches
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    coarse = below(F.array(*bounds[::step]))
    fine = below(F.slice(F.array(*bounds), F.greatest((coarse - 1) * step + 1, F.lit(1)), F.lit(step)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine).cast("bigint")


def with_positions(df: DataFrame, *order: Column | str, out: str = "pos", cell: Column | None = None, sums: Mapping[str, str] | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the given ascending order; nulls come first, and ties are numbered in any order. ``sums`` (new column: column
    of integers) adds what the rows before have together, beside the position and in the same order.

    Rows are dealt by ``cell``, a function of the row that never falls as the order rises: top bits of a hash, or else ranges
    by literal bounds. A cell's rows are numbered by a window of their own, and set off by the counts of the cells before,
    the only window without a partition: it has a row for each cell. An empty table stays empty.
    """
    cell = range_cell(df, *order) if cell is None else cell
    names = [out, *(sums or {})]
    values = [F.lit(1), *map(F.col, (sums or {}).values())]
    rows = df.withColumn("__cell", cell)
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__cell").agg(*[F.sum(v).alias(f"__n{i}") for i, v in enumerate(values)])
    offsets = offsets.select(F.col("__cell").alias("__at"), *[F.coalesce(F.sum(f"__n{i}").over(before), F.lit(0)).alias(f"__before{i}") for i in range(len(values))])
    inside = Window.partitionBy("__cell").orderBy(*order)
    own = [F.row_number().over(inside) - 1, *[F.coalesce(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for v in values[1:]]]
    numbered = rows.withColumns({f"__i{i}": c for i, c in enumerate(own)})
    met = numbered.join(F.broadcast(offsets), F.col("__cell").eqNullSafe(F.col("__at")))
    met = met.withColumns({c: F.col(f"__before{i}") + F.col(f"__i{i}") for i, c in enumerate(names)})
    return met.drop("__at", "__cell", *[f"__{x}{i}" for i in range(len(values)) for x in ("i", "before")])


#: Bins of a range in a pass of ``quantiles``, and the rows of a range whose distinct values are fetched.
_BINS, _FEW = 1024, 1024


def _height(v: Column) -> Column:
    """A number that rises with v over all of its magnitudes: its logarithm, with the sign's side."""
    return F.when(v > 0, F.ln(v) + F.lit(745.0)).when(v < 0, -(F.ln(-v) + F.lit(745.0))).otherwise(F.lit(0.0))


def _height_of(v: float) -> float:
    return math.copysign(math.log(abs(v)) + 745.0, v) if v else 0.0


def quantiles(df: DataFrame, column: str, ps: Sequence[float]) -> list[float]:
    """Exact quantiles (0 to 1) of a column's values, interpolated between neighbours. Nulls and NaN do not count, infinite values
    are the least and the greatest; None without values.

    All wanted ranks are found together. A pass counts the rows of the ranges that hold a wanted rank in bins, and a bin with its rank
    becomes the next range, from its smallest value to its greatest. Bins are even in the logarithm while a range spans magnitudes, in the value
    then. A range of one value is done, and one of few rows is fetched as counted values. So a pass brings at most ``_BINS`` counts a rank
    to the driver, whatever the rows, and a value that many rows share ends a range at once.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    finite = F.when(F.abs(v) < F.lit(math.inf), v)
    below, n, lo, hi, inside = values.agg(F.count(F.when(v == F.lit(-math.inf), 1)), F.count("*"), F.min(finite), F.max(finite), F.count(finite)).first()
    if not n:
        return [None] * len(ps)
    wanted = sorted({k for p in ps for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found = {r: -math.inf if r < below else math.inf for r in wanted if not below <= r < below + inside}
    #: (least, greatest, rows, rows before) of ranges with wanted ranks
    ranges = [(lo, hi, inside, below)] if len(found) < len(wanted) else []
    while ranges:
        found.update({r: a for a, b, k, before in ranges if a == b for r in wanted if before <= r < before + k})
        ranges = [x for x in ranges if x[0] < x[1]]
        few, many = [x for x in ranges if x[2] <= _FEW], [x for x in ranges if x[2] > _FEW]
        if few:
            held = F.lit(False)
            for a, b, *_ in few:
                held = held | v.between(a, b)
            counted = sorted((r[0], r[1]) for r in values.where(held).groupBy("v").count().collect())
            for a, b, _, before in few:
                for x, k in counted:
                    if a <= x <= b:
                        found.update({r: x for r in wanted if before <= r < before + k})
                        before += k
        ranges = _refined(values, many, wanted) if many else []
    at = lambda x: found[math.floor(x)] if found[math.floor(x)] == found[math.ceil(x)] else found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x))
    return [at(p * (n - 1)) for p in ps]


def _refined(values: DataFrame, ranges: list[tuple], wanted: list[int]) -> list[tuple]:
    """The bins of the ranges that hold a wanted rank, as ranges."""
    v, cell = F.col("v"), F.lit(None).cast("int")
    for i, (a, b, *_) in enumerate(ranges):
        far = a <= 0 <= b or max(abs(a), abs(b)) > 1e3 * min(abs(a), abs(b))
        x, low, high = (_height(v), _height_of(a), _height_of(b)) if far else (v, a, b)
        width = max((high - low) / _BINS, 5e-324)
        k = F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(_BINS - 1))
        # the range's ends have bins of their own, so that a range always gets shorter
        k = F.when(v <= F.lit(a), 0).when(v >= F.lit(b), _BINS + 1).otherwise(k + 1)
        cell = F.when(v.between(a, b), (k + i * (_BINS + 2)).cast("int")).otherwise(cell)
    bins = values.select("v", cell.alias("c")).where("c is not null").groupBy("c").agg(F.min("v"), F.max("v"), F.count("*")).collect()
    out, at, before = [], -1, 0
    for c, a, b, k in sorted(bins):
        if c // (_BINS + 2) != at:
            at, before = c // (_BINS + 2), ranges[c // (_BINS + 2)][3]
        if any(before <= r < before + k for r in wanted):
            out.append((a, b, k, before))
        before += k
    return out
