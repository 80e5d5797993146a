"""Unions of stores and of row sets, projections of lists of outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators import rowset


def union_all(parts: Sequence[DataFrame], mark: str | None = None) -> DataFrame:
    """Bag union by name; ``mark`` numbers the parts."""
    tagged = [p.withColumn(mark, F.lit(i)) if mark else p for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def union_last_wins(stores: Sequence[DataFrame], path: str) -> DataFrame:
    """Stores one after the other; of rows with one path the last store's stay, at the first one's place (``store_no``)."""
    both = union_all(stores, "__s")
    ends = both.groupBy(path).agg(F.max("__s").alias("__last"), F.min("__s").alias("store_no"))
    return both.join(ends, path).where(F.col("__s") == F.col("__last")).drop("__s", "__last")


def routed(stores: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Channels that lie in different stores, joined by row."""
    if len(set(stores)) != len(stores):
        raise ValueError("a channel has two stores")
    return reduce(lambda a, b: a.join(b, list(keys)), stores.values())


def grouped(stores: Mapping[str, DataFrame]) -> DataFrame:
    """Each store is a group."""
    return union_all([s.withColumn("grp", F.lit(g)) for g, s in stores.items()])


def concat_with_proportions(parts: Sequence[DataFrame], proportions: Sequence[float], key: str) -> DataFrame:
    """Each part gives max(1, int(n * p + 0.5)) rows: copies in whole, the rest in hash order."""
    out = []
    for i, (part, p) in enumerate(zip(parts, proportions)):
        n = part.count()
        order = rowset.shuffled(part, key)
        out.append(rowset.tiled(order, max(1, int(n * p + 0.5)), n).withColumn("part", F.lit(i)))
    return union_all(out)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def first_of_each(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values at their first position."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def multiplied(df: DataFrame, columns: Sequence[str], times: int | Mapping[int, int]) -> DataFrame:
    """Output columns repeated: the whole list, or each by its own number (0 leaves it out); copies get numbered names."""
    if isinstance(times, int):
        picks = [(c, k) for k in range(times) for c in columns]
    else:
        picks = [(c, k) for i, c in enumerate(columns) for k in range(times.get(i, 1))]
    used = set(columns)
    return df.select(*[c for c in df.columns if c not in used], *[F.col(c).alias(c if k == 0 else f"{c}_{k}") for c, k in picks])


def with_weight_map(df: DataFrame, column: str, post, weight) -> DataFrame:
    """Post-processed values with the weight map of the unprocessed ones behind them."""
    return df.withColumn(column, F.concat(post(F.col(column)), weight(F.col(column))))


def concat_batches(parts: Sequence[DataFrame], counts: Sequence[int], batch: str = "batch") -> DataFrame:
    """Batched parts one after the other: a part's batches keep their rows and follow those of the parts before it.

    ``counts`` are the numbers of batches. Parts must have the same columns; ``part`` says which one a batch is of.
    """
    if len({tuple(sorted(p.columns)) for p in parts}) > 1:
        raise ValueError("parts have different columns")
    before = [sum(counts[:i]) for i in range(len(parts))]
    out = [p.withColumns({batch: (F.col(batch) + b).cast("bigint"), "part": F.lit(i)}) for i, (p, b) in enumerate(zip(parts, before))]
    return union_all(out)


def repeated(n: int, value) -> list:
    """A value for each of n: one, or a list of one, stands for all."""
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if len(values) not in (1, n):
        raise ValueError(f"{len(values)} values for {n}")
    return values * n if len(values) == 1 else values


def flattened(parts: Sequence) -> list[DataFrame]:
    """Parts of parts, one after the other."""
    return [p for x in parts for p in (flattened(x) if isinstance(x, (list, tuple)) else [x])]


def batch_plan(batches: DataFrame, proportions: Sequence[float] | float, n_parts: int, weight: str | None = None, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """An epoch of concatenated parts as (pos, batch, part), of a table with a row for each batch of each part.

    A part of n batches gives max(1, int(n * p + 0.5)) of them, none at p = 0: with a weight drawn with replacement, else in whole copies and a
    rest in hash order. The parts follow each other, or are shuffled together.
    """
    counts = {r[0]: r[1] for r in batches.groupBy("part").count().collect()}  # a row a part
    plans, before = [], 0
    for i, p in enumerate(repeated(n_parts, proportions)):
        n = counts.get(i, 0)
        if p <= 0 or not n:
            continue
        size, own = max(1, int(n * p + 0.5)), batches.where(F.col("part") == i)
        if weight is not None:
            taken = rowset.resampled(own, weight, size, "batch", seed).withColumn("pos", F.col("draw"))
        else:
            taken = rowset.tiled(rowset.shuffled(own, "batch", seed), size, n)
        plans.append(taken.select((F.col("pos") + before).cast("bigint").alias("pos"), F.col("batch").cast("bigint").alias("batch"), "part"))
        before += size
    if not plans:
        return batches.select(F.lit(0).cast("bigint").alias("pos"), F.col("batch").cast("bigint").alias("batch"), "part").limit(0)
    plan = union_all(plans)
    return rowset.shuffled(plan.withColumnRenamed("pos", "slot"), "slot", seed).select("pos", "batch", "part") if shuffle else plan


def transposed(items: Column, fields: Sequence[str]) -> Column:
    """An array of structs as a struct of arrays."""
    field = lambda f: F.transform(items, lambda x: x[f]).alias(f)
    return F.struct(*map(field, fields))
