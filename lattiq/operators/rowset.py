"""Row sets: which rows, in which order, how often, in which batches.

A row set is a table with a row key; order is an explicit column. Shuffles and draws order rows by an integer hash of the key, so
they can be repeated and have an equal in any SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.operators.positions import hash_cell, hash_order, with_positions

KEEP, CONSTANT_SIZE, REMOVE = "keep", "constant_size", "remove"
#: Draws of one row that are made at a time.
_POINTS = 4096


def allowed(df: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids, list(on), "left_semi")


def excluded(df: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    return df.join(ids, list(on), "left_anti")


def shuffled(df: DataFrame, key: str, seed: int = 0, out: str = "pos") -> DataFrame:
    """Positions in shuffle order."""
    h = hash_order(key, seed)
    return with_positions(df, h, key, out=out, cell=hash_cell(df, h))


def n_batches(n: int, batch_size: int, mode: str = KEEP, steps: int = 0) -> int:
    if steps > 0:
        return steps
    return max(1, n // batch_size) if mode == REMOVE else math.ceil(n / batch_size)


def batched(df: DataFrame, batch_size: int, n: int, mode: str = KEEP, pos: str = "pos") -> DataFrame:
    """Adds the batch of each position. KEEP leaves the last batch short, REMOVE drops it, and CONSTANT_SIZE makes it the
    last ``batch_size`` rows, so that it shares rows with the one before; fewer rows than a batch are then repeated."""
    b = F.floor(F.col(pos) / batch_size)
    count = n_batches(n, batch_size, mode)
    if mode == KEEP or n % batch_size == 0:
        return df.withColumn("batch", b)
    if mode == REMOVE:
        return df.withColumn("batch", b).where(F.col("batch") < count) if n >= batch_size else df.withColumn("batch", F.lit(0).cast("bigint"))
    if n < batch_size:
        return tiled(df, batch_size, n, pos).withColumn("batch", F.lit(0).cast("bigint"))
    which = F.array_compact(F.array(F.when(b < count - 1, b), F.when(F.col(pos) >= n - batch_size, F.lit(count - 1).cast("bigint"))))
    return df.withColumn("batch", F.explode(which))


def tiled(df: DataFrame, size: int, n: int, pos: str = "pos") -> DataFrame:
    """Exactly ``size`` rows: whole copies, then the first rows once more."""
    if n == 0:
        return df
    copies = -(-size // n)
    return df.withColumn(pos, F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.col(pos) + k * n))).where(F.col(pos) < size)


def stepped(df: DataFrame, steps: int, batch_size: int, n: int, pos: str = "pos") -> DataFrame:
    """Rows repeated or cut to steps * batch_size."""
    return tiled(df, steps * batch_size, n, pos)


def _ranked(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Adds ``__rank`` in hash order (within each group, if there are groups) and ``__n``, the rows that are ranked together.

    A group is dealt over ranges of the hash, and each range is numbered by a window of its own, so a group of a third of all
    rows spreads over tasks; a range's place in its group is the sum of the group's counts before it. Null is a group.
    """
    if not by:
        ranked = with_positions(df, hash_order(key), key, out="__rank", cell=hash_cell(df, hash_order(key)))
        return ranked.withColumn("__n", df.select(F.count("*")).scalar())
    names = [f"__by{i}" for i in range(len(by))]
    rows = df.withColumn("__cell", hash_cell(df, hash_order(key)))
    counts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__cell").alias("__at")).agg(F.count("*").alias("__k"))
    group = Window.partitionBy(*names)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__k").over(group.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__k").over(group)}).drop("__k")
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(hash_order(key), key)) - 1)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)] + [F.col("__cell").eqNullSafe(F.col("__at"))]
    return rows.join(counts, on).withColumn("__rank", F.col("__before") + F.col("__i")).drop("__before", "__i", "__cell", "__at", *names)


def picked(df: DataFrame, key: str, proportion: float, *by: str) -> DataFrame:
    """A proportion of the rows, of each group if there is one: whole copies, then a part without replacement."""
    if proportion <= 0:
        return df.limit(0)
    whole, part = int(proportion), proportion - int(proportion)
    ranked = _ranked(df, key, *by)
    more = (F.col("__rank") < F.floor(F.col("__n") * part + 0.5)).cast("int")
    out = ranked.withColumn("__k", F.lit(whole) + more).where("__k > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))) if whole else out.withColumn("copy", F.lit(0))
    return out.drop("__rank", "__n", "__k")


def with_void_proportion(df: DataFrame, key: str, void: Column, low: float, high: float) -> DataFrame:
    """Void rows dropped to at most, or repeated to at least, a proportion of the result; ``copy`` numbers repeats.

    Nothing changes unless both kinds are there. Which rows go or repeat is decided by hash order.
    """
    df = df.withColumn("__void", void)
    n_void, n_other = df.agg(F.count(F.when(F.col("__void"), 1)), F.count(F.when(~F.col("__void"), 1))).first()
    plain = df.withColumn("copy", F.lit(0))
    if not n_void or not n_other:
        return plain.drop("__void")
    most = None if high >= 1 else int(high / (1 - high) * n_other)
    least = 0 if low >= 1 else int(low / (1 - low) * n_other)
    voids, others = df.where("__void"), plain.where("not __void")
    if most is not None and n_void > most:
        kept = _ranked(voids, key).where(F.col("__rank") < most).drop("__rank", "__n").withColumn("copy", F.lit(0))
    elif n_void < least:
        ranked = _ranked(voids, key)
        copies = F.lit(least // n_void) + (F.col("__rank") < least % n_void).cast("int")
        kept = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__rank", "__n")
    else:
        return plain.drop("__void")
    return others.unionByName(kept.select(others.columns)).drop("__void")


def normalized_weights(df: DataFrame, weight: str, *by: str, out: str = "p") -> DataFrame:
    """Weights that sum to 1 in each group; where they sum to 0, all rows weigh the same."""
    if not by:
        total, n = df.agg(F.sum(weight), F.count("*")).first()
        return df.withColumn(out, F.col(weight) / F.lit(float(total)) if total else F.lit(1.0 / max(n, 1)))
    sums = df.groupBy(*by).agg(F.sum(weight).alias("__s"), F.count("*").alias("__n"))
    p = F.when(F.col("__s") == 0, F.lit(1.0) / F.col("__n")).otherwise(F.col(weight) / F.col("__s"))
    return df.join(sums, list(by)).withColumn(out, p).drop("__s", "__n")


def resampled(df: DataFrame, weight: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """``size`` draws with replacement. The draws are the points (k + u_k) / size of a stratified sample, u by hash, and a row
    is drawn by each point in its part of the cumulative weights: rows count their own points, so there is no join.

    Rows are dealt by ranges of a hash of the key; a range's total is its last cumulative weight, and ranges add up in their
    order, so that one row's part ends exactly where the next one's begins and no point falls between. Weights are not negative;
    a null weight is 0. If they sum to 0, no row is drawn.
    """
    h = hash_order(key, seed)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.withColumns({"__b": hash_cell(df, h), "__w": w})
    inside = Window.partitionBy("__b").orderBy(h, key)
    rows = rows.withColumns({"__to": F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__from": F.coalesce(F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    cells = rows.groupBy("__b").agg(F.max("__to").alias("__c"))
    before = Window.orderBy("__b")
    cells = cells.select("__b", F.coalesce(F.sum("__c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__o"), F.sum("__c").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("__e"))
    cells = cells.withColumn("__t", F.max("__e").over(Window.partitionBy())).select("__b", "__o", "__t")
    rows = rows.join(F.broadcast(cells), "__b").where("__t > 0")
    end, start = (F.col("__o") + F.col("__to")) / F.col("__t") * size, (F.col("__o") + F.col("__from")) / F.col("__t") * size
    u = lambda k: hash_order(k, seed + 1) / F.lit(4294967296.0)
    # a row of large weight has many points: they are made a run at a time, so no array grows with the weight
    rows = rows.withColumns({"__first": F.greatest(F.floor(start) - 1, F.lit(0)), "__last": F.floor(end)})
    rows = rows.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__last") - F.col("__first")) / _POINTS))))
    low = F.col("__first") + F.col("__run") * _POINTS
    numbers = F.sequence(low, F.least(low + (_POINTS - 1), F.col("__last")))
    points = F.filter(F.transform(numbers, lambda k: F.struct(k.alias("draw"), (k + u(k)).alias("x"))), lambda p: (p["x"] >= start) & (p["x"] < end) & (p["draw"] < size))
    return rows.withColumn("draw", F.explode(points)).withColumn("draw", F.col("draw.draw")).drop("__b", "__w", "__to", "__from", "__o", "__t", "__first", "__last", "__run")


def split(df: DataFrame, key: str, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly int(n * fraction) rows in hash order are the test."""
    ranked = _ranked(df, key)
    is_test = F.col("__rank") < F.floor(F.col("__n") * test_fraction)
    return ranked.where(~is_test).drop("__rank", "__n"), ranked.where(is_test).drop("__rank", "__n")


def split_sizes(n: int, test: float | int | None = 0.25, train: float | int | None = None) -> tuple[int, int]:
    """(train, test) rows of n: parts below 1 are shares, of which the test's is rounded up and the train's down; what is not given is the
    complement."""
    share = lambda x, f: None if x is None else f(x * n) if isinstance(x, float) else x
    n_test, n_train = share(test, math.ceil), share(train, math.floor)
    if n_test is None:
        n_test = math.ceil(0.25 * n) if n_train is None else n - n_train
    n_train = n - n_test if n_train is None else n_train
    if n_train <= 0 or n_test < 0 or n_train + n_test > n:
        raise ValueError(f"{n} rows cannot be split into {n_train} and {n_test}")
    return n_train, n_test


def apportioned(counts: DataFrame, count: str, total: int, n: int, out: str, *names: str) -> DataFrame:
    """Adds each stratum's part of ``n`` rows, of strata that have ``total`` rows: the whole part of its quota, and one more for the
    largest remainders, of equal ones for the first in the order of ``names``. The parts sum to n, however many strata there are."""
    big = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(19,0)")
    quota = counts.withColumn("__q", big(count) * big(n))
    quota = quota.withColumns({out: F.expr(f"bigint(__q div decimal({total}))"), "__rest": F.pmod("__q", big(total))})
    more = n - quota.agg(F.coalesce(F.sum(out), F.lit(0))).first()[0]
    ranked = with_positions(quota, -F.col("__rest"), *names, out="__place")
    return ranked.withColumn(out, F.col(out) + (F.col("__place") < more).cast("bigint")).drop("__q", "__rest", "__place")


def split_by_size(df: DataFrame, key: str, test: float | int | None = 0.25, train: float | int | None = None, stratum: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes in hash order; with a stratum, each is spread over the strata by largest remainders, the train first and
    the test over what that leaves. A stratum of one row, or more strata than rows on either side, is an error. Null is a stratum."""
    n = df.count()
    n_train, n_test = split_sizes(n, test, train)
    if stratum is None:
        ranked = _ranked(df, key)
        part = F.when(F.col("__rank") < n_test, 1).when(F.col("__rank") < n_test + n_train, 0)
        ranked = ranked.withColumn("__part", part)
    else:
        strata = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__m")).persist()  # a row a stratum, used several times
        n_strata, least = strata.agg(F.count("*"), F.min("__m")).first()
        if least < 2 or n_strata > min(n_train, n_test):
            raise ValueError(f"{n_strata} strata, the least of {least} rows, cannot be split into {n_train} and {n_test} rows")
        strata = apportioned(strata, "__m", n, n_train, "__train", "__s").withColumn("__left", F.col("__m") - F.col("__train"))
        strata = apportioned(strata, "__left", n - n_train, n_test, "__test", "__s")
        ranked = _ranked(df, key, stratum).join(strata, F.col(stratum).eqNullSafe(F.col("__s")))
        ranked = ranked.withColumn("__part", F.when(F.col("__rank") < F.col("__train"), 0).when(F.col("__rank") < F.col("__train") + F.col("__test"), 1))
    return tuple(ranked.where(F.col("__part") == k).select(*df.columns) for k in (0, 1))


def refilled_batch(df: DataFrame, first_batch: int, n_batches_: int, size: int, batch: str = "batch", pos: str = "pos") -> DataFrame:
    """Up to ``size`` rows of the batches from ``first_batch`` on, around the end to the start."""
    turn = F.pmod(F.col(batch) - first_batch, F.lit(n_batches_))
    return df.withColumn("__t", turn).orderBy("__t", pos).limit(size).drop("__t")
