"""Positions keep every row beside any columns, however many partitions there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import rowset, union
from lattiq.operators.positions import hash_order, with_positions

SF = "/root/testdata/sf0.1"


@pytest.fixture(params=[(1, "true"), (24, "false")], ids=lambda p: f"{p[0]}-adaptive-{p[1]}")
def partitions(request, spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    for k, v in zip(old, (*request.param, "1m")):
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def hashes(ids):
    return [int(i) * 2654435761 % 4294967296 for i in ids]


def in_order(ids):
    return [i for _, i in sorted(zip(hashes(ids), ids))]


def test_shuffled(spark, partitions):
    docs = documents(spark)
    ids = [r[0] for r in docs.select("doc_id").collect()]
    got = rowset.shuffled(docs, "doc_id").select("pos", "doc_id", F.length("text").alias("n"), "lang").collect()
    assert [r.doc_id for r in sorted(got)] == in_order(ids) and [r.pos for r in sorted(got)] == list(range(len(ids)))


def test_positions_of_many_rows_and_columns(spark, partitions):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("id", F.monotonically_increasing_id())
    order = ["l_shipdate", "l_comment" if "l_comment" in lines.columns else "l_extendedprice", "id"]
    got = with_positions(lines, *order).select("pos", *order, "l_tax", "l_quantity").toPandas().sort_values("pos")
    assert (got["pos"].to_numpy() == np.arange(600_000)).all()
    assert got.reset_index(drop=True)["id"].equals(got.sort_values(order).reset_index(drop=True)["id"])


def test_split_picked_void_and_parts(spark, partitions):
    docs = documents(spark)
    rows = {r.doc_id: (r.lang, r.n_chars) for r in docs.select("doc_id", "lang", "n_chars").collect()}
    order = in_order(rows)
    train, test = rowset.split(docs, "doc_id", 0.2)
    assert {r.doc_id for r in test.select("doc_id", "text").collect()} == set(order[:2000])
    assert sorted(r.doc_id for r in train.select("doc_id", "text").collect()) == sorted(order[2000:])
    picked = rowset.picked(docs, "doc_id", 0.5, "lang")
    want = []
    for lang in {v[0] for v in rows.values()}:
        of = [i for i in order if rows[i][0] == lang]
        want += of[: int(len(of) * 0.5 + 0.5)]
    assert sorted(r.doc_id for r in picked.select("doc_id", "text", "copy").collect()) == sorted(want)
    short = [i for i in order if rows[i][1] < 300]
    most = int(0.1 / 0.9 * (len(rows) - len(short)))
    void = rowset.with_void_proportion(docs, "doc_id", F.col("n_chars") < 300, 0.0, 0.1).select("doc_id", "text", "n_chars").collect()
    assert sorted(r.doc_id for r in void if r.n_chars < 300) == sorted(short[:most]) and sum(r.n_chars >= 300 for r in void) == len(rows) - len(short)
    parts = union.concat_with_proportions([docs, docs.where("lang = 'en'")], [0.1, 2.5], "doc_id").select("part", "pos", "doc_id", "text").collect()
    english = [i for i in order if rows[i][0] == "en"]
    assert [r.doc_id for r in sorted(parts) if r.part == 0] == order[:1000]
    n = int(len(english) * 2.5 + 0.5)
    assert [r.doc_id for r in sorted(parts) if r.part == 1] == (english * 3)[:n]


def test_draws_and_batches(spark, partitions):
    docs = documents(spark)
    order = in_order([r[0] for r in docs.select("doc_id").collect()])
    drawn = rowset.resampled(docs.withColumn("w", F.col("n_chars").cast("double")), "w", 5000, "doc_id").select("draw", "doc_id", "text").collect()
    assert sorted(r.draw for r in drawn) == list(range(5000))
    weights = dict(docs.select("doc_id", F.col("n_chars").cast("double")).collect())
    ends = np.cumsum([weights[i] for i in order]) / sum(weights.values()) * 5000
    points = [k + hashes([k + 1])[0] / 4294967296 for k in range(5000)]
    assert [r.doc_id for r in sorted(drawn)] == [order[k] for k in np.searchsorted(ends, points, side="right")]
    batches = rowset.batched(rowset.shuffled(docs, "doc_id"), 33, 10_000, rowset.CONSTANT_SIZE).select("batch", "pos", "doc_id", "text").collect()
    assert len(batches) == 304 * 33 and {r.doc_id for r in batches if r.batch == 303} == set(order[-33:])


def test_odd_orders(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("a", 4), (None, 5)], "k string, pos_ long")
    got = [r.pos_ for r in with_positions(df, "k", F.col("pos_")).orderBy("pos").collect()]
    assert got == [1, 5, 3, 4, 2]
    assert with_positions(df.limit(0), "k").count() == 0
    same = rowset.shuffled(spark.range(50).select(F.lit(7).alias("k"), "id"), "k")
    assert sorted(r.pos for r in same.collect()) == list(range(50))
    below = rowset.shuffled(spark.range(-50, 50), "id")
    assert sorted(r.pos for r in below.collect()) == list(range(100))
    none = rowset.picked(spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i long, g string"), "i", 1.0, "g")
    assert none.count() == 3
    assert rowset.resampled(spark.range(5).withColumn("w", F.lit(0.0)), "w", 10, "id").count() == 0
    assert isinstance(hash_order("id"), type(F.lit(1)))


WIDE = [0, 1, -1, 7, 2**31, 3_474_701_544, 2**32 - 1, 2**32, 2**40, 2**40 + 1, 2**63 - 1, -(2**63), -(2**40)]


def wide_hash(k, times=1, plus=0, seed=0):
    h = lambda x: ((x & 0xFFFFFFFF) * 2654435761 + (x >> 32 & 0xFFFFFFFF) * 2246822519) % 2**32
    return (h(k) * times + (plus + seed) * 2654435761) % 2**32


def test_hash_of_every_id(spark):
    import duckdb

    from lattiq.plans.base import HASH

    ids = spark.createDataFrame([(k,) for k in WIDE], "k long")
    got = dict(ids.select("k", hash_order("k")).collect())
    assert got == {k: wide_hash(k) for k in WIDE}
    assert dict(duckdb.sql(f"SELECT k, {HASH.format('k')} FROM (SELECT unnest({[str(k) for k in WIDE]}::BIGINT[]) AS k)").fetchall()) == got
    many = ids.select("k", hash_order("k", 5, 1000, F.lit(17)).alias("h")).collect()
    assert {r.k: r.h for r in many} == {k: wide_hash(k, 1000, 17, 5) for k in WIDE}
    # small keys: what key * times + plus + seed itself would give
    assert wide_hash(123 * 1000 + 17 + 5) == wide_hash(123, 1000, 17, 5)


def test_operators_take_every_id(spark):
    from lattiq.functions import draws
    from lattiq.operators import temporal, tiles

    ids = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0], float(i)) for i, k in enumerate(WIDE)], "k long, a array<double>, w double")
    order = sorted(WIDE, key=lambda k: (wide_hash(k), k))
    assert [r.k for r in rowset.shuffled(ids, "k").orderBy("pos").collect()] == order
    train, test = rowset.split(ids, "k", 0.5)
    assert {r.k for r in test.collect()} == set(order[:6]) and train.count() == 7
    assert {r.k for r in rowset.picked(ids, "k", 0.5).collect()} == set(order[:7])
    assert rowset.with_void_proportion(ids, "k", F.col("w") < 10, 0.0, 0.5).count() == 6
    assert rowset.resampled(ids, "w", 20, "k", 9).count() == 20
    drawn = ids.select("k", draws.choice(F.col("a"), 3, F.col("k"), seed=2).alias("x"), draws.choice(F.col("a"), 2, F.col("k"), replace=False).alias("y")).collect()
    assert all(r.x == [[1.0, 2.0, 3.0, 4.0][wide_hash(r.k, 3, i, 2) * 4 >> 32] for i in range(3)] and len(set(r.y)) == 2 for r in drawn)
    assert tiles.chosen_tiles(ids, "a", 2, "k").count() == 2 * len(WIDE)
    assert tiles.augmented_in_place(ids, ["a"], (2, 2), "k").count() == len(WIDE)
    c = ids.withColumn("im", F.lit(0))
    assert temporal.drawn_frame_stack(c, ["w"], F.col("k"), 1, 3, 1, 0.5, series="k", im="im").count() == len(WIDE)


def numpy_quantiles(values, ps):
    return np.quantile(np.array(values), ps, method="linear").tolist()


@pytest.mark.parametrize("kind", ["zeros", "tails", "near", "mixed", "tiny", "large"])
def test_quantiles_against_numpy(spark, kind):
    rng = np.random.default_rng(8)
    n = 20_000
    v = {
        "zeros": np.where(rng.random(n) < 0.25, 0.0, rng.normal(0, 1, n)),
        "tails": rng.standard_cauchy(n) ** 9,
        "near": 1.0 + rng.integers(0, 5000, n) * 2.0**-52,
        "mixed": np.exp(rng.normal(0, 100, n)) * rng.choice([-1, 1], n),
        "tiny": rng.random(n) * 5e-320,
        "large": rng.random(n) * 1.7e308 * rng.choice([-1, 1], n),
    }[kind]
    from lattiq.operators.positions import quantiles

    ps = [0, 0.01, 0.25, 0.5, 0.501, 0.99, 1]
    df = spark.createDataFrame(__import__("pandas").DataFrame({"v": v}))
    s = np.sort(v)
    got = quantiles(df, "v", ps)
    for p, x in zip(ps, got):
        k = p * (n - 1)
        a, b = s[int(np.floor(k))], s[int(np.ceil(k))]
        assert x == (a if a == b else a + (b - a) * (k - np.floor(k)))


def test_quantiles_of_odd_values(spark):
    from lattiq.operators.positions import quantiles

    inf = float("inf")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "v double")
    assert quantiles(one(), "v", [0.5]) == [None] and quantiles(one(None, float("nan")), "v", [0, 1]) == [None, None]
    assert quantiles(one(3.0), "v", [0, 0.3, 1]) == [3.0] * 3
    assert quantiles(one(1.0, None, float("nan"), 2.0, inf, -inf), "v", [0, 1 / 3, 0.5, 2 / 3, 1]) == pytest.approx([-inf, 1.0, 1.5, 2.0, inf])
    assert quantiles(one(inf, inf), "v", [0, 0.5]) == [inf, inf]


def test_statistics_leave_out_what_is_no_number(spark):
    from lattiq.operators import mining, stats

    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1.0,), (nan,), (3.0,), (None,), (inf,), (-inf,)], "v double")
    s = stats.distribution_summary(odd, 3).first()
    assert (s["min"], s["max"], s["mean"], s["sd"]) == (1.0, 3.0, 2.0, 1.0)
    none = stats.distribution_summary(odd.where("v is null")).collect()
    assert len(none) == 1 and set(none[0]) == {None}
    h = stats.histogram(odd, 2).collect()
    assert sorted((r.bin, r.lo, r.cnt) for r in h) == [(0, 1.0, 1), (1, 3.0, 1)]
    p = [r.p for r in mining.index_probability(odd.where("v is null or v < 5 or isnan(v)"), "v").collect()]
    assert sum(x for x in p if x is not None) == pytest.approx(1) and sum(x is None for x in p) == 2
    assert [r.p for r in mining.index_probability(odd.where("v is null"), "v").collect()] == [None]


def test_probabilities_against_plain_search(spark):
    """The three regimes, and ties at the quantiles: the power by trying each in turn."""
    from lattiq.operators import mining

    rng = np.random.default_rng(9)
    for v, quantile_max in ((rng.random(3000), 0.5), (-rng.random(3000), 0.99), (np.where(rng.random(3000) < 0.25, 0, rng.random(3000)), 0.99), (np.ones(500), 0.99), (rng.random(3000) ** 6, 0.99)):
        q0, q1 = np.quantile(v, [0.01, quantile_max])
        mid = (v > q0) & (v < q1)
        r = (v[mid] - q1) / ((q0 - q1) or 1.0)
        n_hard, n_easy, p_max = (v <= q0).sum(), (v >= q1).sum(), 10 / len(v)
        rest = mid.sum() + n_easy - r.sum()
        p_min = (1 - p_max * (n_hard + r.sum())) / rest if rest else -1
        power = 1.0
        if p_min < 0:
            p_min, target = 0.0, 1 / p_max - n_hard
            if target <= 0:
                power = 10.0
            else:
                k = next((k for k in range(91) if (r ** (1 + k * 0.1)).sum() <= target), 90)
                power = 1 + (k - 1 if k and (r ** (1 + k * 0.1)).sum() < target else k) * 0.1
        p = np.full(len(v), p_min)
        p[mid] = p_min + (p_max - p_min) * r**power
        p[v <= q0] = p_max
        got = mining.regime(spark.createDataFrame([(float(x),) for x in v], "m double"), "m", quantile_max=quantile_max)
        assert got.power == pytest.approx(power) and got.p_min == pytest.approx(p_min) and got.total == pytest.approx(p.sum())


def test_a_row_of_nearly_all_weight(spark):
    df = spark.range(5).withColumn("w", F.when(F.col("id") == 2, 1e6).otherwise(1.0))
    drawn = rowset.resampled(df, "w", 50_000, "id").select("draw", "id").collect()
    assert sorted(r.draw for r in drawn) == list(range(50_000)) and sum(r.id == 2 for r in drawn) >= 49_990
    arrays = rowset.resampled(df, "w", 50_000, "id").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in arrays}[2] >= 49_990
