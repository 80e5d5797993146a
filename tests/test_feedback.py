"""Weights that follow a stream of metrics, tiles from SQL, ids among very many parts."""

import bisect
import itertools
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lattiq.functions import table_functions
from lattiq.operators import align, mining, tiles
from lattiq.operators.positions import with_positions
from lattiq.streaming import feedback

SCHEMA = "id long, epoch long, metrics array<double>"


def arrives(spark, root, *rows):
    spark.createDataFrame([(i, e, [float(x) for x in m]) for i, e, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run(spark, root, schedule):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feedback.follow(stream, ["id"], schedule, f"{root}/out", f"{root}/state", quantile_max=0.5)


def newest(spark, root):
    return {r.id: (r.epoch, r.metrics) for r in feedback.snapshot(spark, f"{root}/out").collect()}


def test_state_is_kept_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    epochs = [[(i, e, (rng.random(), rng.random())) for i in range(30)] for e in range(3)]
    late = [(3, 0, (9, 9)), (4, 2, (0.5, 0.5))]  # an older epoch changes nothing, a further part of the newest one joins its mean
    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    schedule = mining.Schedule(period=2, start=0, n_metrics=2)
    for root in (once, twice):
        arrives(spark, root, *epochs[0])
        arrives(spark, root, *epochs[1])
        if root == twice:
            run(spark, root, schedule)
            assert newest(spark, root) == {i: (1, list(m)) for i, _, m in epochs[1]}
        arrives(spark, root, *epochs[2], *late)
        run(spark, root, schedule)
    assert newest(spark, once) == newest(spark, twice)
    want = {i: (2, list(m)) for i, _, m in epochs[2]}
    want[4] = (2, [(x + 0.5) / 2 for x in want[4][1]])
    assert {i: (e, [pytest.approx(x) for x in m]) for i, (e, m) in want.items()} == newest(spark, once)
    for epoch in (0, 2):
        a, b = ({r.id: r.p for r in feedback.weights(spark, f"{r}/out", epoch).collect()} for r in (once, twice))
        assert a == b and sum(a.values()) == pytest.approx(1)
    with pytest.raises(Exception):
        feedback.weights(spark, f"{once}/out", 1)
    # epoch 2 is the second that is due: the second metric, low values first
    p = {r.id: r.p for r in feedback.weights(spark, f"{once}/out", 2).collect()}
    hardest = min(want, key=lambda i: want[i][1][1])
    assert p[hardest] == max(p.values())


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    arrives(spark, root, *[(i, 0, (i, 0)) for i in range(10)])
    run(spark, root, mining.Schedule(period=1))
    before = newest(spark, root)
    shutil.rmtree(f"{root}/state/commits")  # as if the driver had died after the output of the batch
    run(spark, root, mining.Schedule(period=1))
    assert newest(spark, root) == before


def test_ids_among_very_many_parts(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 1, 1, 2, 3, 50]) for _ in range(100_000)]
    sizes[777], sizes[50_000] = 40_000_000, 0
    starts, at = [], 0
    for n in sizes:
        starts.append(at)
        at += n
    parts = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(zip(sizes, starts))], "part int, n long, offset long")
    ids = [rng.randrange(-5, at + 5) for _ in range(3000)] + [rng.randrange(0, 5000) for _ in range(3000)] + [starts[777], starts[777] + 39_999_999, starts[50_000], at - 1, at, -1]
    df = spark.createDataFrame([(g,) for g in ids] + [(None,)], "global_idx long")
    got = sorted((r.global_idx, r.part, r.im_idx) for r in align.resolve_ids(df, parts).collect())
    want = []
    for g in ids:
        if 0 <= g < at:
            k = bisect.bisect_right(starts, g) - 1
            while sizes[k] == 0:
                k -= 1
            want.append((g, k, g - starts[k]))
    assert got == sorted(want)
    plan = align.resolve_ids(df, parts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert align.resolve_ids(df, parts.limit(0)).count() == 0


def test_labels_are_all_or_none(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ds_idx int, v string")
    every = spark.createDataFrame([(1, "l1"), (2, "l2"), (9, "l9")], "ds_idx int, label string")
    labels = lambda t: sorted((r.v, r.label) for r in align.with_labels(a, t, ["ds_idx"]).collect())
    assert labels(every) == [("x", "l1"), ("y", "l2")]
    assert labels(every.where("ds_idx <> 2")) == labels(every.withColumn("label", F.when(F.col("ds_idx") == 1, "l1"))) == [("x", None), ("y", None)]
    assert align.with_labels(a.limit(0), every, ["ds_idx"]).count() == 0


def test_tiles_from_sql_are_those_of_the_library(spark):
    table_functions.register(spark)
    cells = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: (F.col("id") * 100 + j).cast("double"))
    df = spark.range(4).select("id", F.when(F.col("id") < 3, cells).alias("data"))
    sql = spark.sql("SELECT id, t.* FROM {df} d, LATERAL tile(d.data, array(5, 6), array(2, 3), 'allow', 1) t", df=df).collect()
    lib = df.where("id < 3").transform(tiles.tile_function(["data"], (5, 6), (2, 3))).collect()
    assert sorted((r.id, r.tile_id, r.start, r.data) for r in sql) == sorted((r.id, r.tile_id, [r.tile_y, r.tile_x], r.data) for r in lib)
    volume = spark.sql("SELECT t.* FROM {df} d, LATERAL tile(d.data, array(5, 3, 2), array(5, 2, 2), 'force', 1) t WHERE id = 0", df=df).collect()
    assert [(r.start, len(r.data)) for r in sorted(volume)] == [([0, 0, 0], 20), ([0, 1, 0], 20)]
    for bad, why in (("'slide', 1", "overlap mode"), ("'allow', 1", "must be an array")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {{df}} d, LATERAL tile({'d.id' if 'array' in why else 'd.data'}, array(5, 6), array(2, 3), {bad}) t", df=df).collect()


def test_very_many_parts_are_shuffled_and_not_sent(spark):
    """Parts that a file holds in a few bytes each are sent to no task, whatever Spark takes for their size; few ones are."""
    n = 1 + F.col("id") % 7 + F.when(F.col("id") % 500 == 0, 100_000).otherwise(0)
    parts = with_positions(spark.range(20_000).select("id", n.alias("n")), "id", out="part", sums={"offset": "n"})
    ids = spark.range(0, 3_000_000, 1000).withColumnRenamed("id", "global_idx")

    def joins(p):
        met = align.resolve_ids(ids, p)
        got = met.collect()
        final = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # what remains are the sums of the cells, a row each
        return [x for x in final.splitlines() if "Join" in x and "global_idx" in x or "Join" in x and "__w" in x], got

    many, got = joins(parts)
    assert many and all("SortMergeJoin" in x for x in many)
    sizes = [1 + i % 7 + (100_000 if i % 500 == 0 else 0) for i in range(20_000)]
    starts = [0, *itertools.accumulate(sizes)]
    want = [(g, bisect.bisect_right(starts, g) - 1) for g in range(0, 3_000_000, 1000)]
    assert sorted((r.global_idx, r.part, r.im_idx) for r in got) == [(g, k, g - starts[k]) for g, k in want if k < 20_000]
    few, _ = joins(parts.where("id < 50"))
    assert few and all("BroadcastHashJoin" in x for x in few)


def test_catalog_and_sums_by_cells(spark):
    rows = [("b", 3), ("a", 1), (None, 2), ("d", 4), ("c", 1)]
    df = spark.createDataFrame([(p,) for p, k in rows for _ in range(k)], "ds_path string")
    assert [tuple(r) for r in align.catalog(df).orderBy("ds_idx").collect()] == [(0, None, 2, 0), (1, "a", 1, 2), (2, "b", 3, 3), (3, "c", 1, 6), (4, "d", 4, 7)]
    assert align.catalog(df.limit(0)).count() == 0
    # a window over a whole table holds a row for each cell, never one for each path
    plan = align.catalog(spark.range(1000).select(F.col("id").cast("string").alias("ds_path")))._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.splitlines() if "Window [" in x and "ds_path" in x and "__cell" not in x]
    assert not whole


def test_newest_metrics_are_merged_without_a_call_for_each_sample(spark, tmp_path, monkeypatch):
    """Sums of parts over batches, null metrics as NaN, and no Python state that is called for each key."""
    monkeypatch.setattr(feedback.Newest, "handleInputRows", lambda *a: 1 / 0)
    root = str(tmp_path)
    arrives(spark, root, (1, 0, (1, 2)), (1, 0, (3, 4)), (2, 1, (5, 6)))
    run(spark, root, mining.Schedule(period=1))
    arrives(spark, root, (1, 0, (5, 6)), (2, 0, (9, 9)), (3, 0, (7, 7)))
    run(spark, root, mining.Schedule(period=1))
    assert newest(spark, root) == {1: (0, [3.0, 4.0]), 2: (1, [5.0, 6.0]), 3: (0, [7.0, 7.0])}
    rows = spark.createDataFrame([(1, 0, 1, [None, 2.0]), (1, 0, 1, [1.0, 2.0]), (2, None, 1, [1.0]), (3, 5, 1, [])], "id long, epoch long, n long, sums array<double>")
    got = {r.id: (r.epoch, r.n, str(r.metrics)) for r in feedback.newest_of(rows, ["id"]).collect()}
    assert got == {1: (0, 2, "[nan, 2.0]"), 3: (5, 1, "[]")}
