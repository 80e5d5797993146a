"""The front door, and the small functions around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.dataset import ArrayDataset, align_names
from lattiq.functions import coords, paths
from lattiq.operators import augment, boxes, mining, rowset, stats, temporal
from lattiq.sources import files, sinks
from lattiq.streaming import epochs

SHAPE = (4, 6)


def store(spark, channel, keep=lambda s, k: True, groups=("train", "test"), n=5):
    rows = []
    for g in groups:
        for s in range(2):
            for k in range(n):
                if keep(s, k):
                    base = 100.0 * s + 10 * k + (1000 if g == "test" else 0)
                    rows.append((f"{g}/set{s}/{channel}", k, [base + x for x in range(24)], f"s{s}_f{k:05d}"))
    return spark.createDataFrame(rows, "ds_path string, im_idx long, data array<double>, label string")


@pytest.fixture(scope="module")
def opened(spark):
    stores = {"raw": store(spark, "raw"), "mask": store(spark, "mask", lambda s, k: k != 3)}
    single = spark.createDataFrame([(f"{g}/set{s}/flat", 0, [float(s)]) for g in ("train", "test") for s in range(2)], "ds_path string, im_idx long, data array<double>")
    return ArrayDataset.open(spark, {**stores, "flat": single}, SHAPE, masks=["mask"], singletons=["flat"])


def test_channels_meet(opened):
    rows = opened.df.collect()
    assert len(rows) == 2 * 2 * 4 and all(r.im_idx != 3 and r.raw == r.mask and r.flat == [float(r.ds_path[-1])] for r in rows)
    assert opened.channels == ("raw", "mask", "flat") and {r.ds_path for r in rows} == {f"{g}/set{s}" for g in ("train", "test") for s in range(2)}
    assert [(r.ds_path, r.n, r.offset) for r in opened.catalog().orderBy("ds_idx").collect()] == [("test/set0", 4, 0), ("test/set1", 4, 4), ("train/set0", 4, 8), ("train/set1", 4, 12)]


def test_groups_keep_their_order_and_numbers_follow(spark):
    ds = ArrayDataset.open(spark, {"raw": spark.createDataFrame([("train/a/raw", k, [1.0], "l") for k in range(3)], "ds_path string, im_idx long, data array<double>, label string")}, (1,))
    assert [r.global_idx for r in ds.numbered().df.orderBy("global_idx").collect()] == [0, 1, 2]
    later = store(spark, "raw", groups=("train",)).withColumn("data", F.transform("data", lambda x: -x)).where("ds_path like '%set1%'")
    both = ArrayDataset.open(spark, {"raw": [store(spark, "raw"), later]}, SHAPE)
    assert all((r.raw[5] < 0) == (r.ds_path == "train/set1") for r in both.df.collect())


def test_chained_calls(opened):
    twice = opened.select(["mask", "raw", "raw"])
    assert twice.channels == ("mask", "raw", "raw_1") and twice.masks == ("mask",) and align_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    ds = opened.select(["raw", "mask"]).where("ds_path like 'train%'").numbered()
    ids = ds.df.where("im_idx = 0").select("ds_path", "im_idx")
    assert ds.allow(ids).df.count() == 2 and ds.exclude(ids).df.count() == 6
    train, test = ds.split(0.25)
    assert (train.df.count(), test.df.count()) == (6, 2) and train.channels == ds.channels
    assert sorted(r.batch for r in ds.batched(3, rowset.REMOVE).collect()) == [0, 0, 0, 1, 1, 1]
    t = ds.tile((2, 3), mode=coords.NO_OVERLAP)
    assert t.shape == (2, 3) and t.df.count() == 8 * 4 and all(len(r.raw) == 6 for r in t.df.collect())
    b = ds.boxes(boxes.overlap_boxes(SHAPE, (2, 3), key="global_idx"), (2, 3))
    assert all(r.raw[0] - r.raw[0] // 10 * 10 >= 0 and r.raw == r.mask for r in b.df.collect())
    made = ds.with_channel("sum", lambda df: df.withColumn("sum", F.zip_with("raw", "mask", lambda x, y: x + y)))
    assert made.channels[-1] == "sum" and made.df.first()["sum"][0] == 2 * made.df.first()["raw"][0]
    kept = ds.persist()
    assert kept.df.is_cached
    kept.close()
    assert not kept.df.is_cached


def test_frames_augmentation_and_errors(opened):
    ds = opened.select(["raw", "mask"]).where("ds_path = 'train/set1'").numbered()
    f = {r.im_idx: [x[0] for x in r.raw] for r in ds.frames(1).df.collect()}
    assert f == {0: [100, 100, 110], 1: [100, 110, 120], 2: [110, 120, 140], 4: [120, 140, 140]}
    broken = {r.im_idx: [x[0] for x in r.raw] for r in ds.frames(1, labels=True).df.collect()}
    assert broken[2] == [110, 120, 120] and broken[4] == [140, 140, 140]
    p = augment.pipeline(augment.Scaling(augment.CONSTANT, center_range=(100, 100), scale_range=(2, 2)), None, augment.Geometry(flip_x=True))
    a = ds.augmented(p, "global_idx", keep="aug")
    for r in a.df.collect():
        x = (np.arange(24).reshape(SHAPE) + 10.0 * r.im_idx) / 2
        assert a.augmentation is p and r.raw == (x[:, ::-1] if r.aug.geometry.flip_x else x).ravel().tolist()
    e = {r.im_idx: r.mae for r in ds.evaluate(lambda x: x + 1, "mask", ["mae"], carried=["im_idx"]).collect()}
    assert set(e.values()) == {1.0} and len(e) == 4


def test_paths_and_stores(spark, tmp_path):
    images = store(spark, "raw").unionByName(store(spark, "mask"))
    assert sorted(r[0] for r in files.datasets_with_suffix(images, "/mask", "train").collect()) == ["train/set0/mask", "train/set1/mask"]
    assert files.contains_path(images, "test/set0/raw") and not files.contains_path(images, "test/set0")
    first = files.open_channel(images.where("ds_path like '%raw'"), 3).collect()
    assert [(r.ds_path, r.im_idx) for r in first] == [("test/set0/raw", k) for k in range(3)]
    assert images.select(paths.channel_path(F.col("ds_path"), "raw", "seg")).first()[0].endswith("/seg")
    for k in range(3):
        sinks.append_log(spark.createDataFrame([(k, k / 2)], "epoch int, loss double"), str(tmp_path / "log"))
    assert sorted(tuple(r) for r in sinks.read_log(spark, str(tmp_path / "log"), "epoch int, loss double").collect()) == [(0, 0.0), (1, 0.5), (2, 1.0)]


def test_frames_shapes_and_factors(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([7],), ([1, 2],)], "f array<int>")
    assert [r[0] for r in df.select(temporal.frames_to_augment(F.col("f"), True)).collect()] == [[1, 3, 5], [7], [1, 2]]
    assert [r[0] for r in df.select(temporal.frames_to_augment(F.col("f"), False)).collect()] == [[1, 2, 3, 4, 5], [7], [1, 2]]
    assert stats.image_shape(spark.createDataFrame([([2, 3],)] * 2, "shape array<int>")) == [2, 3]
    for bad in ([], [([2, 3],), ([3, 2],)]):
        with pytest.raises(ValueError):
            stats.image_shape(spark.createDataFrame(bad, "shape array<int>"))
    assert stats.decimation_factor(10**6, 1000) == 10.0 and stats.decimation_factor(10, 10) == 1.0 and stats.decimation_factor(10**6, 1000, most=3) == 3 and stats.decimation_factor(10**9, 10) == 5.0


def test_epochs_whose_draw_follows_metrics(spark):
    df = spark.range(200).withColumnRenamed("id", "i")
    even = lambda d: d.withColumn("metric", F.when(F.col("i") < 10, 0.01).otherwise(0.9 + F.col("i") / 10_000))
    late = lambda d: d.withColumn("metric", F.when(F.col("i") >= 190, 0.01).otherwise(0.9 + F.col("i") / 10_000))
    drawn = [[r.i for r in x.collect()] for x in epochs.mined_epochs(df, "i", [even, late], mining.Schedule(period=2, start=1, n_metrics=2), 4, 400, quantile_min=0.04)]
    share = [(sum(i < 10 for i in x) / len(x), sum(i >= 190 for i in x) / len(x)) for x in drawn]
    assert [len(x) for x in drawn] == [400] * 4 and share[0][0] < 0.1 and share[1][0] > 0.25 and share[2] == pytest.approx(share[1], abs=0.1) and share[3][1] > 0.25
    p = mining.index_probabilities(even(df).withColumn("b", -F.col("metric")), ["metric", "b"]).agg(F.sum("p_metric"), F.sum("p_b")).first()
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(1)


def test_plans_of_concatenated_batches(spark):
    from lattiq.functions import images
    from lattiq.operators import union

    b = spark.range(10).select(F.lit(0).alias("part"), F.col("id").alias("batch")).unionByName(spark.range(4).select(F.lit(1).alias("part"), F.col("id").alias("batch")))
    plan = union.batch_plan(b, [0.5, 2.0], 2, seed=1).collect()
    assert sorted(r.pos for r in plan) == list(range(13)) and len({r.batch for r in plan if r.part == 0}) == 5
    assert sorted(r.batch for r in plan if r.part == 1) == [0, 0, 1, 1, 2, 2, 3, 3]
    ordered = union.batch_plan(b, 1.0, 2, shuffle=False).orderBy("pos").collect()
    assert [r.part for r in ordered] == [0] * 10 + [1] * 4
    assert union.batch_plan(b, [0.0, 0.0], 2).count() == 0 and {r.part for r in union.batch_plan(b, [0.0, 1.0], 2).collect()} == {1}
    assert union.repeated(3, 2) == [2, 2, 2] and union.repeated(2, [1, 5]) == [1, 5] and union.repeated(2, None) == [None, None]
    with pytest.raises(ValueError):
        union.repeated(3, [1, 2])
    shapes = spark.createDataFrame([([2, 3],), ([2, 3, 4],)], "s array<int>")
    assert [r[0] for r in shapes.select(images.with_channel_axis(F.col("s"))).collect()] == [[2, 3, 1], [2, 3, 4]]
