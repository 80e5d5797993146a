"""The data source: what is planned, read, pushed, written, and left after a failure."""

import os

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lattiq.functions import tiff
from lattiq.sources import connector


@pytest.fixture(scope="module")
def source(spark):
    connector.register(spark)
    return lambda path, **options: spark.read.format("lattiq").options(**options).load(str(path))


def images(spark, n, sets=2, shape=(3, 4)):
    size = int(np.prod(shape))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (F.col("id") * 100 + j).cast("double"))
    return spark.range(n).select(F.concat(F.lit("exp/s"), F.col("id") % sets, F.lit("/raw")).alias("ds_path"), F.col("id").alias("im_idx"), F.array(*map(F.lit, shape)).alias("shape"), cells.alias("data"))


def visible(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


@pytest.mark.parametrize("extension", ["npy", "tif"])
@pytest.mark.parametrize("shape", [(3, 4), (2, 3, 2)])
def test_a_file_for_each_image(spark, source, tmp_path, extension, shape):
    images(spark, 25, shape=shape).write.format("lattiq").option("extension", extension).option("dtype", "float64").mode("append").save(str(tmp_path))
    assert len(visible(tmp_path)) == 25
    got = {(r.ds_path, r.im_idx): r for r in source(tmp_path, channel="raw", group="exp").collect()}
    for s in (0, 1):
        for place, k in enumerate(range(s, 25, 2)):
            a = np.arange(np.prod(shape)).reshape(shape) + 100.0 * k
            a = np.moveaxis(a, -1, 0) if extension == "tif" and len(shape) == 3 else a  # channels are pages
            r = got[f"exp/s{s}/raw", place]
            assert list(r.shape) == list(a.shape) and r.data == a.ravel().tolist()
    assert source(tmp_path, channel="mask").count() == 0 and source(tmp_path, group="other").count() == 0


def test_pushed_filters_decide_what_is_planned(spark, source, tmp_path):
    images(spark, 40).write.format("lattiq").mode("append").save(str(tmp_path))
    df = source(tmp_path, taskBytes=1)
    assert df.rdd.getNumPartitions() == 40
    one = df.where("ds_path = 'exp/s1/raw' and im_idx in (3, 5) and size(data) > 1")
    assert one.rdd.getNumPartitions() == 2 and sorted(r.im_idx for r in one.collect()) == [3, 5]
    reader = connector.FolderReader({"path": str(tmp_path), "taskBytes": "1"})
    col, num = ("ds_path",), ("im_idx",)
    rest = list(reader.pushFilters([ds.StringEndsWith(col, "0/raw"), ds.StringContains(col, "s"), ds.StringStartsWith(col, "exp"), ds.GreaterThan(num, 2), ds.LessThanOrEqual(num, 6), ds.IsNotNull(num), ds.EqualTo(("label",), "x"), ds.Not(ds.EqualTo(num, 4))]))
    assert [type(f) for f in rest] == [ds.EqualTo, ds.Not]
    assert [p.whole[0][2] for p in reader.partitions()] == [3, 4, 5, 6]
    assert source(tmp_path).where("ds_path = 'none'").count() == 0


def test_many_tasks_read_one_file(spark, source, tmp_path):
    (tmp_path / "s").mkdir()
    a = np.arange(10_000 * 6, dtype="int32").reshape(10_000, 2, 3)
    np.save(tmp_path / "s/raw.npy", a)
    reader = connector.FolderReader({"path": str(tmp_path), "frames": "true", "taskBytes": str(24 * 1000)})
    parts = reader.partitions()
    assert len(parts) == 10 and all(p.stop - p.start == 1000 and not p.frames.strips for p in parts)
    held = [b.num_rows for b in reader.read(parts[3])]
    assert sum(held) == 1000
    df = source(tmp_path / "s/raw.npy", taskBytes=24 * 1000)  # a file stands for its folder
    assert df.rdd.getNumPartitions() == 10 and df.count() == 10_000
    some = df.where("im_idx between 2990 and 3009")
    assert some.rdd.getNumPartitions() == 1
    assert {r.im_idx: r.data for r in some.collect()} == {k: a[k].ravel().astype(float).tolist() for k in range(2990, 3010)}


def test_reads_are_of_the_frames_bytes(tmp_path, monkeypatch):
    np.save(tmp_path / "a.npy", np.zeros((5000, 10, 10)))
    monkeypatch.setattr(connector, "HELD_BYTES", 8000)
    fs, _ = connector.opened(str(tmp_path))
    at = connector.index(fs, str(tmp_path / "a.npy"))
    assert [len(x) for x in connector.read_range(fs, str(tmp_path / "a.npy"), at, 100, 125)] == [10, 10, 5]


def test_pages_of_a_file(spark, source, tmp_path):
    a = (np.arange(50 * 12).reshape(50, 3, 4) % 251).astype("uint16")
    (tmp_path / "x.tif").write_bytes(tiff.encode(a))
    df = source(tmp_path, frames="true", taskBytes=24 * 8)
    assert df.rdd.getNumPartitions() == 7
    assert {r.im_idx: r.data for r in df.where("im_idx >= 17").collect()} == {k: a[k].ravel().astype(float).tolist() for k in range(17, 50)}


def test_frames_are_written_in_one_file(spark, source, tmp_path):
    rows = images(spark, 31, 3).repartition("ds_path").sortWithinPartitions("ds_path", "im_idx")
    rows.write.format("lattiq").option("frames", "true").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == [f"exp/s{s}/raw.npy" for s in range(3)]
    assert np.load(tmp_path / "exp/s1/raw.npy")[:, 0, 0].tolist() == [100.0 * k for k in range(1, 31, 3)]
    with pytest.raises(Exception, match="would be one file"):
        images(spark, 30, 1).repartition(3).write.format("lattiq").option("frames", "true").mode("append").save(str(tmp_path / "b"))
    assert visible(tmp_path / "b") == []


def test_a_failed_write_leaves_nothing(spark, source, tmp_path):
    bad = images(spark, 30).withColumn("shape", F.when(F.col("im_idx") == 29, F.array(F.lit(7))).otherwise(F.col("shape")))
    with pytest.raises(Exception):
        bad.repartition(4).write.format("lattiq").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == [] and source(tmp_path).count() == 0
    for path in ("../up/raw", "_hidden/raw"):
        with pytest.raises(Exception, match="not a path below"):
            images(spark, 2).withColumn("ds_path", F.lit(path)).write.format("lattiq").mode("append").save(str(tmp_path / "in"))
    twice = images(spark, 4).unionByName(images(spark, 1))
    with pytest.raises(Exception, match="would be one file"):
        twice.write.format("lattiq").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == []
    (tmp_path / "_temporary-killed/0/exp").mkdir(parents=True)
    (tmp_path / "_temporary-killed/0/exp/0.npy").write_bytes(b"half a file")
    assert source(tmp_path).count() == 0


def test_append_replaces_single_images_and_overwrite_all(spark, source, tmp_path):
    images(spark, 10).write.format("lattiq").mode("append").save(str(tmp_path))
    newer = images(spark, 10).where("im_idx between 4 and 5").withColumn("data", F.transform("data", lambda x: -x))
    newer.write.format("lattiq").mode("append").save(str(tmp_path))
    first = {(r.ds_path, r.im_idx): r.data[1] for r in source(tmp_path).collect()}
    assert first["exp/s0/raw", 2] == -401 and first["exp/s1/raw", 2] == -501 and first["exp/s0/raw", 1] == 201
    newer.write.format("lattiq").mode("overwrite").save(str(tmp_path))
    assert visible(tmp_path) == ["exp/s0/raw/0000000004.npy", "exp/s1/raw/0000000005.npy"]


def test_odd_files(spark, source, tmp_path):
    assert source(tmp_path / "absent").count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((3, 4, 5))))
    with pytest.raises(Exception, match="Fortran"):
        source(tmp_path, frames="true").count()
    (tmp_path / "o").mkdir()
    np.save(tmp_path / "o/e.npy", np.zeros((0, 4)))
    assert source(tmp_path / "o", frames="true").count() == 0


def test_images_are_fitted_by_channel(spark, source, tmp_path):
    from lattiq.functions import kernels

    a = np.arange(20.0).reshape(4, 5)
    for c in ("raw", "mask"):
        (tmp_path / "s" / c).mkdir(parents=True)
        np.save(tmp_path / "s" / c / "0.npy", a)
    got = {r.ds_path: r for r in source(tmp_path, targetShape="7,3", orders="raw=3, mask=0").collect()}
    assert np.allclose(got["s/raw"].data, kernels.zoomed(a, (7, 3), 3).ravel()) and got["s/mask"].data == kernels.zoomed(a, (7, 3), 0).ravel().tolist()
    assert got["s/raw"]["shape"] == [7, 3]
    cut = source(tmp_path, channel="raw", targetShape="3,6").first()
    want = np.zeros((3, 6))
    want[:, :5] = a[:3]
    assert cut.data == want.ravel().tolist()
    with pytest.raises(Exception, match="no order"):
        source(tmp_path, targetShape="7,3", orders="raw=1").collect()
