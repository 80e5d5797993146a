"""Stores, formats and draws against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import draws, tiff
from lattiq.operators import union
from lattiq.sources import files, sinks


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("shape", [(5, 7), (3, 5, 7), (1, 1)])
def test_tiff_round_trip(dtype, shape):
    a = (np.arange(np.prod(shape)) * 3.7).reshape(shape).astype(dtype)
    b = tiff.decode(tiff.encode(a))
    assert b.shape == shape and b.dtype.kind == a.dtype.kind and (a == b).all()


def test_tiff_refuses_other_content():
    with pytest.raises(ValueError):
        tiff.decode(b"\x89PNG....")
    with pytest.raises(ValueError):
        tiff.encode(np.zeros((2, 2), dtype=complex))
    packed = bytearray(tiff.encode(np.zeros((2, 2), dtype="uint8")))
    at = packed.index((259).to_bytes(2, "little") + b"\x04\x00")
    packed[at + 8] = 5
    with pytest.raises(ValueError):
        tiff.decode(bytes(packed))


def test_resized_folder_of_mixed_files(spark, tmp_path):
    a = np.arange(12, dtype="float64").reshape(3, 4)
    (tmp_path / "s1/raw").mkdir(parents=True)
    np.save(tmp_path / "s1/raw/0.npy", a)
    (tmp_path / "s1/raw/1.TIF").write_bytes(tiff.encode(a + 1))  # not selected: globs mind case
    (tmp_path / "s1/raw/2.tif").write_bytes(tiff.encode(a + 2))
    (tmp_path / "s1/raw/notes.txt").write_text("x")
    rows = sorted(files.open_dataset(spark, str(tmp_path), "raw").collect(), key=lambda r: r["im_idx"])
    assert [np.array(r["data"]).tolist() for r in rows] == [a.ravel().tolist(), (a + 2).ravel().tolist()]
    small = files.read_frames(spark, str(tmp_path), ".npy", "raw", None, True, target_shape=(2, 2), order=0).first()
    assert list(small["shape"]) == [2, 2] and set(small["data"]) <= set(a.ravel())


def test_write_range_into_an_absent_store_and_over_it(spark, tmp_path):
    rows = lambda a, b, v: spark.range(a, b).select(F.lit("d").alias("ds_path"), F.col("id").alias("im_idx"), F.lit(v).alias("v"))
    sinks.write_range(rows(0, 50, 0), str(tmp_path / "s"), str(tmp_path / "t1"), run=8)
    sinks.write_range(rows(20, 30, 1), str(tmp_path / "s"), str(tmp_path / "t2"), run=8)
    sinks.write_range(rows(60, 62, 2), str(tmp_path / "s"), str(tmp_path / "t3"), run=8)
    got = {r["im_idx"]: r["v"] for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {i: int(20 <= i < 30) for i in range(50)} | {60: 2, 61: 2}


def test_routed_write_without_a_store_fails(spark, tmp_path):
    df = spark.createDataFrame([("a/1",), ("b/1",)], "ds_path string")
    with pytest.raises(Exception, match="no store for b/1"):
        sinks.write_routed(df, {"a": str(tmp_path / "a")}, str(tmp_path / "staging"))


def test_choice_of_weights_and_of_too_few(spark):
    df = spark.range(4000).withColumns({"x": F.array(*map(F.lit, "abc")), "p": F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))})
    n = {r["v"]: r["count"] for r in df.select(F.explode(draws.choice(F.col("x"), 2, F.col("id"), F.col("p"))).alias("v")).groupBy("v").count().collect()}
    assert "b" not in n and n["a"] + n["c"] == 8000 and abs(n["a"] / 8000 - 0.25) < 0.03
    both = df.select(draws.choice(F.col("x"), 2, F.col("id"), F.col("p"), replace=False).alias("v"))
    assert {tuple(sorted(r["v"])) for r in both.distinct().collect()} == {("a", "c")}
    with pytest.raises(Exception, match="fewer than 3"):
        df.limit(1).select(draws.choice(F.col("x"), 3, F.col("id"), F.col("p"), replace=False)).collect()
    assert spark.range(1).select(draws.choice(F.array().cast("array<int>"), 2, F.col("id")).alias("v")).first()["v"] is None


def test_concat_batches_wants_equal_columns(spark):
    with pytest.raises(ValueError):
        union.concat_batches([spark.range(2).withColumn("batch", F.lit(0)), spark.range(2).toDF("x").withColumn("batch", F.lit(0))], [1, 1])


def test_folders_of_runs_do_not_grow_with_the_store(spark, tmp_path, monkeypatch):
    """A larger store has wider runs, which later writes keep; a small one and one of an earlier layout stay as they are."""
    monkeypatch.setattr(sinks, "MAX_RUNS", 8)
    rows = lambda a, b, v: spark.range(a, b).select(F.lit("d").alias("ds_path"), F.col("id").alias("im_idx"), F.lit(v).alias("v"))
    for n, width in ((16, 4), (400, 64)):
        path = tmp_path / f"s{n}"
        sinks.write_range(rows(0, n, 0), str(path), str(tmp_path / f"a{n}"), run=4)
        assert len(list(path.glob("ds_path=*/*/run=*"))) <= 8
        before = set(path.rglob("*.parquet"))
        sinks.write_range(rows(5, 8, 1), str(path), str(tmp_path / f"b{n}"), run=4)
        assert {f.name for f in path.glob("ds_path=*/*")} == {f"run_width={width}"}
        assert len(before & set(path.rglob("*.parquet"))) == len(before) - 1  # the run of 5 to 7 alone are written again
        got = spark.read.parquet(str(path)).collect()
        assert len(got) == n and {r.im_idx: r.v for r in got} == {i: int(5 <= i < 8) for i in range(n)}
    earlier = str(tmp_path / "earlier")
    rows(0, 20, 0).withColumn("run", F.floor(F.col("im_idx") / 4)).write.partitionBy("ds_path", "run").parquet(earlier)
    sinks.write_range(rows(5, 8, 1), earlier, str(tmp_path / "c"), run=4)
    got = spark.read.parquet(earlier)
    assert "run_width" not in got.columns and sorted((r.im_idx, r.v) for r in got.collect()) == [(i, int(5 <= i < 8)) for i in range(20)]
