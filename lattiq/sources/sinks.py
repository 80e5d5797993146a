"""Predictions and other results written back beside their inputs."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import tiff
from lattiq.functions.paths import replace_last


def predicted(df: DataFrame, model: Callable[[np.ndarray], np.ndarray | Sequence[np.ndarray]], column: str = "data", shape: tuple[int, ...] | None = None, outputs: Sequence[str] = ("prediction",), batch_size: int = 32, apply: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Adds a flat array for each output of a model that takes a batch of images (batch, *shape).

    Rows keep their keys, so results need no order to be written. A wrong number of outputs or rows is an error.
    """
    keep = [c for c in df.columns if c not in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch_size):
                part = b.iloc[k : k + batch_size]
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part[column]])
                y = model(x.reshape(len(x), *shape) if shape else x)
                ys = [y] if isinstance(y, np.ndarray) else list(y)
                if len(ys) != len(outputs):
                    raise ValueError(f"model gave {len(ys)} outputs, expected {len(outputs)}")
                out = part[keep].copy()
                for name, a in zip(outputs, ys):
                    if len(a) != len(part):
                        raise ValueError("model gave another number of images")
                    a = apply(a) if apply else a
                    out[name] = [v.ravel() for v in a]
                yield out

    schema = df.select(*keep).schema
    from pyspark.sql.types import ArrayType, DoubleType

    for name in outputs:
        schema = schema.add(name, ArrayType(DoubleType()))
    return df.mapInPandas(run, schema)


def write_predictions(df: DataFrame, path: str, column: str, channel0: str, output: str, mode: str = "append") -> None:
    """Under each sub-dataset's path with the channel's name replaced; rows are keyed by im_idx, labels go along."""
    extra = [c for c in ("label", "shape") if c in df.columns]
    out = df.select(replace_last(F.col("ds_path"), channel0, output).alias("ds_path"), "im_idx", *extra, F.col(column).alias("data"))
    out.write.mode(mode).partitionBy("ds_path").parquet(path)


RUN = 1024
#: Folders of runs in a new store, beyond two for each sub-dataset.
MAX_RUNS = 1024


def _run_width(df: DataFrame, run: int) -> int:
    """The least ``run * 2 ** k`` images that leave a new store of these rows no more than its folders."""
    ends = df.groupBy("ds_path").agg(F.min("im_idx").alias("a"), F.max("im_idx").alias("b"))
    folders = lambda w: F.floor(F.col("b") / w) - F.floor(F.col("a") / w) + 1
    widths = [run << k for k in range(40)]
    n, *counts = ends.agg(F.count("*"), *[F.coalesce(F.sum(folders(w)), F.lit(0)) for w in widths]).first()
    return next((w for w, c in zip(widths, counts) if c <= max(MAX_RUNS, 2 * n)), widths[-1])


def write_range(df: DataFrame, path: str, staging: str, run: int = RUN) -> None:
    """Rows of (ds_path, im_idx) replace those that are there; others stay.

    A store is cut into runs of images, and only the runs that the rows touch are read, merged and written again. The merged runs go
    to ``staging`` (a fresh shared path) first, so that nothing is overwritten while it is read, and a failed job can be run again.

    A run has ``run`` images, or in a large store so many times as many that its folders, each of which is listed whenever the store is
    read, do not grow with it. A store keeps the width that its first rows gave it, in its folders' names (``run_width``).
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stored = spark.read.parquet(path) if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target) else None
    folders = ["ds_path", "run_width", "run"]
    if stored is None:
        run = _run_width(df, run)
    elif "run_width" in stored.columns:
        run = stored.select("run_width").first()[0]
    else:
        folders.remove("run_width")  # a store from before it was kept
    new = df.withColumns({"run_width": F.lit(run).cast("bigint"), "run": F.floor(F.col("im_idx") / run)}).select(*df.columns, *folders[1:])
    if stored is not None:
        old = stored.select(*new.columns).withColumns({c: F.col(c).cast("bigint") for c in folders[1:]})
        old = old.join(new.select("ds_path", "run").distinct(), ["ds_path", "run"], "left_semi")
        new = new.unionByName(old.join(new.select("ds_path", "im_idx"), ["ds_path", "im_idx"], "left_anti"))
    new.write.parquet(staging)
    merged = spark.read.schema(new.schema).parquet(staging).repartition("ds_path", "run")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def write_routed(df: DataFrame, stores: Mapping[str, str], staging: str, mode: str = "append") -> None:
    """Each row to the store whose key its path begins with, the longest such key first; a path of no store is an error.

    The plan runs once: its rows go to ``staging`` (a fresh shared path), a folder for each store, and from there to the stores, which are
    not touched if any row has none.
    """
    keys = sorted(stores, key=lambda k: (-len(k), k))
    number = {k: i for i, k in enumerate(keys)}
    owner = F.coalesce(*[F.when(F.col("ds_path").startswith(k), F.lit(number[k])) for k in keys])
    rows = df.withColumn("__store", F.coalesce(owner, F.raise_error(F.concat(F.lit("no store for "), F.col("ds_path"))).cast("int")))
    rows.write.partitionBy("__store").parquet(staging)
    held = df.sparkSession.read.schema(rows.schema).parquet(staging)
    for k in stores:
        held.where(F.col("__store") == number[k]).drop("__store").write.mode(mode).parquet(stores[k])


def tiff_files(df: DataFrame, n: int, shape: tuple[int, ...] | None = None, dtype: str = "float32") -> DataFrame:
    """(name, content) of one uncompressed TIFF file for each image of two axes, or stack of pages of three."""
    return _files(df, n, shape, ".tif", lambda a: tiff.encode(a.astype(dtype)))


def npy_files(df: DataFrame, n: int, shape: tuple[int, ...] | None = None) -> DataFrame:
    """(name, content) of one npy file for each image; names are padded so that they sort by number."""

    def saved(a: np.ndarray) -> bytes:
        f = io.BytesIO()
        np.save(f, a)
        return f.getvalue()

    return _files(df, n, shape, ".npy", saved)


def _files(df: DataFrame, n: int, shape: tuple[int, ...] | None, extension: str, save: Callable[[np.ndarray], bytes]) -> DataFrame:
    width = len(str(max(n, 1)))

    @F.pandas_udf("binary")
    def encode(data: pd.Series, shapes: pd.Series) -> pd.Series:
        return pd.Series([save(np.asarray(d).reshape([int(v) for v in s])) for d, s in zip(data, shapes)])

    s = F.array(*[F.lit(v) for v in shape]) if shape else F.col("shape")
    name = F.concat("ds_path", F.lit("/"), F.lpad(F.col("im_idx").cast("string"), width, "0"), F.lit(extension))
    return df.select(name.alias("name"), encode(F.col("data"), s).alias("content"))


def write_npy(df: DataFrame, folder: str, n: int, shape: tuple[int, ...] | None = None) -> None:
    write_files(npy_files(df, n, shape), folder)


def write_files(files: DataFrame, folder: str) -> None:
    """(name, content) to a folder that all executors mount; a retried task overwrites its own files, each by renaming."""
    root = folder.removeprefix("file://").removeprefix("file:").rstrip("/")

    def put(rows: Iterator[Row]) -> None:
        import os

        for r in rows:
            path = f"{root}/{r['name'].lstrip('/')}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.tmp", "wb") as f:
                f.write(r["content"])
            os.replace(f"{path}.tmp", path)

    files.foreachPartition(put)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of metrics as semicolon-separated text, one more file in a folder; each file has the header, as ``read_log`` expects."""
    df.coalesce(1).write.mode("append").option("sep", ";").option("header", "true").csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", "true").csv(path)
