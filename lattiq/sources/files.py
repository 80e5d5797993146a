"""Stores of arrays as tables: a row for each image, with path, place, shape and flat data.

Parquet is the native form. ``.npy`` files are read with Spark's own binary reader, so any file system that Spark knows will do;
images and HDF5 need libraries that may be absent, and say so when they are asked for.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.functions import kernels, paths, tiff
from lattiq.operators import union
from lattiq.sources import connector

SCHEMA = "ds_path string, im_idx bigint, shape array<int>, data array<double>"
IMAGE_EXTENSIONS, ARRAY_EXTENSIONS, MOVIE_EXTENSIONS = (".png", ".tif", ".tiff"), (".npy",), (".mov",)


def decode_npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def decode_image(content: bytes) -> np.ndarray:
    """One image, or all frames of a multi-page file; without Pillow, uncompressed TIFF only."""
    try:
        from PIL import Image, ImageSequence
    except ImportError as e:
        if content[:2] in (b"II", b"MM"):
            return tiff.decode(content)
        raise ImportError("reading png files needs Pillow") from e
    with Image.open(io.BytesIO(content)) as im:
        frames = [np.asarray(f) for f in ImageSequence.Iterator(im)]
    return frames[0] if len(frames) == 1 else np.stack(frames)


def decoder(extension: str) -> Callable[[bytes], np.ndarray]:
    if extension in ARRAY_EXTENSIONS:
        return decode_npy
    if extension in IMAGE_EXTENSIONS:
        return decode_image
    raise ValueError(f"unsupported file type {extension}")


def fitted(image: np.ndarray, shape: tuple[int, int] | None, order: int = 1) -> np.ndarray:
    """An image in another shape: by the nearest pixel (order 0, as labels need) or linearly (1)."""
    return image if shape is None or image.shape[:2] == tuple(shape) else kernels.zoomed(image, tuple(shape), order)


def read_frames(spark: SparkSession, folder: str, extension: str | Sequence[str] = ".npy", name: str | None = None, group: str | None = None, one_image_per_file: bool = False, target_shape: tuple[int, int] | None = None, order: int = 1) -> DataFrame:
    """Rows of images from files.

    With one image for each file, a directory is a sub-dataset and its files are its images in the order of their paths;
    otherwise each file is a sub-dataset and its first axis numbers the frames. ``name`` is the channel: the directory's
    base name, or a part of the file's. ``group`` selects by path. With several extensions each file is decoded by its own;
    ``target_shape`` resizes every image.
    """
    decoders = {e: decoder(e) for e in ([extension] if isinstance(extension, str) else extension)}
    decode = lambda content, path: next(f for e, f in decoders.items() if path.lower().endswith(e))(content)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(decoders)}}}").load(folder)
    files = files.where(paths.in_group(F.col("path"), group))
    if one_image_per_file:
        files = files.withColumn("ds_path", paths.parent_path(F.col("path")))
        files = files.where(paths.base_name(F.col("ds_path")) == name) if name else files
        # numbers are given to paths alone, content joins them by path
        numbers = files.select("ds_path", "path").withColumn("im_idx", F.row_number().over(Window.partitionBy("ds_path").orderBy("path")).cast("bigint") - 1)
        files = files.select("path", "content").join(numbers, "path")
        files = files.select("path", "content", "ds_path", "im_idx")
    else:
        files = files.where(F.contains(paths.base_name(F.col("path")), F.lit(name))) if name else files
        files = files.select("path", "content", F.col("path").alias("ds_path"), F.lit(0).cast("bigint").alias("im_idx"))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, ds, im in zip(b["path"], b["content"], b["ds_path"], b["im_idx"]):
                a = decode(content, path)
                a = a[None] if one_image_per_file or path.lower().endswith(IMAGE_EXTENSIONS) and a.ndim == 2 else a
                for k in range(0, len(a), 256):  # a long movie is not one batch
                    part = [fitted(x, target_shape, order) for x in a[k : k + 256]]
                    yield pd.DataFrame({"ds_path": ds, "im_idx": im + k + np.arange(len(part)), "shape": [list(x.shape) for x in part], "data": [x.astype(np.float64).ravel() for x in part]})

    return files.select("path", "content", "ds_path", "im_idx").mapInPandas(frames, SCHEMA)


def read_hdf5(spark: SparkSession, path: str, channel: str, group: str | None = None) -> DataFrame:
    """Arrays of an HDF5 file whose path ends with the channel; a task for each run of images."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 files needs h5py; convert them to parquet or npy, or install it") from e
    found: list[tuple[str, int]] = []
    with h5py.File(path, "r") as f:
        f.visititems(lambda name, node: found.append((name, node.shape[0])) if isinstance(node, h5py.Dataset) and name.endswith(channel) else None)
    runs = [(n, a, min(a + 256, size)) for n, size in found for a in range(0, size, 256)]
    table = spark.createDataFrame(runs, "ds_path string, a bigint, b bigint").where(paths.in_group(F.col("ds_path"), group)).repartition(max(1, len(runs)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with h5py.File(path, "r") as f:
            for t in batches:
                for ds, a, b in t.itertuples(index=False):
                    x = f[ds][a:b]
                    yield pd.DataFrame({"ds_path": ds, "im_idx": np.arange(a, b), "shape": [list(v.shape) for v in x], "data": [v.astype(np.float64).ravel() for v in x]})

    return table.mapInPandas(read, SCHEMA)


def open_dataset(spark: SparkSession, source: DataFrame | str | Sequence[str], channel: str | None = None, group: str | None = None) -> DataFrame:
    """A table as it is; parquet; HDF5 by its suffix; npy and image files, or folders of them; a list is a union in which later
    stores replace earlier ones' paths. Local and mounted folders are read by the data source, with paths below the folder; others by Spark's
    binary reader."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        parts = [open_dataset(spark, s, channel, group) for s in source]
        return parts[0] if len(parts) == 1 else union.union_last_wins(parts, "ds_path")
    if source.endswith((".h5", ".hdf5")):
        return read_hdf5(spark, source, channel or "", group)
    if source.endswith(".parquet"):
        df = spark.read.parquet(source)
        return df.where(paths.in_group(F.col("ds_path"), group)) if group and "ds_path" in df.columns else df
    for ext in (*ARRAY_EXTENSIONS, *IMAGE_EXTENSIONS):
        if source.endswith(ext):
            return read_frames(spark, source, ext, channel, group)
    if "." in source.rsplit("/", 1)[-1]:
        raise ValueError(f"unsupported dataset {source}")
    if "://" not in source and not source.startswith("file:"):
        return connector.register(spark).read.format(connector.NAME).option("mindCase", "true").options(**{k: v for k, v in (("channel", channel), ("group", group)) if v}).load(source)
    return read_frames(spark, source, (*ARRAY_EXTENSIONS, *IMAGE_EXTENSIONS), channel, group, one_image_per_file=True)


def datasets_with_suffix(images: DataFrame, suffix: str, group: str | None = None) -> DataFrame:
    """Paths of a channel, and of a group if it is given."""
    return images.select("ds_path").distinct().where(F.col("ds_path").endswith(suffix) & paths.in_group(F.col("ds_path"), group))


def contains_path(images: DataFrame, path: str) -> bool:
    return images.where(F.col("ds_path") == path).limit(1).count() > 0


def open_channel(images: DataFrame, size: int | None = None) -> DataFrame:
    """The first rows of a channel in order; all of them without a size."""
    df = images.orderBy("ds_path", "im_idx")
    return df if size is None else df.limit(size)
