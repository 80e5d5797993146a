"""Folders of arrays as a Spark data source: ``spark.read.format("lattiq")`` and ``df.write.format("lattiq")``.

The driver plans from a listing and from the headers of files with many frames; tasks read only their own bytes. Paths are opened by
pyarrow's file systems (local and mounted folders, and the object stores that it knows).
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

import lattiq
from lattiq.functions import kernels, tiff

#: Executors need no copy of the package: the source travels with the plan.
cloudpickle.register_pickle_by_value(lattiq)

NAME = "lattiq"
SCHEMA = "ds_path string, im_idx bigint, shape array<int>, data array<double>"
EXTENSIONS = (".npy", ".tif", ".tiff", ".png")
#: Bytes of files or frames that a task reads, and bytes of frames that it holds at a time.
TASK_BYTES, HELD_BYTES = 32 << 20, 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _hidden(relative: str) -> bool:
    """Files of unfinished writes, and others that begin like them."""
    return any(p.startswith(("_", ".")) for p in relative.split("/"))


@dataclass(frozen=True)
class Frames:
    """Where a file's frames are: the shape and type of one, and its byte offsets, even (first, stride) or a list of strips for each frame."""

    n: int
    shape: tuple[int, ...]
    dtype: str
    first: int = 0
    strips: tuple[tuple[tuple[int, int], ...], ...] = ()

    @property
    def frame_bytes(self) -> int:
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape, dtype=np.int64))


def npy_frames(file: pa.NativeFile) -> Frames:
    """The index of an npy file from its header alone; the first axis numbers the frames."""
    fmt = np.lib.format
    version = fmt.read_magic(file)
    shape, fortran, dtype = fmt.read_array_header_1_0(file) if version == (1, 0) else fmt.read_array_header_2_0(file)
    if dtype.hasobject or dtype.kind not in "biuf" or not shape:
        raise ValueError(f"not an array of numbers with a first axis: {dtype} {shape}")
    if fortran and len(shape) > 1:
        raise ValueError("frames of an array in Fortran order do not lie together; write it in C order")
    return Frames(int(shape[0]), tuple(map(int, shape[1:])), dtype.str, file.tell())


def tiff_frames(file: pa.NativeFile) -> Frames:
    """The index of a TIFF file: its directories are read one after the other, no pixels."""
    pages = list(tiff.directories(lambda at, size: file.read_at(size, at)))
    kinds = {(p.shape, p.dtype) for p in pages}
    if len(kinds) != 1:
        raise ValueError("the pages of a file have different shapes or types")
    (shape, dtype), strips = kinds.pop(), tuple(p.strips for p in pages)
    return Frames(len(pages), shape, dtype, 0, strips)


def index(fs: pafs.FileSystem, path: str) -> Frames:
    with fs.open_input_file(path) as f:
        return npy_frames(f) if path.lower().endswith(".npy") else tiff_frames(f)


def read_range(fs: pafs.FileSystem, path: str, at: Frames, start: int, stop: int) -> Iterator[np.ndarray]:
    """Frames from start to stop in runs of some ``HELD_BYTES``; only their bytes are read."""
    step = max(1, HELD_BYTES // max(at.frame_bytes, 1))
    with fs.open_input_file(path) as f:
        for a in range(start, stop, step):
            b = min(stop, a + step)
            if at.strips:
                raw = b"".join(f.read_at(n, o) for frame in at.strips[a - start : b - start] for o, n in frame)
            else:
                raw = f.read_at((b - a) * at.frame_bytes, at.first + a * at.frame_bytes)
            yield np.frombuffer(raw, dtype=at.dtype).reshape(b - a, *at.shape)


def decoded(path: str, content: bytes) -> np.ndarray:
    from lattiq.sources import files

    return files.decoder(posixpath.splitext(path)[1].lower())(content)


def batch(ds_path: str, first: int, images: np.ndarray) -> pa.RecordBatch:
    """Rows of equally shaped images."""
    n, flat = len(images), np.ascontiguousarray(images, dtype=np.float64).reshape(-1)
    each, rank = flat.size // n, images.ndim - 1
    shapes = np.tile(np.array(images.shape[1:], np.int32), n)
    lists = lambda values, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array([ds_path] * n), pa.array(np.arange(first, first + n)), lists(shapes, rank), lists(flat, each)], names=["ds_path", "im_idx", "shape", "data"])


@dataclass
class Part(ds.InputPartition):
    """Whole files as (path, ds_path, im_idx), or a range of one file's frames."""

    whole: list[tuple[str, str, int]] = field(default_factory=list)
    path: str = ""
    ds_path: str = ""
    frames: Frames | None = None
    start: int = 0
    stop: int = 0

    def __hash__(self) -> int:
        return id(self)


class FolderReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        fs, path = opened(self.options["path"])
        self.root, self.many = path.rstrip("/"), self.options.get("frames", "false").lower() == "true"
        if path.lower().endswith(EXTENSIONS) and fs.get_file_info(path).type == pafs.FileType.File:
            self.root, self.many = posixpath.dirname(path), True  # a file stands for its folder, whose files hold many frames
        self.pushed: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Conditions on the path and on the number of an image decide which files and frames are planned at all."""
        text = (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
        number = (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ds_path",) and isinstance(f, text) or column == ("im_idx",) and isinstance(f, number):
                self.pushed.append(f)
            elif not (isinstance(f, ds.IsNotNull) and column in (("ds_path",), ("im_idx",))):  # neither is ever null
                yield f

    def _holds(self, column: str, value) -> bool:
        for f in self.pushed:
            if f.attribute != (column,):
                continue
            ok = {
                ds.EqualTo: lambda: value == f.value,
                ds.In: lambda: value in f.value,
                ds.StringStartsWith: lambda: value.startswith(f.value),
                ds.StringEndsWith: lambda: value.endswith(f.value),
                ds.StringContains: lambda: f.value in value,
                ds.GreaterThan: lambda: value > f.value,
                ds.GreaterThanOrEqual: lambda: value >= f.value,
                ds.LessThan: lambda: value < f.value,
                ds.LessThanOrEqual: lambda: value <= f.value,
            }[type(f)]()
            if not ok:
                return False
        return True

    def listed(self) -> list[tuple[str, str, int]]:
        """(path, path below the root, bytes) of the files, in the order of their paths."""
        fs, _ = opened(self.options["path"])
        wanted = tuple("." + e.strip().lstrip(".").lower() for e in self.options.get("extensions", ",".join(EXTENSIONS)).split(","))
        found = []
        for f in fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            below = f.path[len(self.root) :].lstrip("/")
            ending = below if self.options.get("mindcase", "false").lower() == "true" else below.lower()
            if f.type == pafs.FileType.File and ending.endswith(wanted) and not _hidden(below):
                found.append((f.path, below, f.size))
        return sorted(found, key=lambda f: f[1])

    def partitions(self) -> list[Part]:
        channel, group, size = self.options.get("channel"), self.options.get("group"), int(self.options.get("taskbytes", TASK_BYTES))
        fs, _ = opened(self.options["path"])
        parts: list[Part] = []
        number: dict[str, int] = {}
        held = 0
        for path, below, n_bytes in self.listed():
            folder = posixpath.dirname(below)
            own = below if self.many else folder
            place = number.get(folder, 0)
            number[folder] = place + 1
            named = channel is None or (channel in posixpath.basename(below) if self.many else posixpath.basename(folder) == channel)
            if not named or group and group not in folder or not self._holds("ds_path", own):
                continue
            if self.many and not below.lower().endswith(".png"):
                parts += self._ranges(fs, path, own, size)
            elif self._holds("im_idx", 0 if self.many else place):
                if not parts or not parts[-1].whole or held + n_bytes > size:
                    parts.append(Part())
                    held = 0
                parts[-1].whole.append((path, own, 0 if self.many else place))
                held += n_bytes
        return parts or [Part()]

    def _ranges(self, fs: pafs.FileSystem, path: str, own: str, size: int) -> Iterator[Part]:
        at = index(fs, path)
        keep = [k for k in range(at.n) if self._holds("im_idx", k)] if any(f.attribute == ("im_idx",) for f in self.pushed) else range(at.n)
        step = max(1, size // max(at.frame_bytes, 1))
        k = 0
        while k < len(keep):
            j = k
            while j + 1 < len(keep) and keep[j + 1] == keep[j] + 1 and j + 1 - k < step:
                j += 1
            a, b = keep[k], keep[j] + 1
            yield Part(path=path, ds_path=own, frames=Frames(at.n, at.shape, at.dtype, at.first, at.strips[a:b]), start=a, stop=b)
            k = j + 1

    def _fitted(self, images: np.ndarray, own: str) -> np.ndarray:
        """Images in ``targetShape``: resampled by the order of their channel in ``orders`` (``raw=1,mask=0``), or cut without any."""
        if "targetshape" not in self.options:
            return images
        shape = tuple(int(x) for x in self.options["targetshape"].split(","))
        orders = dict(x.strip().split("=") for x in self.options.get("orders", "").split(",") if x.strip())
        channel = posixpath.splitext(posixpath.basename(own))[0] if self.many else posixpath.basename(own)
        if not orders:
            out = np.zeros((len(images), *shape, *images.shape[1 + len(shape) :]), dtype=images.dtype)
            inside = (slice(None), *(slice(0, min(a, b)) for a, b in zip(shape, images.shape[1:])))
            out[inside] = images[inside]
            return out
        if channel not in orders:
            raise ValueError(f"no order of interpolation for channel {channel}")
        return np.stack([kernels.zoomed(x, shape, int(orders[channel])) for x in images]) if len(images) else images

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.options["path"])
        for path, own, place in partition.whole:
            with fs.open_input_file(path) as f:
                yield batch(own, place, self._fitted(decoded(path, f.read())[None], own))
        if partition.frames is not None:
            at = partition.start
            for images in read_range(fs, partition.path, partition.frames, partition.start, partition.stop):
                yield batch(partition.ds_path, at, self._fitted(images, partition.ds_path))
                at += len(images)


@dataclass
class Written(ds.WriterCommitMessage):
    """Files that a task has made, and where they belong."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class _Stack:
    """A file of many frames on its way: the body first, then a header that knows how many there are."""

    def __init__(self, fs: pafs.FileSystem, path: str, shape: tuple[int, ...]):
        self.fs, self.path, self.shape, self.n = fs, path, shape, 0
        self.body = fs.open_output_stream(f"{path}.body")

    def add(self, image: np.ndarray) -> None:
        if image.shape != self.shape:
            raise ValueError(f"frames of one file have different shapes: {self.shape}, {image.shape}")
        self.body.write(np.ascontiguousarray(image, dtype="<f8").tobytes())
        self.n += 1

    def close(self) -> None:
        self.body.close()
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (self.n, *self.shape)})
        with self.fs.open_output_stream(self.path) as out, self.fs.open_input_stream(f"{self.path}.body") as body:
            out.write(head.getvalue())
            while block := body.read(HELD_BYTES):
                out.write(block)
        self.fs.delete_file(f"{self.path}.body")


class FolderWriter(ds.DataSourceArrowWriter):
    """A file for each image, ``<ds_path>/<im_idx>.<extension>``, or with ``frames`` a file for each path.

    Tasks write below a hidden folder of the job; the driver moves what they made to its place when all have ended, and removes the folder
    if any failed, so a killed write leaves nothing that is read. Two rows of one image are an error.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options = {k.lower(): v for k, v in options.items()}
        _, path = opened(self.options["path"])
        self.root, self.overwrite, self.many = path.rstrip("/"), overwrite, self.options.get("frames", "false").lower() == "true"
        self.extension = self.options.get("extension", "npy").lstrip(".").lower()
        if self.extension not in ("npy", "tif", "tiff") or self.many and self.extension != "npy":
            raise ValueError(f"cannot write {self.extension} files{' of many frames' if self.many else ''}")
        self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}"

    def _encoded(self, image: np.ndarray) -> bytes:
        if self.extension == "npy":
            out = io.BytesIO()
            np.save(out, image)
            return out.getvalue()
        pages = np.moveaxis(image, -1, 0) if image.ndim == 3 and self.options.get("axes", "yxc").lower() == "yxc" else image
        return tiff.encode(pages.astype(self.options.get("dtype", "float32")))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, _ = opened(self.options["path"])
        own = f"{self.temporary}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        done, stack, last = Written(), None, None
        width = int(self.options.get("width", 10))
        for b in iterator:
            paths, numbers, shapes, data = (b.column(c) for c in ("ds_path", "im_idx", "shape", "data"))
            for i in range(b.num_rows):
                image = data[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shapes[i].as_py())
                folder = paths[i].as_py().strip("/")
                below = f"{folder}.npy" if self.many else f"{folder}/{numbers[i].as_py():0{width}d}.{self.extension}"
                if posixpath.normpath(below).startswith(("..", "/")) or _hidden(below):
                    raise ValueError(f"not a path below the folder: {folder}")
                if not self.many or last != folder:
                    fs.create_dir(posixpath.dirname(f"{own}/{below}"), recursive=True)
                    done.moves.append((f"{own}/{below}", f"{self.root}/{below}"))
                if not self.many:
                    with fs.open_output_stream(f"{own}/{below}") as f:
                        f.write(self._encoded(image))
                    continue
                if last != folder:
                    if stack:
                        stack.close()
                    stack, last = _Stack(fs, f"{own}/{below}", image.shape), folder
                stack.add(image)
        if stack:
            stack.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.options["path"])
        moves = [m for w in messages if w is not None for m in w.moves]
        places = [m[1] for m in moves]
        if len(set(places)) < len(places):
            self.abort(messages)
            twice = next(p for i, p in enumerate(sorted(places)) if i and sorted(places)[i - 1] == p)
            raise ValueError(f"several rows, or rows of several tasks, would be one file: {twice}")
        if self.overwrite:
            reader = FolderReader({"path": self.options["path"]})
            for path, *_ in reader.listed():
                if path not in set(places):
                    fs.delete_file(path)
        for folder in sorted({posixpath.dirname(p) for p in places}):
            fs.create_dir(folder, recursive=True)
        for made, place in moves:
            fs.move(made, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.options["path"])
        if fs.get_file_info(self.temporary).type == pafs.FileType.Directory:
            fs.delete_dir(self.temporary)


class ArrayFolder(ds.DataSource):
    """Options of a read: path, frames (files hold many), channel, group, extensions, mindCase (of extensions), targetShape, orders (of
    splines, by channel), taskBytes; of a write: path, frames, extension (npy,
    tif), dtype and axes of TIFF (yxc: the last axis becomes pages), width of the padded number.

    A folder's files are its images in the order of their names; with ``frames``, or for a path of one file, each file is a
    sub-dataset. Paths in ``ds_path`` are below the root.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes ``format("lattiq")`` known to a session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFolder)
    return spark
