"""Neighbours in time: frames before and after, clamped to a series and broken where labels are not consecutive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lattiq.functions.paths import barcode_of, frame_of
from lattiq.operators.positions import hash_order


def clamped_neighbour(im: Column, n: Column, k: int) -> Column:
    """The index k frames on (or back), held inside 0 to n - 1."""
    return F.least(F.greatest(im + k, F.lit(0)), n - 1)


#: Rows of a series that one window sees at a time, at least four times as many as it reaches.
CHUNK = 4096


def chunked(df: DataFrame, reach: int, series: str = "ds_idx", im: str = "im_idx", size: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """A series dealt over chunks of neighbouring rows, and the window over one chunk: a long series is many tasks.

    A row is in the chunk of its place in the series and, if it lies within ``reach`` of an end, in the neighbouring chunk too, so that every row sees its
    neighbours in its own chunk, where ``__own`` holds. Places come from counts by ranges of ``im`` (integers), a row for each range, so no
    task holds a whole series to find them.
    """
    size = max(CHUNK if size is None else size, 4 * max(reach, 1))
    rows = df.withColumn("__cell", F.floor(F.col(im) / size))
    counts = rows.groupBy(F.col(series).alias("__series"), F.col("__cell").alias("__at")).agg(F.count("*").alias("__k"))
    before = Window.partitionBy("__series").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    inside = F.row_number().over(Window.partitionBy(series, "__cell").orderBy(im)) - 1
    rows = rows.withColumn("__i", inside).join(counts, F.col(series).eqNullSafe(F.col("__series")) & F.col("__cell").eqNullSafe(F.col("__at")))
    place = F.col("__before") + F.col("__i")
    at, off = F.floor(place / size), place % size
    near = F.array_compact(F.array(at, F.when((off < reach) & (at > 0), at - 1), F.when(off >= size - reach, at + 1)))
    rows = rows.withColumns({"__home": at, "__chunk": F.explode(near)}).withColumn("__own", F.col("__home") == F.col("__chunk"))
    return rows.drop("__cell", "__i", "__series", "__at", "__before", "__home"), Window.partitionBy(series, "__chunk").orderBy(im)


def owned(df: DataFrame) -> DataFrame:
    """A chunked table's rows, each once."""
    return df.where("__own").drop("__own", "__chunk")


def _with_increment(df: DataFrame, w: WindowSpec, k: int, back: bool, im: str, label: str, out: str) -> DataFrame:
    move, sign = (F.lag, -1) if back else (F.lead, 1)
    at = lambda c, j: move(c, j).over(w)
    df = df.withColumns({"__f": frame_of(F.col(label)), "__b": barcode_of(F.col(label))})
    steps = [F.when((at("__b", j) == F.col("__b")) & (at("__f", j) == F.col("__f") + sign * j) & (at(im, j) == F.col(im) + sign * j), F.lit(j)) for j in range(k, 0, -1)]
    return df.withColumn(out, F.coalesce(*steps, F.lit(0))).drop("__f", "__b")


def max_increment(df: DataFrame, k: int, back: bool = True, series: str = "ds_idx", im: str = "im_idx", label: str = "label", out: str = "increment") -> DataFrame:
    """Adds the largest step of k or fewer to a row whose label is as many frames away in the same barcode; else 0.

    One window over chunks of the series looks at the k rows around each row; no pairs are made.
    """
    rows, w = chunked(df, k, series, im)
    return owned(_with_increment(rows, w, k, back, im, label, out))


def frame_stack(df: DataFrame, columns: Sequence[str], n_frames: int = 1, stride: int | tuple[Column, Sequence[int]] = 1, before: bool = True, after: bool = True, series: str = "ds_idx", im: str = "im_idx", label: str | None = None, keep_current: Column | None = None, chunk: int | None = None) -> DataFrame:
    """Each column becomes an array of its values at t - n*stride ... t ... t + n*stride.

    Frames beyond an end repeat the end (or, with labels, the farthest frame still continuous). Where ``keep_current`` holds,
    all neighbours are the current frame. All columns share one window over chunks of the series. A stride may differ by row: a column, and the
    values it can have.
    """
    strides = [stride] if isinstance(stride, int) else sorted(set(stride[1]))
    reach = n_frames * max(strides)
    df, w = chunked(df, reach, series, im, chunk)

    def value(c: str, k: int) -> Column:
        if k == 0:
            return F.col(c)
        move = F.lag if k < 0 else F.lead
        if label is None:
            # the nearest end is within reach: the farthest row there is
            v = F.coalesce(*[F.when(move(im, j).over(w).isNotNull(), F.struct(move(c, j).over(w).alias("v"))) for j in range(abs(k), 0, -1)], F.struct(F.col(c).alias("v")))["v"]
        else:
            step = F.least(F.col("__back" if k < 0 else "__fwd"), F.lit(abs(k)))
            v = F.coalesce(*[F.when(step == j, move(c, j).over(w)) for j in range(abs(k), 0, -1)], F.col(c))
        return v if keep_current is None else F.when(keep_current, F.col(c)).otherwise(v)

    steps = [*(range(-n_frames, 0) if before else ()), 0, *(range(1, n_frames + 1) if after else ())]
    if label is not None:
        for back, out in ((True, "__back"), (False, "__fwd")):
            df = _with_increment(df, w, reach, back, im, label, out)

    def stack(c: str) -> Column:
        made = [F.array(*[value(c, j * s) for j in steps]) for s in strides]
        return made[0] if isinstance(stride, int) else F.coalesce(*[F.when(stride[0] == s, a) for s, a in zip(strides, made)])

    return owned(df.withColumns({c: stack(c) for c in columns})).drop("__back", "__fwd")


def drawn_frame_stack(df: DataFrame, columns: Sequence[str], batch: Column, low: int, high: int, n_frames: int = 1, remove_probability: float = 0.0, seed: int = 0, **options) -> DataFrame:
    """A stack whose stride, from ``low`` to ``high``, is drawn for each batch; with ``remove_probability`` a batch's neighbours are
    all the current frame. The draws are hashes of the batch's number (an integer), so every row of a batch and every rerun agree."""
    stride = F.lit(low) + F.pmod(F.floor(hash_order(batch, seed) / 65536), F.lit(high - low + 1))
    still = hash_order(batch, seed + 1) / F.lit(4294967296.0) < remove_probability
    return frame_stack(df, columns, n_frames, (stride, range(low, high + 1)), keep_current=still if remove_probability else None, **options)


def neighbour_ids(df: DataFrame, ids: DataFrame, back: bool, key: str, series: str = "ds_idx", im: str = "im_idx", label: str = "label") -> DataFrame:
    """Keys of the rows one frame before (or after) the given ones, where labels are consecutive. Only keys and labels are moved."""
    rows, w = chunked(df.select(series, im, label, *[k for k in (key,) if k not in (series, im, label)]), 1, series, im)
    near = (F.lag if back else F.lead)(key, 1).over(w)
    near = owned(_with_increment(rows, w, 1, back, im, label, "__k").withColumn("__n", near)).where("__k = 1")
    return near.join(ids.select(key), key, "left_semi").select(F.col("__n").alias(key)).distinct()


def leak_free_split(df: DataFrame, train: DataFrame, test: DataFrame, key: str, before: bool = True, after: bool = False, **names) -> tuple[DataFrame, DataFrame]:
    """(train, test): the train set loses rows that would see, or be seen by, a test row as a neighbour."""
    lost = None
    for use, back in ((before, False), (after, True)):
        if use:
            near = neighbour_ids(df, test, back, key, **names)
            lost = near if lost is None else lost.unionByName(near).distinct()
    return (train if lost is None else train.join(lost, key, "left_anti")), test


def frames_to_augment(frames: Column, only_ends: bool) -> Column:
    """All frames, or the first, the middle and the last."""
    n = F.size(frames)
    picks = F.array_distinct(F.array(F.lit(1), F.floor(n / 2).cast("int") + 1, n))
    return F.transform(picks, lambda i: F.element_at(frames, i)) if only_ends else frames
