"""Boxes that differ by row: tile coordinates as columns (an array of structs for each row), drawn from the row's key or set by its
anchors, for arrays of any rank and boxes of each channel's own.

Nothing is drawn inside Python: a draw is a digest of key and number, so SQL repeats it, and boxes are data that can be
kept, joined and given again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import coords, kernels, ndim
from lattiq.functions.draws import drawn


class Draws:
    """A row's draws, numbered as they are taken."""

    def __init__(self, key: str, seed: int = 0):
        self.key, self.seed, self.used = F.col(key), seed, 0

    def number(self) -> Column:
        """The next draw, from 0 to 1 (exclusive)."""
        self.used += 1
        return drawn(self.key, self.used - 1, self.seed)

    def whole(self, low: Column | int, high: Column | int) -> Column:
        """A whole number from low to high; low if there is none."""
        low, high = F.lit(low), F.lit(high)
        return (low + F.floor(self.number() * F.greatest(high - low + 1, F.lit(1)))).cast("int")


def axis_starts(size: int, tile: int, n: int, draws: Draws | None = None) -> list[Column]:
    """Starts of n tiles along an axis. With draws each is moved within the gap or overlap around it: a single tile
    goes anywhere, two move inwards, more move by up to half a gap (of half a step where they overlap) and stay inside."""
    base = [0] if tile == size else coords.axis_coords(size, tile, n)
    if draws is None or tile == size:
        return [F.lit(b) for b in base]
    if n == 1:
        return [draws.whole(0, size - tile)]
    if n == 2:
        most = max((size - 2 * tile) // 2 - 1, 0)
        return [draws.whole(0, most), F.lit(size - tile) - draws.whole(0, most)]
    step = (size - tile) // (n - 1)
    most = (step - tile) // 2 if step >= tile else -(-step // 2)
    return [F.least(F.greatest(F.lit(b) + draws.whole(-most, most), F.lit(0)), F.lit(size - tile)) for b in base]


def _grid(axes: Sequence[Sequence[Column]]) -> list[Column]:
    """Structs (tile_id, start) of all combinations, the last axis fastest."""
    return [F.struct(F.lit(i).alias("tile_id"), F.array(*s).cast("array<int>").alias("start")) for i, s in enumerate(itertools.product(*axes))]


def _counts(shape: Sequence[int], tile: Sequence[int], mode: str, min_overlap: int | Sequence[int]) -> list[int]:
    least = [min_overlap] * len(shape) if isinstance(min_overlap, int) else min_overlap
    return [1 if s == t else coords.n_tiles_for(s, t, mode, m) for s, t, m in zip(shape, tile, least)]


def overlap_boxes(shape: Sequence[int], tile: Sequence[int], mode: str = coords.ALLOW, min_overlap: int | Sequence[int] = 1, key: str | None = None, seed: int = 0) -> Column:
    """An array of (tile_id, start) that covers an image by an overlap mode, of any rank; with a key each row's starts are drawn."""
    n = _counts(shape, tile, mode, min_overlap)
    draws = Draws(key, seed) if key else None
    return F.array(*_grid([axis_starts(s, t, k, draws) for s, t, k in zip(shape, tile, n)]))


def some_boxes(shape: tuple[int, int], tile: tuple[int, int], n_tiles: int, key: str | None = None, seed: int = 0) -> Column:
    """``n_tiles`` boxes (tile_id, start) of an image of two axes. With a key the starts are drawn, and of more boxes than are wanted a
    drawn choice is kept, in the order of the draws; without, the first ones are."""
    _, n = coords.stride_2d(shape, tile, n_tiles)
    if math.prod(n) < n_tiles:
        raise ValueError(f"only {math.prod(n)} tiles of {n_tiles}")
    draws = Draws(key, seed) if key else None
    made = _grid([axis_starts(s, t, k, draws) for s, t, k in zip(shape, tile, n)])
    if draws is None or len(made) == n_tiles:
        return F.array(*made[:n_tiles])
    ranked = F.array_sort(F.array(*[F.struct(draws.number().alias("u"), m["tile_id"].alias("k"), m["start"].alias("start")) for m in made]))
    return F.transform(F.slice(ranked, 1, n_tiles), lambda x, i: F.struct(i.alias("tile_id"), x["start"].alias("start")))


def _anchored(size: int, tile: int, n: Column, i: Column, low: Column, high: Column) -> Column:
    """Start of the i-th of n tiles that hold the interval from low to high as far as they can."""
    a, b = F.least(low, F.lit(size - tile)), F.greatest(high - tile + 1, F.lit(0))
    first, last = F.least(a, b), F.greatest(a, b)
    even = F.floor(first + (last - first) * (i / F.greatest(n - 1, F.lit(1))))
    return F.when(n == 1, F.floor((first + last) / 2)).when(i == n - 1, last).otherwise(even).cast("int")


def anchor_counts(shape: tuple[int, int], tile: tuple[int, int], n_tiles: int, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """A struct (y, x) of the tiles along each axis for an interval of anchors that differs by row; the rule of ``coords.stride_2d`` as
    columns. Without any room all tiles lie in one place."""
    pair = lambda y, x: F.struct(y.alias("y"), x.alias("x"))
    if n_tiles == 1:
        return pair(F.lit(1), F.lit(1))
    room = [F.least(F.lit(s - t), a, F.lit(s) - b) for s, t, a, b in zip(shape, tile, low, high)]

    def exact(r: Column) -> Column:
        half = (r["y"] + r["x"]) / (2 * (n_tiles - 1))
        stride = F.nullif(half + F.sqrt(half * half + r["y"] * r["x"] / (n_tiles - 1)), F.lit(0.0))
        return ndim.let(stride, lambda s: pair(r["y"] / s + 1, r["x"] / s + 1))

    def whole(e: Column) -> Column:
        by_x = F.abs(F.bround(e["x"]) - e["x"]) < F.abs(F.bround(e["y"]) - e["y"])
        n = F.when(by_x, pair(F.floor(n_tiles / F.bround(e["x"])).cast("double"), F.bround(e["x"]))).otherwise(pair(F.bround(e["y"]), F.floor(n_tiles / F.bround(e["y"])).cast("double")))
        return ndim.let(n, lambda w: enough(e, w))

    def enough(e: Column, w: Column) -> Column:
        short, more_x = w["y"] * w["x"] < n_tiles, F.abs(w["x"] + 1 - e["x"]) < F.abs(w["y"] + 1 - e["y"])
        count = pair((w["y"] + (short & ~more_x).cast("int")).cast("int"), (w["x"] + (short & more_x).cast("int")).cast("int"))
        return F.when(e["y"].isNull(), pair(F.lit(n_tiles), F.lit(1))).otherwise(count)

    return ndim.let(pair(*room), lambda r: ndim.let(exact(r), whole))


def anchor_boxes(shape: tuple[int, int], tile: tuple[int, int], n_tiles: int, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """``n_tiles`` boxes (tile_id, start) around each row's own interval of anchors (a column for each axis): how many lie along either
    axis differs by row, too. Fewer than ``n_tiles`` is an error."""

    def made(n: Column) -> Column:
        def box(i: Column) -> Column:
            y, x = F.floor(i / n["x"]), i % n["x"]
            start = F.array(_anchored(shape[0], tile[0], n["y"], y, low[0], high[0]), _anchored(shape[1], tile[1], n["x"], x, low[1], high[1]))
            return F.struct(i.alias("tile_id"), start.alias("start"))

        boxes = F.transform(F.sequence(F.lit(0), F.lit(n_tiles - 1)), box)
        return F.when(n["y"] * n["x"] >= n_tiles, boxes).otherwise(F.raise_error(F.lit(f"fewer than {n_tiles} tiles")))

    return ndim.let(anchor_counts(shape, tile, n_tiles, low, high), made)


def chosen_boxes(shape: Sequence[int], tile: Sequence[int], n_tiles: int, probabilities: Column, key: str, seed: int = 0) -> Column:
    """``n_tiles`` boxes drawn with replacement by a probability for each box of the ``allow`` grid; each lies around the middle of
    the box that was drawn. Probabilities that sum to nothing draw evenly."""
    whole = list(itertools.product(*[coords.axis_coords_overlap(s, t, coords.ALLOW, 0) for s, t in zip(shape, tile)]))
    middle = lambda s, a: s[a] + tile[a] / 2
    start_of = lambda m, a: int((min(m, shape[a] - tile[a]) + max(m - tile[a] + 1, 0)) // 2)
    table = F.array(*[F.array(*[F.lit(start_of(middle(s, a), a)) for a in range(len(shape))]) for s in whole])
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    weight = lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / len(whole)))
    draws = Draws(key, seed)

    def one(i: int) -> Column:
        u = draws.number()
        passed = F.aggregate(probabilities, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k")), lambda a, x: F.struct((a["c"] + weight(x)).alias("c"), (a["k"] + (a["c"] + weight(x) <= u).cast("int")).alias("k")))
        return F.struct(F.lit(i).alias("tile_id"), F.get(table, F.least(passed["k"], F.lit(len(whole) - 1))).alias("start"))

    return F.array(*[one(i) for i in range(n_tiles)])


def with_boxes(df: DataFrame, boxes: Column) -> DataFrame:
    """A row for each box: its ``tile_id`` and ``start``. Columns of these names are replaced."""
    rest = [c for c in df.columns if c not in ("tile_id", "start")]
    return df.withColumn("__b", F.explode(boxes)).select(*rest, "__b.tile_id", "__b.start")


def cut(df: DataFrame, columns: Sequence[str], shape: Sequence[int], tile: Sequence[int], channels: Mapping[str, int] | None = None, start: str = "start") -> DataFrame:
    """Columns cut to the row's box; a column with channels has them as its last axis, all of one box."""
    channels = channels or {}

    def box(c: str) -> Column:
        if c not in channels:
            return ndim.crop(F.col(c), shape, tile, F.col(start))
        n = channels[c]
        return ndim.crop(F.col(c), (*shape, n), (*tile, n), [*(F.get(start, F.lit(k)) for k in range(len(shape))), 0])

    return df.withColumns({c: box(c) for c in columns})


def jittered(df: DataFrame, shape: Sequence[int], tile: Sequence[int], n_channels: int, jitter: int | Sequence[int], key: str, seed: int = 0, out: str = "starts") -> DataFrame:
    """Adds a start for each channel around the row's ``start``, within the jitter and the image; ``tile_id`` parts the draws of a row's boxes."""
    by = [jitter] * len(shape) if isinstance(jitter, int) else jitter
    many = n_channels * len(shape)
    starts = []
    for c in range(n_channels):
        axes = []
        for a, (s, t, j) in enumerate(zip(shape, tile, by)):
            at = F.get("start", F.lit(a))
            low, high = F.greatest(at - j, F.lit(0)), F.least(at + j, F.lit(s - t))
            u = drawn(F.col(key), F.col("tile_id") * many + F.lit(c * len(shape) + a), seed)
            axes.append((low + F.floor(u * (high - low + 1))).cast("int"))
        starts.append(F.array(*axes))
    return df.withColumn(out, F.array(*starts))


def cut_by_channel(df: DataFrame, columns: Sequence[str], shape: Sequence[int], tile: Sequence[int], starts: str = "starts") -> DataFrame:
    """Columns with channels as their last axis, each channel cut to its own box."""
    return df.withColumns({c: ndim.crop_by_channel(F.col(c), shape, tile, F.col(starts)) for c in columns})


def zoomed(df: DataFrame, shape: Sequence[int], tile: Sequence[int], zoom: tuple[float, float], aspect: tuple[float, float], key: str, probability: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds ``box``, the size of what is resampled to a tile, and moves ``start`` so that it lies inside.

    A zoom above 1 takes less of the image and shows it larger; one below 1 takes as much more as fits. The aspect is that of further
    axes to the first. Both, and whether a tile is zoomed at all, are drawn from the row's key and tile.
    """
    rank = len(shape)
    least, most = 1 / max(zoom), min(1 / min(zoom), *(s / t for s, t in zip(shape, tile)))
    narrow, wide = 1 / max(aspect), 1 / min(aspect)
    u = [drawn(F.col(key), F.col("tile_id") * (rank + 1) + F.lit(k), seed) for k in range(rank + 1)]
    z = F.when(u[0] < probability, least + u[1] * (most - least)).otherwise(1.0)
    sizes = [F.greatest(F.bround(z * tile[0]), F.lit(1)).cast("int")]
    for a in range(1, rank):
        top = F.least(shape[a] / (z * tile[a]), F.lit(wide))
        ratio = F.when(u[0] < probability, narrow + u[a + 1] * (top - narrow)).otherwise(1.0)
        sizes.append(F.least(F.greatest(F.bround(z * ratio * tile[a]), F.lit(1)), F.lit(shape[a])).cast("int"))
    out = df.withColumn("box", F.array(*sizes))
    moved = [F.least(F.get("start", F.lit(a)), F.lit(shape[a]) - F.get("box", F.lit(a))) for a in range(rank)]
    return out.withColumn("start", F.array(*moved))


def resampled(df: DataFrame, columns: Sequence[str], shape: tuple[int, ...], tile: tuple[int, ...], orders: Mapping[str, int] | None = None, start: str = "start", box: str = "box") -> DataFrame:
    """Columns cut to the given boxes and resampled to the tile, all in one pass of Arrow batches; ``orders`` has the order of the spline of
    each column (1 if none is given, 0 for labels)."""
    orders = {c: (orders or {}).get(c, 1) for c in columns}

    @F.pandas_udf(", ".join(f"{c} array<double>" for c in columns))
    def run(starts: pd.Series, boxes: pd.Series, *data: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in columns}
        for row in zip(starts, boxes, *data):
            window = tuple(slice(int(s), int(s) + int(b)) for s, b in zip(row[0], row[1]))
            for c, d in zip(columns, row[2:]):
                out[c].append(kernels.zoomed(np.asarray(d, dtype=np.float64).reshape(shape)[window], tile, orders[c]).ravel())
        return pd.DataFrame(out)

    made = df.withColumn("__r", run(F.col(start), F.col(box), *[F.col(c) for c in columns]))
    return made.withColumns({c: F.col(f"__r.{c}") for c in columns}).drop("__r")
