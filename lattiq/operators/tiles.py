"""Tiles as table functions: one image to several, by coordinate lists or by ranges of exploded pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import coords, images
from lattiq.functions.draws import drawn
from lattiq.operators import boxes
from lattiq.operators.positions import hash_order


def tile_starts(shape: tuple[int, int], tile: tuple[int, int], mode: str = coords.ALLOW, min_overlap: int = 1, n_tiles: int | None = None, anchors: tuple[tuple[int, int], tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Starts by overlap mode, by number of tiles, or around an interval of anchors."""
    if n_tiles is None:
        return coords.grid(*[coords.axis_coords_overlap(s, t, mode, min_overlap) for s, t in zip(shape, tile)])
    _, count = coords.stride_2d(shape, tile, n_tiles, anchors)
    if anchors is not None:
        axes = [coords.anchor_axis_coords(s, t, c, a) for s, t, c, a in zip(shape, tile, count, anchors)]
    else:
        axes = [coords.axis_coords(s, t, c) for s, t, c in zip(shape, tile, count)]
    starts = coords.grid(*axes)
    if len(starts) < n_tiles:
        raise ValueError(f"only {len(starts)} tiles of {n_tiles}")
    return starts[:n_tiles]


def extract_tiles(df: DataFrame, columns: Sequence[str], shape: tuple[int, int], tile: tuple[int, int], starts: Sequence[tuple[int, int]]) -> DataFrame:
    """One row for each tile: tile_id, tile_y, tile_x, and the columns cropped alike. Tile-major order is (tile_id, row)."""
    table = F.array(*[F.struct(F.lit(i).alias("tile_id"), F.lit(y).alias("tile_y"), F.lit(x).alias("tile_x")) for i, (y, x) in enumerate(starts)])
    out = df.withColumn("__t", F.explode(table)).select(*df.columns, "__t.tile_id", "__t.tile_y", "__t.tile_x")
    w = shape[1]

    def box(c: str) -> Column:
        rows = F.sequence(F.lit(0), F.lit(tile[0] - 1))
        return F.flatten(F.transform(rows, lambda r: F.slice(F.col(c), ((F.col("tile_y") + r) * w + F.col("tile_x") + 1).cast("int"), F.lit(tile[1]))))

    return out.withColumns({c: box(c) for c in columns})


def tile_function(columns: Sequence[str], shape: tuple[int, int], tile: tuple[int, int], **options):
    """For DataFrame.transform."""
    starts = tile_starts(shape, tile, **options)
    return lambda df: extract_tiles(df, columns, shape, tile, starts)


def augmented_tiles(df: DataFrame, columns: Sequence[str], shape: tuple[int, int], rotate: bool = True) -> DataFrame:
    """Four times the rows (three flips), or eight with quarter turns; ``aug`` says which."""
    ks = range(8 if rotate else 4)
    out = df.withColumn("aug", F.explode(F.array(*[F.lit(k) for k in ks])))
    return out.withColumns({c: F.element_at(F.array(*[images.dihedral(F.col(c), shape, k) for k in ks]), F.col("aug") + 1) if len(ks) == 1 else _by_aug(c, shape, ks) for c in columns})


def _by_aug(c: str, shape: tuple[int, int], ks: range) -> Column:
    out = F.lit(None)
    for k in ks:
        out = F.when(F.col("aug") == k, images.dihedral(F.col(c), shape, k)).otherwise(out)
    return out


def augmented_in_place(df: DataFrame, columns: Sequence[str], shape: tuple[int, int], key: str, rotate: bool = True, seed: int = 0) -> DataFrame:
    """One of the symmetries for each row, drawn by hash, the same for all columns."""
    n = 8 if rotate else 4
    out = df.withColumn("aug", F.pmod(F.floor(hash_order(key, seed) / 65536), F.lit(n)).cast("int"))
    return out.withColumns({c: _by_aug(c, shape, range(n)) for c in columns})


def mask_anchor_intervals(masks: DataFrame, shape: tuple[int, int], mask: str, *by: str, jitter: int = 0) -> DataFrame:
    """For each group the interval of its masks' centres on both axes, widened by the jitter and held inside the image."""
    c = masks.withColumn("__c", images.center_of_mass(F.col(mask), shape))
    at = lambda f, a, s: f(F.col("__c")[a]) + s
    hold = lambda col, n: F.greatest(F.least(col, F.lit(n - 1)), F.lit(0)).cast("int")
    ends = [hold(at(f, a, s), shape[a]).alias(name) for a, ax in ((0, "y"), (1, "x")) for f, s, name in ((lambda v: F.floor(F.min(v)), -jitter, f"{ax}0"), (lambda v: F.ceil(F.max(v)), jitter, f"{ax}1"))]
    return c.groupBy(*by).agg(*ends)


def chosen_tiles(df: DataFrame, weights: str, n_draws: int, key: str, seed: int = 0, out: str = "tile_id") -> DataFrame:
    """``n_draws`` tiles for each row, with replacement, by an array of weights; the draws come from a hash of key and number.
    Rows whose weights sum to nothing draw evenly."""
    w = F.col(weights)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    even = F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(w)))
    u = hash_order(key, seed, n_draws, F.col("draw")) / F.lit(4294967296.0)
    pick = F.aggregate("__w", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["k"] + F.when(a["sum"] + x <= F.col("__u"), 1).otherwise(0)).alias("k")), lambda a: F.least(a["k"], F.size("__w") - 1))
    return df.withColumn("__w", even).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("__u", u).withColumn(out, pick).drop("__w", "__u")


def zoomed_tiles(df: DataFrame, columns: Sequence[str], shape: tuple[int, int], tile: tuple[int, int], starts: Sequence[tuple[int, int]], key: str, zoom: tuple[float, float] = (1.0, 1.0), aspect: tuple[float, float] = (1.0, 1.0), probability: float = 1.0, jitter: int = 0, masks: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Tiles whose boxes are zoomed, moved back inside the image and resampled to the tile's shape, all columns in one pass.

    Zoom, aspect and jitter are columns drawn from (seed, key, tile), so all columns share them and SQL can repeat them; masks are resampled
    by the nearest pixel.
    """
    table = F.array(*[F.struct(F.lit(i).alias("tile_id"), F.array(*map(F.lit, s)).alias("start")) for i, s in enumerate(starts)])
    out = boxes.with_boxes(df, table)
    at = lambda a: F.get("start", F.lit(a))
    u = [drawn(F.col(key), F.col("tile_id") * 2 + F.lit(a), seed + 1) for a in (0, 1)]
    moved = [F.least(F.greatest(at(a) - jitter + F.floor(u[a] * (2 * jitter + 1)), F.lit(0)), F.lit(shape[a] - tile[a])) for a in (0, 1)]
    out = out.withColumns({"tile_y": at(0), "tile_x": at(1)}).withColumn("start", F.array(*moved).cast("array<int>") if jitter else F.col("start"))
    out = boxes.zoomed(out, shape, tile, zoom, aspect, key, probability, seed)
    return boxes.resampled(out, columns, shape, tile, {c: 0 for c in masks})
