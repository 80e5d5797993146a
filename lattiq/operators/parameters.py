"""Augmentation with its parameters as data: drawn into a struct column, adjusted there, kept or given, then applied to all channels
of a row in one pass of Arrow batches.

The struct has ``geometry``, the same for all channels of a row, and for each channel that is no mask a struct of its own; a field that a
step does not use is null. Draws are digests of the row's key, so SQL repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import images, kernels
from lattiq.functions.draws import drawn
from lattiq.operators import augment
from lattiq.operators.augment import Geometry, Illumination, Pipeline, Scaling

GEOMETRY = "struct<theta:double,tx:double,ty:double,shear:double,zy:double,zx:double,flip_y:boolean,flip_x:boolean,brightness:double>"
SCALING = "struct<low:double,high:double,center:double,scale:double>"
ILLUMINATION = "struct<deltas:array<double>,y:array<double>,x:array<double>,grid:array<double>,blur:double,gaussian:double,poisson:double,speckle:double,noise:bigint>"
#: Pairs of ranks that are drawn until one is in order; if none is, the last one is turned around.
_TRIES = 4


class _Draws:
    def __init__(self, key: str, seed: int, first: int):
        self.key, self.seed, self.at = F.col(key), seed, first

    def __call__(self, low: float = 0.0, high: float = 1.0) -> Column:
        """The next draw, from low to high."""
        u = drawn(self.key, self.at, self.seed)
        self.at += 1
        return u if (low, high) == (0.0, 1.0) else F.lit(float(low)) + u * F.lit(float(high) - float(low))

    def several(self, n: int, low: float, high: float) -> Column:
        first = self.at
        self.at += n
        return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: F.lit(float(low)) + drawn(self.key, k, self.seed) * F.lit(float(high) - float(low)))


def _struct(kind: str, **fields: Column) -> Column:
    names = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]
    types = [f.split(":", 1)[1] for f in kind[len("struct<") : -1].split(",")]
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in zip(names, types)])


def geometry(g: Geometry, key: str, seed: int = 0, first: int = 0) -> Column:
    """Drawn numbers ``first`` to ``first`` + 8: rotation, shifts, shear, zooms, flips and brightness."""
    u = _Draws(key, seed, first)
    both = lambda r: u(-r, r) * 1.0
    out = {"theta": both(g.rotation), "tx": both(g.shift_y), "ty": both(g.shift_x), "shear": both(g.shear), "zy": u(*g.zoom), "zx": u(*g.zoom)}
    out |= {"flip_y": (u() < 0.5) & F.lit(g.flip_y), "flip_x": (u() < 0.5) & F.lit(g.flip_x)}
    return _struct(GEOMETRY, **out, **({"brightness": u(*g.brightness)} if g.brightness else {}))


def scaling(s: Scaling, key: str, seed: int = 0, first: int = 0) -> Column:
    """Places between centiles (low, high), an interval to scale to (low, high), or (center, scale), by the mode."""
    u = _Draws(key, seed, first)
    if s.mode == augment.RANDOM_CENTILES:
        rank = lambda ends, x: ends[0] + (ends[1] - ends[0]) * x
        pairs = [F.struct(u().alias("a"), u().alias("b")) for _ in range(_TRIES if s.centiles_low[1] >= s.centiles_high[0] else 1)]
        ordered = [F.when(rank(s.centiles_low, p["a"]) < rank(s.centiles_high, p["b"]), p) for p in pairs]
        p = F.coalesce(*ordered, F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
        return _struct(SCALING, low=p["a"], high=p["b"])
    if s.mode == augment.RANDOM_MIN_MAX:
        low, high = s.value_range
        if s.least_width > high - low:
            raise ValueError("the range is narrower than its least width")
        a = u(low, high - s.least_width)
        start = a + s.least_width
        return _struct(SCALING, low=a, high=start + u() * (F.lit(float(high)) - start))
    if s.mode == augment.CONSTANT:
        return _struct(SCALING, center=F.lit(sum(s.center_range) / 2), scale=F.lit(sum(s.scale_range) / 2))
    return _struct(SCALING, center=u(*s.center_range), scale=u(*s.scale_range))


def illumination(i: Illumination, key: str, seed: int = 0, first: int = 0) -> Column:
    """Offsets of the histogram's points, curves or a grid of light, blur, the level of each noise (null where a coin left it out), and the
    number that begins the noise."""
    u = _Draws(key, seed, first)
    out: dict[str, Column] = {"blur": u(*i.blur), "noise": F.floor(u() * 2**32)}
    light = ((1 - i.variation) / 2, (1 + i.variation) / 2)
    if i.points:
        out["deltas"] = F.concat(F.array(F.lit(0.0)), u.several(i.points, -1, 1), F.array(F.lit(0.0)))
    if i.grid and i.variation:
        out["grid"] = u.several(math.prod(i.grid), *light)
    else:
        for axis, n in zip("yx", i.points_yx):
            if n and i.variation:
                out[axis] = u.several(n, *light)
    names = [k for k in ("gaussian", "poisson", "speckle") if getattr(i, k)]
    coins = {k: u() < 0.5 for k in names}
    on = sum((c.cast("int") for c in coins.values()), F.lit(0))
    most = F.lit(i.noise) / F.pow(F.lit(1.5), on - 1)
    for k, c in coins.items():
        out[k] = F.when(c, u() * most * (0.7 if k == "gaussian" else 1.0))
    return _struct(ILLUMINATION, **out)


def with_parameters(df: DataFrame, p: Pipeline, columns: Sequence[str], key: str, masks: Sequence[str] = (), out: str = "aug") -> DataFrame:
    """Adds the parameters of every row. Without randomness, geometry and illumination are null, and the fields of
    scaling are, which stands for the middle of its ranges."""
    steps = {type(s): s for s in p.steps if not isinstance(s, augment.Function)}
    if len(steps) < sum(not isinstance(s, augment.Function) for s in p.steps):
        raise ValueError("a pipeline has each kind of step once")
    fields = []
    if Geometry in steps:
        fields.append((geometry(steps[Geometry], key, p.seed) if p.random else F.lit(None).cast(GEOMETRY)).alias("geometry"))
    for c, name in enumerate(columns):
        if name in masks:
            continue
        own = []
        if Scaling in steps:
            own.append((scaling(steps[Scaling], key, p.seed, 1000 * (c + 1)) if p.random else _struct(SCALING)).alias("scaling"))
        if Illumination in steps:
            own.append((illumination(steps[Illumination], key, p.seed, 1000 * (c + 1) + 100) if p.random else F.lit(None).cast(ILLUMINATION)).alias("illumination"))
        if own:
            fields.append(F.struct(*own).alias(name))
    return df.withColumn(out, F.struct(*(fields or [F.lit(None).cast(GEOMETRY).alias("geometry")])))


def adjusted(df: DataFrame, mask: str, adjust: Callable[[Column, Column], Column], params: str = "aug") -> DataFrame:
    """The geometry of each row as ``adjust`` makes it from the drawn one and the row's mask, before anything is applied."""
    return df.withColumn(params, F.col(params).withField("geometry", adjust(F.col(f"{params}.geometry"), F.col(mask))))


def keep_at_borders(shape: tuple[int, int]) -> Callable[[Column, Column], Column]:
    """For ``adjusted``: where an object touches the first or last row, nothing moves it off: no rotation, shear, shift or zoom in y."""

    def adjust(g: Column, mask: Column) -> Column:
        b = images.touches_y_borders(mask, shape)
        held = g
        for name, still in (("theta", 0.0), ("shear", 0.0), ("tx", 0.0), ("zy", 1.0)):
            held = held.withField(name, F.lit(still))
        return F.when(b[0] | b[1], held).otherwise(g)

    return adjust


def _given(step: augment.Generator, values: Mapping) -> dict:
    """What a step's ``apply`` takes, from the fields of its struct."""
    p = {k: v for k, v in values.items() if v is not None and not (isinstance(v, float) and math.isnan(v))}
    if isinstance(step, Scaling):
        if not p:
            return step.constant()
        return {"to": (p["low"], p["high"])} if step.mode == augment.RANDOM_MIN_MAX else p
    if isinstance(step, Geometry):
        return p | {k: bool(p[k]) for k in ("flip_y", "flip_x") if k in p}
    arrays = {k: np.asarray(p[k], dtype=np.float64) for k in ("deltas", "y", "x", "grid") if k in p}
    return {k: v for k, v in p.items() if k != "noise"} | arrays


def augmented(image: np.ndarray, steps: Sequence[augment.Generator], geometry: Mapping | None, own: Mapping | None, mask: bool = False) -> np.ndarray:
    """One image through all steps by given parameters; a mask only moves, by the nearest pixel."""
    for step in steps:
        if isinstance(step, Geometry):
            if geometry is not None:
                image = (augment.replace(step, order=0) if mask else step).apply(image, _given(step, geometry | {"brightness": None} if mask else geometry))
        elif isinstance(step, augment.Function):
            image = image if mask else step.f(image)
        elif not mask and own is not None:
            values = own.get("scaling" if isinstance(step, Scaling) else "illumination")
            if values is not None:
                image = step.apply(image, _given(step, values), np.random.default_rng(int(values.get("noise") or 0)))
    return image


def apply_parameters(df: DataFrame, p: Pipeline, columns: Sequence[str], shape: tuple[int, ...], masks: Sequence[str] = (), params: str = "aug") -> DataFrame:
    """Columns of flat images through all steps, by the parameters in each row; null images stay null. All channels of a row are
    augmented in one Arrow pass."""

    @F.pandas_udf(", ".join(f"{c} array<double>" for c in columns))
    def run(given: pd.DataFrame, *data: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in columns}
        for values, *row in zip(given.to_dict("records"), *data):
            for c, d in zip(columns, row):
                image = None if d is None else np.asarray(d, dtype=np.float64).reshape(shape)
                out[c].append(None if image is None else np.asarray(augmented(image, p.steps, values.get("geometry"), values.get(c), c in masks), dtype=np.float64).ravel())
        return pd.DataFrame(out)

    made = df.withColumn("__a", run(F.col(params), *[F.col(c) for c in columns]))
    return made.withColumns({c: F.col(f"__a.{c}") for c in columns}).drop("__a")


def with_channels_processed(df: DataFrame, column: str, p: Pipeline, channels: Sequence[int], shape: tuple[int, ...], key: str) -> DataFrame:
    """A column of images (rows, columns, channels): the chosen channels, each an image of its own, by one draw for the row."""
    rows = with_parameters(df, p, [column], key, out="__p")

    @F.pandas_udf("array<double>")
    def run(given: pd.DataFrame, data: pd.Series) -> pd.Series:
        out = []
        for values, d in zip(given.to_dict("records"), data):
            if d is not None:
                d = np.array(d, dtype=np.float64).reshape(shape)
                for c in channels:
                    d[..., c] = augmented(d[..., c], p.steps, values.get("geometry"), values.get(column))
                d = d.ravel()
            out.append(d)
        return pd.Series(out)

    return rows.withColumn(column, run(F.col("__p"), F.col(column))).drop("__p")


def scaling_function(mode: str = augment.RANDOM_CENTILES, **options) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    """A function that scales an image by parameters it draws."""
    s = Scaling(mode, **options)
    return lambda image, rng: s.apply(image, s.draw(rng), rng)


def scaling_of(df: DataFrame, mode: str, channel: str | None = None, **options) -> Scaling:
    """A Scaling whose ranges come from the data: values (column v) of all datasets that are to share it."""
    from lattiq.operators import stats

    if mode == augment.RANDOM_MIN_MAX:
        low0, low1, high0, high1 = stats.min_max_range(df)
        return Scaling(mode, value_range=(low0, high1), least_width=max(high0 - low1, 0.0), **options)
    if mode in (augment.FLUORESCENCE, augment.BRIGHT_FIELD):
        center, scale = stats.center_scale_range(df, fluorescence=mode == augment.FLUORESCENCE, channel=channel)
        return Scaling(mode, center_range=tuple(center), scale_range=tuple(scale), **options)
    return Scaling(mode, **options)
