"""Augmentation as generators that first draw parameters and then apply them.

A generator's draw is a pure function of (seed, row key), so retries and reruns agree; ``apply`` with given parameters is the
deterministic half. All channels of a row share geometry; intensities are drawn for each channel by its own seed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from lattiq.functions import kernels

RANDOM_CENTILES, RANDOM_MIN_MAX, FLUORESCENCE, BRIGHT_FIELD, CONSTANT = "RANDOM_CENTILES", "RANDOM_MIN_MAX", "FLUORESCENCE", "BRIGHT_FIELD", "CONSTANT"


def draw_range(rng: np.random.Generator, least_width: float, low: float, high: float) -> tuple[float, float]:
    """A random part of [low, high] that is at least so wide."""
    if least_width > high - low:
        raise ValueError("the range is narrower than its least width")
    if least_width == high - low:
        return low, high
    a = rng.uniform(low, high - least_width)
    return a, rng.uniform(a + least_width, high)


@dataclass(frozen=True)
class Scaling:
    """Intensity scaling in one of five modes."""

    mode: str = RANDOM_CENTILES
    centiles_low: tuple[float, float] = (0.1, 5)
    centiles_high: tuple[float, float] = (95, 99.9)
    saturation: tuple[float, float] = (1.0, 1.0)
    least_width: float = 0.1
    value_range: tuple[float, float] = (0.0, 1.0)
    center_range: tuple[float, float] = (0.0, 0.0)
    scale_range: tuple[float, float] = (1.0, 1.0)
    per_image: bool = False

    def __post_init__(self) -> None:
        if self.mode not in (RANDOM_CENTILES, RANDOM_MIN_MAX, FLUORESCENCE, BRIGHT_FIELD, CONSTANT):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode == FLUORESCENCE and self.per_image:
            raise NotImplementedError("fluorescence scales are of data sets, not of images")

    def draw(self, rng: np.random.Generator) -> dict:
        if self.mode == RANDOM_CENTILES:
            # places between the values at either end's two percentiles; the ranks there must be in order
            rank = lambda ends, u: ends[0] + (ends[1] - ends[0]) * u
            while True:
                u, v = rng.random(2)
                if rank(self.centiles_low, u) < rank(self.centiles_high, v):
                    return {"low": u, "high": v}
        if self.mode == RANDOM_MIN_MAX:
            return {"to": draw_range(rng, self.least_width, *self.value_range)}
        if self.mode == CONSTANT:
            return self.constant()
        return {"center": rng.uniform(*self.center_range), "scale": rng.uniform(*self.scale_range)}

    def constant(self) -> dict:
        if self.mode == RANDOM_CENTILES:
            return {"ranks": (sum(self.centiles_low) / 2, sum(self.centiles_high) / 2)}
        if self.mode == RANDOM_MIN_MAX:
            return {"to": (0.0, 1.0)}
        return {"center": sum(self.center_range) / 2, "scale": sum(self.scale_range) / 2}

    def apply(self, image: np.ndarray, p: dict, rng: np.random.Generator | None = None) -> np.ndarray:
        if self.mode == RANDOM_CENTILES:
            if "ranks" in p:
                lo, hi = np.percentile(image, p["ranks"])
            else:
                a, b, c, d = np.percentile(image, [*self.centiles_low, *self.centiles_high])
                lo, hi = a + (b - a) * p["low"], c + (d - c) * p["high"]
            y = (image - lo) / ((hi - lo) or 1.0)
            lower, upper = self.saturation
            below = np.zeros_like(y) if lower == 0 else -np.power(np.where(y < 0, -y, 0), lower)
            above = np.ones_like(y) if upper == 0 else np.power(np.where(y > 1, y, 1), upper)
            return np.where(y < 0, below, np.where(y > 1, above, y))
        if self.mode == RANDOM_MIN_MAX:
            return kernels.rescaled(image, *p["to"])
        c, s = p["center"], p["scale"]
        if self.mode == BRIGHT_FIELD and self.per_image:
            c, s = c * image.std() + image.mean(), s * image.std()
        y = (image - c) / s
        upper = self.saturation[1]
        return y if upper == 1 else np.where(y > 1, 1.0 if upper == 0 else np.power(np.maximum(y, 1), upper), y)


@dataclass(frozen=True)
class Illumination:
    """Deforms the histogram, varies illumination, blurs, then adds noises; each noise by a coin, with a level of its own."""

    points: int = 5
    deform: float = 0.5
    points_yx: tuple[int, int] = (0, 0)
    grid: tuple[int, int] | None = None
    variation: float = 0.6
    blur: tuple[float, float] = (0.0, 2.0)
    noise: float = 0.1
    gaussian: bool = True
    poisson: bool = True
    speckle: bool = False

    def draw(self, rng: np.random.Generator) -> dict:
        p: dict = {"blur": rng.uniform(*self.blur)}
        if self.points:
            d = rng.uniform(-1, 1, self.points + 2)
            d[0] = d[-1] = 0
            p["deltas"] = d
        if self.grid and self.variation:
            p["grid"] = rng.uniform((1 - self.variation) / 2, (1 + self.variation) / 2, self.grid)
        for axis, n in zip("yx", self.points_yx):
            if n and self.variation and not self.grid:
                p[axis] = rng.uniform((1 - self.variation) / 2, (1 + self.variation) / 2, n)
        on = [k for k in ("gaussian", "poisson", "speckle") if getattr(self, k) and rng.random() < 0.5]
        most = self.noise / 1.5 ** (len(on) - 1)
        return p | {k: rng.uniform(0, most * (0.7 if k == "gaussian" else 1.0)) for k in on}

    def constant(self) -> dict:
        return {}

    def apply(self, image: np.ndarray, p: dict, rng: np.random.Generator | None = None) -> np.ndarray:
        rng = rng or np.random.default_rng(0)
        if "deltas" in p:
            image = kernels.histogram_deform(image, p["deltas"], self.deform)
        if "grid" in p:
            image = kernels.illumination(image, None, None, np.reshape(p["grid"], self.grid))
        if "y" in p or "x" in p:
            y, x = p.get("y"), p.get("x")
            if y is not None and x is not None:  # each pixel is multiplied by both curves
                y, x = np.sqrt(y), np.sqrt(x)
            image = kernels.illumination(image, y, x)
        if p.get("blur", 0) > 0.33:
            image = kernels.gaussian_blur(image, p["blur"])
        for k, f in (("gaussian", kernels.gaussian_noise), ("poisson", kernels.poisson_noise), ("speckle", kernels.speckle_noise)):
            if p.get(k):
                image = f(image, p[k], rng)
        return image


@dataclass(frozen=True)
class Geometry:
    """Rotation, shifts, shear, zoom, flips and brightness. Shifts under 1 are parts of the image."""

    rotation: float = 0
    shift_y: float = 0
    shift_x: float = 0
    shear: float = 0
    zoom: tuple[float, float] = (1.0, 1.0)
    flip_y: bool = False
    flip_x: bool = False
    brightness: tuple[float, float] | None = None
    order: int = 1

    def draw(self, rng: np.random.Generator) -> dict:
        u = lambda r: rng.uniform(-r, r) if r else 0.0
        p = {"theta": u(self.rotation), "tx": u(self.shift_y), "ty": u(self.shift_x), "shear": u(self.shear)}
        p |= {"zy": rng.uniform(*self.zoom), "zx": rng.uniform(*self.zoom), "flip_y": bool(self.flip_y and rng.random() < 0.5), "flip_x": bool(self.flip_x and rng.random() < 0.5)}
        return p | ({"brightness": rng.uniform(*self.brightness)} if self.brightness else {})

    def constant(self) -> dict:
        return {}

    def apply(self, image: np.ndarray, p: dict, rng: np.random.Generator | None = None) -> np.ndarray:
        p = dict(p)
        b = p.pop("brightness", 1.0)
        if not p:
            return image * b
        p = {"theta": 0.0, "tx": 0.0, "ty": 0.0} | p
        p["tx"] *= image.shape[0] if abs(self.shift_y) < 1 else 1
        p["ty"] *= image.shape[1] if abs(self.shift_x) < 1 else 1
        return kernels.affine(image, **p, order=self.order) * b


@dataclass(frozen=True)
class Function:
    """A function of the image; always applied."""

    f: Callable[[np.ndarray], np.ndarray]

    def draw(self, rng: np.random.Generator) -> dict:
        return {}

    def constant(self) -> dict:
        return {}

    def apply(self, image: np.ndarray, p: dict, rng: np.random.Generator | None = None) -> np.ndarray:
        return self.f(image)


Generator = Scaling | Illumination | Geometry | Function


@dataclass(frozen=True)
class Pipeline:
    """Generators one after the other; geometry of a row is the same for all channels."""

    steps: Sequence[Generator]
    seed: int = 0
    random: bool = True

    def deterministic(self) -> Pipeline:
        """As for evaluation: constant parameters, no random geometry or noise."""
        return replace(self, random=False)

    def image(self, image: np.ndarray, key: int, channel: int = 0, mask: bool = False) -> np.ndarray:
        for k, step in enumerate(self.steps):
            shared = isinstance(step, Geometry)
            if mask and not shared:
                continue
            rng = np.random.default_rng([self.seed & 0xFFFFFFFF, key & 0xFFFFFFFFFFFF, k, 0 if shared else channel + 1])
            p = step.draw(rng) if self.random else step.constant()
            s = replace(step, order=0) if mask and shared else step
            image = s.apply(image, p, rng)
        return image

    def apply(self, df: DataFrame, columns: Sequence[str], key: str, shape: tuple[int, ...], masks: Sequence[str] = (), keep: str | None = None) -> DataFrame:
        """Columns of flat images, all through all steps in one Arrow pass; masks only move. ``keep`` names a column that takes the
        parameters."""
        from lattiq.operators import parameters

        name = keep or "__aug"
        rows = parameters.with_parameters(df, self, columns, key, masks, name)
        out = parameters.apply_parameters(rows, self, columns, shape, masks, name)
        return out if keep else out.drop(name)


def pipeline(scaling: Scaling | None = None, illumination: Illumination | None = None, geometry: Geometry | None = None, **options) -> Pipeline:
    """In this order, whatever is given."""
    return Pipeline([s for s in (scaling, illumination, geometry) if s is not None], **options)
