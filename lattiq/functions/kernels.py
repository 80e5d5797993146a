"""Numerical kernels that columns cannot express: numpy on one image, wrapped for Arrow batches of images."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import splines


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable over the first two axes, edges mirrored with the edge value repeated; 0 changes nothing."""
    if sigma <= 0:
        return image
    w = gaussian_kernel(sigma)
    r, out = len(w) // 2, image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        i = np.abs(np.arange(-r, n + r) + 0.5).astype(int) % (2 * n)
        i = np.where(i >= n, 2 * n - 1 - i, i)
        out = sum(x * out.take(i[k : k + n], axis=axis) for k, x in enumerate(w))
    return out


def pchip(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Shape-preserving cubic through the points (Fritsch and Carlson's slopes by weighted harmonic means)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h = np.diff(x)
    s = np.diff(y) / h
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = s[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = s[1:] * s[:-1] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            d[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)

        def end(h0: float, h1: float, s0: float, s1: float) -> float:
            v = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if v * s0 <= 0:
                return 0.0
            return 3 * s0 if s0 * s1 <= 0 and abs(v) > 3 * abs(s0) else v

        d[0], d[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])

    def at(v: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(x, v, side="right") - 1, 0, len(h) - 1)
        t = (v - x[k]) / h[k]
        return y[k] * (1 + 2 * t) * (1 - t) ** 2 + d[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + d[k + 1] * h[k] * t * t * (t - 1)

    return at


def histogram_deform(image: np.ndarray, deltas: np.ndarray, intensity: float = 0.5) -> np.ndarray:
    """Values through a monotone curve of jittered points; its ends stay."""
    lo, hi = float(image.min()), float(image.max())
    if hi == lo:
        return image
    points = np.linspace(lo, hi, len(deltas))
    target = points + np.asarray(deltas) * intensity * (hi - lo) / (len(deltas) - 1)
    target[0], target[-1] = lo, hi
    return pchip(points, target)(image)


def rescaled(image: np.ndarray, lo: float, hi: float) -> np.ndarray:
    a, b = float(image.min()), float(image.max())
    return np.full_like(image, lo) if a == b else (image - a) / (b - a) * (hi - lo) + lo


def illumination(image: np.ndarray, points_y: np.ndarray | None, points_x: np.ndarray | None, grid: np.ndarray | None = None) -> np.ndarray:
    """Multiplied by a curve along each axis, or by a bilinear grid; then brought back to its range."""
    lo, hi = float(image.min()), float(image.max())
    out = image - lo
    extra = (1,) * (image.ndim - 2)
    if grid is not None:
        gy, gx = (np.linspace(0, n - 1, m) for n, m in zip(image.shape, grid.shape))
        rows = np.stack([np.interp(np.arange(image.shape[1]), gx, g) for g in grid])
        field = np.stack([np.interp(np.arange(image.shape[0]), gy, c) for c in rows.T], axis=1)
        return rescaled(out * field.reshape(*field.shape, *extra), lo, hi)
    for axis, p in ((0, points_y), (1, points_x)):
        if p is not None and len(p):
            n = image.shape[axis]
            curve = pchip(np.linspace(0, n - 1, len(p)), p)(np.arange(n, dtype=float))
            out = out * curve.reshape((n, 1) if axis == 0 else (1, n)).reshape(*((n, 1) if axis == 0 else (1, n)), *extra)
    return rescaled(out, lo, hi)


def gaussian_noise(image: np.ndarray, sigma: float, rng: np.random.Generator, to_range: bool = False) -> np.ndarray:
    s = sigma * float(image.max() - image.min()) if to_range else sigma
    return image + rng.normal(0, s, image.shape)


def poisson_noise(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    lo, hi = float(image.min()), float(image.max())
    if hi == lo:
        return image
    lam = intensity / 10
    return rng.poisson((image - lo) / (hi - lo) / lam) * lam * (hi - lo) + lo


def speckle_noise(image: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    lo = float(image.min())
    return (image - lo) * rng.normal(1, sigma, image.shape) + lo


def _mirrored(c: np.ndarray, n: int) -> np.ndarray:
    c = np.abs(c) % (2 * n - 2) if n > 1 else np.zeros_like(c)
    return np.where(c > n - 1, 2 * n - 2 - c, c)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, order: int = 1) -> np.ndarray:
    """The image at real coordinates, mirrored beyond its edges; order 0 takes the nearest pixel, 1 is bilinear, 2 to 5 are B-splines."""
    if order >= 2:
        return splines.sampled(image, y, x, order)
    y, x = _mirrored(y, image.shape[0]), _mirrored(x, image.shape[1])
    if order == 0:
        return image[np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = y - y0, x - x0
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def zoomed(image: np.ndarray, shape: tuple[int, ...], order: int = 1) -> np.ndarray:
    """Its first axes resampled to a shape, corners on corners, by the nearest value (0), linearly (1) or by B-splines (2 to 5)."""
    if tuple(image.shape[: len(shape)]) == tuple(shape):
        return image
    out = image
    if order >= 2:
        return splines.resized(image, shape, order)
    for axis, m in enumerate(shape):
        n = out.shape[axis]
        if n == m:
            continue
        at = np.linspace(0, n - 1, m)
        if order == 0:
            out = out.take(np.minimum(np.floor(at + 0.5).astype(int), n - 1), axis=axis)
        else:
            low = np.floor(at).astype(int)
            part = (at - low).reshape(-1, *[1] * (out.ndim - axis - 1))
            out = out.take(low, axis=axis) * (1 - part) + out.take(np.minimum(low + 1, n - 1), axis=axis) * part
    return out


def affine(image: np.ndarray, theta: float = 0, tx: float = 0, ty: float = 0, shear: float = 0, zy: float = 1, zx: float = 1, flip_y: bool = False, flip_x: bool = False, order: int = 1) -> np.ndarray:
    """Degrees and pixels, around the centre: output pixels look up their place in the input."""
    a, s = math.radians(theta), math.radians(shear)
    m = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) @ np.array([[1, -math.sin(s)], [0, math.cos(s)]]) @ np.diag([zy, zx])
    c = (np.array(image.shape[:2]) - 1) / 2
    y, x = np.meshgrid(np.arange(image.shape[0]), np.arange(image.shape[1]), indexing="ij")
    p = np.stack([y - c[0] + tx, x - c[1] + ty])
    q = np.tensordot(m, p, axes=1) + c[:, None, None]
    out = sampled(image, q[0], q[1], order)
    return out[:: -1 if flip_y else 1, :: -1 if flip_x else 1]


#: Defaults of elastic deformation: pixels between points of the grid, and the deviation as a part of that.
GRID, SIGMA_PART = 15, 1 / 9


def elastic_field(shape: tuple[int, ...], grid_spacing: int = GRID, sigma: float | None = None, seed: int = 0, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Displacements (y, x) of each pixel: a coarse field, zero at the edges and held to a quarter of the spacing, spread by splines.
    Without ``sigma`` the deviation is ``SIGMA_PART`` of the smaller spacing."""
    rng = np.random.default_rng(seed)
    points = [max(5, 1 + n // grid_spacing) for n in shape[:2]]
    step = [n / (p - 1) for n, p in zip(shape, points)]
    sigma = SIGMA_PART * min(step) if sigma is None else sigma
    out = []
    for s in step:
        f = np.clip(rng.normal(0, sigma, points), -s / 4, s / 4)
        f[[0, -1], :] = 0
        f[:, [0, -1]] = 0
        out.append(splines.resized(f, tuple(shape[:2]), order, splines.MIRROR) if order >= 2 else zoomed(f, tuple(shape[:2]), order))
    return out[0], out[1]


def displaced(image: np.ndarray, field: tuple[np.ndarray, np.ndarray], order: int = 1) -> np.ndarray:
    """The image at its pixels' places plus the field's displacements."""
    y, x = np.meshgrid(np.arange(image.shape[0]), np.arange(image.shape[1]), indexing="ij")
    return sampled(image, y + field[0], x + field[1], order)


def elastic(image: np.ndarray, grid_spacing: int, sigma: float, seed: int, order: int = 1) -> np.ndarray:
    """An image deformed by a field of its own, spread bilinearly."""
    return displaced(image, elastic_field(image.shape, grid_spacing, sigma, seed, 1), order)


def elastic_together(df: DataFrame, columns: Sequence[str], shape: tuple[int, ...], batch: str, masks: Sequence[str] = (), probability: float = 1.0, grid_spacing: int = GRID, sigma: float | None = None, order: int = 1, field_order: int = 3, seed: int = 0) -> DataFrame:
    """All rows of a batch (an integer column) and all of their columns deformed by one field, in one pass of Arrow batches; a batch is
    deformed at all with the given probability, and masks take the nearest pixel.

    A field is a pure function of seed and batch number, so rows of a batch need not meet: no shuffle, and reruns agree.
    """

    @F.pandas_udf(", ".join(f"{c} array<double>" for c in columns))
    def run(batches: pd.Series, *data: pd.Series) -> pd.DataFrame:
        fields: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        out: dict[str, list] = {c: [] for c in columns}
        for b, *row in zip(batches, *data):
            n = int(b) & 0xFFFFFFFFFFFFFFFF
            if n not in fields:
                moved = np.random.default_rng([seed & 0xFFFFFFFF, n, 0]).random() < probability
                fields = {n: elastic_field(shape, grid_spacing, sigma, [seed & 0xFFFFFFFF, n, 1], field_order) if moved else None}  # one at a time
            for c, d in zip(columns, row):
                image = None if d is None else np.asarray(d, dtype=np.float64).reshape(shape)
                out[c].append(None if image is None else (image if fields[n] is None else displaced(image, fields[n], 0 if c in masks else order)).ravel())
        return pd.DataFrame(out)

    made = df.withColumn("__e", run(F.col(batch), *[F.col(c) for c in columns]))
    return made.withColumns({c: F.col(f"__e.{c}") for c in columns}).drop("__e")


def column(f: Callable[[np.ndarray, int], np.ndarray], data: Column, key: Column, shape: tuple[int, ...]) -> Column:
    """f(image, key) on a column of flat images; the key seeds what is random, so a retried task gives the same."""

    @F.pandas_udf("array<double>")
    def run(images: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else np.asarray(f(np.asarray(d, dtype=np.float64).reshape(shape), int(k)), dtype=np.float64).ravel() for d, k in zip(images, keys)])

    return run(data, key)


def with_kernel(df: DataFrame, columns: list[str], key: str, shape: tuple[int, ...], f: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    return df.withColumns({c: column(f, F.col(c), F.col(key), shape) for c in columns})
