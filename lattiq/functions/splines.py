"""B-splines of orders 2 to 5 through an array's values: coefficients by recursive filters, values at real coordinates by the basis.

Beyond its edges an array is mirrored: MIRROR turns on the edge value, REFLECT repeats it.
"""

from __future__ import annotations

import math

import numpy as np

MIRROR, REFLECT = "mirror", "reflect"
#: The poles of the filter that inverts each order's basis at the integers.
POLES = {
    2: (math.sqrt(8) - 3,),
    3: (math.sqrt(3) - 2,),
    4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19),
    5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5),
}


def basis(order: int, x: np.ndarray) -> np.ndarray:
    """The centred basis at x: a sum of truncated powers."""
    x = np.abs(np.asarray(x, dtype=np.float64))
    half = (order + 1) / 2
    out = np.zeros_like(x)
    for k in range(int(half) + 1):
        out += (-1) ** k * math.comb(order + 1, k) * np.where(half - k - x > 0, half - k - x, 0.0) ** order
    return np.where(x < half, out / math.factorial(order), 0.0)


def mirrored_index(i: np.ndarray, n: int, edges: str = MIRROR) -> np.ndarray:
    """Whole positions, brought inside 0 to n - 1."""
    if n == 1:
        return np.zeros_like(i)
    period = 2 * n - 2 if edges == MIRROR else 2 * n
    i = np.mod(i, period)
    return np.where(i < n, i, (period if edges == MIRROR else period - 1) - i)


def coefficients(values: np.ndarray, order: int, axis: int = 0, edges: str = MIRROR) -> np.ndarray:
    """Coefficients along an axis, so that the basis weighted by them goes through the values. One pass forth and one back for each
    pole, begun by the exact sum over the mirrored, endlessly repeated axis."""
    c = np.moveaxis(np.array(values, dtype=np.float64), axis, 0)
    n = len(c)
    if order < 2 or n == 1:
        return np.moveaxis(c, 0, axis)
    for z in POLES[order]:
        c = c * ((1 - z) * (1 - 1 / z))
        k = np.arange(n).reshape(-1, *[1] * (c.ndim - 1))
        if edges == MIRROR:
            weight = z**k + np.where((k > 0) & (k < n - 1), z ** (2.0 * n - 2 - k), 0.0)
            first = (weight * c).sum(axis=0) / (1 - z ** (2 * n - 2))
        else:
            first = c[0] + z / (1 - z ** (2 * n)) * ((z**k + z ** (2.0 * n - 1 - k)) * c).sum(axis=0)
        c[0] = first
        for i in range(1, n):
            c[i] += z * c[i - 1]
        c[n - 1] = z / (z * z - 1) * (c[n - 1] + z * c[n - 2]) if edges == MIRROR else z / (z - 1) * c[n - 1]
        for i in range(n - 2, -1, -1):
            c[i] = z * (c[i + 1] - c[i])
    return np.moveaxis(c, 0, axis)


def _support(order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, weights), both (order + 1, *x.shape), of the basis functions that are not zero at x."""
    first = np.floor(x - (order - 1) / 2).astype(np.int64)
    at = first[None] + np.arange(order + 1).reshape(-1, *[1] * x.ndim)
    return at, basis(order, x[None] - at)


def matrix(n: int, x: np.ndarray, order: int, edges: str = MIRROR) -> np.ndarray:
    """(len(x), n): what each coefficient weighs at each coordinate of an axis of n values."""
    at, weight = _support(order, x)
    out = np.zeros((len(x), n))
    for i, w in zip(mirrored_index(at, n, edges), weight):
        np.add.at(out, (np.arange(len(x)), i), w)
    return out


def resized(values: np.ndarray, shape: tuple[int, ...], order: int, edges: str = REFLECT) -> np.ndarray:
    """The first axes resampled to a shape, corners on corners, one axis after the other."""
    out = np.asarray(values, dtype=np.float64)
    for axis, m in enumerate(shape):
        n = out.shape[axis]
        if n == m:
            continue
        w = matrix(n, np.linspace(0, n - 1, m), order, edges)
        out = np.moveaxis(np.tensordot(w, coefficients(out, order, axis, edges), axes=(1, axis)), 0, axis)
    return out


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, order: int, edges: str = MIRROR) -> np.ndarray:
    """An image (rows, columns[, channels]) at real coordinates of any number of points."""
    c = coefficients(coefficients(image, order, 0, edges), order, 1, edges)
    (iy, wy), (ix, wx) = _support(order, y), _support(order, x)
    iy, ix = mirrored_index(iy, image.shape[0], edges), mirrored_index(ix, image.shape[1], edges)
    more = (1,) * (image.ndim - 2)
    out = np.zeros((*y.shape, *image.shape[2:]))
    for a in range(order + 1):
        for b in range(order + 1):
            out += c[iy[a], ix[b]] * (wy[a] * wx[b]).reshape(*y.shape, *more)
    return out
