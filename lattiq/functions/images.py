"""Images as flat arrays in row order: expressions on one image, without Python at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop(data: Column, shape: tuple[int, int], target: tuple[int, int], start: tuple[int, int] = (0, 0)) -> Column:
    """A box of an image; its start is moved so that it stays inside."""
    (h, w), (th, tw) = shape, target
    if th > h or tw > w:
        raise ValueError("target is larger than image")
    y0, x0 = (min(max(s, 0), n - t) for s, n, t in zip(start, shape, target))
    rows = F.transform(F.sequence(F.lit(y0), F.lit(y0 + th - 1)), lambda y: F.slice(data, y * w + x0 + 1, F.lit(tw)))
    return F.flatten(rows)


def crop_to_multiple(data: Column, shape: tuple[int, int], factor: tuple[int, int] | int) -> Column:
    f = (factor, factor) if isinstance(factor, int) else factor
    return crop(data, shape, tuple(k * (n // k) for n, k in zip(shape, f)))


def dihedral(data: Column, shape: tuple[int, int], k: int) -> Column:
    """The k-th of eight symmetries: as it is, flipped in y, in x, in both, and these four turned by a quarter."""
    h, w = shape
    oh, ow = (h, w) if k < 4 else (w, h)

    def at(i: Column) -> Column:
        r, c = F.floor(i / ow), i % ow
        y, x = (r, c) if k < 4 else (c, w - 1 - r)
        y = h - 1 - y if k % 4 in (1, 3) else y
        x = w - 1 - x if k % 4 in (2, 3) else x
        return F.element_at(data, (y * w + x + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(oh * ow - 1)), at)


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, x: a + x)


def is_void(mask: Column) -> Column:
    """No pixel but zero; an image without pixels is void."""
    return ~F.exists(mask, lambda x: x != 0)


def mean(data: Column) -> Column:
    return total(data) / F.size(data)


def sd(data: Column) -> Column:
    """Of the population."""
    m = mean(data)
    return F.sqrt(F.aggregate(data, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(data))


def touches_y_borders(mask: Column, shape: tuple[int, int]) -> Column:
    """(first row, last row) hold an object."""
    h, w = shape
    hit = lambda s: F.exists(F.slice(mask, s, w), lambda x: x != 0)
    return F.array(hit(1), hit((h - 1) * w + 1))


def map_range(data: Column, low: Column | float, high: Column | float, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Linear and clamped."""
    low, high = F.lit(low), F.lit(high)
    return F.transform(data, lambda x: F.when(x <= low, F.lit(to_low)).when(x >= high, F.lit(to_high)).otherwise((x - low) / (high - low) * (to_high - to_low) + to_low))


def scale(data: Column, center: Column | float, factor: Column | float, saturation: float = 1.0) -> Column:
    """(x - center) / factor, and above 1 its power; 0 cuts at 1, and 1 changes nothing."""
    c, f = F.lit(center), F.lit(factor)
    y = lambda x: (x - c) / f
    if saturation == 1:
        return F.transform(data, y)
    if saturation == 0:
        return F.transform(data, lambda x: F.least(y(x), F.lit(1.0)))
    return F.transform(data, lambda x: F.when(y(x) > 1, F.pow(y(x), F.lit(saturation))).otherwise(y(x)))


def scale_percentiles(data: Column, low: Column, high: Column, lower: float = 1.0, upper: float = 1.0) -> Column:
    """[low, high] to [0, 1]; beyond, tails are powers, or cut where the power is 0."""

    def one(x: Column) -> Column:
        y = (x - low) / (high - low)
        below = F.lit(0.0) if lower == 0 else -F.pow(-y, F.lit(lower))
        above = F.lit(1.0) if upper == 0 else F.pow(y, F.lit(upper))
        return F.when(y < 0, below).when(y > 1, above).otherwise(y)

    return F.transform(data, one)


def denoised_mask(data: Column, eps: float = 1e-10) -> Column:
    return F.transform(data, lambda x: F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x.cast("double")))


def padded(data: Column, n: Column | int, value: float = 0) -> Column:
    """Zeros at the end up to n values."""
    return F.concat(data, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(data), F.lit(0)).cast("int")))


def center_of_mass(mask: Column, shape: tuple[int, int]) -> Column:
    """Mean (y, x) of the pixels above 0; null where there are none."""
    h, w = shape
    at = F.filter(F.transform(mask, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    axis = lambda f: F.aggregate(at, F.lit(0.0), lambda a, i: a + f(i)) / F.nullif(F.size(at), F.lit(0))
    return F.array(axis(lambda i: F.floor(i / w)), axis(lambda i: i % w))


def is_null_value(values: Column, value: float) -> Column:
    """Null, or every item null or the value."""
    return values.isNull() | F.forall(values, lambda x: x.isNull() | (x == value))


def channel_slice(data: Column, n_channels: int, start: int, stop: int) -> Column:
    """Of pixels with n_channels values each, the values from start to stop."""
    return F.filter(data, lambda x, i: (i % n_channels >= start) & (i % n_channels < stop))


def channels_split(data: Column, n_channels: int) -> Column:
    """An array of one flat image for each channel."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.filter(data, lambda x, i: i % n_channels == c))


def percentiles(data: Column, ps: Sequence[float]) -> Column:
    """An array of the values below which these percents lie, interpolated between neighbours; null for an empty image."""

    def of_sorted(x: Column) -> Column:
        def one(p: float) -> Column:
            at = (F.size(x) - 1) * F.lit(p / 100)
            low = F.floor(at).cast("int")
            value = lambda i: F.element_at(x, F.least(i, F.size(x) - 1) + 1)
            return value(low) + (value(low + 1) - value(low)) * (at - low)

        return F.array(*[one(p) for p in ps])

    return F.when(F.size(data) > 0, F.element_at(F.transform(F.array(F.array_sort(data)), of_sorted), 1))


def with_channel_axis(shape: Column, n_spatial: int = 2) -> Column:
    """A shape with a last axis for channels, of 1 where there was none."""
    return F.when(F.size(shape) == n_spatial, F.concat(shape, F.array(F.lit(1)))).otherwise(shape)
