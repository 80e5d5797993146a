"""Statistics of values, and of histograms as tables (bin, lo, hi, cnt).

Only what defines the next plan reaches the driver: a minimum, a maximum, a handful of percentiles. Histogram tables have
a row for each bin, so their windows are as small as the number of bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Values = DataFrame  #: a table with a double column ``v``


def exploded(images: DataFrame, data: str = "data", *keep: str) -> Values:
    """One row for each pixel: the kept columns, px (position in the image) and v."""
    return images.select(*keep, F.posexplode(data).alias("px", "v")).withColumn("v", F.col("v").cast("double"))


def min_max(df: Values, *by: str) -> DataFrame:
    agg = (F.min("v").alias("min"), F.max("v").alias("max"))
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def decimation_factor(pixels_per_batch: int, n_batches: int, target: float = 1e8, most: float | None = None) -> float:
    """Every how many batches one is read."""
    f = max(1.0, min(n_batches / 2, pixels_per_batch * n_batches / target))
    return f if most is None else min(most, f)


def decimated(df: DataFrame, batch: str, factor: float) -> DataFrame:
    """Batches int(0), int(f), int(2 f), ...; with a factor of 1 all of them."""
    if factor <= 1:
        return df
    k = F.ceil(F.col(batch) / factor)
    return df.where(F.floor(k * factor) == F.col(batch))


def finite(df: Values) -> Values:
    """Rows whose value is a number: neither null nor NaN nor infinite. Histograms, summaries and what is derived from them count these."""
    v = F.col("v").cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _bounds(df: Values) -> tuple[float, float]:
    lo, hi = min_max(df).first()
    return lo, hi


def _densified(counts: DataFrame, edges: Column, n: int) -> DataFrame:
    """All bins, empty ones too: percentiles are interpolated from the last empty bin."""
    bins = counts.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))
    return out.withColumn("lo", edges(F.col("bin"))).withColumn("hi", edges(F.col("bin") + 1)).select("bin", "lo", "hi", "cnt")


def histogram(df: Values, bins: int | Sequence[float] | None = None, bin_size: float | None = None) -> DataFrame:
    """Counts by bin.

    ``bins=n``: the largest value falls on the last bin's lower edge. ``bin_size``: as many bins as fit, the size set anew.
    A list of edges: half-open bins but the last, which is closed; values outside are left out. NaN, infinite and null values are
    in no bin, and without others all bins are empty.
    """
    df = finite(df)
    if bins is None or isinstance(bins, int):
        lo, hi = _bounds(df)
        if lo is None:
            return _densified(df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("cnt")).limit(0), lambda b: b.cast("double"), bins or 1)
        n = bins if bins is not None else int(1 + (hi - lo) / bin_size)
        size = (hi - lo) / (n - 1) if n > 1 else 1.0
        size = size or 1.0
        which = F.least(F.floor((F.col("v") - lo) / size), F.lit(n - 1)).cast("int")
        counts = df.groupBy(which.alias("bin")).agg(F.count("*").alias("cnt"))
        return _densified(counts, lambda b: F.lit(lo) + b * F.lit(size), n)
    edges = [float(e) for e in bins]
    n = len(edges) - 1
    at = F.array(*[F.lit(e) for e in edges])
    inside = df.where(F.col("v").between(edges[0], edges[-1]))
    if all(abs((b - a) - (edges[-1] - edges[0]) / n) <= 1e-12 * max(1.0, abs(edges[-1])) for a, b in zip(edges, edges[1:])):
        # even edges: one division, then at most one step to the bin whose edges hold the value
        k = F.least(F.floor((F.col("v") - edges[0]) / ((edges[-1] - edges[0]) / n)), F.lit(n - 1)).cast("int")
        k = F.when(F.col("v") < F.element_at(at, k + 1), k - 1).when((k < n - 1) & (F.col("v") >= F.element_at(at, k + 2)), k + 1).otherwise(k)
        which = k
    else:
        which = F.least(F.size(F.filter(at, lambda e: e <= F.col("v"))) - 1, F.lit(n - 1))
    counts = inside.groupBy(which.cast("int").alias("bin")).agg(F.count("*").alias("cnt"))
    return _densified(counts, lambda b: F.element_at(at, b + 1), n)


def normalized(hist: DataFrame) -> DataFrame:
    return hist.withColumn("freq", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def smoothed(hist: DataFrame, sigma_bins: float) -> DataFrame:
    """Gaussian smoothing over bins, edges repeated, cut to whole counts."""
    import math

    r = int(4 * sigma_bins + 0.5)
    w = [math.exp(-0.5 * (k / sigma_bins) ** 2) for k in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    all_counts = F.array_sort(F.collect_list(F.struct("bin", "cnt")).over(Window.partitionBy()))
    h = hist.withColumn("__c", F.transform(all_counts, lambda x: x["cnt"]))
    last = F.size("__c")
    at = lambda k: F.element_at("__c", F.least(F.greatest(F.col("bin") + k + 1, F.lit(1)), last).cast("int"))
    return h.withColumn("cnt", sum((at(k) * F.lit(x) for k, x in zip(range(-r, r + 1), w)), F.lit(0.0)).cast("bigint")).drop("__c")


def _cumulated(hist: DataFrame) -> DataFrame:
    by_bin = Window.orderBy("bin")
    h = hist.withColumns({"cum": F.sum("cnt").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)), "mid": (F.col("lo") + F.col("hi")) / 2, "total": F.sum("cnt").over(Window.partitionBy())})
    return h.withColumns({"cum2": F.lead("cum").over(by_bin), "mid2": F.lead("mid").over(by_bin)})


def _interpolated(rows: DataFrame, x: str, y: str, targets: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """y at each target over rows in the order of bin; clamped at the ends, of tied x the last."""
    aggs = []
    for t, name in zip(targets, names):
        part = F.when(F.col(f"{x}2").isNull() | (F.col(f"{x}2") == F.col(x)), F.col(y)).otherwise(F.col(y) + (t - F.col(x)) * (F.col(f"{y}2") - F.col(y)) / (F.col(f"{x}2") - F.col(x)))
        aggs.append(F.coalesce(F.max_by(F.when(F.col(x) <= t, part), F.when(F.col(x) <= t, F.col("bin"))), F.min_by(y, "bin")).alias(name))
    return rows.agg(*aggs)


def percentiles(hist: DataFrame, ps: Sequence[float]) -> DataFrame:
    """One row with columns p0, p1, ... : the value below which ps percent of the counts lie, interpolated between centres."""
    return _interpolated(_cumulated(hist), "cum", "mid", [F.col("total") * F.lit(p / 100) for p in ps], [f"p{i}" for i in range(len(ps))])


def percentiles_of(hist: DataFrame, values: Sequence[float]) -> DataFrame:
    """The inverse: the percent of the counts below each value."""
    h = _cumulated(hist).withColumns({"pct": F.col("cum") / F.col("total") * 100, "pct2": F.col("cum2") / F.col("total") * 100})
    return _interpolated(h, "mid", "pct", [F.lit(float(v)) for v in values], [f"p{i}" for i in range(len(values))])


def mode(hist: DataFrame) -> DataFrame:
    """Centre of the first of the fullest bins."""
    return hist.agg(F.max_by((F.col("lo") + F.col("hi")) / 2, F.struct("cnt", -F.col("bin"))).alias("mode"))


def ipr_edges(hist: DataFrame, n_bins: int = 256, percentile_range: Sequence[float] | float = (25, 75), min_bin_size: float | None = None, value_range: Sequence[float] | float = (0, 100)) -> list[float]:
    """Edges of bins whose size is an inter-percentile range over n_bins; the bins span the value range."""
    pair = lambda p: sorted([p, 100 - p]) if isinstance(p, (int, float)) else list(p)
    lo, hi, v0, v1 = percentiles(hist, [*pair(percentile_range), *pair(value_range)]).first()
    size = (hi - lo) / n_bins
    size = max(size, min_bin_size) if min_bin_size else size
    n = max(1, round((v1 - v0) / size)) if size > 0 else 1
    return [v0 + (v1 - v0) * i / n for i in range(n + 1)]


def mean_sd(df: Values, *by: str) -> DataFrame:
    """Mean, deviation of the population and count."""
    agg = (F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def distribution_summary(df: Values, n_bins: int = 1000, ps: Sequence[float] = (5, 50, 95)) -> DataFrame:
    """One row: min, max, mode, mean, sd and the percentiles of the finite values; of none all are null. Two passes: moments with
    the bounds, then the histogram."""
    df = finite(df)
    lo, hi, mean, sd = df.agg(F.min("v"), F.max("v"), F.avg("v"), F.stddev_pop("v")).first()
    names = ["min", "max", "mode", "mean", "sd", *[f"p{q:g}" for q in ps]]
    if lo is None:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in names])
    size = ((hi - lo) / (n_bins - 1) if n_bins > 1 else 1.0) or 1.0
    which = F.least(F.floor((F.col("v") - lo) / size), F.lit(n_bins - 1)).cast("int")
    counts = df.groupBy(which.alias("bin")).agg(F.count("*").alias("cnt"))
    hist = _densified(counts, lambda b: F.lit(lo) + b * F.lit(size), n_bins)
    p = percentiles(hist, ps).crossJoin(mode(hist))  # one row each
    return p.select(F.lit(lo).alias("min"), F.lit(hi).alias("max"), "mode", F.lit(mean).alias("mean"), F.lit(sd).alias("sd"), *[F.col(f"p{i}").alias(f"p{q:g}") for i, q in enumerate(ps)])


def min_max_range(df: Values, min_range: tuple[float, float] = (0.1, 5), max_range: tuple[float, float] = (95, 99.9)) -> list[float]:
    """Four values: two percentiles for the lower end of a random range, two for its upper end."""
    edges = ipr_edges(histogram(df, 1000), 256, (0, 95))
    return list(percentiles(histogram(df, edges), [*min_range, *max_range]).first())


def center_scale_from_histogram(hist: DataFrame, center_extent: float | tuple[float, float], scale_range: tuple[float, float], scale_max: float | None = None) -> tuple[list[float], list[float]]:
    """(center range, scale range) of fluorescence images: percentiles around the mode, and percentiles minus the mode."""
    m = mode(hist).first()[0]
    at = percentiles_of(hist, [m]).first()[0]
    if at >= scale_range[0]:
        raise ValueError(f"the mode is at {at} percent and must be below {scale_range[0]}")
    below, above = center_extent if isinstance(center_extent, tuple) else (center_extent, center_extent)
    ps = [max(0, at - below), min(100, at + above), *scale_range, *([scale_max] if scale_max is not None else [])]
    v = list(percentiles(hist, ps).first())
    return v[:2], [x - m for x in v[2:]]


def center_scale_range(df: Values, fluorescence: bool = False, center_extent: float | tuple[float, float] = (20, 30), scale_range: tuple[float, float] = (75, 99.9), scale_max: float | None = None, sd_factor: float = 3.0, channel: str | None = None) -> tuple[list[float], list[float]]:
    """(center range, scale range). Bright field: mean and deviation (averaged over channels) times or over a factor."""
    if fluorescence:
        edges = ipr_edges(histogram(df, 1000), 256, (0, 95))
        return center_scale_from_histogram(histogram(df, edges), center_extent, scale_range, scale_max)
    per = mean_sd(df, *([channel] if channel else []))
    m, s = per.agg(F.avg("mean"), F.avg("sd")).first()
    return [m - sd_factor * s, m + sd_factor * s], [s / sd_factor, s * sd_factor]


def image_shape(images: DataFrame, shape: str = "shape") -> list[int]:
    """The one shape of all images; more than one is an error."""
    shapes = [r[0] for r in images.select(shape).distinct().limit(2).collect()]
    if len(shapes) != 1:
        raise ValueError("images have different shapes" if shapes else "there are no images")
    return list(shapes[0])


def n_channels(shape: Sequence[int], n_spatial: int = 2) -> int:
    return 1 if len(shape) == n_spatial else int(shape[-1])


def metrics(df: DataFrame, truth: str, prediction: str, *by: str) -> DataFrame:
    """Mean squared and absolute errors, over all values and over those where the truth is not zero."""
    d = F.col(prediction) - F.col(truth)
    there = F.col(truth) != 0
    agg = [F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.avg(F.when(there, d * d)).alias("msem"), F.avg(F.when(there, F.abs(d))).alias("maem")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)

#: Errors that need no function of the user.
ERRORS = ("mse", "mae", "msem", "maem")


def _sums(truth: str, prediction: str) -> dict[str, Column]:
    """Sums over a row's pixels: squared and absolute errors and their number, and the same where the truth is not zero."""
    pairs = F.zip_with(truth, prediction, lambda y, p: F.struct(y.cast("double").alias("y"), (p - y).cast("double").alias("d")))
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + f(x))
    there = lambda x, v: F.when(x["y"] != 0, v).otherwise(0.0)
    whole = {"__se": add(lambda x: x["d"] * x["d"]), "__ae": add(lambda x: F.abs(x["d"])), "__n": add(lambda x: F.lit(1.0))}
    masked = {"__sem": add(lambda x: there(x, x["d"] * x["d"])), "__aem": add(lambda x: there(x, F.abs(x["d"]))), "__nm": add(lambda x: there(x, F.lit(1.0)))}
    return whole | masked


def evaluated(df: DataFrame, truth: str, prediction: str, errors: Sequence[str] = ERRORS, metrics: dict | None = None, by: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """One row an image: its errors, and a user's metrics, functions of (list of truth arrays, list of prediction arrays) to a number.

    Without ``by`` a row is an image. With it, rows are parts of images (tiles, frames) and are grouped: errors are summed by partial
    aggregation, and only a user's metric brings an image's parts together in one task. ``carried`` columns (path, label, frame) are the
    group's own. Rows without a truth or a prediction have no error; a masked error without a non-zero truth is null.
    """
    metrics = metrics or {}
    if unknown := set(errors) - set(ERRORS):
        raise ValueError(f"unknown errors {sorted(unknown)}")
    top = {"mse": ("__se", "__n"), "mae": ("__ae", "__n"), "msem": ("__sem", "__nm"), "maem": ("__aem", "__nm")}
    rows = df.withColumns(_sums(truth, prediction))
    ratio = lambda e, f: (f(top[e][0]) / F.nullif(f(top[e][1]), F.lit(0.0))).alias(e)
    if not by:
        names = [*carried] or [c for c in df.columns if c not in (truth, prediction)]
        return rows.select(*names, *[ratio(e, F.col) for e in errors], *[_of_rows(f)(truth, prediction).alias(m) for m, f in metrics.items()])
    first = rows.groupBy(*by).agg(*[F.min(c).alias(c) for c in carried], *[ratio(e, F.sum) for e in errors], F.count(F.lit(1)).alias("__parts")).drop("__parts")
    if not metrics:
        return first
    # Python's and partial aggregates do not mix: each is an aggregation of its own, and they meet by the key
    second = df.groupBy(*by).agg(*[_of_groups(f)(truth, prediction).alias(m) for m, f in metrics.items()]).withColumnsRenamed({c: f"__{c}" for c in by})
    met = first.join(second, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return met.drop(*[f"__{c}" for c in by])


def _of_groups(f: Callable):
    @F.pandas_udf("double")
    def run(truth: pd.Series, prediction: pd.Series) -> float:
        pairs = [(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)) for a, b in zip(truth, prediction) if a is not None and b is not None]
        return float(f([a for a, _ in pairs], [b for _, b in pairs])) if pairs else None

    return run


def _of_rows(f: Callable):
    @F.pandas_udf("double")
    def run(truth: pd.Series, prediction: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else float(f([np.asarray(a, dtype=np.float64)], [np.asarray(b, dtype=np.float64)])) for a, b in zip(truth, prediction)], dtype="float64")

    return run
