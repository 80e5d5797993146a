"""Hard-example mining: sampling probabilities from metrics of which low values are hard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.positions import quantiles


@dataclass(frozen=True)
class Regime:
    """What turns a metric into a probability: two quantiles, two probabilities and a power between them."""

    q_hard: float
    q_easy: float
    p_max: float
    p_min: float
    power: float

    total: float = 1.0

    def probability(self, metric: Column) -> Column:
        """Null where the metric is null or not a number."""
        r = (metric - self.q_easy) / ((self.q_hard - self.q_easy) or 1.0)
        between = self.p_min + (self.p_max - self.p_min) * F.pow(r, F.lit(self.power))
        p = F.when(metric <= self.q_hard, F.lit(self.p_max)).when(metric >= self.q_easy, F.lit(self.p_min)).otherwise(between)
        return F.when(~F.isnan(metric.cast("double")), p / F.lit(self.total))


#: Powers that are tried in one pass.
_AT_ONCE = 10


def regime(df: DataFrame, metric: str, enrich: float = 10.0, quantile_min: float = 0.01, quantile_max: float | None = 0.99, max_power: float = 10.0, accuracy: float = 0.1) -> Regime:
    """The hardest quantile is drawn ``enrich`` times as often as even sampling would.

    If that leaves nothing for easy examples, the middle ones' share is bent by the least power that fits. The sum of the shares falls
    as the power rises, so the power is searched, ``_AT_ONCE`` sums a pass. Rows whose metric is null or NaN have no part; without
    others the probabilities are null.
    """
    if not 0 <= quantile_min < 0.5:
        raise ValueError(f"invalid lower quantile {quantile_min}")
    quantile_min = min(quantile_min, 1 / enrich)
    quantile_max = 1 - quantile_min if quantile_max is None else quantile_max
    m = F.col(metric).cast("double")
    hard, easy = quantiles(df, metric, [quantile_min, quantile_max])
    if hard is None:
        return Regime(0.0, 0.0, 0.0, 0.0, 1.0)
    numbers = df.select(m.alias("m")).where(F.col("m").isNotNull() & ~F.isnan("m"))
    m = F.col("m")
    middle = (m > hard) & (m < easy)
    r = (m - easy) / ((hard - easy) or 1.0)

    def sums(powers: list[float]) -> list[float]:
        return list(numbers.where(middle).agg(*[F.coalesce(F.sum(F.pow(r, F.lit(p))), F.lit(0.0)) for p in powers]).first())

    n, n_hard, n_easy, n_mid, s = numbers.agg(F.count("*"), F.count(F.when(m <= hard, 1)), F.count(F.when((m >= easy) & (m > hard), 1)), F.count(F.when(middle, 1)), F.coalesce(F.sum(F.when(middle, r)), F.lit(0.0))).first()
    p_max = enrich / n
    also_easy = n_easy if easy > hard else n_hard
    rest = n_mid + also_easy - s

    def made(p_min: float, power: float, of_power: float) -> Regime:
        total = p_max * n_hard + p_min * (n_easy + n_mid) + (p_max - p_min) * of_power
        return Regime(hard, easy, p_max, p_min, power, total)

    p_min = (1 - p_max * (n_hard + s)) / rest if rest else -1.0
    if p_min >= 0:
        return made(p_min, 1.0, s)
    target = 1 / p_max - n_hard
    if target <= 0:
        return made(0.0, max_power, sums([max_power])[0])
    last = int(round((max_power - 1) / accuracy))
    power = lambda k: 1 + k * accuracy
    known = {0: s}
    low, high = 0, last  # the first power whose sum is at most the target, or the last one
    if s > target:
        while high - low > 1:
            tried = sorted({low + (high - low) * i // _AT_ONCE for i in range(1, _AT_ONCE + 1)} - set(known))
            known.update(zip(tried, sums([power(k) for k in tried])))
            high = min((k for k in known if low < k <= high and known[k] <= target), default=high)
            low = max(k for k in known if k < high and known[k] > target)
            if high == last and known[last] > target:
                break
    k = high if s > target else 0
    if k > 0 and known[k] < target:
        k -= 1
    return made(0.0, power(k), known[k] if k in known else sums([power(k)])[0])


def index_probability(df: DataFrame, metric: str, out: str = "p", **options) -> DataFrame:
    """Adds each row's probability; they sum to 1. Rows without a number have none."""
    return df.withColumn(out, regime(df, metric, **options).probability(F.col(metric)))


def index_probabilities(df: DataFrame, metrics: list[str], **options) -> DataFrame:
    """A probability column p_<metric> for each metric."""
    return df.withColumns({f"p_{m}": regime(df, m, **options).probability(F.col(m)) for m in metrics})


@dataclass(frozen=True)
class Schedule:
    """When weights are computed anew, and by which metric: every ``period`` epochs from ``start``, the metrics in turn."""

    period: int = 10
    start: int = 0
    n_metrics: int = 1

    def due(self, epoch: int) -> bool:
        return epoch >= self.start and (epoch - self.start) % self.period == 0

    def metric(self, epoch: int) -> int:
        return max(0, (epoch - self.start) // self.period) % self.n_metrics
