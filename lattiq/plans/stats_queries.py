"""Queries of the statistics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import images
from lattiq.operators import mining, stats
from lattiq.plans.base import PIXELS, SHAPE, pixels, query, rounded, scratch, table, vectors
from lattiq.streaming import feedback


def prices(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"), "l_returnflag")


def _hist_sql(n: int) -> str:
    return f"""
b AS (SELECT min(v) AS lo, (max(v) - min(v)) / {n - 1} AS bs FROM d),
c AS (SELECT CAST(least(floor((v - lo) / bs), {n - 1}) AS INTEGER) AS bin, count(*) AS cnt FROM d, b GROUP BY 1),
h AS (SELECT CAST(r.bin AS INTEGER) AS bin, lo + r.bin * bs AS lo, lo + (r.bin + 1) * bs AS hi, coalesce(cnt, 0) AS cnt
      FROM range({n}) r(bin) LEFT JOIN c USING (bin), b)"""


_CUM = """
k AS (SELECT *, sum(cnt) OVER (ORDER BY bin) AS cum, (lo + hi) / 2 AS mid, sum(cnt) OVER () AS total FROM h),
l AS (SELECT *, lead(cum) OVER (ORDER BY bin) AS cum2, lead(mid) OVER (ORDER BY bin) AS mid2 FROM k)"""


def _pct_sql(p: float) -> str:
    part = f"CASE WHEN cum2 IS NULL OR cum2 = cum THEN mid ELSE mid + (total * ({p} / 100.0::DOUBLE) - cum) * (mid2 - mid) / (cum2 - cum) END"
    return f"coalesce(max_by({part}, bin) FILTER (cum <= total * ({p} / 100.0::DOUBLE)), min_by(mid, bin))"


_PRICES = "WITH d AS (SELECT l_extendedprice AS v FROM lineitem),"


@query("min_max", "SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def min_max(spark, sf):
    return stats.min_max(prices(spark, sf), "l_returnflag")


@query("histogram_int_bins", _PRICES + _hist_sql(64) + " SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, cnt FROM h")
def histogram_int_bins(spark, sf):
    return rounded(stats.histogram(prices(spark, sf), 64), 4)


@query("histogram_bin_size", """
WITH d AS (SELECT l_quantity AS v FROM lineitem), m AS (SELECT min(v) AS lo, max(v) AS hi FROM d),
n AS (SELECT *, CAST(floor(1 + (hi - lo) / 2.5) AS INTEGER) AS n FROM m), b AS (SELECT lo, n, (hi - lo) / (n - 1) AS bs FROM n),
c AS (SELECT CAST(least(floor((v - lo) / bs), n - 1) AS INTEGER) AS bin, count(*) AS cnt FROM d, b GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * bs, 4) AS lo, round(lo + (r.bin + 1) * bs, 4) AS hi, coalesce(cnt, 0) AS cnt
FROM b, range(1000) r(bin) LEFT JOIN c USING (bin) WHERE r.bin < n""")
def histogram_bin_size(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("v"))
    return rounded(stats.histogram(df, None, 2.5), 4)


@query("histogram_edges", """
SELECT CAST(b AS INTEGER) AS bin, e[b + 1] AS lo, e[b + 2] AS hi, count(v) AS cnt
FROM (SELECT [0.0::DOUBLE, 1.0, 10.0, 25.0, 40.0] AS e) x, range(4) r(b)
LEFT JOIN (SELECT l_quantity AS v FROM lineitem) d ON v >= e[b + 1] AND (v < e[b + 2] OR (b = 3 AND v <= e[b + 2])) GROUP BY ALL""")
def histogram_edges(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("v"))
    return stats.histogram(df, [0, 1, 10, 25, 40])


@query("histogram_normalised", _PRICES + _hist_sql(32) + " SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, cnt, round(cnt / sum(cnt) OVER (), 6) AS freq FROM h")
def histogram_normalised(spark, sf):
    h = stats.normalized(stats.histogram(prices(spark, sf), 32))
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "cnt", F.round("freq", 6).alias("freq"))


@query("histogram_smoothed", _PRICES + _hist_sql(40) + """,
w AS (SELECT k, exp(-0.5 * k * k / 1.0::DOUBLE) AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
s AS (SELECT sum(w) AS t FROM w)
SELECT h.bin, CAST(floor(round(sum(g.cnt * w.w / s.t), 7)) AS BIGINT) AS cnt FROM h, w, s, h g
WHERE g.bin = least(greatest(h.bin + w.k, 0), 39) GROUP BY h.bin""")
def histogram_smoothed(spark, sf):
    return stats.smoothed(stats.histogram(prices(spark, sf), 40), 1.0).select("bin", "cnt")


@query("hist_percentile", _PRICES + _hist_sql(100) + "," + _CUM + f" SELECT round({_pct_sql(5)}, 4) AS p0, round({_pct_sql(50)}, 4) AS p1, round({_pct_sql(99.5)}, 4) AS p2 FROM l")
def hist_percentile(spark, sf):
    return rounded(stats.percentiles(stats.histogram(prices(spark, sf), 100), [5, 50, 99.5]), 4)


@query("hist_percentile_of_value", _PRICES + _hist_sql(100) + "," + _CUM + """,
v AS (SELECT unnest([1000.0::DOUBLE, 25000.0, 1e9]) AS v, unnest([0, 1, 2]) AS i),
a AS (SELECT i, coalesce(max_by(CASE WHEN mid2 IS NULL THEN 100.0 * cum / total ELSE 100.0 * (cum + (v.v - mid) * (cum2 - cum) / (mid2 - mid)) / total END, bin) FILTER (mid <= v.v), 100.0 * min_by(cum / total, bin)) AS p FROM l, v GROUP BY i)
SELECT round(max(p) FILTER (i = 0), 6) AS p0, round(max(p) FILTER (i = 1), 6) AS p1, round(max(p) FILTER (i = 2), 6) AS p2 FROM a""")
def hist_percentile_of_value(spark, sf):
    return rounded(stats.percentiles_of(stats.histogram(prices(spark, sf), 100), [1000, 25000, 1e9]), 6)


@query("hist_mode", _PRICES + _hist_sql(100) + " SELECT round((lo + hi) / 2, 4) AS mode FROM h ORDER BY cnt DESC, bin LIMIT 1")
def hist_mode(spark, sf):
    return rounded(stats.mode(stats.histogram(prices(spark, sf), 100)), 4)


@query("histogram_ipr_bins", _PRICES + _hist_sql(1000) + "," + _CUM + f""",
q AS (SELECT {_pct_sql(25)} AS a, {_pct_sql(75)} AS b, {_pct_sql(0)} AS v0, {_pct_sql(100)} AS v1 FROM l),
n AS (SELECT *, CAST(round_even((v1 - v0) / ((b - a) / 16), 0) AS INTEGER) AS n FROM q),
e AS (SELECT n, v0, v1 FROM n), g AS (SELECT CAST(r.i AS INTEGER) AS bin, v0 + (v1 - v0) * r.i / n AS lo, v0 + (v1 - v0) * (r.i + 1) / n AS hi, r.i = n - 1 AS final FROM e, range(4000) r(i) WHERE r.i < n),
w AS (SELECT v, CAST(least(greatest(floor((v - v0) / ((v1 - v0) / n)), 0), n - 1) AS INTEGER) AS near FROM d, e WHERE v BETWEEN v0 AND v1)
SELECT g.bin, round(lo, 3) AS lo, round(hi, 3) AS hi, count(v) AS cnt FROM g LEFT JOIN w ON abs(w.near - g.bin) <= 1 AND v >= lo AND (v < hi OR final AND v <= hi) GROUP BY 1, 2, 3""")
def histogram_ipr_bins(spark, sf):
    df = prices(spark, sf)
    edges = stats.ipr_edges(stats.histogram(df, 1000), 16, (25, 75))
    return rounded(stats.histogram(df, edges), 3)


@query("mean_sd_global", "SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, count(*) AS n FROM lineitem")
def mean_sd_global(spark, sf):
    return rounded(stats.mean_sd(prices(spark, sf)), 4)


@query("mean_sd_per_channel", f"SELECT CAST(px AS INTEGER) AS px, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM ({PIXELS}) GROUP BY 1")
def mean_sd_per_channel(spark, sf):
    return rounded(stats.mean_sd(pixels(spark, sf), "px"))


@query("distribution_summary", f"WITH d AS ({PIXELS})," + _hist_sql(1000) + "," + _CUM + f""",
p AS (SELECT {_pct_sql(5)} AS p5, {_pct_sql(50)} AS p50, {_pct_sql(95)} AS p95, arg_max(mid, (cnt, -bin)) AS mode FROM l)
SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(any_value(mode), 6) AS mode, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd,
  round(any_value(p5), 6) AS p5, round(any_value(p50), 6) AS p50, round(any_value(p95), 6) AS p95 FROM d, p""")
def distribution_summary(spark, sf):
    return rounded(stats.distribution_summary(pixels(spark, sf)))


@query("center_scale_brightfield", """
WITH c AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT round(avg(m) - 3 * avg(s), 4) AS c0, round(avg(m) + 3 * avg(s), 4) AS c1, round(avg(s) / 3, 4) AS s0, round(avg(s) * 3, 4) AS s1 FROM c""")
def center_scale_brightfield(spark, sf):
    center, scale = stats.center_scale_range(prices(spark, sf), channel="l_returnflag")
    return rounded(spark.createDataFrame([(*center, *scale)], "c0 double, c1 double, s0 double, s1 double"), 4)


def _ipr_sql(values: str, n_bins: int = 256, low: float = 0, high: float = 95) -> str:
    """SQL of the histogram h2 of ``values`` in bins of the size (percentile high - low) / n_bins, and its cumulated l2."""
    return f"""WITH d AS ({values}),""" + _hist_sql(1000) + "," + _CUM + f""",
q AS (SELECT {_pct_sql(low)} AS a, {_pct_sql(high)} AS b, {_pct_sql(0)} AS v0, {_pct_sql(100)} AS v1 FROM l),
n AS (SELECT *, greatest(CAST(round_even((v1 - v0) / ((b - a) / {n_bins}), 0) AS INTEGER), 1) AS n FROM q),
g AS (SELECT CAST(r.i AS INTEGER) AS bin, v0 + (v1 - v0) * r.i / n AS lo, v0 + (v1 - v0) * (r.i + 1) / n AS hi, r.i = n - 1 AS final FROM n, range(100000) r(i) WHERE r.i < n),
w AS (SELECT v, CAST(least(greatest(floor((v - v0) / ((v1 - v0) / n)), 0), n - 1) AS INTEGER) AS near FROM d, n WHERE v BETWEEN v0 AND v1),
h2 AS (SELECT g.bin, lo, hi, count(v) AS cnt FROM g LEFT JOIN w ON abs(w.near - g.bin) <= 1 AND v >= lo AND (v < hi OR final AND v <= hi) GROUP BY 1, 2, 3),
k2 AS (SELECT *, sum(cnt) OVER (ORDER BY bin) AS cum, (lo + hi) / 2 AS mid, sum(cnt) OVER () AS total FROM h2),
l2 AS (SELECT *, lead(cum) OVER (ORDER BY bin) AS cum2, lead(mid) OVER (ORDER BY bin) AS mid2 FROM k2)"""


def _at_sql(p: str) -> str:
    """SQL of a percentile of l2, given as an expression of a column of the one row o."""
    part = f"CASE WHEN cum2 IS NULL OR cum2 = cum THEN mid ELSE mid + (total * ({p} / 100.0::DOUBLE) - cum) * (mid2 - mid) / (cum2 - cum) END"
    return f"coalesce(max_by({part}, bin) FILTER (cum <= total * ({p} / 100.0::DOUBLE)), min_by(mid, bin))"


@query("min_max_range", _ipr_sql("SELECT l_extendedprice AS v FROM lineitem") + f" SELECT round({_at_sql('0.1')}, 4) AS min_low, round({_at_sql('5')}, 4) AS min_high, round({_at_sql('95')}, 4) AS max_low, round({_at_sql('99.9')}, 4) AS max_high FROM l2")
def min_max_range(spark, sf):
    values = stats.min_max_range(prices(spark, sf))
    return spark.createDataFrame([tuple(round(v, 4) for v in values)], "min_low double, min_high double, max_low double, max_high double")


@query("center_scale_fluorescence", _ipr_sql("SELECT value * value AS v FROM events") + f""", m AS (SELECT arg_max(mid, (cnt, -bin)) AS m FROM k2),
pl AS (SELECT max_by(CASE WHEN mid2 IS NULL THEN 100.0 * cum / total ELSE 100.0 * (cum + (m - mid) * (cum2 - cum) / (mid2 - mid)) / total END, bin) FILTER (mid <= m) AS a FROM l2, m),
o AS (SELECT m, greatest(0, a - 20) AS below, least(100, a + 30) AS above FROM m, pl)
SELECT round({_at_sql('below')}, 4) AS c0, round({_at_sql('above')}, 4) AS c1, round({_at_sql('75')} - any_value(m), 4) AS s0, round({_at_sql('99.9')} - any_value(m), 4) AS s1 FROM l2, o""")
def center_scale_fluorescence(spark, sf):
    df = table(spark, sf, "events").select((F.col("value") * F.col("value")).alias("v"))
    center, scale = stats.center_scale_range(df, fluorescence=True, center_extent=(20, 30))
    return rounded(spark.createDataFrame([(*center, *scale)], "c0 double, c1 double, s0 double, s1 double"), 4)


@query("scale_constant", f"SELECT vec_id, round(sum((v - 0.1) / 2.5), 6) AS total, round(max((v - 0.1) / 2.5), 6) AS top FROM ({PIXELS}) GROUP BY 1")
def scale_constant(spark, sf):
    d = images.scale(F.col("data"), 0.1, 2.5)
    return rounded(vectors(spark, sf).select("vec_id", images.total(d).alias("total"), F.array_max(d).alias("top")))


@query("scale_percentile_clamp", f"""
WITH d AS ({PIXELS}), q AS (SELECT vec_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM d GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN v <= lo THEN 0 WHEN v >= hi THEN 1 ELSE (v - lo) / (hi - lo) END), 5) AS total FROM d JOIN q USING (vec_id) GROUP BY 1""")
def scale_percentile_clamp(spark, sf):
    df = vectors(spark, sf).withColumn("q", images.percentiles(F.col("data"), [5, 95]))
    d = images.scale_percentiles(F.col("data"), F.col("q")[0], F.col("q")[1], 0.0, 0.0)
    return rounded(df.select("vec_id", images.total(d).alias("total")), 5)


@query("scale_brightfield_per_image", f"""
WITH d AS ({PIXELS}), m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM d GROUP BY 1)
SELECT vec_id, round(max((v - (0.2 * s + m)) / (1.5 * s)), 5) AS top, round(sum((v - (0.2 * s + m)) / (1.5 * s)), 5) AS total FROM d JOIN m USING (vec_id) GROUP BY 1""")
def scale_brightfield_per_image(spark, sf):
    df = vectors(spark, sf).withColumns({"m": images.mean(F.col("data")), "s": images.sd(F.col("data"))})
    d = images.scale(F.col("data"), F.col("m") + 0.2 * F.col("s"), 1.5 * F.col("s"))
    return rounded(df.select("vec_id", F.array_max(d).alias("top"), images.total(d).alias("total")), 5)


@query("saturate_power", f"""
WITH d AS (SELECT vec_id, (v + 0.3) / 0.4 AS y FROM ({PIXELS}))
SELECT vec_id, round(sum(CASE WHEN y > 1 THEN pow(y, 0.5) ELSE y END), 5) AS total, round(sum(least(y, 1)), 5) AS cut FROM d GROUP BY 1""")
def saturate_power(spark, sf):
    d, cut = images.scale(F.col("data"), -0.3, 0.4, 0.5), images.scale(F.col("data"), -0.3, 0.4, 0)
    return rounded(vectors(spark, sf).select("vec_id", images.total(d).alias("total"), images.total(cut).alias("cut")), 5)


@query("image_percentiles", f"SELECT vec_id, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM ({PIXELS}) GROUP BY 1")
def image_percentiles(spark, sf):
    q = images.percentiles(F.col("data"), [10, 90])
    return rounded(vectors(spark, sf).select("vec_id", q[0].alias("p10"), q[1].alias("p90")))


@query("mask_centroid", f"""
SELECT vec_id, round(avg(px // 8), 6) AS cy, round(avg(px % 8), 6) AS cx FROM ({PIXELS}) WHERE v > 0.1 GROUP BY 1
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1)) = 0""")
def mask_centroid(spark, sf):
    mask = F.transform("data", lambda x: F.when(x > 0.1, 1.0).otherwise(0.0))
    c = images.center_of_mass(mask, SHAPE)
    return rounded(vectors(spark, sf).select("vec_id", c[0].alias("cy"), c[1].alias("cx")))


@query("metrics_mse_mae", """
WITH m AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS p, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS y FROM events)
SELECT event_type, round(avg((p - y) * (p - y)), 5) AS mse, round(avg(abs(p - y)), 5) AS mae,
  round(avg((p - y) * (p - y)) FILTER (y <> 0), 5) AS msem, round(avg(abs(p - y)) FILTER (y <> 0), 5) AS maem FROM m GROUP BY 1""")
def metrics_mse_mae(spark, sf):
    e = table(spark, sf, "events")
    e = e.join(e.groupBy("user_id").agg(F.avg("value").alias("p")), "user_id").withColumn("y", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")))
    return rounded(stats.metrics(e, "y", "p", "event_type"), 5)


_MINING = """
WITH d AS (SELECT event_id, {metric} AS m FROM events), q AS (SELECT quantile_cont(m, 0.01) AS q0, quantile_cont(m, {qmax}) AS q1, count(*) AS n FROM d),
r AS (SELECT d.*, q.*, (m - q1) / (q0 - q1) AS r FROM d, q),
c AS (SELECT count(*) FILTER (m <= q0) AS nh, count(*) FILTER (m >= q1) AS ne, count(*) FILTER (m > q0 AND m < q1) AS nm, sum(r) FILTER (m > q0 AND m < q1) AS s, 10.0::DOUBLE / any_value(n) AS pmax FROM r),
t AS (SELECT *, CASE WHEN nm + ne - s = 0 THEN -1 ELSE (1 - pmax * (nh + s)) / (nm + ne - s) END AS pm, 1 / pmax - nh AS target FROM c),
k AS (SELECT k, sum(pow(r, 1 + k * 0.1::DOUBLE)) FILTER (m > q0 AND m < q1) AS s FROM r, range(91) x(k) GROUP BY k),
f AS (SELECT coalesce(min(k) FILTER (k.s <= target), 90) AS k FROM k, t),
w AS (SELECT CASE WHEN pm >= 0 THEN 1 WHEN target <= 0 THEN 10 WHEN f.k > 0 AND k.s < target THEN 1 + (f.k - 1) * 0.1::DOUBLE ELSE 1 + f.k * 0.1::DOUBLE END AS power, greatest(pm, 0) AS pmin, pmax FROM t, f JOIN k ON k.k = f.k),
p AS (SELECT event_id, CASE WHEN m <= q0 THEN pmax WHEN m >= q1 THEN pmin ELSE pmin + (pmax - pmin) * pow(r, power) END AS p FROM r, w)
SELECT event_id, round(p / sum(p) OVER (), 10) AS p FROM p"""


@query("hard_mining_prob", _MINING.format(metric="value", qmax="0.5"))
def hard_mining_prob(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(mining.index_probability(e, "value", quantile_max=0.5).select("event_id", "p"), 10)


@query("hard_mining_prob_power", _MINING.format(metric="-value", qmax="0.99"))
def hard_mining_prob_power(spark, sf):
    e = table(spark, sf, "events").select("event_id", (-F.col("value")).alias("m"))
    return rounded(mining.index_probability(e, "m").select("event_id", "p"), 10)

_EVAL = f"""WITH p AS (SELECT vec_id, label, px, CASE WHEN px % 5 = 0 THEN 0 ELSE v END AS y, v * v - 0.1 AS p FROM ({PIXELS}))
SELECT vec_id, 'set' || (vec_id % 3) AS ds_path, label, CAST(vec_id // 3 AS BIGINT) AS frame, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae,
  round(avg((p - y) * (p - y)) FILTER (y <> 0), 6) AS msem, round(avg(abs(p - y)) FILTER (y <> 0), 6) AS maem, round(max(abs(p - y)), 6) AS worst FROM p GROUP BY 1, 2, 3, 4"""


def _predictions(spark, sf):
    y = F.transform("data", lambda x, i: F.when(i % 5 == 0, 0.0).otherwise(x))
    v = vectors(spark, sf).withColumns({"y": y, "p": F.transform("data", lambda x: x * x - 0.1), "ds_path": F.concat(F.lit("set"), F.col("vec_id") % 3), "frame": F.floor(F.col("vec_id") / 3)})
    return v.select("vec_id", "ds_path", "label", "frame", "y", "p")


def _worst(truth, prediction):
    return max(abs(a - b).max() for a, b in zip(truth, prediction))


@query("evaluated_images", _EVAL)
def evaluated_images(spark, sf):
    """A row for each image: errors as expressions, the greatest one by a user's function."""
    return rounded(stats.evaluated(_predictions(spark, sf), "y", "p", metrics={"worst": _worst}))


@query("evaluated_tiles", _EVAL)
def evaluated_tiles(spark, sf):
    """The same when images come as four parts each."""
    parts = F.array(*[F.struct(F.slice("y", 16 * k + 1, 16).alias("y"), F.slice("p", 16 * k + 1, 16).alias("p")) for k in range(4)])
    df = _predictions(spark, sf).withColumn("t", F.explode(parts)).withColumns({"y": F.col("t.y"), "p": F.col("t.p")}).drop("t")
    return rounded(stats.evaluated(df, "y", "p", metrics={"worst": _worst}, by=["vec_id"], carried=["ds_path", "label", "frame"]))


@query("stream_weights", """WITH e AS (SELECT user_id, event_id % 3 AS epoch, value FROM events), l AS (SELECT user_id, max(epoch) AS epoch FROM e GROUP BY 1),
s AS (SELECT user_id, avg(value) AS v FROM e JOIN l USING (user_id, epoch) GROUP BY 1),""" + _MINING.format(metric="v", qmax="0.5").replace("SELECT event_id, v AS m FROM events", "SELECT user_id AS event_id, v AS m FROM s").strip().removeprefix("WITH").replace("SELECT event_id, round(p / sum(p) OVER (), 10) AS p", "SELECT event_id AS user_id, round(p / sum(p) OVER (), 9) AS p"))
def stream_weights(spark, sf):
    """Three epochs of metrics arrive as files; the weights after the last one follow each user's newest metrics."""
    root = scratch(spark, "feedback")
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 3).alias("epoch"), F.array("value", F.lit(0.0)).alias("metrics"))
    for k in range(3):
        e.where(F.col("epoch") == k).repartition(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feedback.follow(stream, ["user_id"], mining.Schedule(period=1, start=0, n_metrics=2), f"{root}/out", f"{root}/state", quantile_max=0.5)
    return rounded(feedback.weights(spark, f"{root}/out", 2), 9)
