"""Queries whose inner work is numpy on Arrow batches, and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattiq.functions import coords, images, kernels
from lattiq.operators import augment, parameters
from lattiq.plans.base import PIXELS, SHAPE, draw_sql as _draw, query, rounded, scratch, table, vectors
from lattiq.sources import sinks
from lattiq.streaming import epochs


@query("predict_linear", f"SELECT vec_id, round(sum(2 * v + 1), 5) AS total FROM ({PIXELS}) GROUP BY 1")
def predict_linear(spark, sf):
    out = sinks.predicted(vectors(spark, sf), lambda x: 2 * x + 1, shape=SHAPE)
    return rounded(out.select("vec_id", images.total(F.col("prediction")).alias("total")), 5)


@query("optimal_tiling", """WITH n AS (SELECT 64 / ((1 - 1 / 3.0::DOUBLE) * 9) AS n), t AS (SELECT CAST(floor(n + 0.5) AS BIGINT) AS m, n FROM n),
c AS (SELECT m AS k, 0 AS r FROM t UNION ALL SELECT CAST(floor(n + 1) AS BIGINT), 1 FROM t UNION ALL SELECT CAST(floor(n) AS BIGINT), 2 FROM t
UNION ALL SELECT m + i, 2 * i + 1 FROM t, range(1, 11) x(i) UNION ALL SELECT m - i, 2 * i + 2 FROM t, range(1, 11) x(i)), o AS (SELECT o_orderkey, o_orderkey % 97 + 1 AS b FROM orders)
SELECT o_orderkey, coalesce(min_by(b // k, r) FILTER (b % k = 0), b) AS batch, coalesce(min_by(k, r) FILTER (b % k = 0), 1) AS n_tiles FROM o, c WHERE k > 0 GROUP BY o_orderkey, b""")
def optimal_tiling(spark, sf):
    table_ = [(b, *coords.optimal_tiling(SHAPE, (3, 3), b)) for b in range(1, 98)]
    fit = spark.createDataFrame(table_, "b bigint, batch bigint, n_tiles bigint")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 + 1).alias("b"))
    return o.join(F.broadcast(fit), "b").select("o_orderkey", "batch", "n_tiles")


@query("gaussian_blur", f"""WITH d AS ({PIXELS}), w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) r(k)),
m AS (SELECT i, k, w, CASE WHEN i + k < 0 THEN -1 - i - k WHEN i + k > 7 THEN 15 - i - k ELSE i + k END AS j FROM range(8) a(i), w),
y AS (SELECT vec_id, i, px % 8 AS x, sum(w * v) AS v FROM m JOIN d ON px // 8 = j GROUP BY 1, 2, 3), z AS (SELECT vec_id, y.i AS y, m.i AS x, sum(w * v) AS v FROM m JOIN y ON y.x = m.j GROUP BY 1, 2, 3)
SELECT vec_id, round(sum(v * (y * 8 + x + 1)), 5) AS moment, round(max(v), 6) AS top, round(max(v) FILTER (y = 0 AND x = 7), 6) AS corner FROM z GROUP BY 1""")
def gaussian_blur(spark, sf):
    out = kernels.with_kernel(vectors(spark, sf), ["data"], "vec_id", SHAPE, lambda x, k: kernels.gaussian_blur(x, 1.0))
    moment = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round(moment, 5).alias("moment"), F.round(F.array_max("data"), 6).alias("top"), F.round(F.col("data")[7], 6).alias("corner"))


def _steps():
    return augment.pipeline(augment.Scaling(), augment.Illumination(points=3, grid=(2, 2), speckle=True), augment.Geometry(rotation=20, shift_y=0.1, zoom=(0.9, 1.1), flip_x=True, brightness=(0.8, 1.2)), seed=3)


_D = lambda n, low=0.0, high=1.0: f"({low}::DOUBLE + {_draw('vec_id', str(n), 3)} * ({high}::DOUBLE - {low}::DOUBLE))"


@query("augmentation_parameters", f"""WITH c AS (SELECT vec_id, {_D(1106)} < 0.5 AS g, {_D(1107)} < 0.5 AS p, {_D(1108)} < 0.5 AS s FROM embeddings WHERE false UNION ALL
SELECT vec_id, {_D(1109)} < 0.5, {_D(1110)} < 0.5, {_D(1111)} < 0.5 FROM embeddings), n AS (SELECT *, 0.1::DOUBLE / pow(1.5, g::INT + p::INT + s::INT - 1) AS most FROM c)
SELECT vec_id, round({_D(0, -20, 20)}, 9) AS theta, round({_D(1, -0.1, 0.1)}, 9) AS tx, round({_D(4, 0.9, 1.1)}, 9) AS zy, {_D(7)} < 0.5 AS flip_x, round({_D(8, 0.8, 1.2)}, 9) AS brightness,
  round({_D(1000)}, 9) AS low, round({_D(1001)}, 9) AS high, round({_D(1100, 0, 2)}, 9) AS blur, CAST(floor({_D(1101)} * 4294967296) AS BIGINT) AS noise,
  round({_D(1103, -1, 1)}, 9) AS delta, round({_D(1108, 0.2, 0.8)}, 9) AS light, round(CASE WHEN g THEN {_D(1112)} * most * 0.7 END, 9) AS gaussian, round(CASE WHEN s THEN {_D(1114)} * most END, 9) AS speckle FROM embeddings JOIN n USING (vec_id)""")
def augmentation_parameters(spark, sf):
    """What each row's augmentation will be, before anything is applied."""
    p = parameters.with_parameters(vectors(spark, sf), _steps(), ["data"], "vec_id")
    g, s, i = F.col("aug.geometry"), F.col("aug.data.scaling"), F.col("aug.data.illumination")
    return rounded(p.select("vec_id", *[g[c].alias(c) for c in ("theta", "tx", "zy", "flip_x", "brightness")], s["low"].alias("low"), s["high"].alias("high"), *[i[c].alias(c) for c in ("blur", "noise", "gaussian", "speckle")], i["deltas"][2].alias("delta"), i["grid"][3].alias("light")), 9)


@query("augmentation_given", f"""WITH t AS (SELECT vec_id, v, px // 8 AS y, px % 8 AS x, (px // 8 = 0 OR px // 8 = 7) AS edge, {_D(6)} < 0.5 AS fy, {_D(7)} < 0.5 AS fx, {_D(8, 0.5, 1.5)} AS b, {_D(1000, -0.1, 0.1)} AS c, {_D(1001, 1, 2)} AS s, {_D(2000, -0.1, 0.1)} AS c2, {_D(2001, 1, 2)} AS s2 FROM ({PIXELS})),
m AS (SELECT vec_id, bool_or(edge AND v > 0.27) AS held FROM t GROUP BY 1),
w AS (SELECT *, CASE WHEN fy AND NOT held THEN 7 - y ELSE y END * 8 + CASE WHEN fx THEN 7 - x ELSE x END + 1 AS place FROM t JOIN m USING (vec_id))
SELECT vec_id, held, round(sum((v - c) / s * b * place), 5) AS raw, round(sum((v - c2) / s2 * b * place), 5) AS other, CAST(sum(place) FILTER (v > 0.27) AS BIGINT) AS mask FROM w GROUP BY 1, 2""")
def augmentation_given(spark, sf):
    """Two channels and a mask by one geometry; where the mask touches the upper or lower edge, the flip in y is taken back before."""
    p = augment.pipeline(augment.Scaling(augment.BRIGHT_FIELD, center_range=(-0.1, 0.1), scale_range=(1, 2)), None, augment.Geometry(flip_y=True, flip_x=True, brightness=(0.5, 1.5)), seed=3)
    df = vectors(spark, sf).withColumns({"other": F.col("data"), "mask": F.transform("data", lambda x: F.when(x > 0.27, 1.0).otherwise(0.0))})
    touches = lambda m: images.touches_y_borders(m, SHAPE)[0] | images.touches_y_borders(m, SHAPE)[1]
    df = df.withColumn("held", touches(F.col("mask")))
    rows = parameters.with_parameters(df, p, ["data", "other", "mask"], "vec_id", ["mask"])
    rows = parameters.adjusted(rows, "mask", lambda g, m: F.when(touches(m), g.withField("flip_y", F.lit(False))).otherwise(g))
    out = parameters.apply_parameters(rows, p, ["data", "other", "mask"], SHAPE, ["mask"])
    moment = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("vec_id", "held", moment("data").alias("raw"), moment("other").alias("other"), F.nullif(moment("mask").cast("bigint"), F.lit(0).cast("bigint")).alias("mask")), 5)


@query("augmented_images")
def augmented_images(spark, sf):
    return _steps().apply(vectors(spark, sf), ["data"], "vec_id", SHAPE).select("vec_id", "data")


@query("elastic_images")
def elastic_images(spark, sf):
    out = kernels.with_kernel(vectors(spark, sf), ["data"], "vec_id", SHAPE, lambda x, k: kernels.elastic(x, 3, 0.5, k))
    return out.select("vec_id", "data")


@query("zoomed_images", f"""WITH p AS (SELECT vec_id, embedding, i, i // 15 * 0.5::DOUBLE AS y, i % 15 * 0.5::DOUBLE AS x FROM embeddings, range(225) r(i)),
q AS (SELECT *, floor(y)::INT AS a, floor(x)::INT AS b FROM p), c AS (SELECT *, least(a + 1, 7) AS a2, least(b + 1, 7) AS b2 FROM q),
v AS (SELECT vec_id, i, (embedding[a * 8 + b + 1]::DOUBLE * (1 - y + a) + embedding[a2 * 8 + b + 1]::DOUBLE * (y - a)) * (1 - x + b) + (embedding[a * 8 + b2 + 1]::DOUBLE * (1 - y + a) + embedding[a2 * 8 + b2 + 1]::DOUBLE * (y - a)) * (x - b) AS v FROM c)
SELECT vec_id, round(sum(v * (i + 1)), 4) AS moment, round(max(v) FILTER (i = 0), 6) AS first, round(max(v) FILTER (i = 224), 6) AS last, 225 AS n FROM v GROUP BY 1""")
def zoomed_images(spark, sf):
    out = kernels.with_kernel(vectors(spark, sf), ["data"], "vec_id", SHAPE, lambda x, k: kernels.zoomed(x, (15, 15)))
    moment = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round(moment, 4).alias("moment"), F.round(F.col("data")[0], 6).alias("first"), F.round(F.element_at("data", -1), 6).alias("last"), F.size("data").alias("n"))


@query("poisson_noise")
def poisson_noise(spark, sf):
    out = kernels.with_kernel(vectors(spark, sf), ["data"], "vec_id", SHAPE, lambda x, k: kernels.poisson_noise(x, 0.5, np.random.default_rng(k)))
    return out.select("vec_id", "data")


@query("stream_event_windows", """WITH m AS (SELECT max(ts) AS top FROM events), e AS (SELECT event_type, value, ts, date_trunc('day', ts) AS day FROM events WHERE event_id % 10 <> 0 UNION ALL
SELECT 'late', 1.0::DOUBLE, top - INTERVAL 30 HOUR, date_trunc('day', top - INTERVAL 30 HOUR) FROM m)
SELECT event_type, CAST(day AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM e, m WHERE day + INTERVAL 1 DAY <= top - INTERVAL 2 DAY OR event_type <> 'late' AND day + INTERVAL 1 DAY <= top - INTERVAL 2 DAY GROUP BY 1, 2""")
def stream_event_windows(spark, sf):
    """Events arrive as files. A window is written once, when the watermark (two days behind the newest event) has passed its end: the newest days
    are still open, and rows of a tenth of the events that come after their window was closed are dropped. A row on time comes
    between, as Spark drops by the watermark of the batch before."""
    root = scratch(spark, "stream")
    e = table(spark, sf, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    top = e.agg(F.max("ts")).first()[0]
    early, rest = e.where("event_id % 10 <> 0"), e.where("event_id % 10 = 0")
    late = rest.where(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= F.lit(top) - F.expr("INTERVAL 2 DAY"))  # too late when they come
    more = spark.range(1).select(F.lit("late").alias("event_type"), F.lit(1.0).alias("value"), (F.lit(top) - F.expr("INTERVAL 30 HOUR")).alias("ts"), F.lit(-1).cast("bigint").alias("event_id"))
    newest = e.where(F.col("ts") == F.lit(top)).limit(1)
    for part in (early.unionByName(newest.where("event_id % 10 = 0")), more, late):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    counts = epochs.windowed_counts(spark, f"{root}/in", e.schema, files_at_once=1)
    epochs.run_once(counts, f"{root}/out", f"{root}/state")
    return rounded(spark.read.parquet(f"{root}/out").select("event_type", F.to_date("start").alias("day"), "n", "total"), 4)


@query("stream_window_totals", "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_totals(spark, sf):
    """All windows as they are when the stream has read everything; none is closed."""
    schema = table(spark, sf, "events").schema
    root = scratch(spark, "stream")
    counts = epochs.windowed_counts(spark, f"{sf}/event[s].parquet", schema)
    epochs.run_batches(counts, f"{root}/state", lambda df, no: df.write.mode("overwrite").parquet(f"{root}/out"), mode="complete")
    return rounded(spark.read.parquet(f"{root}/out").select("event_type", F.to_date("start").alias("day"), "n", "total"), 4)
