"""Queries of stores written and read back, of draws along arrays, drawn strides and concatenated batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattiq.dataset import ArrayDataset
from lattiq.functions import draws, images, paths
from lattiq.operators import align, rowset, temporal, union
from lattiq.operators.positions import with_positions
from lattiq.plans.base import HASH, PIXELS, SHAPE, query, rounded, scratch, table, vectors
from lattiq.sources import connector, files, sinks


# stores


@query("predictions_written", f"SELECT 'set' || (vec_id % 3) || '/out' AS ds_path, vec_id AS im_idx, round(sum(v * v), 5) AS total FROM ({PIXELS}) GROUP BY 1, 2")
def predictions_written(spark, sf):
    """A model's output, written under its own channel name and read again."""
    path = scratch(spark, "predictions")
    v = vectors(spark, sf).select(F.concat(F.lit("set"), F.col("vec_id") % 3, F.lit("/raw")).alias("ds_path"), F.col("vec_id").alias("im_idx"), "data")
    sinks.write_predictions(sinks.predicted(v, np.square, shape=SHAPE), path, "prediction", "raw", "out")
    back = spark.read.parquet(path)
    return rounded(back.select("ds_path", F.col("im_idx").cast("bigint"), images.total(F.col("data")).alias("total")), 5)


def _folder(spark, sf, kind):
    folder = scratch(spark, kind)
    v = vectors(spark, sf).select(F.concat(F.lit("set"), F.col("vec_id") % 3, F.lit("/raw")).alias("ds_path"), F.col("vec_id").alias("im_idx"), "data")
    make = sinks.npy_files if kind == "npy" else lambda *a: sinks.tiff_files(*a, dtype="float64")
    sinks.write_files(make(v, 10**9, SHAPE), folder)
    back = files.open_dataset(spark, folder, "raw")
    ds = F.regexp_extract("ds_path", "(set[0-9]+)/raw$", 1)
    return rounded(back.select(ds.alias("ds_path"), "im_idx", F.size("shape").alias("axes"), images.total(F.col("data")).alias("total")), 5)


_FOLDER = f"""WITH t AS (SELECT vec_id, 'set' || (vec_id % 3) AS ds_path, sum(v) AS s FROM ({PIXELS}) GROUP BY 1, 2)
SELECT ds_path, row_number() OVER (PARTITION BY ds_path ORDER BY vec_id) - 1 AS im_idx, 2 AS axes, round(s, 5) AS total FROM t"""


@query("npy_folder", _FOLDER)
def npy_folder(spark, sf):
    """A file for each image, opened as a folder."""
    return _folder(spark, sf, "npy")


@query("tiff_folder", _FOLDER)
def tiff_folder(spark, sf):
    return _folder(spark, sf, "tif")


def _sets(spark, sf):
    """Embeddings as images of three sets."""
    v = vectors(spark, sf)
    return v.select(F.concat(F.lit("set"), F.col("vec_id") % 3, F.lit("/raw")).alias("ds_path"), F.col("vec_id").alias("im_idx"), F.array(*map(F.lit, SHAPE)).alias("shape"), "data")


def _pixels_of(back):
    moment = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select("ds_path", "im_idx", F.col("shape")[1].alias("width"), moment.alias("moment")), 5)


_SET_ONE = f"""WITH t AS (SELECT vec_id, sum(v * (px + 1)) AS m FROM ({PIXELS}) WHERE vec_id % 3 = 1 GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS im_idx, m FROM t)
SELECT '{{path}}' AS ds_path, im_idx, 8 AS width, round(m, 5) AS moment FROM n WHERE {{where}}"""


@query("connector_files", _SET_ONE.format(path="set1/raw", where="im_idx >= 20"))
def connector_files(spark, sf):
    """A file for each image, written and read by the data source; only the files of one set are planned."""
    folder = scratch(spark, "files")
    connector.register(spark)
    _sets(spark, sf).write.format(connector.NAME).option("extension", "tif").option("dtype", "float64").mode("append").save(folder)
    back = spark.read.format(connector.NAME).load(folder).where("ds_path = 'set1/raw' and im_idx >= 20")
    return _pixels_of(back)


@query("connector_frames", _SET_ONE.format(path="set1/raw.npy", where="im_idx BETWEEN 3 AND 90"))
def connector_frames(spark, sf):
    """A file of many frames for each set; several tasks read ranges of one file."""
    folder = scratch(spark, "frames")
    connector.register(spark)
    rows = _sets(spark, sf).repartition("ds_path").sortWithinPartitions("ds_path", "im_idx")
    rows.write.format(connector.NAME).option("frames", "true").mode("append").save(folder)
    back = spark.read.format(connector.NAME).option("frames", "true").option("taskBytes", 16 * 512).load(folder)
    return _pixels_of(back.where(F.col("ds_path").startswith("set1/") & F.col("im_idx").between(3, 90)))


@query("range_overwritten", """SELECT 's' || (o_custkey % 2) AS ds_path, o_orderkey AS im_idx, CASE WHEN o_orderkey BETWEEN 3000 AND 4500 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders
UNION ALL SELECT 's9', k, 1.0::DOUBLE FROM range(3000, 3010) r(k)""")
def range_overwritten(spark, sf):
    """A range of images written over a store, and new ones beside it."""
    path = scratch(spark, "ranges")
    o = table(spark, sf, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 2).alias("ds_path"), F.col("o_orderkey").alias("im_idx"), F.col("o_totalprice").alias("v"))
    sinks.write_range(o, path, scratch(spark, "staging"))
    new = o.where("im_idx between 3000 and 4500").withColumn("v", -F.col("v")).unionByName(spark.range(3000, 3010).select(F.lit("s9").alias("ds_path"), F.col("id").alias("im_idx"), F.lit(1.0).alias("v")))
    sinks.write_range(new, path, scratch(spark, "staging"))
    return spark.read.parquet(path).select("ds_path", "im_idx", "v")


@query("routed_writes", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS store FROM orders")
def routed_writes(spark, sf):
    """Each row to the store that owns its path."""
    stores = {"1": scratch(spark, "urgent"), "": scratch(spark, "other")}
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ds_path"), "o_orderkey")
    sinks.write_routed(o, stores, scratch(spark, "routed"))
    return union.union_all([spark.read.parquet(stores[k]).select("o_orderkey", F.lit(name).alias("store")) for k, name in (("1", "urgent"), ("", "other"))])


@query("inspect_ids", """WITH c AS (SELECT event_type AS ds_path, count(*) AS n FROM events GROUP BY 1), o AS (SELECT *, CAST(row_number() OVER (ORDER BY ds_path) - 1 AS INTEGER) AS ds_idx, sum(n) OVER (ORDER BY ds_path) - n AS offset_ FROM c)
SELECT k AS global_idx, CAST(k - offset_ AS BIGINT) AS im_idx, ds_idx, ds_path FROM range(0, 900, 7) r(k), o WHERE k >= offset_ AND k < offset_ + n""")
def inspect_ids(spark, sf):
    parts = align.catalog(table(spark, sf, "events").select(F.col("event_type").alias("ds_path")))
    return align.inspected(spark.range(0, 900, 7).select(F.col("id").alias("global_idx")), parts)


# draws


def _u(n: str) -> str:
    return f"({HASH.format(f'({n})')}) / 4294967296.0::DOUBLE"


@query("choice_weighted", f"""WITH w AS (SELECT px, sum(px % 4) OVER (ORDER BY px) AS c FROM (SELECT unnest(range(64)) AS px)),
d AS (SELECT vec_id, embedding, i, (SELECT count(*) FROM w WHERE c <= {_u('vec_id * 5 + i')} * 96) AS j FROM embeddings, range(5) r(i))
SELECT vec_id, i AS draw, CAST(embedding[j + 1] AS DOUBLE) AS v FROM d""")
def choice_weighted(spark, sf):
    p = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (j % 4).cast("double"))
    drawn = draws.choice(F.col("data"), 5, F.col("vec_id"), p)
    return vectors(spark, sf).select("vec_id", F.posexplode(drawn).alias("draw", "v")).withColumn("draw", F.col("draw").cast("bigint"))


@query("choice_distinct", f"""WITH p AS (SELECT vec_id, v, px, row_number() OVER (PARTITION BY vec_id ORDER BY {HASH.format('(vec_id * 64 + px + 3)')}, px) - 1 AS draw FROM ({PIXELS}))
SELECT vec_id, draw, v FROM p WHERE draw < 5""")
def choice_distinct(spark, sf):
    drawn = draws.choice(F.col("data"), 5, F.col("vec_id"), replace=False, seed=3)
    return vectors(spark, sf).select("vec_id", F.posexplode(drawn).alias("draw", "v")).withColumn("draw", F.col("draw").cast("bigint"))


@query("frame_stack_drawn", f"""WITH c AS (SELECT conv_id, turn, len(text) AS n, conv_id // 8 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
d AS (SELECT *, 1 + CAST(floor({HASH.format('(b + 5)')} / 65536) AS BIGINT) % 3 AS s, {_u('b + 6')} < 0.25 AS still FROM c)
SELECT d.conv_id, d.turn, CASE WHEN still THEN d.n ELSE x.n END AS before, d.n AS current, CASE WHEN still THEN d.n ELSE y.n END AS after FROM d
JOIN c x ON x.conv_id = d.conv_id AND x.p = greatest(d.p - s, 0) JOIN c y ON y.conv_id = d.conv_id AND y.p = least(d.p + s, d.m - 1)""")
def frame_stack_drawn(spark, sf):
    """A stride from 1 to 3 for each batch of eight conversations; a quarter of the batches see only the current frame."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    out = temporal.drawn_frame_stack(c, ["n"], F.floor(F.col("conv_id") / 8), 1, 3, 1, 0.25, 5, series="conv_id", im="turn")
    return out.select("conv_id", "turn", F.col("n")[0].alias("before"), F.col("n")[1].alias("current"), F.col("n")[2].alias("after"))


# batches, lists, schedules


@query("concat_batches", """WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier), b AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT id, pos // 16 AS batch, 0 AS part FROM a UNION ALL SELECT id, CAST((SELECT ceil(max(n) / 16.0) FROM a) AS BIGINT) + pos // 40, 1 FROM b""")
def concat_batches(spark, sf):
    parts, counts = [], []
    for name, key, size in (("supplier", "s_suppkey", 16), ("events", "event_id", 40)):
        t = table(spark, sf, name).select(F.col(key).alias("id"))
        n = t.count()
        parts.append(rowset.batched(with_positions(t, "id"), size, n).select("id", "batch"))
        counts.append(rowset.n_batches(n, size))
    return union.concat_batches(parts, counts)


@query("concat_drawn", f"""WITH s AS (SELECT s_suppkey // 4 AS batch, sum(s_acctbal + 1000) AS w FROM supplier GROUP BY 1), c AS (SELECT c_custkey // 10 AS batch, sum(c_acctbal + 1000) AS w FROM customer GROUP BY 1),
b AS (SELECT 0 AS part, * FROM s UNION ALL SELECT 1, * FROM c), o AS (SELECT *, {HASH.format('(batch + 3)')} AS h, CAST(greatest(1, floor(count(*) OVER (PARTITION BY part) * CASE part WHEN 0 THEN 2.5 ELSE 0.5 END + 0.5)) AS BIGINT) AS size FROM b),
e AS (SELECT *, sum(w) OVER k / sum(w) OVER (PARTITION BY part) * size AS stop, w / sum(w) OVER (PARTITION BY part) * size AS own FROM o WINDOW k AS (PARTITION BY part ORDER BY h, batch)),
p AS (SELECT k, k + {_u('k + 4')} AS x FROM range(2000) r(k)) SELECT part, CAST(batch AS BIGINT) AS batch, count(*) AS times FROM e JOIN p ON k < size AND x < stop AND x >= stop - own GROUP BY 1, 2""")
def concat_drawn(spark, sf):
    """Batches of two parts, nested, each drawn by its weight: two and a half times as many of the one, half of the other."""
    s = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 4).alias("batch")).agg(F.sum(F.col("s_acctbal") + 1000).alias("w"))
    c = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("batch")).agg(F.sum(F.col("c_acctbal") + 1000).alias("w"))
    parts = union.flattened([[s], [[c]]])
    both = union.union_all([p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    plan = union.batch_plan(both, [2.5, 0.5], 2, "w", seed=3)
    return plan.groupBy("part", "batch").agg(F.count("*").alias("times"))


@query("transposed_lists", "SELECT o_custkey, len(list(o_orderkey)) AS n, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey, list(o_totalprice ORDER BY o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def transposed_lists(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    t = o.select("o_custkey", F.size("x").cast("bigint").alias("n"), union.transposed(F.col("x"), ["o_orderkey", "o_totalprice"]).alias("t"))
    return t.select("o_custkey", "n", "t.o_orderkey", "t.o_totalprice")


@query("parameters_updated", "SELECT doc_id, CASE WHEN lang = 'flip' THEN 3 ELSE 1 END AS flip, 3 AS lang_value, CASE WHEN lang = 'flip' THEN 2 ELSE 3 END AS n FROM documents")
def parameters_updated(spark, sf):
    """Fixed parameters with a row's own in their place."""
    own = F.create_map(F.coalesce("lang", F.lit("none")), F.lit(3), F.lit("zoom"), F.lit(4))
    p = draws.updated(F.create_map(F.lit("flip"), F.lit(1), F.lit("zoom"), F.lit(2)), own)
    d = table(spark, sf, "documents").select("doc_id", "lang", p.alias("p"))
    return d.select("doc_id", F.col("p")["flip"].alias("flip"), F.element_at("p", F.coalesce("lang", F.lit("none"))).alias("lang_value"), F.size("p").alias("n"))


@query("schedules", """SELECT o_orderkey, round(2 * ((1 - 0.05) * (0.5 * (1 + cos(pi() * least(o_orderkey % 500, 400) / 400))) + 0.05), 9) AS epsilon, (o_orderkey % 50 + 1) % 7 = 0 AS every_7, o_orderkey % 50 + 1 IN (1, 5, 20) AS listed FROM orders""")
def schedules(spark, sf):
    e = F.col("o_orderkey") % 50
    o = table(spark, sf, "orders")
    return rounded(o.select("o_orderkey", draws.cosine_decay(F.col("o_orderkey") % 500, 400, 2.0, 0.1).alias("epsilon"), draws.due(e, 7).alias("every_7"), draws.due(e, [1, 5, 20]).alias("listed")), 9)

# the front door


def _opened(spark, sf):
    """Two stores of one collection: images and masks, a path for each set and channel, and one image of the mean for each set."""
    v = vectors(spark, sf).withColumn("set", F.concat(F.lit("set"), F.col("vec_id") % 3))
    path = lambda c: F.concat("set", F.lit(f"/{c}")).alias("ds_path")
    raw = v.select(path("raw"), F.col("vec_id").alias("im_idx"), "data", F.col("label").cast("string").alias("label"))
    mask = v.where("vec_id % 7 <> 0").select(path("mask"), F.col("vec_id").alias("im_idx"), F.transform("data", lambda x: F.when(x > 0.1, 1.0).otherwise(0.0)).alias("data"))
    flat = v.groupBy(path("flat")).agg(F.lit(0).cast("bigint").alias("im_idx"), F.array(F.avg(F.col("data")[0])).alias("data"))
    roots = {}
    for name, t in (("raw", raw), ("mask", mask), ("flat", flat)):
        roots[name] = f"{scratch(spark, name)}.parquet"
        t.write.parquet(roots[name])
    return ArrayDataset.open(spark, roots, SHAPE, masks=["mask"], singletons=["flat"])


_SET = f"SELECT vec_id, 'set' || (vec_id % 3) AS ds_path, label, px, v FROM ({PIXELS}) WHERE vec_id % 7 <> 0"


@query("dataset_tiles", f"""WITH d AS ({_SET}), f AS (SELECT 'set' || (vec_id % 3) AS ds_path, avg(embedding[1]::DOUBLE) AS flat FROM embeddings GROUP BY 1)
SELECT ds_path, vec_id AS im_idx, CAST(px // 32 * 2 + px % 8 // 4 AS INTEGER) AS tile_id, round(sum(v), 5) AS raw, CAST(count(*) FILTER (v > 0.1) AS BIGINT) AS mask, round(any_value(flat), 6) AS flat
FROM d JOIN f USING (ds_path) GROUP BY 1, 2, 3""")
def dataset_tiles(spark, sf):
    """Three stores opened together: images without a mask are left out, each set's single image meets all of its rows."""
    ds = _opened(spark, sf).select(["raw", "mask", "flat"])
    flat = ds.df.select("ds_path", "im_idx", F.col("flat")[0].alias("flat"))
    t = ds.select(["raw", "mask"]).tile((4, 4), mode="no_overlap").df
    out = t.select("ds_path", "im_idx", "tile_id", images.total(F.col("raw")).alias("raw"), images.total(F.col("mask")).cast("bigint").alias("mask"))
    return out.join(flat, ["ds_path", "im_idx"]).select("ds_path", "im_idx", "tile_id", F.round("raw", 5).alias("raw"), "mask", F.round("flat", 6).alias("flat"))


@query("dataset_evaluated", f"""WITH d AS ({_SET}), n AS (SELECT vec_id, row_number() OVER (ORDER BY 'set' || (vec_id % 3), vec_id) - 1 AS global_idx FROM embeddings WHERE vec_id % 7 <> 0)
SELECT global_idx, ds_path, CAST(label AS VARCHAR) AS label, round(avg(pow(2 * v - (v > 0.1)::INT, 2)), 6) AS mse, round(avg(abs(2 * v - 1)) FILTER (v > 0.1), 6) AS maem FROM d JOIN n USING (vec_id) GROUP BY 1, 2, 3""")
def dataset_evaluated(spark, sf):
    """Rows numbered over all sets, a model applied, its errors by image."""
    ds = _opened(spark, sf).select(["raw", "mask"]).numbered()
    return rounded(ds.evaluate(lambda x: 2 * x, "mask", ["mse", "maem"], carried=["global_idx", "ds_path", "label"]))


@query("dataset_split", f"""WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY 'set' || (vec_id % 3), vec_id) - 1 AS g FROM embeddings WHERE vec_id % 7 <> 0),
c AS (SELECT label AS s, count(*) AS m, sum(count(*)) OVER () AS n FROM n GROUP BY 1), z AS (SELECT *, CAST(n - ceil(n * 0.25::DOUBLE) AS BIGINT) AS k FROM c),
q AS (SELECT *, m * k // n AS t, m * k % n AS rest FROM z), t AS (SELECT *, t + (row_number() OVER (ORDER BY rest DESC, CAST(s AS VARCHAR)) <= k - sum(t) OVER ())::INT AS train FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format('g')}, g) - 1 AS r FROM n), e AS (SELECT r.*, train FROM r JOIN t ON label = s WHERE r >= train),
p AS (SELECT g, vec_id, row_number() OVER (ORDER BY {HASH.format('(g + 5)')}, g) - 1 AS pos FROM e) SELECT g AS global_idx, vec_id AS im_idx, CAST(pos // 8 AS BIGINT) AS batch FROM p""")
def dataset_split(spark, sf):
    """A quarter of the rows, spread over the labels, shuffled and cut into batches of eight."""
    _, test = _opened(spark, sf).select(["raw"]).numbered().split(0.25, stratum="label")
    return test.batched(8, seed=5).select("global_idx", "im_idx", "batch")


# paths, logs, ranges


@query("channel_paths", "SELECT DISTINCT 'exp' || (o_custkey % 4) || '/raw' AS ds_path, 'exp' || (o_custkey % 4) || '/mask' AS mask_path FROM orders WHERE o_custkey % 4 < 3")
def channel_paths(spark, sf):
    """The paths of a channel in some groups, and of another channel beside it."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("exp"), F.col("o_custkey") % 4, F.when(F.col("o_orderkey") % 2 == 0, "/raw").otherwise("/mask")).alias("ds_path"))
    p = files.datasets_with_suffix(o, "/raw", "exp[012].*")
    return p.select("ds_path", paths.channel_path(F.col("ds_path"), "raw", "mask").alias("mask_path"))


@query("null_values", "SELECT doc_id, quality IS NULL OR quality = 1 AS one, (quality IS NULL OR quality = 1) AND (toxic IS NULL OR toxic = 1) AS both FROM labels")
def null_values(spark, sf):
    q = F.array(F.col("quality").cast("double"))
    return table(spark, sf, "labels").select("doc_id", images.is_null_value(q, 1).alias("one"), images.is_null_value(F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")), 1).alias("both"))


@query("mapped_range", f"SELECT vec_id, round(sum(CASE WHEN v <= -0.1 THEN 2 WHEN v >= 0.2 THEN 3 ELSE 2 + (v + 0.1) / (0.2 + 0.1) END), 5) AS total FROM ({PIXELS}) GROUP BY 1")
def mapped_range(spark, sf):
    return rounded(vectors(spark, sf).select("vec_id", images.total(images.map_range(F.col("data"), -0.1, 0.2, 2.0, 3.0)).alias("total")), 5)


@query("metrics_logged", "SELECT CAST(o_orderkey % 5 AS INTEGER) AS epoch, round(avg(o_totalprice), 4) AS loss, count(*) AS n FROM orders GROUP BY 1")
def metrics_logged(spark, sf):
    """A row for each epoch, appended one epoch after the other and read back in order."""
    o = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).cast("int").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), F.count("*").alias("n"))
    log = scratch(spark, "log")
    for k in range(5):
        sinks.append_log(o.where(F.col("epoch") == k), log)
    return sinks.read_log(spark, log, "epoch int, loss double, n bigint")
