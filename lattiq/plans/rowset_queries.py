"""Queries of row sets, joins, time, tiles, unions and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import coords, images, ndim, paths
from lattiq.operators import align, boxes, rowset, temporal, tiles, union
from lattiq.operators.positions import hash_order, with_positions
from lattiq.plans.base import HASH, PIXELS, SHAPE, draw_sql as _draw, query, rounded, table, vectors

_EVENT_HASH = HASH.format("event_id")


# strings and paths


@query("neighbour_label_fn", """
WITH l AS (SELECT conv_id, turn, 'c' || conv_id || '_f' || lpad(CAST(turn AS VARCHAR), 5, '0') AS label FROM conversations),
n AS (SELECT *, CAST(right(label, 5) AS INTEGER) - 1 AS p, CAST(right(label, 5) AS INTEGER) + 2 AS q FROM l)
SELECT conv_id, turn, CASE WHEN p >= 0 THEN left(label, len(label) - 5) || lpad(CAST(p AS VARCHAR), 5, '0') END AS prev, left(label, len(label) - 5) || lpad(CAST(q AS VARCHAR), 5, '0') AS next2 FROM n""")
def neighbour_label_fn(spark, sf):
    label = F.concat(F.lit("c"), F.col("conv_id"), F.lit("_f"), paths.zero_padded(F.col("turn"), 5))
    return table(spark, sf, "conversations").select("conv_id", "turn", paths.neighbor_label(label, -1).alias("prev"), paths.neighbor_label(label, 2).alias("next2"))


@query("path_functions", """
SELECT page_id, reverse(regexp_replace(reverse(url), '/', '|')) AS replaced, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent,
  list_last(string_split(url, '/')) AS base, lower(regexp_extract(list_last(string_split(url, '/')), '(\\.[^.]*)$', 1)) AS ext FROM pages""")
def path_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", paths.replace_last(u, "/", "|").alias("replaced"), paths.parent_path(u).alias("parent"), paths.base_name(u).alias("base"), paths.extension(u).alias("ext"))


@query("group_filter", "SELECT page_id, contains(url, '/en/') AS part, regexp_matches(url, 'blog.*html') AS pattern FROM pages WHERE contains(url, '/en/') OR regexp_matches(url, 'blog.*html')")
def group_filter(spark, sf):
    part, pattern = paths.in_group(F.col("url"), "/en/"), paths.in_group(F.col("url"), "blog.*html")
    return table(spark, sf, "pages").where(part | pattern).select("page_id", part.alias("part"), pattern.alias("pattern"))


@query("path_suffix", "SELECT page_id, url FROM pages WHERE ends_with(url, '.html') AND contains(url, 'example.com')")
def path_suffix(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").endswith(".html") & paths.in_group(F.col("url"), "example.com")).select("page_id", "url")


# filters


@query("allowed_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowed_semi(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return rowset.allowed(table(spark, sf, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("leak_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def leak_anti(spark, sf):
    return rowset.excluded(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id"), "doc_id")


def _mask():
    return F.transform("data", lambda x: F.when(x > 0.27, x).otherwise(0.0))


@query("void_filter", f"SELECT vec_id, bool_and(v <= 0.27) AS void FROM ({PIXELS}) GROUP BY 1")
def void_filter(spark, sf):
    return vectors(spark, sf).select("vec_id", images.is_void(_mask()).alias("void"))


@query("nonvoid_sum_threshold", f"SELECT vec_id FROM ({PIXELS}) GROUP BY 1 HAVING round(sum(v), 6) > 0.5")
def nonvoid_sum_threshold(spark, sf):
    return vectors(spark, sf).where(F.round(images.total(F.col("data")), 6) > 0.5).select("vec_id")


@query("border_objects", f"SELECT vec_id, bool_or(px < 8 AND v > 0.27) AS first_row, bool_or(px >= 56 AND v > 0.27) AS last_row FROM ({PIXELS}) GROUP BY 1")
def border_objects(spark, sf):
    b = images.touches_y_borders(_mask(), SHAPE)
    return vectors(spark, sf).select("vec_id", b[0].alias("first_row"), b[1].alias("last_row"))


_VOID = """
WITH e AS (SELECT event_id, value < {cut} AS void, {h} AS h FROM events),
n AS (SELECT count(*) FILTER (void) AS nv, count(*) FILTER (NOT void) AS nn FROM e)"""


@query("void_proportion_cap", _VOID.format(cut="20", h=_EVENT_HASH) + """,
r AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id) - 1 AS r FROM e WHERE void)
SELECT event_id, 0 AS copy FROM e WHERE NOT void UNION ALL SELECT event_id, 0 FROM r, n WHERE r < CAST(floor(0.1::DOUBLE / (1 - 0.1::DOUBLE) * nn) AS BIGINT)""")
def void_proportion_cap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rowset.with_void_proportion(e, "event_id", F.col("value") < 20, 0.0, 0.1).select("event_id", "copy")


@query("void_proportion_fill", _VOID.format(cut="1", h=_EVENT_HASH) + """,
r AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id) - 1 AS r FROM e WHERE void),
t AS (SELECT CAST(floor(0.5::DOUBLE / (1 - 0.5::DOUBLE) * nn) AS BIGINT) AS least, nv FROM n)
SELECT event_id, 0 AS copy FROM e WHERE NOT void
UNION ALL SELECT event_id, CAST(unnest(range(least // nv + CASE WHEN r < least % nv THEN 1 ELSE 0 END)) AS INTEGER) FROM r, t""")
def void_proportion_fill(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rowset.with_void_proportion(e, "event_id", F.col("value") < 1, 0.5, 0.9).select("event_id", "copy")


# order and batches


def _events(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return with_positions(e, "event_id"), e.count()


_POS = "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"


@query("shuffle_positions", f"SELECT event_id, row_number() OVER (ORDER BY {_EVENT_HASH}, event_id) - 1 AS pos FROM events")
def shuffle_positions(spark, sf):
    return rowset.shuffled(table(spark, sf, "events").select("event_id"), "event_id")


@query("batch_keep", _POS + " SELECT pos // 33 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM e GROUP BY 1")
def batch_keep(spark, sf):
    e, n = _events(spark, sf)
    return _batches(rowset.batched(e, 33, n))


@query("batch_remove", _POS + " SELECT pos // 33 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM e WHERE pos // 33 < n // 33 GROUP BY 1")
def batch_remove(spark, sf):
    e, n = _events(spark, sf)
    return _batches(rowset.batched(e, 33, n, rowset.REMOVE))


@query("batch_constant", _POS + """, b AS (SELECT pos // 33 AS batch, event_id FROM e WHERE pos // 33 < n // 33
UNION ALL SELECT n // 33, event_id FROM e WHERE n % 33 > 0 AND pos >= n - 33)
SELECT batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY 1""")
def batch_constant(spark, sf):
    e, n = _events(spark, sf)
    return _batches(rowset.batched(e, 33, n, rowset.CONSTANT_SIZE))


def _batches(df):
    return df.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("step_tiling", """WITH o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, pos + k * n AS pos FROM o, range(1000) r(k) WHERE pos + k * n < 7 * 45""")
def step_tiling(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    n = s.count()
    return rowset.stepped(with_positions(s, "s_suppkey"), 7, 45, n)


@query("refilled_batch", _POS + """, b AS (SELECT event_id, pos, pos // 50 AS batch, CAST(ceil(n / 50.0) AS BIGINT) AS nb FROM e), s AS (SELECT * FROM b WHERE event_id % 4 = 0)
SELECT event_id FROM s ORDER BY ((batch - 3) % nb + nb) % nb, pos LIMIT 40""")
def refilled_batch(spark, sf):
    e, n = _events(spark, sf)
    b = rowset.batched(e, 50, n).where("event_id % 4 = 0")
    return rowset.refilled_batch(b, 3, rowset.n_batches(n, 50), 40).select("event_id")


# samples


_RANK = f"r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EVENT_HASH}, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("stratified_proportion", f"WITH {_RANK} SELECT event_id, event_type, 0 AS copy FROM r WHERE r < floor(n * 0.3::DOUBLE + 0.5)")
def stratified_proportion(spark, sf):
    return rowset.picked(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 0.3, "event_type")


@query("oversample_proportion", f"WITH {_RANK} SELECT event_id, event_type, CAST(unnest(range(2 + CASE WHEN r < floor(n * 0.25::DOUBLE + 0.5) THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r")
def oversample_proportion(spark, sf):
    return rowset.picked(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 2.25, "event_type")


@query("weights_normalised", """SELECT event_id, round(CASE WHEN sum(w) OVER (PARTITION BY event_type) = 0 THEN 1.0 / count(*) OVER (PARTITION BY event_type) ELSE w / sum(w) OVER (PARTITION BY event_type) END, 9) AS p
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS w FROM events)""")
def weights_normalised(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value")).alias("w"))
    return rounded(rowset.normalized_weights(e, "w", "event_type").select("event_id", "p"), 9)


@query("weighted_resample", f"""
WITH e AS (SELECT event_id, value AS w, {_EVENT_HASH} AS h FROM events),
c AS (SELECT event_id, sum(w) OVER (ORDER BY h, event_id) / sum(w) OVER () * 500 AS stop, w / sum(w) OVER () * 500 AS part FROM e),
p AS (SELECT k + ((k + 1) * 2654435761 % 4294967296) / 4294967296.0::DOUBLE AS x FROM range(500) r(k))
SELECT event_id, count(*) AS times FROM c JOIN p ON x < stop AND x >= stop - part GROUP BY event_id""")
def weighted_resample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rowset.resampled(e, "value", 500, "event_id").groupBy("event_id").agg(F.count("*").alias("times"))


@query("split_hash", f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {_EVENT_HASH}, event_id) - 1 AS r, count(*) OVER () AS n FROM events) SELECT event_id, r < CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS is_test FROM r")
def split_hash(spark, sf):
    train, test = rowset.split(table(spark, sf, "events").select("event_id"), "event_id", 0.2)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("split_stratified", f"""WITH c AS (SELECT event_type AS s, count(*) AS m, sum(count(*)) OVER () AS n FROM events GROUP BY 1), z AS (SELECT *, CAST(n - ceil(n * 0.3::DOUBLE) AS BIGINT) AS n_train FROM c),
q AS (SELECT *, m * n_train // n AS t, m * n_train % n AS rest FROM z), t AS (SELECT *, t + (row_number() OVER (ORDER BY rest DESC, s) <= n_train - sum(t) OVER ())::INT AS train FROM q),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EVENT_HASH}, event_id) - 1 AS r FROM events)
SELECT event_id, event_type, r >= train AS is_test FROM r JOIN t ON event_type = s""")
def split_stratified(spark, sf):
    """Three tenths of the rows, rounded up, spread over the kinds of events by largest remainders."""
    train, test = rowset.split_by_size(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 0.3, stratum="event_type")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("split_documents", f"""WITH r AS (SELECT doc_id, lang, len(text) AS n, row_number() OVER (ORDER BY {HASH.format('doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS rows FROM documents)
SELECT doc_id, lang, n, pos < CAST(floor(rows * 0.2::DOUBLE) AS BIGINT) AS is_test FROM r""")
def split_documents(spark, sf):
    """Whole rows, texts too, go to either side."""
    train, test = rowset.split(table(spark, sf, "documents"), "doc_id", 0.2)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.select("doc_id", "lang", F.length("text").cast("bigint").alias("n"), "is_test")


@query("shuffled_orders", f"""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, row_number() OVER (ORDER BY {HASH.format('(o_orderkey + 3)')}, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, o_totalprice, o_orderpriority, pos FROM o""")
def shuffled_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rowset.shuffled(o, "o_orderkey", 3)


@query("concat_proportion", f"""WITH a AS (SELECT event_id AS id, 0 AS part, row_number() OVER (ORDER BY {_EVENT_HASH}, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
b AS (SELECT s_suppkey AS id, 1 AS part, row_number() OVER (ORDER BY {HASH.format('s_suppkey')}, s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier)
SELECT id, part, pos FROM a WHERE pos < greatest(1, floor(n * 0.1::DOUBLE + 0.5)) UNION ALL SELECT id, part, pos + k * n FROM b, range(10) r(k) WHERE pos + k * n < greatest(1, floor(n * 2.5::DOUBLE + 0.5))""")
def concat_proportion(spark, sf):
    parts = [table(spark, sf, "events").select(F.col("event_id").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))]
    return union.concat_with_proportions(parts, [0.1, 2.5], "id").select("id", "part", "pos")


@query("decimated_batches", "SELECT event_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 10 AS b FROM events) WHERE b IN (SELECT floor(k * 2.5::DOUBLE) FROM range(100000) r(k))")
def decimated_batches(spark, sf):
    from lattiq.operators import stats

    e, n = _events(spark, sf)
    return stats.decimated(rowset.batched(e, 10, n), "batch", 2.5).select("event_id")


# unions and sets


@query("union_last_wins", """WITH s AS (SELECT o_orderkey, o_totalprice AS v, 0 AS s FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, -o_totalprice, 1 FROM orders WHERE o_orderkey % 3 > 0),
m AS (SELECT *, max(s) OVER (PARTITION BY o_orderkey) AS l, min(s) OVER (PARTITION BY o_orderkey) AS store_no FROM s) SELECT o_orderkey, v, store_no FROM m WHERE s = l""")
def union_last_wins(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 < 2").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = o.where("o_orderkey % 3 > 0").select("o_orderkey", (-F.col("o_totalprice")).alias("v"))
    return union.union_last_wins([a, b], "o_orderkey").select("o_orderkey", "v", "store_no")


@query("setdiff", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0")
def setdiff(spark, sf):
    o = table(spark, sf, "orders")
    return union.except_distinct(o.select("o_custkey"), o.where("o_orderkey % 7 = 0").select("o_custkey"))


@query("dedupe_order", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_order(spark, sf):
    return union.first_of_each(table(spark, sf, "events"), "user_id", "event_id")


@query("multiplicity", "SELECT doc_id, lang, source, lang AS lang_1 FROM documents")
def multiplicity(spark, sf):
    return union.multiplied(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], {0: 2, 1: 1})


@query("weight_map_concat", f"SELECT vec_id, len(embedding) * 2 AS n, round(s, 5) AS total FROM embeddings JOIN (SELECT vec_id, sum(v * 2) + count(*) FILTER (v > 0) AS s FROM ({PIXELS}) GROUP BY 1) USING (vec_id)")
def weight_map_concat(spark, sf):
    post, weight = (lambda c: F.transform(c, lambda x: x * 2)), (lambda c: F.transform(c, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    d = union.with_weight_map(vectors(spark, sf), "data", post, weight)
    return rounded(d.select("vec_id", F.size("data").cast("bigint").alias("n"), images.total(F.col("data")).alias("total")), 5)


# joins


@query("channel_align", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def channel_align(spark, sf):
    return align.align([table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")], ["doc_id"])


@query("singleton_broadcast", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def singleton_broadcast(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "ds_idx")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ds_idx"), "n_name")
    return align.with_singleton(s, n).select("s_suppkey", "n_name")


@query("label_lookup", "SELECT doc_id, CAST(NULL AS INTEGER) AS quality FROM documents")
def label_lookup(spark, sf):
    return align.with_labels(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality")


@query("label_lookup_whole", "SELECT o_orderkey, c_name AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def label_lookup_whole(spark, sf):
    """Every row has a label, so all keep theirs."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("ds_idx"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ds_idx"), F.col("c_name").alias("label"))
    return align.with_labels(o, c, ["ds_idx"]).select("o_orderkey", "label")


@query("range_join_orders", """WITH p AS (SELECT o_orderkey AS ds_path, 1 + o_orderkey % 7 + CASE WHEN o_orderkey % 500 = 0 THEN 100000 ELSE 0 END AS n FROM orders),
c AS (SELECT *, row_number() OVER (ORDER BY ds_path) - 1 AS ds_idx, sum(n) OVER (ORDER BY ds_path) - n AS first FROM p), i AS (SELECT l_orderkey * 11 + l_linenumber AS global_idx FROM lineitem)
SELECT global_idx, CAST(ds_idx AS INTEGER) AS ds_idx, ds_path, CAST(global_idx - first AS BIGINT) AS im_idx FROM i ASOF JOIN c ON i.global_idx >= c.first WHERE global_idx < first + n""")
def range_join_orders(spark, sf):
    """As many parts as orders, most of a few ids and some of very many."""
    n = 1 + F.col("o_orderkey") % 7 + F.when(F.col("o_orderkey") % 500 == 0, 100_000).otherwise(0)
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ds_path"), n.alias("n"))
    parts = with_positions(p, "ds_path", out="ds_idx", sums={"offset": "n"}).withColumn("ds_idx", F.col("ds_idx").cast("int"))
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 11 + F.col("l_linenumber")).alias("global_idx"))
    return align.resolve_ids(ids, parts)


@query("tile_table_function", f"""WITH d AS ({PIXELS}), t AS (SELECT y * 3 + x AS tile_id, [0, 2, 4][y + 1] AS y0, [0, 2, 4][x + 1] AS x0 FROM range(3) a(y), range(3) b(x))
SELECT vec_id, CAST(tile_id AS INTEGER) AS tile_id, y0, x0, round(sum(v * ((px // 8 - y0) * 4 + px % 8 - x0 + 1)), 5) AS moment FROM d, t WHERE px // 8 >= y0 AND px // 8 < y0 + 4 AND px % 8 >= x0 AND px % 8 < x0 + 4 GROUP BY ALL""")
def tile_table_function(spark, sf):
    """Tiles from SQL, by a table function."""
    from lattiq.functions import table_functions

    table_functions.register(spark)
    sql = "SELECT vec_id, t.tile_id, t.start[0] AS y0, t.start[1] AS x0, t.data FROM {v} v, LATERAL tile(v.data, array(8, 8), array(4, 4), 'force', 1) t"
    out = spark.sql(sql, v=vectors(spark, sf))
    return rounded(out.select("vec_id", "tile_id", "y0", "x0", _moment().alias("moment")), 5)


@query("pad_ragged", """WITH t AS (SELECT page_id, list_transform(string_split(url, '/'), lambda x: len(x)) AS a FROM pages), m AS (SELECT max(len(a)) AS n FROM t)
SELECT page_id, len(a) AS used, n AS size, CAST(list_sum(a) AS BIGINT) AS total FROM t, m""")
def pad_ragged(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.transform(F.split("url", "/"), lambda x: F.length(x).cast("double")).alias("a"))
    out = align.with_side_array(p.select("page_id", F.size("a").cast("bigint").alias("used")), p, "a", ["page_id"])
    return out.select("page_id", "used", F.size("a").cast("bigint").alias("size"), images.total(F.col("a")).cast("bigint").alias("total"))


@query("id_to_dataset_range_join", """WITH c AS (SELECT event_type AS ds_path, count(*) AS n FROM events GROUP BY 1), o AS (SELECT *, CAST(row_number() OVER (ORDER BY ds_path) - 1 AS INTEGER) AS ds_idx, sum(n) OVER (ORDER BY ds_path) - n AS offset_ FROM c)
SELECT o_orderkey % 700 AS global_idx, ds_idx, ds_path, CAST(o_orderkey % 700 - offset_ AS BIGINT) AS im_idx FROM orders, o WHERE o_orderkey % 700 >= offset_ AND o_orderkey % 700 < offset_ + n""")
def id_to_dataset_range_join(spark, sf):
    parts = align.catalog(table(spark, sf, "events").select(F.col("event_type").alias("ds_path")))
    ids = table(spark, sf, "orders").select((F.col("o_orderkey") % 700).alias("global_idx"))
    return align.resolve_ids(ids, parts)


# time


_TURNS = "l AS (SELECT conv_id, turn, 'c' || conv_id || '_f' || lpad(CAST(turn AS VARCHAR), 5, '0') AS label, len(text) AS len FROM conversations WHERE turn % 4 <> 2)"


def _turns(spark, sf):
    c = table(spark, sf, "conversations").where("turn % 4 <> 2")
    return c.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id"), F.lit("_f"), paths.zero_padded(F.col("turn"), 5)).alias("label"), F.length("text").cast("bigint").alias("len"))


@query("neighbour_label_continuous", f"WITH {_TURNS} SELECT a.conv_id, a.turn, CAST(coalesce(max(a.turn - b.turn), 0) AS INTEGER) AS increment FROM l a LEFT JOIN l b ON a.conv_id = b.conv_id AND a.turn - b.turn BETWEEN 1 AND 3 AND (SELECT count(*) FROM l c WHERE c.conv_id = a.conv_id AND c.turn > b.turn AND c.turn <= a.turn) = a.turn - b.turn GROUP BY 1, 2")
def neighbour_label_continuous(spark, sf):
    return temporal.max_increment(_turns(spark, sf), 3, True, "conv_id", "turn").select("conv_id", "turn", "increment")


@query("neighbour_clamped", "SELECT conv_id, turn, least(greatest(turn - 2, 0), n - 1) AS prev2, least(greatest(turn + 1, 0), n - 1) AS next1 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def neighbour_clamped(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    return c.select("conv_id", "turn", temporal.clamped_neighbour(F.col("turn"), F.col("n"), -2).alias("prev2"), temporal.clamped_neighbour(F.col("turn"), F.col("n"), 1).alias("next1"))


def _frames(k: int, s: int) -> str:
    def at(j: int) -> str:
        if j == 0:
            return "len"
        move, edge = ("lag", "first_value") if j < 0 else ("lead", "last_value")
        return f"coalesce({move}(len, {abs(j)}) OVER w, {edge}(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"

    cells = ", ".join(f"{at(j * s)} AS f{j + k}" for j in range(-k, k + 1))
    return f"SELECT conv_id, turn, {cells} FROM (SELECT conv_id, turn, len(text) AS len FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def _stack(spark, sf, k: int, s: int):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("len"))
    out = temporal.frame_stack(c, ["len"], k, s, series="conv_id", im="turn")
    return out.select("conv_id", "turn", *[F.col("len")[i].alias(f"f{i}") for i in range(2 * k + 1)])


@query("frame_stack", _frames(1, 1))
def frame_stack(spark, sf):
    return _stack(spark, sf, 1, 1)


@query("frame_stack_strided", _frames(2, 2))
def frame_stack_strided(spark, sf):
    return _stack(spark, sf, 2, 2)


@query("split_leak_free", """WITH t AS (SELECT conv_id, turn, conv_id * 100000 + turn AS id FROM conversations), s AS (SELECT * FROM t WHERE {0} % 10 < 2)
SELECT id, false AS is_test FROM t WHERE id NOT IN (SELECT id FROM s) AND id - 1 NOT IN (SELECT id FROM s) UNION ALL SELECT id, true FROM s""".format(HASH.format("(conv_id * 100000 + turn)")))
def split_leak_free(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100000 + F.col("turn")).alias("id"))
    c = c.withColumn("label", F.concat(F.lit("c"), F.col("conv_id"), F.lit("_f"), paths.zero_padded(F.col("turn"), 5)))
    is_test = hash_order("id") % 10 < 2
    train, test = temporal.leak_free_split(c, c.where(~is_test), c.where(is_test), "id", True, False, series="conv_id", im="turn")
    return train.select("id", F.lit(False).alias("is_test")).unionByName(test.select("id", F.lit(True).alias("is_test")))


# tiles


def _tile_sql(starts, size: int = 4) -> str:
    cells = ", ".join(f"({i}, {y}, {x})" for i, (y, x) in enumerate(starts))
    return f"WITH d AS ({PIXELS}), t(tile_id, ty, tx) AS (VALUES {cells}) SELECT vec_id, tile_id, ty AS tile_y, tx AS tile_x, round(sum(v), 5) AS total, round(max(v) FILTER (px // 8 = ty AND px % 8 = tx), 5) AS corner FROM d, t WHERE px // 8 >= ty AND px // 8 < ty + {size} AND px % 8 >= tx AND px % 8 < tx + {size} GROUP BY 1, 2, 3, 4"


def _tile_query(spark, sf, size: int = 4, **options):
    df = vectors(spark, sf).transform(tiles.tile_function(["data"], SHAPE, (size, size), **options))
    return rounded(df.select("vec_id", "tile_id", "tile_y", "tile_x", images.total(F.col("data")).alias("total"), F.col("data")[0].alias("corner")), 5)


@query("tile_grid_allow", _tile_sql([(y, x) for y in (0, 2, 5) for x in (0, 2, 5)], 3))
def tile_grid_allow(spark, sf):
    return _tile_query(spark, sf, 3, mode=coords.ALLOW)


@query("tile_grid_no_overlap", _tile_sql([(0, 0), (0, 5), (5, 0), (5, 5)], 3))
def tile_grid_no_overlap(spark, sf):
    return _tile_query(spark, sf, 3, mode=coords.NO_OVERLAP)


@query("tile_grid_force", _tile_sql([(y, x) for y in (0, 2, 4) for x in (0, 2, 4)]))
def tile_grid_force(spark, sf):
    return _tile_query(spark, sf, mode=coords.FORCE, min_overlap=1)


@query("tile_n", _tile_sql([(0, 0), (0, 4), (4, 0), (4, 4)]))
def tile_n(spark, sf):
    return _tile_query(spark, sf, n_tiles=4)


@query("crop", f"SELECT vec_id, round(sum(v) FILTER (px // 8 BETWEEN 1 AND 5 AND px % 8 BETWEEN 4 AND 7), 5) AS box, round(sum(v) FILTER (px // 8 < 6 AND px % 8 < 6), 5) AS multiple FROM ({PIXELS}) GROUP BY 1")
def crop(spark, sf):
    d = F.col("data")
    return rounded(vectors(spark, sf).select("vec_id", images.total(images.crop(d, SHAPE, (5, 4), (1, 6))).alias("box"), images.total(images.crop_to_multiple(d, SHAPE, 3)).alias("multiple")), 5)


_SYM = "CASE k % 4 WHEN 0 THEN r * 8 + c WHEN 1 THEN (7 - r) * 8 + c WHEN 2 THEN r * 8 + 7 - c ELSE (7 - r) * 8 + 7 - c END"


@query("dihedral_8", f"""WITH k AS (SELECT k, i, CASE WHEN k < 4 THEN i // 8 ELSE i % 8 END AS r, CASE WHEN k < 4 THEN i % 8 ELSE 7 - i // 8 END AS c FROM range(8) a(k), range(64) b(i)),
m AS (SELECT k, i, {_SYM} AS src FROM k) SELECT vec_id, CAST(k AS INTEGER) AS aug, round(sum(embedding[src + 1]::DOUBLE * (i + 1)), 4) AS moment FROM embeddings, m GROUP BY 1, 2""")
def dihedral_8(spark, sf):
    df = tiles.augmented_tiles(vectors(spark, sf), ["data"], SHAPE)
    moment = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("vec_id", "aug", moment.alias("moment")), 4)


@query("dihedral_drawn", f"""WITH e AS (SELECT vec_id, embedding, ({HASH.format('vec_id')}) // 65536 % 8 AS k FROM embeddings), k AS (SELECT vec_id, embedding, k, i, CASE WHEN k < 4 THEN i // 8 ELSE i % 8 END AS r, CASE WHEN k < 4 THEN i % 8 ELSE 7 - i // 8 END AS c FROM e, range(64) b(i)),
m AS (SELECT *, {_SYM} AS src FROM k) SELECT vec_id, CAST(k AS INTEGER) AS aug, round(sum(embedding[src + 1]::DOUBLE * (i + 1)), 4) AS moment FROM m GROUP BY 1, 2""")
def dihedral_drawn(spark, sf):
    out = tiles.augmented_in_place(vectors(spark, sf), ["data"], SHAPE, "vec_id")
    return rounded(out.select("vec_id", "aug", _moment().alias("moment")), 4)


@query("anchor_interval", f"""WITH c AS (SELECT vec_id, label, avg(px // 8) FILTER (v > 0.1) AS cy, avg(px % 8) FILTER (v > 0.1) AS cx FROM ({PIXELS}) GROUP BY 1, 2)
SELECT label, CAST(least(greatest(floor(min(cy)) - 1, 0), 7) AS INTEGER) AS y0, CAST(least(greatest(ceil(max(cy)) + 1, 0), 7) AS INTEGER) AS y1, CAST(least(greatest(floor(min(cx)) - 1, 0), 7) AS INTEGER) AS x0, CAST(least(greatest(ceil(max(cx)) + 1, 0), 7) AS INTEGER) AS x1 FROM c GROUP BY 1""")
def anchor_interval(spark, sf):
    mask = F.transform("data", lambda x: F.when(x > 0.1, 1.0).otherwise(0.0))
    return tiles.mask_anchor_intervals(vectors(spark, sf).withColumn("mask", mask), SHAPE, "mask", "label", jitter=1)


@query("tile_choice", f"""WITH d AS ({PIXELS}), w AS (SELECT vec_id, px // 16 AS k, sum(abs(v)) AS w FROM d GROUP BY 1, 2),
c AS (SELECT vec_id, k, sum(w) OVER (PARTITION BY vec_id ORDER BY k) / sum(w) OVER (PARTITION BY vec_id) AS cum FROM w),
u AS (SELECT vec_id, draw, {HASH.format('(vec_id * 3 + draw)')} / 4294967296.0::DOUBLE AS u FROM embeddings, range(3) r(draw))
SELECT u.vec_id, CAST(u.draw AS INTEGER) AS draw, CAST(least(count(*) FILTER (cum <= u.u), 3) AS INTEGER) AS tile_id FROM u JOIN c USING (vec_id) GROUP BY 1, 2""")
def tile_choice(spark, sf):
    strips = F.array(*[F.aggregate(F.slice("data", 16 * k + 1, 16), F.lit(0.0), lambda a, x: a + F.abs(x)) for k in range(4)])
    df = vectors(spark, sf).select("vec_id", strips.alias("w"))
    return tiles.chosen_tiles(df, "w", 3, "vec_id").select("vec_id", "draw", "tile_id")


_TILE_ZOOM = f"""
WITH t(tile_id, y0, x0) AS (VALUES (0, 0, 0), (1, 0, 4), (2, 4, 0), (3, 4, 4)),
u AS (SELECT vec_id, embedding, t.*, {_draw('vec_id', 'tile_id * 3')} AS u0, {_draw('vec_id', 'tile_id * 3 + 1')} AS u1, {_draw('vec_id', 'tile_id * 3 + 2')} AS u2,
  least(greatest(y0 - 1 + floor({_draw('vec_id', 'tile_id * 2', 1)} * 3), 0), 4) AS sy, least(greatest(x0 - 1 + floor({_draw('vec_id', 'tile_id * 2 + 1', 1)} * 3), 0), 4) AS sx FROM embeddings, t),
z AS (SELECT *, CASE WHEN u0 < 0.8 THEN 1 / 1.6::DOUBLE + u1 * (least(1 / 0.6::DOUBLE, 2) - 1 / 1.6::DOUBLE) ELSE 1 END AS z FROM u),
r AS (SELECT *, CASE WHEN u0 < 0.8 THEN 1 / 1.2::DOUBLE + u2 * (least(8 / (z * 4), 1 / 0.8::DOUBLE) - 1 / 1.2::DOUBLE) ELSE 1 END AS a FROM z),
b AS (SELECT *, CAST(greatest(round_even(z * 4, 0), 1) AS INTEGER) AS by_, CAST(least(greatest(round_even(z * a * 4, 0), 1), 8) AS INTEGER) AS bx FROM r),
s AS (SELECT *, CAST(least(sy, 8 - by_) AS INTEGER) AS y1, CAST(least(sx, 8 - bx) AS INTEGER) AS x1 FROM b),
p AS (SELECT *, i, i // 4 * ((by_ - 1) / 3.0::DOUBLE) AS py, i % 4 * ((bx - 1) / 3.0::DOUBLE) AS px FROM s, range(16) k(i)),
q AS (SELECT *, least(CAST(floor(round(py, 9)) AS INTEGER), by_ - 1) AS ya, least(CAST(floor(round(px, 9)) AS INTEGER), bx - 1) AS xa FROM p),
v AS (SELECT *, list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda d: embedding[(y1 + least(ya + d[1], by_ - 1)) * 8 + x1 + least(xa + d[2], bx - 1) + 1]::DOUBLE) AS c FROM q)
SELECT vec_id, tile_id, y1 AS start_y, x1 AS start_x, by_ AS box_y, bx AS box_x,
  round(sum((i + 1) * ((c[1] * (1 - (py - ya)) + c[3] * (py - ya)) * (1 - (px - xa)) + (c[2] * (1 - (py - ya)) + c[4] * (py - ya)) * (px - xa))), 5) AS moment FROM v GROUP BY ALL"""


def _moment(c: str = "data"):
    return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("tile_zoom", _TILE_ZOOM)
def tile_zoom(spark, sf):
    starts = tiles.tile_starts(SHAPE, (4, 4), coords.NO_OVERLAP)
    out = tiles.zoomed_tiles(vectors(spark, sf), ["data"], SHAPE, (4, 4), starts, "vec_id", (0.6, 1.6), (0.8, 1.2), 0.8, 1)
    at = lambda c, k: F.col(c)[k]
    return rounded(out.select("vec_id", "tile_id", at("start", 0).alias("start_y"), at("start", 1).alias("start_x"), at("box", 0).alias("box_y"), at("box", 1).alias("box_x"), _moment().alias("moment")), 5)


_CUT = """SELECT vec_id, tile_id, y0, x0, round(sum(v * ((px // 8 - y0) * {w} + px % 8 - x0 + 1)), 5) AS moment FROM b JOIN d USING (vec_id)
WHERE px // 8 >= y0 AND px // 8 < y0 + {h} AND px % 8 >= x0 AND px % 8 < x0 + {w} GROUP BY ALL"""


def _cut_query(df, tile):
    out = boxes.cut(df, ["data"], SHAPE, tile)
    return rounded(out.select("vec_id", "tile_id", F.col("start")[0].alias("y0"), F.col("start")[1].alias("x0"), _moment().alias("moment")), 5)


@query("boxes_random_stride", f"""WITH d AS ({PIXELS}), a(i, base) AS (VALUES (0, 0), (1, 2), (2, 5)),
s AS (SELECT vec_id, axis, i, CAST(least(greatest(base - 1 + floor({_draw('vec_id', 'axis * 3 + i', 4)} * 3), 0), 5) AS INTEGER) AS s FROM embeddings, a, range(2) r(axis)),
b AS (SELECT y.vec_id, y.i * 3 + x.i AS tile_id, y.s AS y0, x.s AS x0 FROM s y JOIN s x ON x.vec_id = y.vec_id AND y.axis = 0 AND x.axis = 1) {_CUT.format(h=3, w=3)}""")
def boxes_random_stride(spark, sf):
    """Nine boxes of each image, each moved within the overlap around it by the row's own draws."""
    return _cut_query(boxes.with_boxes(vectors(spark, sf), boxes.overlap_boxes(SHAPE, (3, 3), coords.ALLOW, key="vec_id", seed=4)), (3, 3))


@query("boxes_drawn_subset", f"""WITH d AS ({PIXELS}),
y AS (SELECT vec_id, i, CAST(least(greatest((CASE i WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END) - 1 + floor({_draw('vec_id', 'i')} * 3), 0), 5) AS INTEGER) AS s FROM embeddings, range(3) r(i)),
g AS (SELECT vec_id, y.i * 2 + x.i AS k, y.s AS y0, CASE x.i WHEN 0 THEN 0 ELSE 5 END AS x0, {_draw('vec_id', '5 + y.i * 2 + x.i')} AS u FROM y, range(2) x(i)),
b AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY u, k) - 1 AS INTEGER) AS tile_id, y0, CAST(x0 AS INTEGER) AS x0 FROM g QUALIFY tile_id < 5) {_CUT.format(h=3, w=3)}""")
def boxes_drawn_subset(spark, sf):
    """Five of the six boxes that two axes of unlike counts give, by the row's draws."""
    return _cut_query(boxes.with_boxes(vectors(spark, sf), boxes.some_boxes(SHAPE, (3, 3), 5, "vec_id")), (3, 3))


@query("boxes_by_anchor", f"""WITH d AS ({PIXELS}), m AS (SELECT vec_id, CAST(floor(avg(px // 8) FILTER (v > 0.1)) AS INTEGER) AS a, CAST(floor(avg(px % 8) FILTER (v > 0.1)) AS INTEGER) AS c FROM d GROUP BY 1),
r AS (SELECT *, least(5, a, 8 - (a + 1)) AS ry, least(5, c, 8 - (c + 1)) AS rx FROM m WHERE a IS NOT NULL),
h AS (SELECT *, (ry + rx) / 6.0::DOUBLE AS half FROM r), s AS (SELECT *, half + sqrt(half * half + ry * rx / 3.0::DOUBLE) AS st FROM h),
e AS (SELECT *, ry / nullif(st, 0) + 1 AS ey, rx / nullif(st, 0) + 1 AS ex FROM s), w AS (SELECT *, round_even(ey, 0) AS wy, round_even(ex, 0) AS wx FROM e),
n AS (SELECT *, CASE WHEN abs(wx - ex) < abs(wy - ey) THEN floor(4 / wx) ELSE wy END AS ny, CASE WHEN abs(wx - ex) < abs(wy - ey) THEN wx ELSE floor(4 / wy) END AS nx FROM w),
k AS (SELECT *, CASE WHEN st = 0 THEN 4 WHEN ny * nx < 4 AND NOT abs(nx + 1 - ex) < abs(ny + 1 - ey) THEN ny + 1 ELSE ny END AS ky, CASE WHEN st = 0 THEN 1 WHEN ny * nx < 4 AND abs(nx + 1 - ex) < abs(ny + 1 - ey) THEN nx + 1 ELSE nx END AS kx FROM n),
t AS (SELECT *, CAST(i AS INTEGER) AS tile_id, floor(i / kx) AS iy, i % kx AS ix, least(least(a, 5), greatest(a + 1 - 3 + 1, 0)) AS y1, greatest(least(a, 5), greatest(a + 1 - 3 + 1, 0)) AS y2,
  least(least(c, 5), greatest(c + 1 - 3 + 1, 0)) AS x1, greatest(least(c, 5), greatest(c + 1 - 3 + 1, 0)) AS x2 FROM k, range(4) q(i)),
b AS (SELECT vec_id, tile_id, CAST(CASE WHEN ky = 1 THEN (y1 + y2) // 2 WHEN iy = ky - 1 THEN y2 ELSE floor(y1 + (y2 - y1) * (iy / (ky - 1))) END AS INTEGER) AS y0,
  CAST(CASE WHEN kx = 1 THEN (x1 + x2) // 2 WHEN ix = kx - 1 THEN x2 ELSE floor(x1 + (x2 - x1) * (ix / (kx - 1))) END AS INTEGER) AS x0 FROM t) {_CUT.format(h=3, w=3)}""")
def boxes_by_anchor(spark, sf):
    """Four boxes around the centre of each image's own bright pixels; how many lie along either axis differs by row."""
    mask = F.transform("data", lambda x: F.when(x > 0.1, 1.0).otherwise(0.0))
    df = vectors(spark, sf).withColumn("c", images.center_of_mass(mask, SHAPE)).where(F.col("c")[0].isNotNull())
    low = [F.floor(F.col("c")[a]).cast("int") for a in (0, 1)]
    return _cut_query(boxes.with_boxes(df, boxes.anchor_boxes(SHAPE, (3, 3), 4, low, [x + 1 for x in low])), (3, 3))


@query("boxes_by_channel", f"""WITH d AS (SELECT vec_id, v, px // 2 // 4 AS y, px // 2 % 4 AS x, px % 2 AS c FROM ({PIXELS})), t(tile_id, y0, x0) AS (VALUES (0, 0, 0), (1, 0, 2), (2, 2, 0), (3, 2, 2), (4, 5, 0), (5, 5, 2)),
s AS (SELECT vec_id, tile_id, c, greatest(y0 - 1, 0) + CAST(floor({_draw('vec_id', 'tile_id * 4 + c * 2', 9)} * (least(y0 + 1, 5) - greatest(y0 - 1, 0) + 1)) AS INTEGER) AS sy,
  greatest(x0 - 1, 0) + CAST(floor({_draw('vec_id', 'tile_id * 4 + c * 2 + 1', 9)} * (least(x0 + 1, 2) - greatest(x0 - 1, 0) + 1)) AS INTEGER) AS sx FROM embeddings, t, range(2) r(c))
SELECT vec_id, tile_id, round(sum(v * (((y - sy) * 2 + x - sx) * 2 + c + 1)), 5) AS moment, CAST(sum(sy * 10 + sx) // 6 AS BIGINT) AS places
FROM s JOIN d USING (vec_id, c) WHERE y >= sy AND y < sy + 3 AND x >= sx AND x < sx + 2 GROUP BY 1, 2""")
def boxes_by_channel(spark, sf):
    """Images of 8 x 4 pixels and two channels: each channel of a tile has its own jittered box."""
    df = boxes.with_boxes(vectors(spark, sf), boxes.overlap_boxes((8, 4), (3, 2), coords.ALLOW))
    df = boxes.jittered(df, (8, 4), (3, 2), 2, 1, "vec_id", 9)
    out = boxes.cut_by_channel(df, ["data"], (8, 4), (3, 2))
    places = F.aggregate("starts", F.lit(0), lambda a, s: a + s[0] * 10 + s[1])
    return rounded(out.select("vec_id", "tile_id", _moment().alias("moment"), places.cast("bigint").alias("places")), 5)


@query("boxes_chosen", f"""WITH d AS ({PIXELS}), g AS (SELECT vec_id, y * 2 + x AS k, coalesce(sum(abs(v)) FILTER (px // 8 // 4 = y AND px % 8 // 4 = x), 0) AS w FROM d, range(2) a(y), range(2) b(x) GROUP BY 1, 2),
c AS (SELECT vec_id, k, sum(w / t) OVER (PARTITION BY vec_id ORDER BY k) AS cum FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM g)),
u AS (SELECT vec_id, i, {_draw('vec_id', 'i', 2)} AS u FROM embeddings, range(3) r(i)),
p AS (SELECT u.vec_id, i, least(count(*) FILTER (cum <= u), 3) AS k FROM u JOIN c USING (vec_id) GROUP BY 1, 2),
b AS (SELECT vec_id, CAST(i AS INTEGER) AS tile_id, CAST(CASE WHEN k // 2 = 0 THEN 1 ELSE 3 END AS INTEGER) AS y0, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS INTEGER) AS x0 FROM p) {_CUT.format(h=4, w=4)}""")
def boxes_chosen(spark, sf):
    """Three boxes of each image, by the weight of its quarters."""
    quarter = lambda y, x: images.total(F.transform(images.crop(F.col("data"), SHAPE, (4, 4), (4 * y, 4 * x)), F.abs))
    df = vectors(spark, sf)
    p = F.array(*[quarter(y, x) for y in (0, 1) for x in (0, 1)])
    return _cut_query(boxes.with_boxes(df, boxes.chosen_boxes(SHAPE, (4, 4), 3, p, "vec_id", 2)), (4, 4))


@query("volume_boxes", f"""WITH d AS (SELECT vec_id, v, px // 16 AS z, px // 4 % 4 AS y, px % 4 AS x FROM ({PIXELS})), s AS (SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS z0, CAST(vec_id % 3 AS INTEGER) AS y0, CAST(vec_id % 5 AS INTEGER) AS x0 FROM embeddings),
c AS (SELECT vec_id, least(z0, 2) AS z0, least(y0, 1) AS y0, least(x0, 2) AS x0 FROM s)
SELECT vec_id, round(sum(v * ((z - z0) * 6 + (y - y0) * 2 + x - x0 + 1)) FILTER (z >= z0 AND z < z0 + 2 AND y >= y0 AND y < y0 + 3 AND x >= x0 AND x < x0 + 2), 5) AS box,
  round(sum(v * ((3 - z) * 16 + y * 4 + 3 - x + 1)), 5) AS flipped, round(sum(v * (x * 16 + z * 4 + y + 1)), 5) AS turned FROM d JOIN c USING (vec_id) GROUP BY 1""")
def volume_boxes(spark, sf):
    """Embeddings as volumes of 4 x 4 x 4: a box at each row's own start, mirrored in z and x, axes in another order."""
    d, shape = F.col("data"), (4, 4, 4)
    start = F.array(F.col("vec_id") % 4, F.col("vec_id") % 3, F.col("vec_id") % 5).cast("array<int>")
    df = vectors(spark, sf).withColumns({"box": ndim.crop(d, shape, (2, 3, 2), start), "flipped": ndim.flipped(d, shape, (0, 2)), "turned": ndim.transposed(d, shape, (2, 0, 1))})
    return rounded(df.select("vec_id", *[_moment(c).alias(c) for c in ("box", "flipped", "turned")]), 5)


@query("tile_plain_zoom", _tile_sql([(0, 0), (0, 4), (4, 0), (4, 4)]))
def tile_plain_zoom(spark, sf):
    """Without zoom or jitter, resampled tiles are the tiles."""
    starts = tiles.tile_starts(SHAPE, (4, 4), coords.NO_OVERLAP)
    out = tiles.zoomed_tiles(vectors(spark, sf), ["data"], SHAPE, (4, 4), starts, "vec_id")
    return rounded(out.select("vec_id", "tile_id", "tile_y", "tile_x", images.total(F.col("data")).alias("total"), F.col("data")[0].alias("corner")), 5)


@query("channel_slice", f"SELECT vec_id, round(sum(v) FILTER (px % 4 IN (1, 2)), 5) AS middle, round(sum(v) FILTER (px % 4 = 3), 5) AS last FROM ({PIXELS}) GROUP BY 1")
def channel_slice(spark, sf):
    d = F.col("data")
    return rounded(vectors(spark, sf).select("vec_id", images.total(images.channel_slice(d, 4, 1, 3)).alias("middle"), images.total(images.channels_split(d, 4)[3]).alias("last")), 5)


@query("mask_denoise", f"SELECT vec_id, count(*) FILTER (abs(v / 1e10) < 1e-11) AS n_zero FROM ({PIXELS}) GROUP BY 1")
def mask_denoise(spark, sf):
    tiny = F.transform("data", lambda x: x / 1e10)
    clean = images.denoised_mask(tiny, 1e-11)
    return vectors(spark, sf).select("vec_id", F.size(F.filter(clean, lambda x: x == 0)).cast("bigint").alias("n_zero"))


@query("image_index_frames", "SELECT conv_id, turn, coalesce(lag(turn) OVER w, turn) AS i0, turn AS i1, coalesce(lead(turn) OVER w, turn) AS i2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def image_index_frames(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("idx"))
    out = temporal.frame_stack(c, ["idx"], 1, series="conv_id", im="turn")
    return out.select("conv_id", "turn", *[F.col("idx")[i].alias(f"i{i}") for i in range(3)])


@query("grouped_stores", "SELECT 'open' AS grp, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'done', o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def grouped_stores(spark, sf):
    o = table(spark, sf, "orders")
    parts = {g: o.where(F.col("o_orderstatus") == s).select("o_orderkey") for g, s in (("open", "O"), ("done", "F"))}
    return union.grouped(parts).select("grp", "o_orderkey")


@query("routed_channels", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def routed_channels(spark, sf):
    o = table(spark, sf, "orders")
    stores = {"a": o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), "b": o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus")}
    return union.routed(stores, ["o_orderkey"])
