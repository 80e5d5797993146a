"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their ids and queued for two passes. A document's virtual finish time
is the source's cumulative words, itself included, divided by the source's weight. The mix is the queue in the order of
finish times up to the total budget; a source that has given both passes drops out and the others take its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.llm import common

WEIGHTS = (5, 2, 1)
_CELL_BITS, _RANGES = 10, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """For (source, source_size): weight, target, level; one row per source.

    Sources by code point, null last, get the weights in turn. The targets share ``share`` times all words by weight, and
    none exceeds ``passes`` times its source; the excess goes to the others by weight. With sources in the order of cap
    over weight, that is one level: the first at which the caps before it and the level's share of the rest fill the
    budget. The windows below run over the sources, not over rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sizes.withColumn("__k", (F.row_number().over(by_name) - 1) % len(weights))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__k") + 1)).withColumn("__cap", passes * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("__budget", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose cap the level does not reach sets the level; if none does, all give their caps
    open_level = F.when(F.col("__level") <= F.col("__cap") / F.col("weight"), F.col("__level"))
    s = s.withColumn("level", F.coalesce(F.min(F.when(open_level.isNotNull(), F.struct(F.col("__cap") / F.col("weight"), open_level.alias("l")))).over(everything)["l"], F.max(F.col("__cap") / F.col("weight")).over(everything)))
    return s.select("source", "source_size", "weight", F.least("__cap", F.col("level") * F.col("weight")).alias("target"), "level")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Adds size, source_size, target, copies (0 to ``passes``) and taken (size times copies) to every row.

    ``keep`` lists the columns that the result has (all). Every row is kept, those not taken with 0 copies; null texts and
    texts without words have size 0 and 0 taken. Rows with equal ids are queued one after the other. A source's words are
    summed over 2**10 cells of shuffled ids, so a source with a third of all rows is never in one task; the budget is cut
    inside one of 4,096 ranges of finish time. Reruns agree: the order depends on ids, sizes and texts' hashes only.

    The texts are read and shuffled once: each cell's rows are queued and written to the shared folder with their place in
    the queue; what follows reads their sizes alone, and the last step their other columns.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    own = {c: f"__own{i}" for i, c in enumerate(kept)}
    cell, zero = ["__k", "__c"], F.lit(0).cast("bigint")
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.select(*[F.col(c).alias(x) for c, x in own.items()], common.word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("__s"), F.col(doc_id).alias("__d"), h.alias("__h"), F.xxhash64(F.col(text)).alias("__x"))
    rows = rows.withColumns({"__c": F.shiftright(F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"), 16 - _CELL_BITS), "__k": F.coalesce(F.concat(F.lit("="), F.col("__s")), F.lit("null"))})
    order = Window.partitionBy(*cell).orderBy("__h", "__d", "size", "__x")
    rows = rows.withColumns({"__p": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__t": F.row_number().over(order)})
    rows = common.written(rows.drop("__h", "__d", "__x"), "mix-queue")

    cells = rows.groupBy(*cell).agg(F.sum("size").alias("__b"), F.first("__s").alias("source"))
    sizes = common.written(cells, "mix-cells")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("__b").alias("source_size")), weights, share, passes)
    targets = targets.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    inside = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.withColumn("__o", F.coalesce(F.sum("__b").over(inside), zero)).drop("__b", "source").join(targets, "__k")
    cells = common.written(cells, "mix-offsets")

    finish = F.array(*[(F.col("__o") + F.col("__p") + k * F.col("source_size")) / F.col("weight") for k in range(passes)])
    width = F.when(F.col("level") > 0, F.col("level") / (_RANGES // 2)).otherwise(1.0)
    queued = rows.join(cells, cell).withColumns({"__f": finish, "__w": width})
    bucket = lambda f: F.least(F.floor(f / F.col("__w")), F.lit(_RANGES - 1)).cast("int")
    each = queued.select("__w", "size", F.posexplode("__f").alias("pass", "__end"), *cell, "__t").withColumn("__r", bucket(F.col("__end")))
    ranges = each.groupBy("__r").agg(F.sum("size").alias("__n"))
    budget = F.floor(F.sum("__n").over(Window.partitionBy()) * F.lit(share / passes))
    ranges = ranges.select("__r", "__n", F.sum("__n").over(Window.orderBy("__r")).alias("__cum"), budget.alias("__budget"))
    first = ranges.where("__cum > __budget").agg(F.min(F.struct("__r", (F.col("__budget") - F.col("__cum") + F.col("__n")).alias("left")))).first()[0]
    cut, left = (first[0], first[1]) if first is not None else (_RANGES, 0)
    # in the range where the budget ends, one by one in the order of finish times
    last = each.where(F.col("__r") == cut)
    one_by_one = Window.orderBy("__end", "pass", *cell, "__t").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("__cum", F.sum("size").over(one_by_one)).where(F.col("__cum") <= left)
    last = common.written(last.groupBy(*cell, "__t").agg(F.count("*").alias("__more")), "mix-cut")
    before = F.aggregate("__f", F.lit(0), lambda n, f: n + F.when(bucket(f) < cut, 1).otherwise(0))
    out = queued.withColumn("__n", before).join(last, [*cell, "__t"], "left")
    out = out.withColumn("copies", (F.col("__n") + F.coalesce("__more", zero)).cast("int"))
    return out.select(*[F.col(x).alias(c) for c, x in own.items()], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it was taken, with their own columns only."""
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(columns)])
    names = {c: f"__in{i}" for i, c in enumerate(columns)}
    for k in ("doc_id", "text", "source"):
        options[k] = names[options.get(k, k)]
    taken = mix(inner, **options).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(x).alias(c) for c, x in names.items()])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every row; null and empty texts have size 0 and nothing is taken of them, a null source is the last one."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


#: Sizes are counted by the number of words that a text splits into; the order is the operator's, spelt out.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2 * CAST(source_size AS DOUBLE) AS cap
  FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM s1 WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source))),
s3 AS (
  SELECT *, coalesce(min(CASE WHEN lv <= cap / weight THEN {'r': cap / weight, 'l': lv} END) OVER ()['l'], max(cap / weight) OVER ()) AS level FROM s2),
q AS (
  SELECT d.doc_id, d.size, d.h, s3.source_size, least(s3.cap, s3.level * s3.weight) AS target, s3.weight,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum,
         coalesce('=' || d.source, 'null') AS k
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
e AS (SELECT *, p, CAST(cum + p * source_size AS DOUBLE) / weight AS f FROM q, (VALUES (0), (1)) v(p)),
g AS (SELECT *, sum(size) OVER (ORDER BY f, p, k, substr(h, 1, 4), h, doc_id ROWS UNBOUNDED PRECEDING) AS total, sum(size) OVER () * 0.75::DOUBLE AS budget FROM e)
SELECT doc_id, CAST(max(size) AS BIGINT) AS size, max(source_size) AS source_size, max(target) AS target,
       CAST(sum(CASE WHEN total <= floor(budget) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id
"""
