"""Sharding: contiguous shards of nearly equal bytes, by prefix sums over per-partition totals.

The global order is by hash of the text, then by hash of the id, so copies of a text lie together and only those at one
of the few cuts may part. The order is dealt into cells: 2**12 ranges of text hash, each split into 2**8 ranges of id
hash, so that a text that a third of all rows share still spreads over 256 cells. Each cell's totals are summed where its
rows are; offsets add up over the ranges (4,096 rows at most) and over the cells of a range (256 at most); and only
rows of one cell are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.llm import common

_RANGE_BITS, _CELL_BITS = 12, 8


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(8)


def _top(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def assign_shards(docs: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... within a shard) to every row.

    A row goes to the shard in which the middle of its bytes falls, so shards differ from an equal share by less than
    one text. Null texts have 8 bytes; rows with equal or null ids are told apart by position only, and every row is
    kept; of an empty table the result is empty. Columns that are named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    ht, hi = F.xxhash64(F.col(text)), F.xxhash64(F.lit(7), F.col(doc_id))
    rows = docs.select(*kept, byte_size(F.col(text)).alias("size"), ht.alias("__ht"), hi.alias("__hi"))
    rows = rows.withColumns({"__r": _top(F.col("__ht"), _RANGE_BITS), "__c": _top(F.col("__hi"), _CELL_BITS)})
    cell = ["__r", "__c"]
    rows = rows.repartition(*cell)  # the one shuffle of the rows; the totals below reuse it
    cells = rows.groupBy(*cell).agg(F.sum("size").alias("__b"), F.count("*").alias("__n"))
    ranges = cells.groupBy("__r").agg(F.sum("__b").alias("__rb"), F.sum("__n").alias("__rn"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    ranges = ranges.select("__r", F.coalesce(F.sum("__rb").over(before), zero).alias("__ob"), F.coalesce(F.sum("__rn").over(before), zero).alias("__on"), F.sum("__rb").over(everything).alias("__total"))
    inside = Window.partitionBy("__r").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(F.broadcast(ranges), "__r").select(*cell, "__total", (F.col("__ob") + F.coalesce(F.sum("__b").over(inside), zero)).alias("__ob"), (F.col("__on") + F.coalesce(F.sum("__n").over(inside), zero)).alias("__on"))
    order = Window.partitionBy(*cell).orderBy("__ht", "__hi", doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"__pb": F.coalesce(F.sum("size").over(order), zero), "__pn": F.count(F.lit(1)).over(order)}).join(cells, cell)
    middle = 2 * (F.col("__ob") + F.col("__pb")) + F.col("size")
    shard = F.least(F.expr("int(__m * decimal(1) * {0} div (2 * __total))".format(n_shards)), F.lit(n_shards - 1))
    placed = placed.withColumn("__m", middle.cast("decimal(28,0)")).withColumn("shard", shard).withColumn("__i", F.col("__on") + F.col("__pn"))
    starts = placed.groupBy("shard").agg(F.min("__i").alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(*kept, "size", "shard", (F.col("__i") - F.col("__first")).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Size, shard and slot of every row by the law ``bytes``; a null text has size 8 and the checksum of the empty text, and repeated
    rows have a slot each."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = assign_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
