"""SimHash near-duplicates by pigeonring filtering.

Two fingerprints differ in at most 2 bits only if, of three segments in a ring, some chain that starts with an equal segment
has at most 1 differing bit after two segments and 2 after three: a chain of l segments may use l * 2 / 3 bits. The
candidates are found by that chain's beginning: the equal segment, and the half of the next one that must be equal
too, since at most one bit of it differs. The chain is then followed to its end, which is the full Hamming check.

The bits that such a key leaves open are a ring again, of three shorter segments, in which at most 2 bits differ. So a bucket
that is full is parted by keys that are longer by the beginning of a chain in that ring, and so on: each step about halves the open bits, and when
six are left a bucket has 64 fingerprints at most. Every bucket goes this one way, full ones only further along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm import common
from lattiq.llm.hashing import bit_counts, chunks, shingle_spans, xxh64

#: First bit and length of each segment of the ring.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BUDGET = 2
#: A bucket of more fingerprints is parted by longer keys before its fingerprints are paired.
MAX_BUCKET = 32
#: Steps that leave 33, 17, 10 and 6 bits open at most.
STEPS = 4


def fingerprints(texts: list[bytes], words_each: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text's word shingles; none: 0."""
    buf, begin, end, at = shingle_spans(texts, words_each)
    ones, step = np.zeros((len(texts), 64), dtype=np.int64), 1 << 16
    for a in range(0, len(begin), step):
        b = min(len(begin), a + step)
        low = int(begin[a])
        h = xxh64(buf[low : int(end[b - 1])], begin[a:b] - low, end[a:b] - low, seed)
        ones += bit_counts(h, np.clip(at, a, b) - a)
    return np.packbits(2 * ones > np.diff(at)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed bigint; null and empty texts get 0. A column named like ``out`` is replaced."""
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprints(part) for _, part in chunks(b.column(text).to_pylist())]
            fp = np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept if c != text), pa.array(fp)], names=[*(c for c in kept if c != text), out])

    small = docs.select(*(c for c in kept if c != text))
    return docs.mapInArrow(run, small.schema.add(out, "long"))


def _mask(first: int, length: int) -> int:
    m = ((1 << length) - 1) << first
    return m - (1 << 64) if m >= 1 << 63 else m


def _differing(x: Column, y: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(mask)))


def _beginnings(bits: list[int]) -> list[list[int]]:
    """The bits that are equal at the beginning of a chain in the ring of these bits: a third of them, and either half of the next third."""
    n = len(bits)
    thirds = [bits[: n // 3], bits[n // 3 : 2 * (n // 3)], bits[2 * (n // 3) :]]
    out = []
    for i in range(3):
        after = thirds[(i + 1) % 3]
        out += [thirds[i] + after[: len(after) // 2], thirds[i] + after[len(after) // 2 :]]
    return out


def _signed(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def key_masks(steps: int = STEPS) -> list[list[tuple[int, int, int, int]]]:
    """For each step (part before, part, first segment of the chain, mask of the key): six parts for each one before."""
    levels, parts = [], [(0, 0, [])]
    for step in range(steps):
        rows, nxt = [], []
        for part, segment, fixed in parts:
            for j, more in enumerate(_beginnings([b for b in range(64) if b not in set(fixed)])):
                first = j // 2 if step == 0 else segment
                rows.append((part, 6 * part + j, first, _signed(fixed + more)))
                nxt.append((6 * part + j, first, fixed + more))
        levels.append(rows)
        parts = nxt
    return levels


def similar_pairs(classes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node): all that differ in at most 2 bits, and no others."""
    spark = classes.sparkSession
    rows, found = classes.select("fp", "node", F.lit(0).alias("part")), []
    levels = key_masks()
    for step, masks in enumerate(levels):
        table = spark.createDataFrame(masks, "part int, next int, segment int, mask bigint")  # 6 ** (step + 1) rows
        keyed = rows.join(F.broadcast(table), "part").select("fp", "node", "segment", F.struct(F.col("next").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")).alias("k"))
        many = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
        keyed = common.written(common.salted_join(keyed, many, "k"), "simhash-buckets")
        last = step == len(levels) - 1
        small = keyed if last else keyed.where(F.col("n") <= max_bucket)
        groups = small.groupBy("k", "segment").agg(F.array_sort(F.collect_list(F.struct("node", "fp"))).alias("g"))
        pairs = groups.select("segment", "g", F.posexplode("g").alias("i", "x")).select("segment", "x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y"))
        found.append(_chained(pairs))
        rows = keyed.where(F.col("n") > max_bucket).select("fp", "node", F.col("k.part").alias("part"))
        if last or not rows.limit(1).count():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _chained(pairs: DataFrame) -> DataFrame:
    """The pairs whose chain from ``segment`` on keeps to its budget at each segment, to the whole ring."""
    x, y = F.col("x.fp"), F.col("y.fp")
    chain = F.lit(False)
    for i in range(len(SEGMENTS)):
        m1, m2 = _mask(*SEGMENTS[i]), _mask(*SEGMENTS[(i + 1) % len(SEGMENTS)])
        viable = (_differing(x, y, m1) == 0) & (_differing(x, y, m1 | m2) * len(SEGMENTS) <= 2 * BUDGET)
        chain = chain | (F.col("segment") == i) & viable
    return pairs.where(chain).where(F.bit_count(x.bitwiseXOR(y)) <= BUDGET).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    ``component_id`` is the smallest id reachable over links, the row's own included. Copies are one class by
    fingerprint, so a text that a third of all rows share is compared once. Null and empty texts have fingerprint 0 and
    are linked to each other. Rows with a null id get the component of their fingerprint's class (null if the class has
    no other id, and such a class links to nothing). Repeated rows repeat in the result.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text"))
    prints = common.written(with_fingerprints(rows, "__text"), "simhash-prints")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    parts = common.connected_components(similar_pairs(classes.where("node is not null")))
    linked = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    linked = common.written(linked, "simhash-components")
    return prints.join(linked, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with the smallest id, then the smallest hash of its text; repeated rows stay once.
    Rows without an id have no identity to keep or drop them by, and stay."""
    key = [F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__h")]
    numbered = common.written(docs.select("*", *key).withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")  # ids are fixed by writing them
    ided = numbered.where("__id is not null")
    prints = common.written(with_fingerprints(ided.select("__id", "__h", "__row", F.col("text").alias("__text")), "__text", "__fp"), "simhash-row-prints")
    classes = prints.groupBy("__fp").agg(F.min("__id").alias("node"), F.min(F.struct("__id", "__h", "__row")).alias("least"))
    parts = common.connected_components(similar_pairs(classes.select(F.col("__fp").alias("fp"), "node")))
    least = classes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("least").alias("least"))
    kept = ided.join(least.select(F.col("least.__row").alias("__row")), "__row", "left_semi")
    return kept.unionByName(numbered.where("__id is null")).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null and empty texts are linked by fingerprint 0."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
