"""Near-duplicates by SimHash and pigeonring: chains in the rings of many fingerprints find pairs, Hamming distance and the whole shingle sets decide.

Texts that share 0.8 of their five-word shingles differ in some 10 of a fingerprint's 64 bits, 3 to 16 by chance, and random
ones in 32, so that pigeonring over one fingerprint, which is exact for op3's 2 bits, is no filter here. A text has ``FINGERPRINTS``
of them, each a ring of four segments, and as in op3 a chain is found by its beginning, an equal segment. A bit of two such texts differs with
probability 0.151, so they share some segment with probability 1 - (1 - 0.849 ** 16) ** 96, 0.9993 at 0.8 and more above. The chain is then followed around
its ring: after l segments at most l / 4 of ``BUDGET`` bits may differ, which some 0.99999 of such chains keep to, and 0.13 of those of random texts. Two more
fingerprints part candidates from chance: within ``MAX_DIFFERING`` of 128 bits lie 0.999999 of the former and 0.00002 of the latter.
What lies so near within a bucket is a cluster, named by its smallest member. A text is in up to 96 of them, but takes one row: it and the smallest
members of all its clusters are compared with the least of these, which ties its clusters together. Clusters so tied whose members no links connect
are a family, compared in blocks of so many texts and shingles, each text outside a block's largest component with the whole block, and no pair is
ever a row. Every family goes this way, whatever its size; none is left out. The work on texts that are near to a group and linked to none of it
grows with their number times the group's, dealt over pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType

from lattiq.llm import common
from lattiq.llm.common import labels as _labels
from lattiq.llm.common import runs
from lattiq.llm.hashing import Words, bit_counts, blank_bytes, column_chunks, mix, pair

WORDS_EACH, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits whose segments of 16 find candidates, and those beside them whose Hamming distance is taken.
FINGERPRINTS, CHECKED = 24, 2
MAX_DIFFERING = 40
#: Segments in a fingerprint's ring, and the bits that may differ in all of it.
RING, BUDGET = 4, 20
#: A bucket of more texts is clustered by itself, smaller ones many at a time.
MAX_BUCKET = 512
#: Shingles, and texts, in a block of a family that holds several components.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 1024
#: Fixed values that make another hash of a shingle for each fingerprint.
_TURNS = mix(np.arange(1, FINGERPRINTS + CHECKED + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], words_each: int = WORDS_EACH) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, and where each text's begin and end. Fewer words are one shingle, none are none."""
    w = Words(texts, blank_bytes())
    counts = w.counts()
    h, out_n = w.hash, np.where(counts > 0, np.maximum(counts - words_each + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(out_n)])
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    begin = np.repeat(first - at[:-1], out_n) + np.arange(at[-1])
    length = np.repeat(np.minimum(counts, words_each), out_n)
    out = h[begin]
    for k in range(1, words_each):
        more = np.flatnonzero(length > k)
        out[more] = pair(out[more], h[begin[more] + k])
    return out, at


def distinct_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, ascending in each, and where each text's begin and end."""
    s, at = shingle_sets(texts)
    sets = [np.unique(s[i:j]) for i, j in zip(at[:-1], at[1:])]
    return np.concatenate([*sets, s[:0]]), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def simhashes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 64-bit SimHashes for each set: a bit is 1 if set in over half the set's hashes."""
    out = np.empty((len(at) - 1, len(_TURNS)), dtype="<u8")
    half = np.diff(at)[:, None]
    for k, turn in enumerate(_TURNS):
        out[:, k] = np.packbits(2 * bit_counts(mix(s ^ turn), at) > half, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def segments(prints: np.ndarray) -> np.ndarray:
    """A row of keys for each row of fingerprints: the number and the 16 bits of each segment."""
    parts = np.ascontiguousarray(prints[:, :FINGERPRINTS]).view("<u2")
    return parts.astype(np.int32) + (np.arange(parts.shape[1], dtype=np.int32) << 16)


def chains(prints: str = "__prints") -> Column:
    """The chains of a list of fingerprints, (key, ring) for each segment: its number and bits, as in ``segments``, and its fingerprint
    turned so that the ring begins with it."""
    turned = ", ".join(f"shiftrightunsigned(f, {k}) | shiftleft(f, {64 - k})" if k else "f" for k in range(0, 64, 64 // RING))
    rings = f"flatten(transform({prints}, f -> array({turned})))"
    return F.expr(f"transform({rings}, (r, p) -> struct(int(shiftleft(p, 16) + (r & 65535)) AS key, r AS ring))")


def _with_prints(rows: DataFrame, text: str) -> DataFrame:
    """Takes ``__set``, the hash of a text's set of shingles, ``__prints`` (empty without shingles) and the checked fingerprints for the text."""
    kept = [c for c in rows.columns if c != text]
    names = [*kept, "__set", "__prints", "__f0", "__f1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in column_chunks(b.column(text)):
                s, at = distinct_sets(part)
                hashed = np.concatenate([[np.uint64(0)], np.cumsum(mix(s), dtype=np.uint64)])
                prints = simhashes(s, at)
                full = np.diff(at) > 0
                found = np.ascontiguousarray(prints[full, :FINGERPRINTS]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(full * FINGERPRINTS)]).astype(np.int32)
                made = [(hashed[at[1:]] - hashed[at[:-1]]).view(np.int64), *(np.ascontiguousarray(prints[:, FINGERPRINTS + k]).view(np.int64) for k in range(CHECKED))]
                held = [b.column(c).slice(first, len(part)) for c in kept]
                yield pa.RecordBatch.from_arrays([*held, pa.array(made[0]), pa.ListArray.from_arrays(ends, found.ravel()), *map(pa.array, made[1:])], names=names)

    return rows.mapInArrow(run, rows.select(*kept).schema.add("__set", "long").add("__prints", ArrayType(LongType())).add("__f0", "long").add("__f1", "long"))


def _with_sets(rows: DataFrame, text: str) -> DataFrame:
    """Takes the set as ``__shingles`` for the text."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in column_chunks(b.column(text)):
                s, at = distinct_sets(part)
                held = [b.column(c).slice(first, len(part)) for c in kept]
                yield pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(at.astype(np.int32), s.view(np.int64))], names=[*kept, "__shingles"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("__shingles", ArrayType(LongType())))


def viable(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the chains from the first segments of the rings keep to their budget after each segment, to the whole ring."""
    differing, out = x ^ y, True
    for l in range(1, RING + 1):
        out &= np.bitwise_count(differing & np.uint64((1 << 64 // RING * l) - 1)) * RING <= BUDGET * l
    return out


def hamming_clusters(key: np.ndarray, f0: np.ndarray, f1: np.ndarray, ring: np.ndarray | None = None) -> np.ndarray:
    """For each of the rows, sorted by key, the first of those of its key that it reaches in steps of ``MAX_DIFFERING`` bits; with ``ring``, in
    steps whose chains are viable too."""

    def near(i, j) -> np.ndarray:
        close = np.bitwise_count(f0[i] ^ f0[j]) + np.bitwise_count(f1[i] ^ f1[j]) <= MAX_DIFFERING
        return close if ring is None else close & viable(ring[i], ring[j])

    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(np.where(size <= MAX_BUCKET, start + size, 0), size)
    found_a, found_b, i, step = [], [], np.arange(len(key)), 1
    while len(i := i[i + step < end[i]]):
        hit = i[near(i, i + step)]
        found_a.append(hit)
        found_b.append(hit + step)
        step += 1
    none = np.zeros(0, dtype=np.int64)
    label = _labels(len(key), np.concatenate([none, *found_a]), np.concatenate([none, *found_b]))
    for k in np.flatnonzero(size > MAX_BUCKET):
        rest = np.arange(start[k], start[k] + size[k])
        while len(rest):
            least, rest, front = rest[0], rest[1:], [rest[0]]
            while front and len(rest):
                hit = near(front.pop(), rest)
                label[rest[hit]] = least
                front += rest[hit].tolist()
                rest = rest[~hit]
    return label


def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, __f0, __f1, __set, and ring for chains) sorted by key, the clusters of two or more: each member as (key, __set) with the
    least member as key, so that what several segments find again is the same row."""

    def found(x: list[np.ndarray]) -> pa.RecordBatch:
        key, f0, f1, ids, *ring = x
        label = hamming_clusters(key, *(v.view(np.uint64) for v in (f0, f1, *ring)))
        n = np.bincount(label, minlength=len(key))
        at = np.flatnonzero(n[label] > 1)
        at = at[np.lexsort((ids[at], label[at]))]
        cut = np.flatnonzero(np.diff(label[at], prepend=-1))
        size = np.diff(np.append(cut, len(at)))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at][cut], size)), pa.array(ids[at])], names=["key", "__set"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = [c.to_numpy() for c in b.columns]
        cut = int(np.searchsorted(x[0], x[0][-1]))  # the last key may go on
        if cut or (held and held[-1][0][0] != x[0][0]):
            yield found([np.concatenate(c) for c in zip(*held, [v[:cut] for v in x])])
            held = []
        held.append([v[cut:] for v in x])
    if held:
        yield found([np.concatenate(c) for c in zip(*held)])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are so similar."""
    both = pairs.join(sets.select(F.col("__set").alias("b"), F.col("__shingles").alias("y")), "b").join(sets.select(F.col("__set").alias("a"), F.col("__shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def links_between(sets: list[np.ndarray], component: np.ndarray, similarity: float, spanning: bool = False) -> list[tuple[int, int]]:
    """Positions of similar sets of different components, enough of them to join all components that such a link joins.

    Every set outside the most frequent component is compared with all sets at once, by the postings of its shingles. With ``spanning``
    the components that a link joins are one from then on, so that what has come to the most frequent one is not compared any more.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    u, at = np.unique(np.concatenate(sets)[order], return_index=True)
    at = np.append(at, len(owner))
    names, inverse, n = np.unique(component, return_inverse=True, return_counts=True)
    found, most = [], np.argmax(n)
    for i in np.flatnonzero(inverse != most):
        if inverse[i] == most:
            continue
        k = np.searchsorted(u, sets[i])
        length = at[k + 1] - at[k]
        where = np.repeat(at[k] - np.cumsum(length) + length, length) + np.arange(length.sum())
        shared = np.bincount(owner[where], minlength=len(sets))
        near = np.flatnonzero((shared >= similarity * (sizes + sizes[i] - shared) - 1e-9) & (inverse != inverse[i]))
        met, first = np.unique(inverse[near], return_index=True)
        found += [(int(i), int(j)) for j in near[first]]
        if spanning and len(met):
            inverse[np.isin(inverse, np.append(met, inverse[i]))] = most if most in met else inverse[i]
    return found


def _leftovers(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components within the buckets of (key, __set, component).

    A bucket is cut into blocks of so many shingles or texts, and each pair of blocks is a group of its own; a group with one component
    has nothing to compare and is left out before any set is sent.
    """
    load = named.groupBy("key").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("nb"))
    rows = named.join(load, "key").withColumn("blk", F.pmod(F.xxhash64("__set"), F.col("nb")).cast("int"))
    rows = rows.withColumn("p", F.explode(F.expr("transform(sequence(0, nb - 1), j -> struct(least(j, blk) as lo, greatest(j, blk) as hi))"))).select("key", "p.lo", "p.hi", "__set", "component")
    by = ["key", "lo", "hi"]
    mixed = rows.groupBy(*by).agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select(*by)
    rows = rows.join(mixed, by).join(sets, "__set").repartition(*by).sortWithinPartitions(*by)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, by):
            ids, blobs = g["__set"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in g["__shingles"]]
            got = links_between(blobs, g["component"].to_numpy(), similarity, spanning=True)
            if got:
                yield pd.DataFrame({"a": ids[[i for i, _ in got]], "b": ids[[j for _, j in got]]})

    return rows.select(*by, "__set", "component", "__shingles").mapInPandas(compared, "a bigint, b bigint").distinct()


def _named(met: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows with ``__set`` with their component, which without links is the set itself."""
    return met.join(parts.withColumnRenamed("node", "__set"), "__set", "left").withColumn("component", F.coalesce("component", "__set"))


def _ties(named: DataFrame, stars: DataFrame) -> DataFrame:
    """The components (a, b) of stars that no link has made one."""
    ends = [named.select(F.col("__set").alias(c), F.col("component").alias(f"__{c}")) for c in ("a", "b")]
    both = common.salted_join(stars.join(ends[1], "b"), ends[0], "a").where("__a <> __b")
    return common.written(both.select(F.col("__a").alias("a"), F.col("__b").alias("b")), "simhash-ties")


def _families(named: DataFrame, ties: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, __set, component, n) of the tied components, each family of them under one key, so that each set is sent once."""
    families = common.connected_components(ties).select(F.col("node").alias("component"), F.col("component").alias("key"))
    members = named.join(sets.select("__set", F.size("__shingles").alias("n")), "__set")
    return common.written(common.salted_join(members, families, "component").select("key", "__set", "component", "n"), "simhash-families")


def similar_sets(classes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(__set, component) of the sets that are similar to another one. ``classes`` has a row for each ``__set`` with ``__prints``, ``__f0``,
    ``__f1`` and one of its rows as ``__id`` and ``__h``; ``texts`` has ``__id``, ``__h`` and ``__text``."""
    begun = classes.select(F.explode(chains()).alias("c"), "__f0", "__f1", "__set")
    keys = begun.select("c.key", "__f0", "__f1", "__set", "c.ring")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(clusters, "key bigint, __set bigint")
    # one row for each set, though its segments may find it in as many clusters
    met = common.written(met.groupBy("__set").agg(F.collect_set("key").alias("keys")), "simhash-clusters")
    ids = classes.join(met, "__set", "left_semi").select("__id", "__h", "__set")
    texts = texts.join(ids, ["__id", "__h"]).dropDuplicates(["__id", "__h"])
    sets = common.written(_with_sets(texts.select("__set", "__text"), "__text"), "simhash-sets")
    # the least of a set's clusters ties them all: the set and the clusters' first ones meet its first one
    stars = met.select(F.array_min("keys").alias("a"), F.explode(F.array_union("keys", F.array("__set"))).alias("b"))
    stars = common.written(stars.where("a <> b").distinct(), "simhash-stars")
    links = common.written(_similar(stars, sets, similarity), "simhash-links")
    parts = common.connected_components(links)
    named = common.written(_named(met, parts), "simhash-named")
    ties = _ties(named, stars)
    if not ties.limit(1).count():
        return parts.withColumnRenamed("node", "__set")
    # what no first one ties together is compared block by block
    more = common.written(_leftovers(_families(named, ties, sets), sets, similarity), "simhash-more")
    if more.limit(1).count():
        parts = common.connected_components(links.unionByName(more))
    return parts.withColumnRenamed("node", "__set")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of texts that share ``similarity`` of their five-word shingles: the one with the smallest id,
    then the smallest hash of its columns. Null and empty texts are equal; repeated rows stay once. Rows without an id have no
    identity to keep or drop them by, and stay."""
    columns = docs.columns
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    ided = docs.where(F.col(doc_id).isNotNull()).withColumns({"__id": F.col(doc_id), "__h": F.xxhash64(*hashed)})
    texts = ided.select("__id", "__h", F.col(text).alias("__text"))
    prints = common.written(_with_prints(texts, "__text"), "simhash-prints")
    same = [F.first(c).alias(c) for c in ("__prints", "__f0", "__f1")]
    classes = prints.groupBy("__set").agg(*same, F.min(F.struct("__id", "__h")).alias("f"))
    classes = common.written(classes.select("__set", "__prints", "__f0", "__f1", "f.*"), "simhash-sets-prints")
    parts = similar_sets(classes, texts, similarity)
    keepers = classes.select("__set", F.struct("__id", "__h").alias("f")).join(parts, "__set", "left").groupBy(F.coalesce("component", "__set").alias("c")).agg(F.min("f").alias("f"))
    kept = ided.join(keepers.select("f.*"), ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return kept.select(*columns).unionByName(docs.where(F.col(doc_id).isNull()))
