"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks.

A cosine of c or more between unit vectors is a distance of sqrt(2 - 2c) or less. A function floor((a.v + b) / w) with
Gaussian a maps near vectors to one value often; ``functions`` of them make a table's bucket, and two vectors meet if any of the
``tables`` agrees. At the threshold 0.93 (distance 0.374) a function of width 2 agrees with probability 0.85, eight with
0.27, and one of 20 tables with 0.998; nearer vectors meet more surely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import common


@dataclass(frozen=True)
class PStable:
    functions: int = 8
    tables: int = 20
    width: float = 2.0
    seed: int = 5
    #: A bucket of more vectors is compared block against block, each pair of blocks in a group of its own.
    block: int = 1024


def bucket_keys(unit: np.ndarray, p: PStable) -> np.ndarray:
    """(vectors, tables) of 32-bit bucket keys; vectors of another length get other functions."""
    rng = np.random.default_rng([p.seed, unit.shape[1]])
    a = rng.normal(size=(unit.shape[1], p.tables * p.functions))
    b = rng.uniform(0, p.width, size=p.tables * p.functions)
    cells = np.floor((unit @ a + b) / p.width).astype(np.int64).view(np.uint64).reshape(len(unit), p.tables, p.functions)
    key = np.zeros((len(unit), p.tables), dtype=np.uint64)
    for k in range(p.functions):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can link, and those as doubles of length one; they share one length."""
    good = np.zeros(len(vectors), dtype=bool)
    out = []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, dtype=np.float64)
        top = np.abs(x).max() if np.isfinite(x).all() else 0.0
        if top > 0:
            good[i] = True
            x = x / top  # a long or short vector neither overflows nor vanishes
            out.append(x / np.sqrt(x @ x))
    return good, np.array(out) if out else np.zeros((0, 1))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _packed(x: np.ndarray) -> bytes:
    """A vector in four bytes a component if that loses nothing, else in eight."""
    short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def _unpacked(blobs: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors of packed ones of one length."""
    x = np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dims else np.float64) for v in blobs]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


#: Groups up to this size are compared by distance in the list, all groups at once; larger ones by a matrix product each.
_SMALL = 48


def _pairs(group: np.ndarray, side: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one group whose cosine is the threshold or above. Groups are runs; ``side`` is 0 where all rows of a group
    meet, else 1 or 2, and then only rows of different sides meet."""
    out_i, out_j = [], []
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, min(_SMALL, len(group))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & ((side[:-d] == 0) | (side[:-d] != side[d:])))
        if not len(i) and d >= sizes.max():
            break
        for k in range(0, len(i), 1 << 15):
            p = i[k : k + (1 << 15)]
            hit = p[np.einsum("ij,ij->i", unit[p], unit[p + d]) >= threshold]
            out_i.append(hit)
            out_j.append(hit + d)
    for s, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL]):
        part = side[s : s + n]
        a, b = (np.arange(n), np.arange(n)) if part[0] == 0 else (np.flatnonzero(part == 1), np.flatnonzero(part == 2))
        for k in range(0, len(a), 512):
            i, j = np.nonzero(unit[s + a[k : k + 512]] @ unit[s + b].T >= threshold)
            i = i + k
            keep = a[i] < b[j] if part[0] == 0 else np.ones(len(i), dtype=bool)
            out_i.append(s + a[i[keep]])
            out_j.append(s + b[j[keep]])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, p: PStable = PStable(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors are compared only if their labels are equal and not null and their lengths are equal. Null, zero and non-finite
    vectors, and vectors with null components, link with nothing and stand alone. Rows that repeat an id count as one
    vector, that of the smallest (label, embedding); rows with a null id are kept as they are, without links. Equal vectors of
    a label are one class with a count, whether two or a third of all, and only classes are hashed and compared. Each link of
    classes is counted in the first table in which its ends meet, and never leaves the bucket's task: a bucket gives one count
    and one root for each class. A bucket of many classes is cut into blocks, and each pair of blocks is a group of its own.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    ided = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["v"].map(lambda v: -1 if v is None else len(v))
            for dims, g in b[b["label"].notna()].groupby(lengths):
                good, unit = _unit(g["v"].tolist())
                if good.any():
                    g = g[good]
                    keys = bucket_keys(unit, p)
                    yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy(), "space": g["label"].str.cat([f"/{dims}"] * len(g)), "dims": dims, "raw": [_packed(np.asarray(x, dtype=np.float64)) for x in g["v"]], "keys": list(keys)})

    vecs = common.written(ided.mapInPandas(hashed, "vec_id bigint, space string, dims int, raw binary, keys array<int>").withColumn("c", F.md5(F.concat(F.encode("space", "UTF-8"), F.lit(b"\0"), "raw"))), "vectors")
    classes = vecs.groupBy("c").agg(F.min("vec_id").alias("cls"), F.count("*").alias("size"), F.first("space").alias("space"), F.first("dims").alias("dims"), F.first("raw").alias("raw"), F.first("keys").alias("keys"))
    classes = common.written(classes, "vector-classes")
    spread = classes.select("cls", F.xxhash64("space").alias("space"), F.posexplode("keys").alias("t", "key"))
    sizes = spread.groupBy("t", "space", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / p.block).cast("int")
    met = spread.join(sizes, ["t", "space", "key"]).withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    # a class of block k meets the pairs (i, k) and (k, j)
    pairs = F.expr("transform(sequence(0, nb - 1), j -> struct(least(j, blk) as lo, greatest(j, blk) as hi))")
    met = met.withColumn("p", F.explode(pairs)).select("cls", "t", "space", "key", F.when(F.col("p.lo") == F.col("p.hi"), 0).when(F.col("blk") == F.col("p.lo"), 1).otherwise(2).alias("side"), "p.lo", "p.hi")
    met = met.join(classes.select("cls", "size", "dims", "raw", "keys"), "cls")
    by = ["t", "space", "key", "lo", "hi"]
    met = met.repartition(*by).sortWithinPartitions(*by, "cls")

    def linked(b: pd.DataFrame) -> pd.DataFrame:
        """Of whole groups of one length of vectors: (cls, n, root) of the rows that link."""
        key = b[by].to_numpy()
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
        unit, keys = _unpacked(b["raw"].tolist(), int(b["dims"].iloc[0])), np.stack(b["keys"].to_numpy())
        i, j = _pairs(group, b["side"].to_numpy(), unit, threshold)
        earlier = np.arange(p.tables) < b["t"].to_numpy()[i][:, None]
        fresh = ~((keys[i] == keys[j]) & earlier).any(axis=1)
        size, ids = b["size"].to_numpy(), b["cls"].to_numpy()
        n = np.bincount(i[fresh], weights=size[j[fresh]], minlength=len(b)) + np.bincount(j[fresh], weights=size[i[fresh]], minlength=len(b))
        root = _forest(len(b), i, j)
        some = (n > 0) | (root != np.arange(len(b)))
        return pd.DataFrame({"cls": ids[some], "n": n[some].astype(np.int64), "root": ids[root][some]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b[by] != b[by].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held = b.iloc[cut:]
            for _, g in b.iloc[:cut].groupby("dims"):
                yield linked(g)
        if held is not None and len(held):
            yield linked(held)

    found = common.written(met.mapInPandas(compared, "cls bigint, n bigint, root bigint"), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    parts = common.connected_components(found, "cls", "root").withColumnRenamed("node", "cls")
    per_class = classes.select("c", "cls", "size").join(counts, "cls", "left").join(parts, "cls", "left")
    per_class = per_class.select("c", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    of_class = common.salted_join(vecs.select("vec_id", "c"), per_class, "c").drop("c")
    out = ided.select("vec_id").join(of_class, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    lost = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(lost.withColumn("kept", F.lit(True)))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """All rows of the table by label; what ``near_vectors`` says of odd rows holds."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


#: By comparing all pairs of a label; the operator finds the same links where it misses none.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, r.a = min(r.c) AS kept FROM r LEFT JOIN n USING (a) GROUP BY r.a
"""
