"""What the operators of this subpackage share: tables, checkpoints, folds, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lattiq

#: Executors need no copy of the package: functions travel with the plan.
cloudpickle.register_pickle_by_value(lattiq)

#: Words are runs of anything but these ASCII blanks; as a class for Java's regular expressions.
BLANKS = r"\x20\x09-\x0D"
#: Edges of a graph that a task contracts at a time.
CONTRACTED = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Sets the checkpoint folder from spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a
    cluster it is an error, since executors would each write to their own disk."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattiq-"))
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the rows go to the shared folder, so a lost executor costs nothing that was done."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    with_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again; unlike a checkpoint it stays columnar."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted batches; a run may span batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        key = b[by].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]):
            part = b.iloc[s:e]
            if held and (held[-1][by].iloc[-1].to_numpy() != part[by].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it: a lambda inside would else compute it for each item."""
    return F.element_at(F.transform(F.array(value), f), 1)


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """A join with a table that has one row for each key, when a key may have a third of the other table's rows: these are dealt
    over ``salts`` parts, and the one row goes to each part. It is a sort-merge join: copies compress so well that they would pass
    for a small side and be broadcast, whatever they grow to."""
    dealt = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def word_count(text: Column) -> Column:
    """Number of words (bigint); null: 0. Blanks become one kind of byte, so counting needs no array."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{BLANKS}]++", "\u0001")
    return F.length(F.translate(squeezed, " \u0009\u000a\u000b\u000c\u000d", "")).cast("bigint")


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n can reach over links a to b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as others that connect the same nodes: of each ``CONTRACTED`` of a task or fewer, one from each node to the smallest that it reaches by these."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = labels(len(nodes), at[: len(u)], at[len(u) :])
        low = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[label[low]])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        if held and n + b.num_rows > CONTRACTED:
            yield stars(*map(np.concatenate, zip(*held)))
            held, n = [], 0
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
    if n:
        yield stars(*map(np.concatenate, zip(*held)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 16, most_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    Returns (node, component): each node that has an edge, with the smallest node it can reach. Edges with a null
    end or equal ends are left out. A node may have a third of all edges: they are dealt over ``salts`` parts, its smallest
    neighbour is found by partial aggregation within these and is carried back to them. No links ever reach the driver; each
    round's edges go to the shared checkpoint folder. The number of rounds grows as the logarithm of the longest path.

    The driver keeps a record of every task, and a shuffle has as many as there are partitions, however few the edges. So edges are contracted
    where they are read, in as many tasks as they fill, before each round: that shuffles nothing, and leaves few rounds or none. A round has six
    shuffles, three for each star. Equal edges fall into the same part and are made one there; a round writes at most twice the distinct edges it
    was given, whose number never grows.
    """
    e = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
    e = written(e.where("u is not null and v is not null and u <> v"), "links")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")

    def star(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (u, v), each with u's smallest v as m. A merge, so that no node's row passes through the driver."""
        dealt = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).repartition("u", "s").dropDuplicates(["u", "s", "v"])
        least = dealt.groupBy("u").agg(F.min("v").alias("m"))
        return dealt.join(least.select("u", "m", parts).hint("merge"), ["u", "s"])

    def each(*ends: tuple[str, str]) -> Column:
        return F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])).alias("p")

    for _ in range(most_rounds + 1):
        e = written(e.coalesce(e.count() // CONTRACTED + 1).mapInArrow(contracted, "u bigint, v bigint"), "contracted")
        both = e.select(each(("u", "v"), ("v", "u"))).select("p.*")
        loose = both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < u and lo <> hi")
        if not loose.limit(1).count():  # every node is a root or has one neighbour, a root
            break
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = star(large).select(each(("v", "m"), ("u", "m"))).select("p.*").where("u <> v")
        e = written(small, "links")
    else:
        raise RuntimeError("components did not settle")
    return e.select(each(("u", "v"), ("v", "v"))).select(F.col("p.u").alias("node"), F.col("p.v").alias("component")).distinct()
