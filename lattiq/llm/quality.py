"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.llm import common
from lattiq.llm.hashing import Words, blank_bytes, column_chunks, pair

#: Bounds on the labelled rows that a model is fitted on, those with the smallest hash of their id, and on their bytes of text.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 3000, 64 << 20
#: Families of features: words, pairs of words, shapes, pairs of shapes, and whether a word repeats the last one.
_FAMILIES = 5


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    scale: float = 8.0
    seed: int = 7


def features(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family (text number, bucket) of each n-gram in the order of the texts."""
    w = Words(texts, blank_bytes(), lower=False)
    shape, h = w.shapes(), w.hash
    cont = ~w.first_of_text()
    nxt = np.flatnonzero(cont)
    same = np.full(len(h), 3, dtype=np.uint64)
    same[nxt] = (h[nxt] == h[nxt - 1]).astype(np.uint64)
    out = [(w.text, h), (w.text[nxt], pair(h[nxt - 1], h[nxt])), (w.text, shape), (w.text[nxt], pair(shape[nxt - 1], shape[nxt])), (w.text, same)]
    salt = np.uint64(0x632BE59BD9B4E019)
    shift = np.uint64(64 - bits)
    return [(t, ((x + np.uint64(k + 1)) * salt >> shift).astype(np.int32)) for k, (t, x) in enumerate(out)]


def decision(texts: list[bytes], weights: np.ndarray, bias: float, p: FtrlParams) -> np.ndarray:
    """Sparse dot products: of each text the mean weight of its n-grams, by family."""
    out = np.full(len(texts), bias, dtype=np.float64)
    for t, idx in features(texts, p.bits):
        n = np.bincount(t, minlength=len(texts))
        s = np.bincount(t, weights=weights[idx], minlength=len(texts))
        out += p.scale * s / np.maximum(n, 1)
    return out


def example(text: bytes, p: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text's features: shares of its n-grams, by family."""
    idx, val = [], []
    for _, b in features([text], p.bits):
        u, c = np.unique(b, return_counts=True)
        idx.append(u)
        val.append(p.scale * c / max(len(b), 1))
    i, inverse = np.unique(np.concatenate(idx), return_inverse=True)
    return i.astype(np.int32), np.bincount(inverse, weights=np.concatenate(val), minlength=len(i)).astype(np.float32)


def fit_ftrl(texts: list[bytes], labels: np.ndarray, p: FtrlParams = FtrlParams()) -> tuple[np.ndarray, float]:
    """A model of texts; ``fit_examples`` is the same for texts whose features are known."""
    return fit_examples((example(t, p) for t in texts), labels, p)


def fit_examples(examples: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: FtrlParams = FtrlParams()) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates, one text at a time. Without both classes the bias is the mean's logit."""
    # all rows in two growing buffers, which go back to the system as a whole
    held_i, held_x, at = array("i"), array("f"), [0]
    for i, x in examples:
        held_i.frombytes(i.tobytes())
        held_x.frombytes(x.tobytes())
        at.append(len(held_i))
    all_i, all_x = np.frombuffer(held_i, dtype=np.int32), np.frombuffer(held_x, dtype=np.float32)
    z, n, w = (np.zeros(1 << p.bits) for _ in range(3))
    mean = float(np.clip(np.mean(labels) if len(labels) else 0.5, 1e-4, 1 - 1e-4))
    bias, bias_n = float(np.log(mean / (1 - mean))), 1.0
    if not 0 < (labels == 1).sum() < len(labels):
        return w.astype(np.float32), bias
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(labels)):
            i, x = all_i[at[k] : at[k + 1]], all_x[at[k] : at[k + 1]]
            wi = np.where(np.abs(z[i]) <= p.l1, 0.0, -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))
            d = float(wi @ x) + bias
            g0 = 1 / (1 + np.exp(-np.clip(d, -35, 35))) - labels[k]
            g = g0 * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * wi
            n[i] += g * g
            bias_n += g0 * g0
            bias -= p.alpha * g0 / (p.beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    return w.astype(np.float32), bias


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows outside the held-out fold as (__id, __text, __y): at most ``max_rows``, of at most ``max_bytes`` in all but for
    the first.

    Rows with a null id or label are left out; an id that has several labels gets their rounded mean, and of several texts the
    smallest counts. The ids are chosen by hash before texts are read, so the join's small side has ``max_rows`` ids at most.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (common.fold(doc_id, 3) != 1))
    ids = ids.groupBy(F.col(doc_id).alias("__id")).agg(F.round(F.avg(F.col(label).cast("double"))).alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    got = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id")
    got = got.groupBy("__id").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"), F.min("__y").alias("__y"))
    in_turn = Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, -1)  # over max_rows sizes
    sizes = common.written(got, "labelled-sample")
    fit = sizes.select("__id", F.octet_length("__text").alias("n"), F.xxhash64("__id")).withColumn("before", F.sum("n").over(in_turn))
    return sizes.join(F.broadcast(fit.where(F.coalesce(F.col("before") + F.col("n"), F.lit(0)) <= max_bytes).select("__id")), "__id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, params: FtrlParams = FtrlParams()) -> tuple[np.ndarray, float, FtrlParams]:
    """(weights, bias, parameters) of a bounded labelled sample; executors make the features, the driver gets those only. Null texts
    are empty; without labelled rows of both classes every score is the bias."""
    got = labelled_sample(docs, labels, label, max_rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [example(t.encode("utf-8", "surrogatepass"), params) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__y"), *(pa.array([v[k].tobytes() for v in x], pa.binary()) for k in (0, 1))], names=["__id", "__y", "i", "x"])

    schema = got.select("__id", "__y").schema.add("i", "binary").add("x", "binary")
    rows = sorted(got.mapInArrow(made, schema).collect(), key=lambda r: r[0])
    examples = ((np.frombuffer(r.i, dtype=np.int32), np.frombuffer(r.x, dtype=np.float32)) for r in rows)
    return (*fit_examples(examples, np.array([float(r[1] >= 0.5) for r in rows]), params), params)


def score(docs: DataFrame, model: tuple[np.ndarray, float, FtrlParams], text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (double, 0 to 1) to every row; a null or empty text gets the model's bias alone.

    The model is 2**bits floats (1 MB at 18 bits) whatever the input, so it is broadcast. Texts are scored whole. Other
    columns pass through unchanged; a column named like ``out`` is replaced.
    """
    weights, bias, p = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in column_chunks(b.column(text)):  # in small batches, so that neither side holds large ones
                scores = 1 / (1 + np.exp(-np.clip(decision(part, shared.value, bias, p), -700, 700)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(part)) for c in kept), pa.array(scores)], names=[*kept, out])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(out, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Trains on labels.quality and scores all documents: their columns and ``score``."""
    return score(docs, train(docs, labels, "quality", max_rows))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Each document's score; null and empty texts get that of the bias, null ids are held out if crc32 of the empty text says so,
    and repeated rows repeat."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
