"""Toxicity: non-negative positive-unlabelled learning on hashed words.

Confirmed toxic texts and unlabelled texts train a linear classifier by the risk of Kiryo et al. (2017):
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``; where the bracket falls below zero, the
step goes up its gradient instead. The class prior comes from the labelled rows of the training folds. A feature is the
presence of a hashed word that is in significantly more positives than unlabelled texts, scaled by its log ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import common
from lattiq.llm.hashing import Words, chunks, folded, mix, non_alnum_bytes

#: Bounds on the rows that a model is fitted on, chosen by hash of the id.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 8000
#: Bytes of a word's beginning that is a feature beside the word.
PREFIX = 5


@dataclass(frozen=True)
class NnpuParams:
    bits: int = 20
    steps: int = 1000
    batch: int = 500
    rate: float = 0.05
    l2: float = 1e-4
    least_texts: int = 3
    least_z: float = 3.0
    least_ratio: float = 1.4
    prior_margin: float = 1.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def distinct_words(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct lower-cased words and word beginnings of each text, ordered by text."""
    w = Words([folded(t) for t in texts], non_alnum_bytes())
    bucket = np.concatenate([w.hash, w.prefixes(PREFIX) * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(64 - bits)
    key = (np.concatenate([w.text, w.text]).astype(np.uint64) << np.uint64(bits)) | bucket
    key = np.unique(key)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def features(text: bytes, bits: int) -> np.ndarray:
    return distinct_words([text], bits)[1].astype(np.int32)


def without_copies(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Leaves one of near copies in a sample: texts of which 6 of 12 smallest hashes are those of an earlier one go."""
    kept, owner, seeds = [], {}, [np.uint64(2 * k + 1) for k in range(12)]
    for idx in rows:
        if len(idx):
            h = idx.astype(np.uint64)
            sign = [(k, int((mix(h * np.uint64(2654435761) + s)).min())) for k, s in enumerate(seeds)]
            votes: dict[int, int] = {}
            for key in sign:
                if key in owner:
                    votes[owner[key]] = votes.get(owner[key], 0) + 1
            if max(votes.values(), default=0) >= 6:
                continue
            for key in sign:
                owner.setdefault(key, len(kept))
            kept.append(idx)
    return kept


def fit_nnpu(positive: list[bytes], unlabelled: list[bytes], prior: float, p: NnpuParams = NnpuParams()) -> Model:
    return fit_features([features(x, p.bits) for x in positive], [features(x, p.bits) for x in unlabelled], prior, p)


def fit_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: NnpuParams = NnpuParams()) -> Model:
    """From the distinct buckets of each text. Without positives or without unlabelled texts the score is the prior for
    every text."""
    prior = float(np.clip(prior * p.prior_margin, 1e-4, 0.9))
    weights, bias = np.zeros(1 << p.bits), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights.astype(np.float32), bias, p.bits)
    positive = without_copies(positive)
    texts = [*positive, *unlabelled]
    t = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    idx = np.concatenate(texts)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(idx[t < n_p], minlength=1 << p.bits)
    in_u = np.bincount(idx[t >= n_p], minlength=1 << p.bits)
    pooled = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    ratio = np.log(((in_p + 0.5) / (n_p + 1)) / ((in_u + 0.5) / (n_u + 1)))
    chosen = (in_p >= p.least_texts) & (z >= p.least_z) & (ratio >= p.least_ratio)
    kept = chosen[idx]
    t, idx = t[kept], idx[kept]
    at = np.searchsorted(t, np.arange(len(texts) + 1))
    used, idx = np.unique(idx, return_inverse=True)
    m, v, w = np.zeros(len(used)), np.zeros(len(used)), np.ones(len(used))
    by = ratio[used]
    mb = vb = 0.0
    rng, step, n_pos = np.random.default_rng(p.seed), 0, len(positive)

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(which)), at[which + 1] - at[which]), np.concatenate([idx[at[i] : at[i + 1]] for i in which]) if len(which) else idx[:0]

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    n_steps = max(1, -(-len(unlabelled) // p.batch))
    for _ in range(-(-p.steps // n_steps)):
        pos, unl = rng.permutation(n_pos), rng.permutation(len(unlabelled)) + n_pos
        for k in range(n_steps):
            bu = unl[k * p.batch : (k + 1) * p.batch]
            bp = pos[np.arange(k * p.batch, (k + 1) * p.batch) % n_pos] if n_pos > p.batch else pos
            rp, ip = rows(bp)
            ru, iu = rows(bu)
            dp = np.bincount(rp, weights=(w * by)[ip], minlength=len(bp)) + bias
            du = np.bincount(ru, weights=(w * by)[iu], minlength=len(bu)) + bias
            # sigmoid loss: of a positive s(-d), of a negative s(d); it is bounded, so a text of surely toxic words is
            # scored as such though a tenth of the unlabelled texts is like it
            sp, su = sigmoid(dp), sigmoid(du)
            negative = su.mean() - prior * sp.mean()
            g_neg_u, g_neg_p = su * (1 - su) / len(bu), -prior * sp * (1 - sp) / len(bp)
            g_pos = g_neg_p
            if negative >= 0:
                gp, gu = g_pos + g_neg_p, g_neg_u
            else:
                gp, gu = -g_neg_p, -g_neg_u
            g = (np.bincount(ip, weights=gp[rp], minlength=len(w)) + np.bincount(iu, weights=gu[ru], minlength=len(w))) * by + p.l2 * w
            gb = gp.sum() + gu.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w = w - p.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            bias -= p.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[used] = w * by
    return Model(weights.astype(np.float32), float(bias), p.bits)


def decision(texts: list[bytes], model: Model) -> np.ndarray:
    t, idx = distinct_words(texts, model.bits)
    return model.bias + np.bincount(t, weights=model.weights[idx], minlength=len(texts))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, params: NnpuParams = NnpuParams()) -> Model:
    """Positives: confirmed rows outside the held-out fold. Unlabelled: any documents outside it, their labels unread.

    Both samples are bounded and drawn by hash of the id. Null ids, labels and texts: such rows teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (common.fold("doc_id", 3) != 1))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    prior = known.agg(F.avg((F.col("__y") == 1).cast("double"))).first()[0] or 0.0
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (common.fold("doc_id", 3) != 1)).select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    positive = known.where("__y = 1").orderBy(F.xxhash64("__id"), "__id").limit(max_positive).select("__id")
    some = texts.select("__id").distinct().orderBy(F.xxhash64(F.lit(1), "__id"), "__id").limit(max_unlabelled)
    ids = positive.withColumn("__p", F.lit(True)).unionByName(some.withColumn("__p", F.lit(False)))
    got = texts.join(F.broadcast(ids), "__id").groupBy("__id", "__p").agg(F.min("__text").alias("__text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.encode("utf-8", "surrogatepass"), params.bits).tobytes() for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__p"), pa.array(x, pa.binary())], names=["__id", "__p", "x"])

    schema = got.select("__id", "__p").schema.add("x", "binary")
    rows = got.mapInArrow(hashed, schema).toPandas().sort_values(["__id", "__p"])  # buckets of the bounded samples, not their texts
    part = {k: [np.frombuffer(x, dtype=np.int32) for x in g["x"]] for k, g in rows.groupby("__p")}
    return fit_features(part.get(True, []), part.get(False, []), prior, params)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (double, 0 to 1). Null and empty texts get the score of the bias alone. The model is 2**bits floats
    (4 MB at 20 bits) whatever the input. Other columns pass through; one named like ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.empty(b.num_rows)
            for first, part in chunks(b.column(text).to_pylist()):
                d[first : first + len(part)] = decision(part, shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(1 / (1 + np.exp(-np.clip(d, -700, 700))))], names=[*kept, out])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(out, "double"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's score; null and empty texts are scored without features, null ids are held out if crc32 of the empty text says
    so, and repeated rows repeat."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
