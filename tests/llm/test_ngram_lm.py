import math
import zlib
from collections import Counter

import numpy as np

from lattiq.llm import ngram_lm as lm


def brute(docs, held, mu=lm.MU):
    """docs: [(id, text)] to {id: (n_tokens, n_known, N, base, score)}."""
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    uni, bi, tri, n_docs = Counter(), Counter(), Counter(), 0
    for i, t in toks.items():
        if not held(i):
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
            tri.update(zip(["<s>", "<s>", *t], ["<s>", *t], t))
            n_docs += 1
    total, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in toks.items():
        p = lambda w: (uni[w] + 1) / (total + v + 1)
        base = sum(math.log10(p(w)) for w in t)
        one = lambda a: n_docs if a == "<s>" else uni[a]
        two = lambda a, b: n_docs if b == "<s>" else bi[a, b]
        given = lambda a, w: (bi[a, w] + mu * p(w)) / (one(a) + mu)
        score = sum(math.log10((tri[a, b, w] + mu * given(b, w)) / (two(a, b) + mu)) for a, b, w in zip(["<s>", "<s>", *t], ["<s>", *t], t))
        out[i] = (len(t), sum(uni[w] > 0 for w in t), total, base, score)
    return out


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (70_000, 1 << 20), (150_000, 1 << 45), (3, 1 << 60)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = lm.EliasFano.encode(x)
        assert (e.decode() == x).all() and (e.decode(n // 3, n // 2) == x[n // 3 : n // 2]).all()


def test_levels_find_what_is_in_a_context():
    rng = np.random.default_rng(2)
    for n, contexts, top in ((0, 3, 9), (1, 1, 5), (5000, 40, 1 << 12), (200_000, 30_000, 1 << 32)):
        pairs = np.unique(np.stack([rng.integers(0, contexts, n), rng.integers(0, top, n)], axis=1), axis=0)
        starts = np.searchsorted(pairs[:, 0], np.arange(contexts + 1))
        level = lm.Level.build(starts, pairs[:, 1].astype(np.uint64), np.zeros(len(pairs), np.uint16))
        asked = np.concatenate([pairs[::3], np.stack([rng.integers(-1, contexts, 500), rng.integers(0, top, 500)], axis=1), pairs[1::5] + [0, 1]])
        asked = asked[np.argsort(asked[:, 0], kind="stable")]
        place = {tuple(x): k for k, x in enumerate(pairs.tolist())}
        got = level.find(asked[:, 0], asked[:, 1].astype(np.uint64), step=1000)
        assert got.tolist() == [place.get(tuple(x), -1) for x in asked.tolist()]


def test_packing():
    arrays = [np.zeros(0, np.int64), np.array([255]), np.array([256, 3]), np.array([1 << 40]), np.array([2**64 - 1], dtype=np.uint64), np.array([True, False])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, lm._unpack(lm._pack(*arrays))))


def test_scores_against_brute_force(spark, sf, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    monkeypatch.setattr(lm, "SHARD_BYTES", 3000)  # over a hundred shards for four partitions, and words dealt over them
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "COUNT_BYTES", 30_000)
    got = lm.op6_ngram_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-8 * abs(base) and abs(r.score - score) <= n * math.log10(total) / 65000  # a code's step a token
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    print(sum(r.score for r in held) / sum(r.n_tokens for r in held), sum(r.base_score for r in held) / sum(r.n_tokens for r in held))


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, 1), (2, "", 1), (3, "a b a", 1), (3, "a b a", 1), (None, "A\tc", 1), (4, "z " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = lm.score_texts(docs, F.col("doc_id") == 3).collect()
    assert len(got) == 6 and {r.doc_id for r in got} == {1, 2, 3, 4, None}
    assert all(r.train_tokens == 8 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 1 and by[1].n_known == 1 and by[None].n_known == 2 and by[4].n_known == 1
    none = lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 for r in none)
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0
