import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lattiq.llm import line_rules as lr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    again = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)]


def random_text(rng):
    words = rng.choice([["a", "b"], ["é", "日本", "x|y", "<p>", "WORD"], [f"w{i}" for i in range(40)]])
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", "\r\n", "\x0b", " \n", " ", "\x00"]) for _ in range(rng.choice([0, 1, 5, 9, 30, 200])))


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(400)] + ["", "\n", "a", " a\n a\na", "same line\n" * 50]
    for size in (1, 7, 405):
        for k in range(0, len(texts), size):
            part = texts[k : k + size]
            got = lr.lines([t.encode() for t in part]).counts
            assert np.array([brute_counts(t) for t in part]).T.tolist() == [got[c].tolist() for c in lr.COUNTS]


def test_features_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [random_text(rng).encode() for _ in range(60)]
    whole = lr.lines(texts)
    for k, t in enumerate(texts):
        assert (lr.lines([t]).codes == whole.codes[whole.text == k]).all()
        assert len(lr.lines([t]).codes) == sum(bool(WORD.search(x)) for x in t.decode().split("\n"))
    assert whole.codes.max(initial=0) < lr._OFFSETS[-1]


def weight(labels, scores, start, pairs):
    return sum(s for y, s in zip(labels, scores) if y) + start * labels[0] + sum(pairs[a][b] for a, b in zip(labels, labels[1:]))


def test_viterbi_and_marginals_against_all_sequences():
    rng = np.random.default_rng(3)
    batch = []
    for n in (7, 5, 5, 2, 1):
        batch.append(rng.normal(0, 1.5, n))
    start, pairs = 0.3, rng.normal(0, 1, (2, 2))
    scores = [np.array([s[t] for s in batch if len(s) > t]) for t in range(7)]
    log_z, p, expected, first = lr.marginals(scores, start, pairs)
    want_z, want_p, want_pairs, want_first = 0.0, [[] for _ in range(7)], np.zeros((2, 2)), 0.0
    for s in batch:
        ways = list(itertools.product((0, 1), repeat=len(s)))
        w = np.array([weight(y, s, start, pairs) for y in ways])
        assert weight([int(x) for x in lr.viterbi(s.tolist(), start, pairs)], s, start, pairs) == pytest.approx(w.max())
        z = np.logaddexp.reduce(w)
        prob = np.exp(w - z)
        want_z += z
        for t in range(len(s)):
            want_p[t].append(sum(q for q, y in zip(prob, ways) if y[t]))
        for q, y in zip(prob, ways):
            want_first += q * y[0]
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += q
    assert log_z == pytest.approx(want_z) and first == pytest.approx(want_first) and np.allclose(expected, want_pairs)
    assert all(np.allclose(a, b) for a, b in zip(p, want_p))


def test_fitted_likelihood_is_near_its_greatest():
    """No step along any weight makes the penalised likelihood better."""
    rng = np.random.default_rng(4)
    size = int(lr._OFFSETS[-1])
    sequences = [np.stack([rng.integers(a, b, n) for a, b in zip(lr._OFFSETS, lr._OFFSETS[1:])], axis=1) for n in rng.integers(1, 9, 150)]
    truth = [(c[:, 0] > 1) ^ (rng.random(len(c)) < 0.15) for c in sequences]
    p = lr.FieldParams(steps=600, rate=0.05)
    f = lr.fit(sequences, truth, p)

    def value(theta):
        weights, start, pairs = theta[:size], theta[size], theta[size + 1 :].reshape(2, 2)
        out = -0.5 * p.l2 * float(theta @ theta)
        for c, y in zip(sequences, truth):
            s = weights[c].sum(axis=1)
            out += weight(y.astype(int), s, start, pairs) - lr.marginals([s[t : t + 1] for t in range(len(s))], start, pairs)[0]
        return out

    theta = np.concatenate([f.weights, [f.start], f.pairs.ravel()])
    best = value(theta)
    for k in range(len(theta)):
        for d in (-0.1, 0.1):
            moved = theta.copy()
            moved[k] += d
            assert value(moved) <= best + 1e-3


def test_bad_documents_may_have_good_lines():
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "over", "quiet"]) for _ in range(12)).capitalize() + "."
    bad = lambda: " | ".join("X$%" for _ in range(6))
    texts = ["\n".join(good() for _ in range(5)) for _ in range(80)] + ["\n".join([good(), good(), *(bad() for _ in range(4))]) for _ in range(30)]
    f = lr.fit_documents([lr.lines([t.encode()]).codes for t in texts], np.array([True] * 80 + [False] * 30))
    x = lr.lines([texts[-1].encode()])
    assert lr.viterbi(f.scores(x.codes).tolist(), f.start, f.pairs) == [True, True, False, False, False, False]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in lr.op11_line_rules(spark, sf).collect()}
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert set(rows) == set(texts)
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = {q: [rows[r.doc_id].kept for r in held if r.quality == q and not rows[r.doc_id].base_failed] for q in (0, 1)}
    assert len(right[1]) > 500 and np.mean(right[1]) > 0.99 and np.mean(right[0]) < 0.05
    for i in list(texts)[::50]:
        n = brute_counts(texts[i] or "")
        r = rows[i]
        assert [r[c] for c in lr.COUNTS] == n and r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a line\n" * 30, "x"), (3, "", "x"), (4, "W | " * 30_000, "x"), (5, "Some words of a plain sentence that goes on for long enough to be read as one, it seems.\nAnd on.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 0), (5, 1), (99, 1)], "doc_id long, quality int")
    got = lr.judged(docs, lr.train(docs, labels), with_content=True).collect()
    assert len(got) == len(rows) and sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3, 4, 5]
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 4, None))
    none = docs.limit(0)
    assert lr.judged(none, lr.train(none, labels.limit(0))).count() == 0
    plain = {r.doc_id: r for r in lr.judged(docs, lr.PLAIN, with_content=True).collect()}
    assert plain[5].kept and plain[5].content == rows[6][1] and plain[2].content == ""
