import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lattiq.llm import jaccard
from lattiq.llm.hashing import mix


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts):
    """Ids, each the smallest of its component of texts with similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in ids if root(i) == i}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.random()}"
    return words


def texts(seed=5):
    """Groups of edited copies around the threshold, chains of them, and texts that share a passage only."""
    rng = random.Random(seed)
    out = {}
    passage = [f"p{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for k in range(12):
            out[len(out)] = " ".join(edited(rng, base, k % 6))
            base = edited(rng, base, 1)
        out[len(out)] = " ".join(f"w{rng.randrange(3000)}" for _ in range(60)) + " " + " ".join(passage)
    return out


def test_stage_drops_edited_copies(spark, sf):
    """An edit of one word in a hundred leaves 0.9 of the shingles; op3's two bits leave most of such copies in."""
    rng = random.Random(1)
    words = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(10)]
    rows = [(10 * k + j, " ".join(edited(rng, w, j)), "en", "x", 0) for k, w in enumerate(words) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [10 * k for k in range(10)]


def test_components_against_brute_force(spark, sf):
    own = texts()
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for t in (own, table):
        kept = jaccard.without_near_duplicates(spark.createDataFrame(list(t.items()), "doc_id long, text string"))
        assert {r.doc_id for r in kept.collect()} == brute_kept(t)


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "a  b"), (2, "a  b"), (None, "a b"), (None, "lost"), (5, "A B"), (6, "w " * 5000), (7, "c"), (7, "d")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a b"), (0, "lost"), (1, ""), (2, "a  b"), (6, "w " * 5000), (7, "c"), (7, "d")]
    assert jaccard.without_near_duplicates(docs.limit(0)).count() == 0


def test_leftovers_in_blocks(spark, monkeypatch):
    """A large group of loose copies: most are tied by one member, some only by others, some by none; blocks hold few of them."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    table = {k: " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]))) for k in range(150)}
    for block in (1 << 20, 900):
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
        kept = jaccard.without_near_duplicates(spark.createDataFrame(list(table.items()), "doc_id long, text string"))
        assert {r.doc_id for r in kept.collect()} == brute_kept(table)


def test_overlapping_clusters_are_compared_once(spark, monkeypatch):
    """Segments find a loose group in part, each another part; its sets are sent once, however the family is cut."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    table = {k: " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]))) for k in range(150)}
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    leftovers, sent = jaccard._leftovers, []
    monkeypatch.setattr(jaccard, "_leftovers", lambda named, *a: sent.append(named.count()) or leftovers(named, *a))
    for most_shingles, most_texts in ((1 << 20, 1024), (900, 1024), (1 << 20, 7)):
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", most_shingles)
        monkeypatch.setattr(jaccard, "BLOCK_TEXTS", most_texts)
        assert {r.doc_id for r in jaccard.without_near_duplicates(docs).collect()} == brute_kept(table)
    assert max(sent) <= 150


def test_families_of_short_texts_at_every_size(spark, monkeypatch):
    """Groups of eight words and variants with a ninth: the same rows stay, however a family is cut."""
    rng = random.Random(12)
    rows, groups = {}, 60
    for g in range(groups):
        words = [f"w{rng.randrange(100_000)}" for _ in range(8)]
        for v in range(11):
            rows[g * 100 + v] = " ".join(words if v == 0 else [*words, f"x{rng.randrange(100_000)}"])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = []
    for most_shingles, most_texts in ((1 << 20, 1024), (1 << 20, 4), (1, 1024)):
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", most_shingles)
        monkeypatch.setattr(jaccard, "BLOCK_TEXTS", most_texts)
        kept.append(sorted(r.doc_id for r in jaccard.without_near_duplicates(docs).collect()))
    assert kept[0] == kept[1] == kept[2] == [g * 100 for g in range(groups)]


def test_a_large_group_takes_a_row_a_text(spark, monkeypatch):
    """Many segments find a member of a loose group again, but no table and no comparison has a row for each of them."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    table = {k: " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]))) for k in range(300)}
    rows, written, similar = {}, jaccard.common.written, jaccard._similar

    def counted(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.common, "written", counted)
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *a: rows.update(pairs=pairs.count()) or similar(pairs, *a))
    kept = jaccard.without_near_duplicates(spark.createDataFrame(list(table.items()), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == brute_kept(table)
    assert rows["pairs"] and max(rows.values()) <= 5 * len(table), rows


def test_links_between_that_only_span():
    """Links that join components as all links do, though a set that has come to the largest one is not compared again."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 40, 100)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.12], rng.integers(0, 1 << 40, 4)])) for _ in range(80)]
    component = np.minimum(np.arange(80), 60)
    whole, some = jaccard.links_between(sets, component, 0.8), jaccard.links_between(sets, component, 0.8, spanning=True)
    joined = [jaccard._labels(80, *(np.array(x) for x in zip(*links, *((60, k) for k in range(61, 80))))) for links in (whole, some)]
    assert len(some) < len(whole) and (joined[0] == joined[1]).all() and 1 < len(np.unique(joined[0])) < 60


def test_links_between():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 100)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.12], rng.integers(0, 1 << 40, 4)])) for _ in range(60)]
    component = np.arange(60) // 7
    got = jaccard.links_between(sets, component, 0.8)
    want = {tuple(sorted((component[i], component[j]))) for i in range(60) for j in range(i) if component[i] != component[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert got and {tuple(sorted((component[i], component[j]))) for i, j in got} == want


def test_stage_finds_pairs_by_fingerprints(spark, sf, monkeypatch):
    """Without fingerprints that lie near, only texts with equal sets are one."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(words)), (1, "  ".join(words)), (2, " ".join(edited(rng, words, 1)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()] == [0]
    monkeypatch.setattr(jaccard, "MAX_DIFFERING", -1)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [0, 2]


def test_simhashes_against_plain_counts():
    s, at = jaccard.distinct_sets([b"a b c d e f g a b c d e f g", b"", b"x", b"p q r s t u"])
    got = jaccard.simhashes(s, at)
    for k, turn in enumerate(jaccard._TURNS):
        for i in range(4):
            h = [int(x) for x in mix(s[at[i] : at[i + 1]] ^ turn)]
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    keys = jaccard.segments(got)
    assert keys[0, 7] == (7 << 16) + (int(got[0, 1]) >> 48) and keys.shape == (4, 4 * jaccard.FINGERPRINTS)


@pytest.mark.parametrize("shared, own", [(80, 10), (800, 100), (24, 3)])
def test_recall_at_the_threshold(shared, own):
    """Pairs of similarity 0.8 share a segment and lie near; others do not lie near."""
    rng, n = np.random.default_rng(shared), 300
    made = rng.integers(0, 1 << 63, (n, shared + 2 * own)).astype(np.uint64)
    sets = [x for row in made for x in (row[: shared + own], np.concatenate([row[:shared], row[shared + own :]]))]
    prints = jaccard.simhashes(np.concatenate(sets), np.arange(2 * n + 1) * (shared + own))
    keys, checked = jaccard.segments(prints), prints[:, jaccard.FINGERPRINTS :]
    near = lambda x, y: np.bitwise_count(x ^ y).sum(axis=1) <= jaccard.MAX_DIFFERING
    found = (keys[::2] == keys[1::2]).any(axis=1) & near(checked[::2], checked[1::2])
    assert found.mean() >= 0.99
    assert not near(checked[:-2:2], checked[3::2]).any()


@pytest.mark.parametrize("max_bucket", [2, 512])
def test_clusters_in_batches(monkeypatch, max_bucket):
    """Chains of near fingerprints in buckets of one to sixty, cut into batches anywhere."""
    monkeypatch.setattr(jaccard, "MAX_BUCKET", max_bucket)
    rng, rows = random.Random(4), []
    for key in range(30):
        x = [rng.getrandbits(64), rng.getrandbits(64)]
        for _ in range(rng.choice([1, 2, 7, 60])):
            if rng.random() < 0.3:
                x = [rng.getrandbits(64), rng.getrandbits(64)]
            for b in rng.sample(range(128), 30):
                x[b // 64] ^= 1 << b % 64
            rows.append((key, *x, len(rows) * 7919 % 4001))
    want = set()
    for key in range(30):
        rest = [r for r in rows if r[0] == key]
        while rest:
            group, front = [rest[0]], [rest.pop(0)]
            while front:
                a = front.pop()
                near = [r for r in rest if (r[1] ^ a[1]).bit_count() + (r[2] ^ a[2]).bit_count() <= jaccard.MAX_DIFFERING]
                rest = [r for r in rest if r not in near]
                group += near
                front += near
            if len(group) > 1:
                want.add(frozenset(r[3] for r in group))
    for size in (1, 13, 5000):
        table = [pa.array(np.array(c, dtype=t).view(np.int64 if t != np.int32 else np.int32)) for c, t in zip(zip(*rows), (np.int32, np.uint64, np.uint64, np.int64))]
        whole = pa.RecordBatch.from_arrays(table, names=["key", "__f0", "__f1", "__set"])
        got = {}
        for b in jaccard.clusters(iter([whole.slice(k, size) for k in range(0, len(rows), size)])):
            for least, x in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(least, set()).add(x)
        assert {frozenset(g) for g in got.values()} == want and all(least == min(g) for least, g in got.items())


def test_pairs_are_found_by_chains(spark, sf, monkeypatch):
    """An equal segment only begins a chain: without bits that may differ after it, edited copies are not found."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = spark.createDataFrame([(0, " ".join(words)), (2, " ".join(edited(rng, words, 2)))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()] == [0]
    monkeypatch.setattr(jaccard, "BUDGET", -1)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [0, 2]


def test_chains_and_their_budget(spark):
    prints = np.random.default_rng(6).integers(0, 1 << 64, (3, jaccard.FINGERPRINTS), dtype=np.uint64)
    df = spark.createDataFrame([(i, row.view(np.int64).tolist()) for i, row in enumerate(prints)] + [(3, [])], "i int, __prints array<long>")
    got = {r.i: r.c for r in df.select("i", jaccard.chains().alias("c")).collect()}
    assert got[3] == []
    for i, keys in enumerate(jaccard.segments(prints)):
        assert [c.key for c in got[i]] == keys.tolist()
        for p, c in enumerate(got[i]):
            f, k = int(prints[i, p // 4]), p % 4 * 16
            assert c.ring % (1 << 64) == (f >> k | f << 64 - k) % (1 << 64)
    low = lambda *bits: np.array([sum(((1 << n) - 1) << 16 * k for k, n in enumerate(bits))], dtype=np.uint64)
    zero = np.zeros(1, dtype=np.uint64)
    for bits, want in (((0, 10, 5, 5), True), ((0, 11, 0, 0), False), ((0, 10, 6, 0), False), ((0, 10, 5, 6), False), ((0, 0, 0, 16), True), ((6, 0, 0, 0), False)):
        assert jaccard.viable(low(*bits), zero)[0] == want
    # chains of texts at the threshold that begin with an equal segment are nearly all viable, those of others are not
    rng = np.random.default_rng(7)
    made = rng.integers(0, 1 << 63, (400, 100)).astype(np.uint64)
    sets = [x for row in made for x in (row[:90], np.concatenate([row[:80], row[90:]]))]
    f = jaccard.simhashes(np.concatenate(sets), np.arange(801) * 90)[:, : jaccard.FINGERPRINTS]
    keys = jaccard.segments(f)
    turned = np.stack([f if k == 0 else f >> np.uint64(k) | f << np.uint64(64 - k) for k in (0, 16, 32, 48)], axis=2).reshape(len(f), -1)
    same = keys[::2] == keys[1::2]
    assert same.sum() > 1000 and jaccard.viable(turned[::2], turned[1::2])[same].mean() > 0.999
    other = turned[1::2] ^ (turned[1::2] ^ np.roll(turned[::2], 1, axis=0)) % np.uint64(1 << 16)  # made to begin alike
    assert jaccard.viable(np.roll(turned[::2], 1, axis=0), other).mean() < 0.2
