import random
from collections import defaultdict

import pytest
import xxhash

from lattiq.llm import common, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{id: fingerprint} to {id: smallest reachable id}."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_prints_and_components(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = simhash.op3_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("max_bucket", [2, 32])
def test_links_connect_what_is_near(spark, max_bucket):
    """Clouds of fingerprints around few centres; small buckets send most of them the other way."""
    rng = random.Random(3)
    prints = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints[len(prints)] = x
    prints = {i: p for p, i in {p: i for i, p in prints.items()}.items()}
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()]
    links = simhash.similar_pairs(spark.createDataFrame(rows, "fp long, node long"), max_bucket)
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 2 for r in links.collect())
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    assert {i: got.get(i, i) for i in prints} == brute_components(prints)


def test_keys_leave_no_pair_out():
    """Every two fingerprints within 2 bits share a key at each step, under any key they shared before."""
    levels = simhash.key_masks()
    assert [len(x) for x in levels] == [6, 36, 216, 1296]
    open_bits = [{64 - (m & (1 << 64) - 1).bit_count() for *_, m in rows} for rows in levels]
    assert [max(x) for x in open_bits] == [33, 17, 10, 6]
    rng = random.Random(5)
    for _ in range(300):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        at = {0}
        for rows in levels:
            met = {part: {p for before, p, _, m in rows if before == part and not d & m & (1 << 64) - 1} for part in at}
            assert all(met.values())
            at = set().union(*met.values())


@pytest.mark.parametrize("max_bucket", [2, 8, 32, 10_000])
def test_one_dense_cloud_has_all_its_links_at_every_size(spark, max_bucket):
    rng = random.Random(6)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 700:
        x = centre
        for b in rng.sample(range(20), rng.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()]
    got = {(r.a, r.b) for r in simhash.similar_pairs(spark.createDataFrame(rows, "fp long, node long"), max_bucket).collect()}
    assert got == {(i, j) for i in prints for j in range(i + 1, 700) if (prints[i] ^ prints[j]).bit_count() <= 2}


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "a  b"), (2, "a  b"), (None, "a b"), (None, "lost"), (5, "A B"), (6, "w " * 5000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.component_id)
    assert len(got) == 8 and by[3] == [1] and by[2] == [2, 2] and by[5] == [2] and set(by[None]) == {2, None}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
