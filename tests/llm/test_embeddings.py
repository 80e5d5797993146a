import math

import numpy as np

from lattiq.llm import embeddings


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= threshold) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link)):
            low = min(root[ids[a]], root[ids[b]])
            for k in (ids[a], ids[b]):
                if root[k] != low:
                    root[k], changed = low, True
    return {i: int(n) for i, n in zip(ids, link.sum(1))}, root


def test_embeddings_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, root = brute(rows)
    got = embeddings.op4_embeddings(spark, sf).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= links[r.vec_id] for r in got) and found >= 0.98 * sum(links.values())
    assert sum(r.component_id == root[r.vec_id] for r in got) >= 0.99 * len(rows)


def test_one_large_group_and_chains(spark):
    """A dense group over several blocks, and a chain along a circle in which only neighbours link."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.05 * rng.normal(size=16)).tolist(), 1) for i in range(300)]
    step = math.acos(0.95)
    rows += [(1000 + k, [math.cos(k * step), math.sin(k * step)] + [0.0] * 14, 2) for k in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, root = brute(rows)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, p=embeddings.PStable(block=64, tables=30)).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == root


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, 5), (3, [1.0, 0.0], None, 5), (4, [1.0, 0.0], 2, 5), (5, None, 1, 5), (6, [0.0, 0.0], 1, 5), (7, [1.0, None], 1, 5), (8, [float("nan"), 1.0], 1, 5), (9, [1.0, 0.0, 0.0], 1, 5), (None, [1.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, 5), (10, [], 1, 5), (11, [1e-200, 0.0], 1, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}, None: (0, None, True)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_equal_vectors_are_one_class(spark):
    """A third of all rows is one vector; others are near it, near each other, or far; groups of every size and side."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)).astype(np.float32)
    rows = [(3 * i, centres[0].tolist(), i % 2) for i in range(200)]
    rows += [(10_000 + i, (centres[i % 6] + 0.06 * rng.normal(size=16)).astype(np.float32).tolist(), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links, root = brute(spark.createDataFrame(df.collect(), df.schema).collect())
    for block in (1024, 20):
        got = {r.vec_id: r for r in embeddings.near_vectors(df, p=embeddings.PStable(block=block, tables=40)).collect()}
        assert {i: r.n_links for i, r in got.items()} == links and {i: r.component_id for i, r in got.items()} == root


def test_pairs_of_groups():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(400, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    group = np.sort(rng.integers(0, 12, 400))
    group[150:300] = group[150]  # one long group
    group.sort()
    side = np.where(group % 2 == 0, 0, rng.integers(1, 3, 400))
    i, j = embeddings._pairs(group, side, unit, 0.8)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if group[a] == group[b] and (side[a] == 0 or side[a] != side[b]) and unit[a] @ unit[b] >= 0.8}
    got = [tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())]
    assert set(got) == want and len(got) == len(want)
