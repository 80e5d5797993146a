import hashlib
import math

import duckdb
import numpy as np
import pytest

from lattiq.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, code, error, label_error, sha) of rows by loops over Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 16
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(r[1], k) for r in kept[:64]] for k in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, k: min((far(cut(v, k), e), i) for i, e in enumerate(books[k]))
    for _ in range(2):
        at = [[best(r[1], k)[1] for k in range(16)] for r in kept]
        for k in range(16):
            for e in range(len(books[k])):
                mine = [cut(r[1], k) for r, a in zip(kept, at) if a[k] == e]
                if mine:
                    books[k] = [*books[k][:e], [sum(c) // len(mine) for c in zip(*mine)], *books[k][e + 1 :]]
    final = [[best(r[1], k) for k in range(16)] for r in kept]
    errors = [sum(d for d, _ in f) for f in final]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[2]], sha) for r, f, e in zip(kept, final, errors))


def store(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_nearest_against_all_points():
    rng = np.random.default_rng(1)
    for width in (1, 4, 7):
        for spread in (2, 50):  # many ties, few
            points = rng.integers(-spread, spread, (64, width))
            points[40:] = points[:24]  # equal entries
            x = rng.integers(-spread - 3, spread + 3, (3000, width))
            at, d = vc.nearest(vc.kd_tree(points), points, x)
            want = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
            assert (d == want.min(axis=1)).all() and (at == want.argmin(axis=1)).all()


def test_tree_is_bounded_and_whole():
    points = np.random.default_rng(2).integers(0, 5, (64, 4))

    def leaves(n):
        return [n] if n.halves is None else leaves(n.halves[0]) + leaves(n.halves[1])

    got = leaves(vc.kd_tree(points))
    assert sorted(i for n in got for i in n.index) == list(range(64))
    assert all(len(n.index) <= vc.LEAF or (n.low == n.high).all() for n in got)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 7 % 401, [float(np.float32(v)) for v in rng.normal(0, 0.2, 32)], int(i) % 5 if i % 7 else None) for i in range(300)]
    rows = [(i, v if k % 9 else rows[0][1], label) for k, (i, v, label) in enumerate(rows)]  # a ninth are copies
    got = sorted(tuple(r) for r in vc.op13_vector_codes(spark, store(spark, tmp_path, rows)).collect())
    assert got == brute(rows)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(vc.OP13_SQL)
    assert [d[0] for d in want.description] == vc.op13_vector_codes(spark, sf).columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in vc.op13_vector_codes(spark, sf).collect())


def test_odd_rows(spark, tmp_path):
    good = [0.1 * k for k in range(16)]
    rows = [(1, good, 1), (2, None, 1), (3, [*good[:15], None], 1), (4, [*good[:15], float("nan")], 2), (5, [float("inf"), *good[1:]], 2), (6, good[:8], 1), (None, good, None), (7, [3e38, -3e38, *good[2:]], None), (1, good, 1)]
    rows = [(i, v, label, "x", 0) for i, v, label in rows]
    got = vc.op13_vector_codes(spark, store(spark, tmp_path, rows, SCHEMA + ", code string, error int")).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "7", "None"]
    same = {r.code for r in got if r.vec_id == 1}
    assert len(same) == 1 and all(r.error == 0 for r in got)
    assert vc.op13_vector_codes(spark, store(spark, tmp_path / "none", [], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vc.op13_vector_codes(spark, store(spark, tmp_path / "ten", [(1, good[:10], 1)]))


def test_decoded_vectors_are_near(spark, sf):
    kept = vc.usable(spark.read.parquet(f"{sf}/embeddings.parquet"))
    books = vc.fitted(kept)
    coded = vc.decoded(vc.encoded(kept, books), books).select("embedding", "approximate", "error").collect()
    for r in coded[:50]:
        off = 256 * (np.array(r.embedding) - np.array(r.approximate))
        assert (off**2).sum() <= (np.sqrt(r.error) + 8) ** 2  # an integer is less than one off in each of 64 components
    assert np.mean([r.error for r in coded]) < 0.5 * np.mean([(256**2) * np.square(r.embedding).sum() for r in coded])
