import hashlib
import random
import zlib

import duckdb
import pytest

from lattiq.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, levels of nodes) of a list of digests."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        levels.append(nodes)
    return nodes[0], levels


def way(levels, at):
    """(siblings before, siblings after) at each level from node ``at`` up."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(by[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *tree([leaf(r) for r in mine])))
    root, top = tree([t[1] for t in trees])
    low = str.maketrans(manifest.UPPER, manifest.LOWER)
    out = []
    for no, (mine, subroot, levels) in enumerate(trees):
        for at, r in enumerate(mine):
            path = way(levels, at) + way(top, no)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            f = leaf((*r[:4], r[4].translate(low))) if tampered else leaf(r)
            for before, after in path:
                f = h("".join([*before, f, *after]))
            out.append((str(r[0]), leaf(r), subroot, root, h("".join("".join(b + a) for b, a in path)), f, f == root))
    return sorted(out)


def got(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((str(r[0]), *r[1:]) for r in manifest.op12_manifest(spark, str(tmp_path)).collect())


def documents(n, sources, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice(["Some Text", "all lower", "", None, "É straße\n\t日本 A"]) if rng.random() < 0.5 else f"Row {i} " * rng.randrange(30)
        out.append((rng.randrange(-(10**12), 10**12), rng.choice(sources), rng.choice(["en", None]), None if text is None else len(text), text))
    return out


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (16, ["a"]), (17, ["a"]), (300, [None, "", "a", "é", "Z", "z"]), (700, [f"s{i}" for i in range(40)])])
def test_against_brute_force(spark, tmp_path, n, sources):
    rows = documents(n, sources)
    assert got(spark, tmp_path, rows) == brute(rows)


def test_small_buckets_have_the_same_tree(spark, tmp_path):
    rows = documents(1200, ["hot"] * 30 + ["x", "y", None])
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(str(r[0]), r[4]) for r in brute(rows)}
    for inner in (1, 2, 3):
        m = manifest.build(manifest.leaves(docs), inner)
        assert {(str(r.doc_id), r.proof_sha256) for r in manifest.proofs(m).collect()} == want
        assert m.sources.count() == 4 and m.root == brute(rows)[0][3]


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "abd"), (None, "a", None, None, None), (None, None, "en", 1, "B"), (2, None, None, 0, ""), (3, "a", "en", None, "W " * 100_000)]
    assert got(spark, tmp_path, rows) == brute(rows)
    clash = [(*r, "x", 5) for r in rows]
    assert got(spark, tmp_path, clash, SCHEMA + ", leaf string, pos int") == brute(rows)
    assert got(spark, tmp_path, []) == []


def test_equal_rows_part(spark):
    """A table of one row, many times over, has places of its own for each, and so has its neighbour."""
    rows = [(7, "a", "en", 1, "x")] * 5000 + [(8, "b", "en", 1, "y")]
    m = manifest.build(manifest.leaves(spark.createDataFrame(rows, SCHEMA)))
    assert m.placed.where("src = 0").select("pos").distinct().count() == 5000
    proofs = manifest.proofs(m, with_proof=True).collect()
    assert all(h(r.proof) == r.proof_sha256 and r.folded_root == m.root for r in proofs)
    assert m.root == brute(rows)[0][3]


def test_tampering_shows(spark, sf):
    rows = manifest.op12_manifest(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any(c in manifest.UPPER for c in texts[r.doc_id] or "")
        assert r.verified == (not hit)
    assert {r.verified for r in rows} == {True, False}


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(manifest.OP12_SQL)
    have = manifest.op12_manifest(spark, sf)
    assert [d[0] for d in want.description] == have.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in have.collect())
