import hashlib
import zlib

import pytest

from lattiq.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string"


def odd_docs(spark):
    rows = [(1, "a b", "x", "e"), (2, None, None, None), (3, "", "x", ""), (4, "same text", "y", "q"), (5, "same text", "y", "q"), (6, "w " * 3000, "z", "q"), (None, "lost id", "x", "q"), (7, "a b", "x", "e"), (7, "a b", "x", "e")]
    return spark.createDataFrame(rows, SCHEMA)


def test_shards_of_documents(spark, sf):
    rows = sharding.op2_sharding(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(rows.doc_id) == sorted(docs.index)
    text = docs.text.reindex(rows.doc_id).fillna("")
    assert list(rows["size"]) == [len(t.encode()) + 8 for t in text]
    assert list(rows.text_crc32) == [zlib.crc32(t.encode()) for t in text]
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = rows.groupby("shard")["size"].sum()
    assert (by - rows["size"].sum() / 24).abs().max() <= rows["size"].max()


def test_shards_follow_one_order(spark, sf):
    """Brute force: in the order (shard, slot) a text's middle byte tells its shard."""
    rows = sharding.op2_sharding(spark, sf).toPandas().sort_values(["shard", "slot"])
    total, at = int(rows["size"].sum()), 0
    for size, shard in zip(rows["size"], rows["shard"]):
        assert shard == (2 * at + size) * 24 // (2 * total)
        at += size


def test_odd_rows(spark):
    out = sharding.assign_shards(odd_docs(spark), 3)
    assert out.columns == ["doc_id", "text", "source", "size", "shard", "slot"]
    rows = out.toPandas()
    assert len(rows) == 9 and rows["size"].min() == 8 and set(rows["shard"]) <= {0, 1, 2}
    assert sharding.assign_shards(odd_docs(spark).limit(0), 3).count() == 0
    mixed = mixing.mix(odd_docs(spark)).toPandas()
    assert len(mixed) == 9 and (mixed.taken <= 2 * mixed["size"]).all()
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0
    assert mixing.mixed(odd_docs(spark)).columns == ["doc_id", "text", "source", "size"]


def brute_mix(docs, weights=(5, 2, 1)):
    size = {d: len((t or "").encode().split()) for d, t, _ in docs}
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    queue = []
    for s in names:
        cum = 0
        for d in sorted((d for d, _, x in docs if x == s), key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            cum += size[d]
            queue += [((cum + p * total[s]) / weight[s], p, d) for p in (0, 1)]
    taken, used, budget = dict.fromkeys(size, 0), 0, 1.5 * sum(total.values())
    for _, _, d in sorted(queue):
        used += size[d]
        if used > budget:
            break
        taken[d] += size[d]
    return target, taken, total


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mix_against_brute_force(spark, scale):
    sf = f"/root/testdata/{scale}"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = mixing.op10_mixing(spark, sf).toPandas()
    target, taken, total = brute_mix(docs)
    source = {d: s for d, _, s in docs}
    assert len(rows) == len(docs)
    for d, size, got, t, n in rows[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False):
        assert n == taken[d] and got == total[source[d]] and abs(t - target[source[d]]) < 1e-6 * max(1, t)
