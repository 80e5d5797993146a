"""The pipeline against the same steps on plain Python objects."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_jaccard import brute_kept
from test_sharding_mixing import brute_mix

import corpus_pipeline
from lattiq.llm import decontamination, hashing, quality


def five_words(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    w, b = quality.fit_ftrl([docs[i].text.encode() for i in train], np.array([float(labels[i]) for i in train]))
    good = [i for i, r in docs.items() if quality.decision([(r.text or "").encode()], w, b, quality.FtrlParams())[0] >= 0]
    single = brute_kept({i: docs[i].text for i in good})
    wanted = [five_words(t) for t in items]
    clean = [i for i in sorted(single) if not any(len(x & five_words(docs[i].text)) >= 0.8 * len(x) for x in wanted)]
    target, taken, total = brute_mix([(i, docs[i].text, docs[i].source) for i in clean])

    rows = corpus_pipeline.run(spark, sf).toPandas()
    size = {i: len((docs[i].text or "").encode().split()) for i in clean}
    times = Counter(rows.doc_id)
    assert set(times) <= set(clean)
    assert {i: times[i] * size[i] for i in clean if size[i]} == {i: taken[i] for i in clean if size[i]}
    assert set(rows.columns) == {*docs[0].asDict(), "size", "shard", "slot"}
    assert (rows.text == [docs[i].text for i in rows.doc_id]).all()
    by = rows.groupby("shard")["size"].sum()
    assert (by - rows["size"].sum() / 24).abs().max() <= rows["size"].max()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_stages_on_odd_rows(spark, sf):
    """Null ids, texts and sources, repeated rows and extra columns pass through all stages."""
    rows = [(1, None, "en", "x", 0, "k"), (2, "", None, None, 0, "k"), (None, "some words here", "en", "x", 3, "k"), (3, "some words here", "en", "x", 3, "k"), (3, "some words here", "en", "x", 3, "k"), (4, "w " * 2000, "en", "y", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf)
            assert set(docs.columns) <= set(out.columns)
            out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_texts_pass_python_in_small_batches(spark, monkeypatch):
    """A batch of Spark's ten thousand rows is neither made Python objects nor sent back as a whole."""
    texts = [None, "", *(f"word{i} and more words of row {i}" for i in range(3000)), "x " * 400_000, "end"]
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(["en"] * len(texts))], names=docs.columns)
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: found.append((f, self.columns)) or self)
    quality.score(docs, (np.ones(1 << 18, np.float32), 0.5, quality.FtrlParams()))
    decontamination.contaminated(docs, [(7, "word5 and more words of row 5 and nothing else that any row of them holds")])
    assert len(found) == 2
    for run, columns in found:
        extra = {"item_ids": pa.array([[]] * len(texts), pa.list_(pa.int64())), "best_score": pa.nulls(len(texts), pa.float64())}
        b = pa.RecordBatch.from_arrays([*given.columns, *(extra[c] for c in columns if c in extra)], names=[*given.schema.names, *(c for c in columns if c in extra)])
        got = list(run(iter([b])))
        assert max(x.num_rows for x in got) <= hashing.SLICE
        whole = pa.Table.from_batches(got)
        assert whole.select(given.schema.names).combine_chunks().equals(pa.Table.from_batches([given]))
        if "score" in whole.column_names:
            want = quality.decision([(t or "").encode() for t in texts], np.ones(1 << 18, np.float32), 0.5, quality.FtrlParams())
            assert np.allclose(whole["score"].to_numpy(), 1 / (1 + np.exp(-want)))
