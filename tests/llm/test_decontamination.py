import random
import unicodedata

import numpy as np

from lattiq.llm import decontamination as d
from lattiq.llm.hashing import Words, non_alnum_bytes


def items_and_docs(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "a"] * 40
    item = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))
    items = [(10 * k, item()) for k in range(60)]
    docs = []
    for k in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 400))]
        if k % 4 == 0:
            at, w = rng.randint(0, len(words)), items[rng.randrange(60)][1].upper().split()
            words = words[:at] + w[: len(w) if k % 8 else len(w) // 2] + words[at:]
        docs.append(" ".join(words))
    return items, docs


def test_wand_finds_all_above_threshold():
    items, docs = items_and_docs()
    x = d.build_index(items)
    for text in docs:
        h = np.unique(Words([text.encode()], non_alnum_bytes()).hash)
        terms = np.flatnonzero(np.isin(x.terms, h))
        full = np.zeros(len(x.ids))
        for t in terms:
            full[x.items[x.at[t] : x.at[t + 1]]] += x.impacts[x.at[t] : x.at[t + 1]]
        for theta in (0.1, 0.3, 0.7):
            want = {i: s for i, s in enumerate(full) if s >= theta - 1e-9}
            got = dict(d.block_max_wand(x, terms, theta))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_whole_items_are_found_and_halves_are_not():
    items, docs = items_and_docs(2)
    x = d.build_index(items)
    found = d.search(x, [t.encode() for t in docs])
    for text, got in zip(docs, found):
        want = {k for k, (_, t) in enumerate(items) if f" {t} " in f" {text.lower()} "}
        assert want == {k for k in got}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "one two three four five six seven", "x"), (None, "ONE, two; three four five six seven!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string")
    items = [(5, "one two three four five six seven"), (6, "one two three four five six seven"), (7, ""), (8, "  ")]
    got = d.contaminated(docs, items)
    assert got.columns == ["doc_id", "text", "item_ids", "best_score"]
    assert [r.item_ids for r in got.collect()] == [[], [], [5, 6], [5, 6]]
    assert [r.item_ids for r in d.contaminated(docs, []).collect()] == [[]] * 4
    assert d.contaminated(docs.limit(0), items).count() == 0
    clean = d.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == 2


def test_capitals_of_other_letters():
    """Items stand in capitals, decomposed or with a sharp s spelt out; only A to Z have capitals in bytes."""
    text = "el niño corrió según él más allá del jardín größer während die straße überall müde"
    x = d.build_index([(1, text)])
    for other in (text.upper(), unicodedata.normalize("NFD", text), unicodedata.normalize("NFD", text.upper()), text.title()):
        assert d.search(x, [f"Antes {other} después".encode()])[0].keys() == {0}


def test_one_word_edits():
    """An item with one word changed is found wherever 0.8 of its shingles remain, and without its answer it is not."""
    rng = random.Random(6)
    items = [(n, " ".join(f"v{rng.randrange(5000)}" for _ in range(n))) for n in range(15, 61)]
    x = d.build_index(items)
    pad = ["zz", "yy", "xx"] * 10
    for k, (_, text) in enumerate(items):
        w = text.split()
        whole = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for at in range(len(w)):
            e = [*w[:at], "changed", *w[at + 1 :]]
            left = len(whole & {tuple(e[i : i + 5]) for i in range(len(e) - 4)}) / len(whole)
            got = k in d.search(x, [" ".join(pad + e + pad).encode()])[0]
            assert got or left < 0.8, (len(w), at, left)
        assert k not in d.search(x, [" ".join(pad + w[: int(0.7 * len(w))] + pad).encode()])[0]
        parted = [*w[: round(0.7 * len(w))], "answer", *w[round(0.7 * len(w)) :]]
        assert k in d.search(x, [" ".join(pad + parted + pad).encode()])[0]
