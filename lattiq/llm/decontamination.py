"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND with every passage.

A text's passages are windows of twice the longest item's words, one item's length apart, so an item's words lie whole in
some passage. Impacts are BM25 parts over the item's own total, so a score is the share of an item's weight that the
passage covers, and one threshold holds for all items. Retrieved items are verified: enough of the five-word shingles
of the whole item must be in the passage, with half of the words of its first part (the question) and of its last (the
answer); or enough of the shingles of either part, which holds where other words stand between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import table
from lattiq.llm.hashing import Words, column_chunks, folded, non_alnum_bytes, pair

#: Items in one index, which goes to every executor; more items are searched index by index, by the statistics of all.
MAX_ITEMS = 50_000
#: Bytes of a benchmark's texts, which the driver holds; a longer benchmark is an error, not cut.
MAX_BYTES = 256 << 20


@dataclass(frozen=True)
class Params:
    threshold: float = 0.7
    common: float = 0.05
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    shingle: int = 5
    least_overlap: float = 0.8
    least_words: float = 0.5
    answer_share: float = 0.3


@dataclass
class Index:
    ids: list[int]
    terms: np.ndarray  # sorted hashes
    at: np.ndarray  # term k's postings are at[k] to at[k + 1]
    items: np.ndarray  # by term, ascending
    impacts: np.ndarray
    best: np.ndarray  # largest impact of each term
    many: np.ndarray  # whether a term is in many items
    block_at: np.ndarray  # term k's blocks are block_at[k] to block_at[k + 1]
    block_of: np.ndarray  # the range of items that a block covers
    block_best: np.ndarray  # the term's largest impact there
    block_common: np.ndarray  # by range: what terms of many items give to one of its items at most
    question: list[tuple[np.ndarray, int]]  # distinct shingles, and the words of one
    answer: list[tuple[np.ndarray, int]]
    whole: list[tuple[np.ndarray, int]]
    words: list[tuple[np.ndarray, np.ndarray]]  # distinct words of question and answer
    longest: int
    params: Params = field(default_factory=Params)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; a shorter sequence is one run."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = pair(out, h[k : len(h) - n + 1 + k])
    return out


@dataclass
class Statistics:
    """What a score takes from all items, whatever part of them an index holds."""

    n: int
    terms: np.ndarray
    df: np.ndarray
    mean: float
    longest: int


def item_words(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """(id, hashes of the words in order) of the items that have words."""
    words = [(i, Words([folded((t or "").encode("utf-8", "surrogatepass"))], non_alnum_bytes()).hash) for i, t in items]
    return [(i, h) for i, h in words if len(h)]


def statistics(words: list[tuple[int, np.ndarray]]) -> Statistics:
    terms, df = np.unique(np.concatenate([np.unique(h) for _, h in words]) if words else np.zeros(0, np.uint64), return_counts=True)
    lengths = [len(h) for _, h in words]
    return Statistics(len(words), terms, df, float(np.mean(lengths)) if words else 1.0, max(lengths, default=1))


def build_index(items: list[tuple[int, str]], p: Params = Params()) -> Index:
    """Items without words can't be found and are left out; items with equal texts are all found."""
    words = item_words(items)
    return index_of(words, statistics(words), p)


def index_of(words: list[tuple[int, np.ndarray]], of_all: Statistics, p: Params = Params()) -> Index:
    """The index of some of the items, with the weights that they have among all."""
    ids = [i for i, _ in words]
    uniq = [np.unique(h, return_counts=True) for _, h in words]
    terms = np.unique(np.concatenate([u for u, _ in uniq])) if uniq else np.zeros(0, np.uint64)
    df = of_all.df[np.searchsorted(of_all.terms, terms)]
    n, lengths = len(ids), np.array([len(h) for _, h in words], dtype=float)
    idf = np.log1p((of_all.n - df + 0.5) / (df + 0.5))
    mean = of_all.mean
    t, it, im = [], [], []
    for k, (u, c) in enumerate(uniq):
        pos = np.searchsorted(terms, u)
        w = idf[pos] * c * (p.k1 + 1) / (c + p.k1 * (1 - p.b + p.b * lengths[k] / mean))
        t.append(pos)
        it.append(np.full(len(pos), k))
        im.append(w / w.sum())
    t, it, im = (np.concatenate(x) if x else np.zeros(0) for x in (t, it, im))
    order = np.lexsort((it, t))
    t, it, im = t[order], it[order].astype(np.int64), im[order]
    at = np.searchsorted(t, np.arange(len(terms) + 1))
    best = np.maximum.reduceat(im, at[:-1]) if len(terms) else im
    # terms of many items bound a passage little one by one, but no item gets more from them than its own share of them
    many = df > max(1.0, p.common * of_all.n)
    # blocks are ranges of items; a term's blocks are those in which it occurs
    key = t.astype(np.int64) * (n // p.block + 1) + it // p.block
    heads = np.flatnonzero(np.diff(key, prepend=-1)) if n else np.zeros(0, np.int64)
    block_best = np.maximum.reduceat(im, heads) if n else im
    block_of = (it[heads] // p.block).astype(np.int64)
    block_at = np.searchsorted(t[heads], np.arange(len(terms) + 1))
    share = np.bincount(it, weights=np.where(many[t.astype(np.int64)], im, 0.0), minlength=n)
    block_common = np.array([share[k : k + p.block].max() for k in range(0, n, p.block)])
    cut = [max(1, int(round(len(h) * (1 - p.answer_share)))) for _, h in words]
    halves = [(h[:c], h[c:] if c < len(h) else h) for (_, h), c in zip(words, cut)]
    question, answer = ([(np.unique(shingles(x[k], p.shingle)), min(p.shingle, len(x[k]))) for x in halves] for k in (0, 1))
    whole = [(np.unique(shingles(h, p.shingle)), min(p.shingle, len(h))) for _, h in words]
    distinct = [(np.unique(a), np.unique(b)) for a, b in halves]
    return Index(ids, terms, at, it, im, best, many, block_at, block_of, block_best, block_common, question, answer, whole, distinct, of_all.longest, p)


def block_max_wand(x: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (item, score) of a query of distinct term numbers with a score of the threshold or more, by item."""
    end = len(x.ids)
    cursors = [[int(x.items[x.at[t]]), int(x.at[t]), int(t), int(x.block_at[t])] for t in terms]  # item, posting, term, block
    out, eps, size = [], 1e-9, x.params.block

    def advance(c: list, to: int) -> None:
        t = c[2]
        s = c[1] + int(np.searchsorted(x.items[c[1] : x.at[t + 1]], to))
        c[1], c[0] = s, int(x.items[s]) if s < x.at[t + 1] else end

    while True:
        cursors.sort()
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            if c[0] >= end:
                break
            total += x.best[c[2]]
            if total >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            return out
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, next_item = 0.0, end
        for c in cursors[: pivot + 1]:
            b, stop = c[3], int(x.block_at[c[2] + 1])
            while b < stop and x.block_of[b] < item // size:
                b += 1
            c[3] = b
            if b < stop:
                if x.block_of[b] == item // size:
                    bound += x.block_best[b]
                    next_item = min(next_item, (int(x.block_of[b]) + 1) * size)
                else:
                    next_item = min(next_item, int(x.block_of[b]) * size)
        if bound >= threshold - eps:
            if cursors[0][0] == item:
                score = sum(float(x.impacts[c[1]]) for c in cursors[: pivot + 1])
                if score >= threshold - eps:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    advance(c, to)
        else:
            # no item before the end of these blocks, or before the next list's item, can reach the threshold
            to = max(min(next_item, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end), item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    advance(c, to)


#: Cells up to which a table is kept whole rather than sorted.
_DENSE = 1 << 24


def _distinct(x: np.ndarray, below: int) -> np.ndarray:
    if below > _DENSE:
        return np.unique(x)
    seen = np.zeros(below, dtype=bool)
    seen[x] = True
    return np.flatnonzero(seen)


def _verified(x: Index, item: int, h: np.ndarray) -> bool:
    """Whether a passage's words hold enough of an item."""
    p = x.params
    whole, question, answer = (np.isin(part, shingles(h, n)).mean() for part, n in (x.whole[item], x.question[item], x.answer[item]))
    if whole >= p.least_overlap and min(np.isin(part, h).mean() for part in x.words[item]) >= p.least_words:
        return True
    return min(question, answer) >= p.least_overlap


def search(x: Index, texts: list[bytes]) -> list[dict[int, float]]:
    """For each text its verified items and their best scores."""
    found: list[dict[int, float]] = [{} for _ in texts]
    if not x.ids:
        return found
    w = Words([folded(t) for t in texts], non_alnum_bytes())
    pos = np.minimum(np.searchsorted(x.terms, w.hash), len(x.terms) - 1)
    known = x.terms[pos] == w.hash
    size, step = 2 * x.longest, x.longest
    counts = w.counts()
    first = np.concatenate([[0], np.cumsum(counts)])
    n_win = np.where(counts > 0, np.maximum(1, -(-(counts - size) // step) + 1), 0)
    text = np.repeat(np.arange(len(texts)), n_win)
    start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)) * step
    stop = np.minimum(start + size, first[text + 1])
    p = x.params
    least = p.threshold - 1e-9
    # the blocks' largest impacts bound every passage in every range of items at once: a passage's uncommon words by
    # their blocks, common ones by what they can give to an item of the range
    word = np.flatnonzero(known)
    word = word[~x.many[pos[word]]]
    n_terms, n_ranges = len(x.terms), len(x.block_common)
    last = np.searchsorted(start, word, side="right") - 1
    held = []
    for back in (0, 1):  # a word is in the passage that began last before it, and may be in the one before
        no = last - back
        ok = (no >= 0) & (word < stop[no])
        held.append(no[ok] * n_terms + pos[word[ok]])
    held = _distinct(np.concatenate(held), len(text) * n_terms)
    no, term = held // n_terms, held % n_terms
    n_blocks = x.block_at[term + 1] - x.block_at[term]
    which = np.repeat(x.block_at[term], n_blocks) + (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
    cells, gains = np.repeat(no, n_blocks) * n_ranges + x.block_of[which], x.block_best[which]
    bound = np.bincount(cells, weights=gains) if len(text) * n_ranges <= _DENSE else None
    if bound is None:
        cells, inverse = np.unique(cells, return_inverse=True)
        bound = np.bincount(inverse, weights=gains)
    else:
        cells = np.flatnonzero(bound)
        bound = bound[cells]
    bound = bound + x.block_common[cells % n_ranges]
    alive = np.full(len(text), x.block_common.max() >= least)
    alive[cells[bound >= least] // n_ranges] = True
    for k in np.flatnonzero(alive):
        s, e, t = start[k], stop[k], text[k]
        terms = np.unique(pos[s:e][known[s:e]])
        for item, score in block_max_wand(x, terms, p.threshold):
            if _verified(x, item, w.hash[s:e]):
                found[t][item] = max(score, found[t].get(item, 0.0))
    return found


def contaminated(docs: DataFrame, items: list[tuple[int, str]], p: Params = Params(), text: str = "text") -> DataFrame:
    """Adds ``item_ids`` (array of bigint, ascending) and ``best_score`` (double; null without items) to every row.

    Texts are searched whole. Null and empty texts, and an empty list of items, give no items. The index goes to the
    executors and holds ``MAX_ITEMS`` items at most; longer lists are searched part by part, and the parts' findings
    are joined row by row within one pass. Columns that are named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("item_ids", "best_score")]
    words = item_words(items)
    of_all = statistics(words)
    parts = [index_of(words[k : k + MAX_ITEMS], of_all, p) for k in range(0, len(words), MAX_ITEMS)]
    out = docs.select(*kept, F.array().cast("array<bigint>").alias("item_ids"), F.lit(None).cast("double").alias("best_score"))
    for index in parts:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for b in batches:
                for first, part in column_chunks(b.column(text)):  # in small batches, so that neither side holds large ones
                    ids, best = (b.column(c).slice(first, len(part)).to_pylist() for c in ("item_ids", "best_score"))
                    for k, got in enumerate(search(x, part)):
                        if got:
                            ids[k] = sorted({*ids[k], *(x.ids[i] for i in got)})
                            best[k] = max(best[k] or 0.0, *got.values())
                    held = (b.column(c).slice(first, len(part)) for c in kept)
                    yield pa.RecordBatch.from_arrays([*held, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=[*kept, "item_ids", "best_score"])

        out = out.mapInArrow(run, out.schema)
    return out


def benchmark_items(benchmark: DataFrame) -> list[tuple[int, str]]:
    """The test items, which are few whatever the corpus; rows with a null id or text are left out. More than ``MAX_BYTES`` of
    them are a ValueError."""
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MAX_BYTES:
        raise ValueError(f"the benchmark has more than {MAX_BYTES} bytes; split it and decontaminate by each part")
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").collect()
    return sorted((r[0], r[1]) for r in rows)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with their own columns only, whose text holds no test item; null and empty texts hold none, and without items
    every row stays."""
    columns = docs.columns
    return contaminated(docs, benchmark_items(benchmark)).where(F.size("item_ids") == 0).select(*columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document, null and empty texts too, with the items that it holds; repeated rows repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, benchmark_items(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), F.col("item_ids"), "best_score")
