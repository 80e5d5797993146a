"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model with Dirichlet smoothing, P(w | uv) = (c(uvw) + mu P(w | v)) / (c(uv) + mu) and
P(w | v) = (c(vw) + mu p(w)) / (c(v) + mu), where p is the add-one unigram model. The trie is reversed: its first level holds
the predicted words, its second the words before them, its third the words before those. Each level is one monotone sequence in
Elias-Fano form, in which a context's successors are counted on from the end of the context before; pointers, monotone too, say
where a context's successors lie; n-grams have 16-bit codes of their logarithmic probability; and a shard's levels lie in one file
that is mapped, not read. A query goes down the levels: it seeks the successor in its context's range alone.

Text meets the model without either being gathered: each block of texts sends its distinct n-grams, with the counts of its training
texts, to the shards of their last words; a shard adds them up, builds its trie, asks it for all that was sent and gives the
answers back to the blocks, which know the contexts' counts from the answers too. So an n-gram is sent once a block, however often
it occurs. Words that would fill a shard alone are dealt over all shards by the word before; their counts are known from a first pass.
The blocks are cut twice, once to send and once to receive, and named by their place and content: a source that gives its
rows in another order the second time is an error, never a wrong score.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import common
from lattiq.llm.hashing import CHUNK, Words, blank_bytes, chunks, mix

MU = 30.0
#: Bytes of text in a block, in a shard of n-grams, and in a shard of the first pass over the words.
BLOCK_BYTES, SHARD_BYTES, COUNT_BYTES = 6 << 20, 4 << 20, 64 << 20
#: Bits of the hashes of words before; a context's successors are told apart by them.
V_BITS, U_BITS = 32, 24
#: A word that takes this part of a shard's tokens (a byte of text at least) is dealt over the shards.
HOT_PART = 32
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D)


class EliasFano:
    """A monotone sequence: low bytes as they are, high parts as gaps in a bit vector, with a sample of ones each 4,096 bits."""

    SPAN = 4096

    def __init__(self, high: np.ndarray, low: np.ndarray, ones: np.ndarray, n: int):
        self.high, self.low, self.ones, self.n = high, low, ones, n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)  # whole bytes, rounded up: so the high parts stay under two bits a value
        low = np.stack([(values >> np.uint64(8 * k)).astype(np.uint8) for k in range(width)], axis=1) if width else np.zeros((n, 0), np.uint8)
        at = (values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // cls.SPAN + 1) * cls.SPAN if n else cls.SPAN, dtype=np.uint8)
        bits[at] = 1
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, cls.SPAN).sum(axis=1, dtype=np.int64))])
        return cls(np.packbits(bits), low, ones, n)

    def decode(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Values a to b."""
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.ones, a, side="right")) - 1
        last = int(np.searchsorted(self.ones, b, side="left"))
        bits = np.unpackbits(np.asarray(self.high[first * self.SPAN // 8 : last * self.SPAN // 8]))
        at = np.flatnonzero(bits)[a - int(self.ones[first]) : b - int(self.ones[first])] + first * self.SPAN
        out = (at - np.arange(a, b)).astype(np.uint64)
        for k in range(self.low.shape[1] - 1, -1, -1):
            out = (out << np.uint64(8)) | np.asarray(self.low[a:b, k]).astype(np.uint64)
        return out

    def parts(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "low": self.low, "ones": self.ones}


def _ranges(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranges of ascending values, one after the other, made one ascending sequence: each counts on from the last value before."""
    last = np.zeros(len(ends), dtype=np.uint64)
    full = np.diff(ends, prepend=0) > 0
    last[full] = values[ends[full] - 1]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last)[:-1]]) if len(ends) else last
    return values + np.repeat(before, np.diff(ends, prepend=0))


class Level:
    """The n-grams of one order: successors of each context of the level above, with their codes."""

    def __init__(self, pointers: EliasFano, keys: EliasFano, codes: np.ndarray):
        self.pointers, self.keys, self.codes = pointers, keys, codes

    @classmethod
    def build(cls, starts: np.ndarray, values: np.ndarray, codes: np.ndarray) -> Level:
        """Context k's successors, ascending, are values[starts[k]] to values[starts[k + 1]]."""
        return cls(EliasFano.encode(starts), EliasFano.encode(_ranges(values.astype(np.uint64), starts[1:])), codes)

    def find(self, context: np.ndarray, value: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """The place of each (context, value), -1 where there is none. Contexts ascend, and may be -1 for one that is unknown."""
        out = np.full(len(context), -1, dtype=np.int64)
        known = np.flatnonzero(context >= 0)
        for k in range(0, len(known), step):
            rows = known[k : k + step]
            first = int(context[rows[0]])
            edge = self.pointers.decode(first, int(context[rows[-1]]) + 2).astype(np.int64)
            at = context[rows] - first
            lo, hi = edge[at], edge[at + 1]
            low = max(int(edge[0]) - 1, 0)
            keys = self.keys.decode(low, int(edge[-1]))
            base = np.where(lo > 0, keys[np.minimum(np.maximum(lo - 1 - low, 0), max(len(keys) - 1, 0))] if len(keys) else 0, np.uint64(0)).astype(np.uint64)
            wanted, end = base + value[rows].astype(np.uint64), hi.copy()
            going = np.flatnonzero(lo < hi)
            while len(going):  # successors, each within its context's range
                mid = (lo[going] + hi[going]) >> 1
                less = keys[mid - low] < wanted[going]
                lo[going[less]] = mid[less] + 1
                hi[going[~less]] = mid[~less]
                going = going[lo[going] < hi[going]]
            inside = np.flatnonzero(lo < end)
            hit = inside[keys[lo[inside] - low] == wanted[inside]]
            out[rows[hit]] = lo[hit]
        return out


class Trie:
    """A shard's levels, mapped from one file that is unlinked at once, so nothing stays on the executor's disk."""

    def __init__(self, word: np.ndarray, v: np.ndarray, u: np.ndarray, n: np.ndarray, step: float, counts: dict[int, int] | None = None):
        """Of trigrams (u, v, word) and their counts, in any order, repeated or not. ``counts`` are known counts of words, of
        which the shard has a part. A code is 1 + the logarithm of a count over ``step``; 0 is for what is not there."""
        words, w = np.unique(word, return_inverse=True)
        pairs, p = np.unique((w.astype(np.uint64) << np.uint64(V_BITS)) | v, return_inverse=True)
        grams, g = np.unique((p.astype(np.uint64) << np.uint64(U_BITS)) | u, return_inverse=True)
        c3 = np.bincount(g, weights=n, minlength=len(grams))
        of_pair = (grams >> np.uint64(U_BITS)).astype(np.int64)
        c2 = np.bincount(of_pair, weights=c3, minlength=len(pairs))
        of_word = (pairs >> np.uint64(V_BITS)).astype(np.int64)
        c1 = np.bincount(of_word, weights=c2, minlength=len(words)).astype(np.int64)
        for k, c in (counts or {}).items():
            at = np.searchsorted(words, np.uint64(k))
            if at < len(words) and words[at] == np.uint64(k):
                c1[at] = c
        coded = lambda c: np.round(1 + np.log10(c) / step).astype(np.uint16) if len(c) else np.zeros(0, np.uint16)
        two = Level.build(np.searchsorted(of_word, np.arange(len(words) + 1)), pairs & np.uint64((1 << V_BITS) - 1), coded(c2))
        three = Level.build(np.searchsorted(of_pair, np.arange(len(pairs) + 1)), grams & np.uint64((1 << U_BITS) - 1), coded(c3))
        self._map(EliasFano.encode(words), c1, two, three)

    def _map(self, words: EliasFano, counts: np.ndarray, two: Level, three: Level) -> None:
        sequences = {"w": words, "p2": two.pointers, "k2": two.keys, "p3": three.pointers, "k3": three.keys}
        arrays = {"counts": counts, "codes2": two.codes, "codes3": three.codes}
        arrays |= {f"{name}_{k}": v for name, e in sequences.items() for k, v in e.parts().items()}
        fd, path = tempfile.mkstemp(suffix=".trie")
        try:
            with os.fdopen(fd, "wb") as f:
                at = {}
                for name, a in arrays.items():
                    f.seek(-(-f.tell() // 8) * 8)
                    at[name] = (f.tell(), a.dtype, a.shape)
                    f.write(np.ascontiguousarray(a).tobytes())
                f.write(b"\0" * 8)
            self.map = np.memmap(path, dtype=np.uint8, mode="r")
        finally:
            os.unlink(path)
        view = {k: np.frombuffer(self.map, dtype=d, count=int(np.prod(s)), offset=o).reshape(s) for k, (o, d, s) in at.items()}
        e = {name: EliasFano(view[f"{name}_high"], view[f"{name}_low"], view[f"{name}_ones"], old.n) for name, old in sequences.items()}
        self.words, self.counts = e["w"], view["counts"]
        self.two, self.three = Level(e["p2"], e["k2"], view["codes2"]), Level(e["p3"], e["k3"], view["codes3"])

    def ask(self, word: np.ndarray, n_pairs: np.ndarray, v: np.ndarray, n_grams: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each word, code of each pair, code of each trigram): each word with so many pairs, each pair with so many
        trigrams. Words need not ascend: they are asked for in their order in the trie."""
        known = self.words.decode()
        at = np.searchsorted(known, word)
        there = at < len(known)
        there[there] = known[at[there]] == word[there]
        place = np.where(there, at, -1)
        pair_at = self._in_order(self.two, np.repeat(place, n_pairs), v)
        gram_at = self._in_order(self.three, np.repeat(pair_at, n_grams), u)
        get = lambda values, k: np.where(k >= 0, values[np.maximum(k, 0)], 0) if len(values) else np.zeros(len(k), values.dtype)
        return get(self.counts, place), get(self.two.codes, pair_at), get(self.three.codes, gram_at)

    @staticmethod
    def _in_order(level: Level, context: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.argsort(context, kind="stable")
        out = np.empty(len(context), dtype=np.int64)
        out[order] = level.find(context[order], value[order])
        return out


_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in the fewest bytes that hold its largest."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k in range(4) if top <= np.iinfo(_KINDS[k]).max)
        out += [struct.pack("<BI", kind, len(a)), a.astype(_KINDS[kind]).tobytes()]
    return b"".join(out)


def _unpack(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        kind, n = struct.unpack_from("<BI", b, at)
        out.append(np.frombuffer(b, dtype=_KINDS[kind], count=n, offset=at + 5))
        at += 5 + out[-1].nbytes
    return out


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens of each text): each text's words and then one end. Hashes are made of some texts at a time."""
    ends = np.cumsum([len(t) for t in texts])
    cuts = [0, *np.flatnonzero(np.diff(ends // CHUNK) > 0) + 1, len(texts)]
    parts = [_tokens_of(texts[x:y]) for x, y in zip(cuts, cuts[1:])]
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, blank_bytes())
    n = w.counts() + 1
    h = np.empty(len(w.hash) + len(texts), dtype=np.uint64)
    is_end = np.zeros(len(h), dtype=bool)
    is_end[np.cumsum(n) - 1] = True
    h[~is_end], h[is_end] = w.hash, END
    return h, n


def _shifted(x: np.ndarray, n: np.ndarray, first) -> np.ndarray:
    """The value of the token before; ``first`` for the first token of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[np.cumsum(n) - n] = first
    return out


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of an ascending list."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
    yield from ((int(shard[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:]))


class Block:
    """The distinct n-grams of some texts by shard, word, word before and the one before that; and where each token has its own.

    Words are numbers here: ``index`` has those of the tokens, ``shards`` and ``hot`` are by number, and the last one begins a text.
    """

    def __init__(self, index: np.ndarray, n: np.ndarray, shards: np.ndarray, hot: np.ndarray, n_shards: int):
        w, begin = index.astype(np.int32), len(shards) - 1
        v = _shifted(w, n, begin)
        before = v * np.int64(len(shards)) + _shifted(v, n, begin)
        key = np.where(hot[w], (shards[w] + shards[v]) % n_shards, shards[w]) * len(shards) + w
        del v
        self.order = order = np.lexsort((before, key))
        key, before = key[order], before[order]
        new = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        new_w = new(key)
        new_v = new_w | new(before // len(shards))
        new_u = new_v | new(before)
        at_w, at_v, self.at_u = np.flatnonzero(new_w), np.flatnonzero(new_v), np.flatnonzero(new_u)
        self.shard, self.word = key[at_w] // len(shards), key[at_w] % len(shards)
        self.v, self.u = before[at_v] // len(shards), before[self.at_u] % len(shards)
        self.of_word, self.of_pair, self.of_gram = (np.cumsum(x, dtype=np.int32) - 1 for x in (new_w, new_v, new_u))
        last = lambda at: np.append(at[1:], len(w)) - 1
        self.pair_end, self.gram_end = self.of_pair[last(at_w)] + 1, self.of_gram[last(at_v)] + 1

    def messages(self, names: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, its words, pairs and trigrams with the counts of training tokens); ``names`` are the words' hashes."""
        n = np.add.reduceat(train[self.order].astype(np.int64), self.at_u)
        pairs, grams = np.diff(self.pair_end, prepend=0), np.diff(self.gram_end, prepend=0)
        word, v, u = names[self.word], (mix(names) >> np.uint64(64 - V_BITS))[self.v], (mix(names) >> np.uint64(64 - U_BITS))[self.u]
        for shard, a, b in _by_shard(self.shard):
            p, q = int(self.pair_end[a - 1]) if a else 0, int(self.pair_end[b - 1])
            x, y = int(self.gram_end[p - 1]) if p else 0, int(self.gram_end[q - 1])
            yield shard, _pack(word[a:b], pairs[a:b], v[p:q], grams[p:q], *_split(u[x:y]), n[x:y])

    def of_tokens(self, words: np.ndarray, pairs: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of words, pairs and trigrams for each token in the order of the texts."""
        out = []
        for values, of in ((words, self.of_word), (pairs, self.of_pair), (grams, self.of_gram)):
            x = np.empty(len(self.order), dtype=values.dtype)
            x[self.order] = values[of]
            out.append(x)
        return tuple(out)


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 16 bits, and what is above; of small numbers the latter is noughts, which take no room when compressed."""
    return x & x.dtype.type(0xFFFF), x >> x.dtype.type(16)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | (high.astype(np.int64) << 16)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, the number of each token's word): frequent words have small numbers."""
    words, index, n = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    return words[order], rank[index]


def corpus_counts(rows: DataFrame, n_shards: int, hot_least: int) -> tuple[int, int, dict[int, int]]:
    """(tokens, distinct tokens, counts of the words that occur ``hot_least`` times) of the training texts of (text, train).

    Each block sends its distinct words and their counts to the words' shards; totals and frequent words come to the driver,
    at most one word for each ``hot_least`` tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t, k in zip(b.column("text").to_pylist(), b.column("train").to_pylist()) if k]
            for _, part in chunks(texts, 2 * BLOCK_BYTES):  # twice a block: fewer words are sent again
                words, n = np.unique(_tokens(part)[0], return_counts=True)
                shard = (words % np.uint64(n_shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                words, n = words[order], n[order]
                out = [(s, _pack(words[x:y], n[x:y])) for s, x, y in _by_shard(shard[order])]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "x"])

    def total(g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in g["x"]]
        words, inverse = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        top = np.flatnonzero(n >= hot_least)
        return pd.DataFrame({"n": [int(n.sum())], "v": [len(words)], "words": [words[top].astype(np.uint64).view(np.int64).tolist()], "counts": [n[top].tolist()]})

    sent = rows.mapInArrow(count, "shard int, x binary")
    got = sent.groupBy("shard").applyInPandas(total, "n bigint, v bigint, words array<bigint>, counts array<bigint>")
    got = common.written(got, "word-counts")
    n, v = got.agg(F.sum("n"), F.sum("v")).first()
    frequent = got.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").collect()
    return n or 0, v or 0, {r[0] & (1 << 64) - 1: r[1] for r in frequent}


def score_texts(docs: DataFrame, train, mu: float = MU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``train`` is a condition; the rows that meet it are the training corpus, copies and all. Null texts are empty: one end
    token. Repeated rows and null ids keep a row each; without any training text every token is unknown. Of an empty table the
    result is empty. A text lies whole in one block, so a task holds the longest text.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size, texts_trained = rows.agg(F.sum(F.octet_length("text") + 1), F.count(F.when(F.col("train"), 1))).first()
    size = size or 0
    n_shards = max(8, -(-size // SHARD_BYTES))
    hot_least = max(1, size // n_shards // HOT_PART)
    total, distinct, hot = corpus_counts(rows.select("text", "train"), max(8, -(-size // COUNT_BYTES)), hot_least)
    hot_words = np.array(sorted(hot), dtype=np.uint64)
    hot_counts = np.array([hot[int(k)] for k in hot_words], dtype=np.int64)
    step = np.log10(max(total, 10)) / 65000

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(name, ids, training flags, tokens of each text, hashes of words and of a text's beginning, numbers, shards, hot words)."""
        no = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts, train = (b.column(k).to_pylist() for k in ("doc_id", "text", "train"))
            for first, part in chunks(texts, BLOCK_BYTES):
                no += 1
                h, n = _tokens(part)
                names, index = _numbered(h)
                names = np.append(names, BEGIN)
                content = np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=np.uint64)))
                name = int(mix(np.array([content ^ np.uint64(no)], dtype=np.uint64)).view(np.int64)[0])
                shards = (names % np.uint64(n_shards)).astype(np.int64)
                yield name, ids[first : first + len(part)], np.array(train[first : first + len(part)], dtype=bool), n, names, index, shards, np.isin(names, hot_words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, t, n, names, index, shards, is_hot in blocks(batches):
            out = list(Block(index, n, shards, is_hot, n_shards).messages(names, np.repeat(t, n)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["shard", "block", "x"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, t, n, _, index, shards, is_hot in blocks(batches):
            x = _pack(np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64), np.array([i is None for i in ids], dtype=np.uint8), t, n, *_split(index), shards, is_hot)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([x], pa.binary())], names=["block", "x"])

    def look_up(g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in g["x"]]
        word, n_pairs, v, n_grams, low, high, n = (np.concatenate(x) for x in zip(*parts))
        n_pairs, n_grams = n_pairs.astype(np.int64), n_grams.astype(np.int64)
        word, v, u = word.astype(np.uint64), v.astype(np.uint64), _joined(low, high).astype(np.uint64)
        seen = n > 0
        v_of, w_of = np.repeat(v, n_grams), np.repeat(np.repeat(word, n_pairs), n_grams)
        trie = Trie(w_of[seen], v_of[seen], u[seen], n[seen], step, hot)
        c, two, three = trie.ask(word, n_pairs, v, n_grams, u)
        missing = c == 0  # a frequent word is known though this shard has no training pair of it
        if hot and missing.any():
            at = np.minimum(np.searchsorted(hot_words, word), len(hot_words) - 1)
            c = np.where(missing & (hot_words[at] == word), hot_counts[at], c)
        ends = [np.cumsum([len(p[k]) for p in parts])[:-1] for k in (0, 2, 4)]
        answers = zip(*(np.split(x, e) for x, e in zip((c, two, three), ends)))
        return pd.DataFrame({"block": g["block"].to_numpy(), "shard": g["shard"].to_numpy(), "x": [_pack(*a) for a in answers]})

    def put_together(answered: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if len(kept) != 1 or not len(answered):
            raise RuntimeError("the rows came in another order the second time; write them before they are scored")
        answers = [_unpack(x) for x in answered.sort_values("shard")["x"]]
        ids, null, t, n, low, high, shards, is_hot = _unpack(kept["x"].iloc[0])
        n = n.astype(np.int64)
        block = Block(_joined(low, high), n, shards.astype(np.int64), is_hot.astype(bool), n_shards)
        c1, c2, c3 = (np.concatenate(x) for x in zip(*answers))
        counted = lambda code: np.where(code > 0, np.power(10.0, (code.astype(np.float64) - 1) * step), 0.0)
        c1, c2, c3 = block.of_tokens(c1.astype(np.float64), counted(c2), counted(c3))
        p = (c1 + 1) / (total + distinct + 1.0)
        p = (c2 + mu * p) / (_shifted(c1, n, texts_trained) + mu)
        p = (c3 + mu * p) / (_shifted(c2, n, texts_trained) + mu)
        doc = np.repeat(np.arange(len(n)), n)
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(n))
        out = pd.array(ids.astype(np.uint64).view(np.int64), dtype="Int64")
        out[null.astype(bool)] = pd.NA
        base = sums(np.log10(c1 + 1)) - n * np.log10(total + distinct + 1.0)
        return pd.DataFrame({"doc_id": out, "held_out": ~t.astype(bool), "n_tokens": n, "n_known": sums(c1 > 0).astype(np.int64), "base_score": base, "score": sums(np.log10(p))})

    sent = rows.mapInArrow(send, "shard int, block bigint, x binary")
    back = sent.groupBy("shard").applyInPandas(look_up, "block bigint, shard int, x binary")
    kept = rows.mapInArrow(keep, "block bigint, x binary")
    done = back.groupBy("block").cogroup(kept.groupBy("block")).applyInPandas(put_together, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op6_ngram_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, common.fold("doc_id", 7) != 2)
