"""Words of many texts as 64-bit hashes, by numpy over one byte buffer."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}
#: Bytes taken at a time; a longer text is taken alone.
CHUNK = 1 << 20
#: Rows and bytes of an Arrow batch that are taken at a time.
SLICE, SLICE_BYTES = 512, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = max(n, CHUNK + 4096)
        for name, p in (("up", _P), ("down", _P_INV)):
            t = np.full(size, p, dtype=np.uint64)
            t[0] = 1
            _TABLES[name] = np.cumprod(t, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def blank_bytes() -> np.ndarray:
    """True for the six ASCII blanks."""
    t = np.zeros(256, dtype=bool)
    t[[32, *range(9, 14)]] = True
    return t


def non_alnum_bytes() -> np.ndarray:
    """True for ASCII other than letters and digits; bytes of other letters count as letters."""
    return np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def shape_bytes() -> np.ndarray:
    """The class of each byte: capital, small, digit, blank, other script, or a sign for itself."""
    t = np.arange(256, dtype=np.uint8)
    t[[i for i in range(65, 91)]] = 65
    t[[i for i in range(97, 123)]] = 97
    t[[i for i in range(48, 58)]] = 48
    t[128:] = 97
    return t


def chunks(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) for runs of texts of about ``limit`` bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        x = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(x) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield first, held


def column_chunks(column, rows: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Chunks of an Arrow column; few of its texts are Python objects at a time."""
    for k in range(0, len(column), rows):
        for first, part in chunks(column.slice(k, rows).to_pylist(), SLICE_BYTES):
            yield k + first, part


def folded(text: bytes) -> bytes:
    """The text without case in any script, composed: one form for e and an accent, and for a sharp s and its capitals."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text.decode("utf-8", "surrogatepass").casefold()).encode("utf-8", "surrogatepass")


class Words:
    """The words of a chunk of texts: hash, first and last byte, text number. Lower case is that of A to Z."""

    def __init__(self, texts: list[bytes], blanks: np.ndarray, lower: bool = True, hashed: bool = True):
        raw = b" ".join(texts) + b" "
        buf = np.frombuffer(raw.lower() if lower else raw, dtype=np.uint8)
        self.buf, self.n_texts = buf, len(texts)
        gap = blanks[buf]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        if hashed:
            self.hash = self._hash(buf, self.end)

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word; a shorter word is its own prefix."""
        return self._hash(self.buf, np.minimum(self.end, self.start + n))

    def _hash(self, values: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(len(values) + 1)
        sums = np.empty(len(values) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
        return mix((sums[end] - sums[self.start]) * down[self.start])

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: its classes of bytes with runs made one."""
        kind = shape_bytes()[self.buf]
        run = np.empty(len(kind), dtype=bool)
        run[0], run[1:] = True, kind[1:] != kind[:-1]
        run[self.start] = True
        # positions within the squeezed buffer
        kept = np.flatnonzero(run)
        squeezed, at = kind[kept], np.cumsum(run) - 1
        start, end = at[self.start], at[np.maximum(self.end - 1, 0)] + 1
        up, down = _powers(len(squeezed) + 1)
        sums = np.empty(len(squeezed) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((squeezed.astype(np.uint64) + np.uint64(1)) * up[: len(squeezed)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.n_texts)

    def first_of_text(self) -> np.ndarray:
        """True where a word is the first of its text."""
        new = np.empty(len(self.text), dtype=bool)
        if len(new):
            new[0], new[1:] = True, self.text[1:] != self.text[:-1]
        return new


#: The five primes of XXH64.
_X1, _X2, _X3, _X4, _X5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of a byte buffer, all spans at once: a step takes those that are still long enough for it."""
    at, left = start.astype(np.int64), (end - start).astype(np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,)))  # the eight bytes from each place on
    one_round = lambda acc, x: _rotated(acc + x * _X2, 31) * _X1
    h = np.full(len(at), np.uint64(seed) + _X5, dtype=np.uint64)
    i = np.flatnonzero(left >= 32)
    if len(i):
        with np.errstate(over="ignore"):
            lanes = [np.full(len(at), np.uint64(seed) + x, dtype=np.uint64) for x in (_X1 + _X2, _X2, np.uint64(0), np.uint64(0) - _X1)]
        long = i
        while len(i):
            for k in range(4):
                lanes[k][i] = one_round(lanes[k][i], eight[at[i] + 8 * k])
            at[i] += 32
            left[i] -= 32
            i = i[left[i] >= 32]
        mixed = sum(_rotated(lanes[k][long], n) for k, n in enumerate((1, 7, 12, 18)))
        for k in range(4):
            mixed = (mixed ^ one_round(np.uint64(0), lanes[k][long])) * _X1 + _X4
        h[long] = mixed
    h += (end - start).astype(np.uint64)
    i = np.flatnonzero(left >= 8)
    while len(i):
        h[i] = _rotated(h[i] ^ one_round(np.uint64(0), eight[at[i]]), 27) * _X1 + _X4
        at[i] += 8
        left[i] -= 8
        i = i[left[i] >= 8]
    i = np.flatnonzero(left >= 4)
    h[i] = _rotated(h[i] ^ (eight[at[i]] & np.uint64(0xFFFFFFFF)) * _X1, 23) * _X2 + _X3
    at[i] += 4
    left[i] -= 4
    i = np.flatnonzero(left)
    while len(i):
        h[i] = _rotated(h[i] ^ (eight[at[i]] & np.uint64(0xFF)) * _X5, 11) * _X1
        at[i] += 1
        left[i] -= 1
        i = i[left[i] > 0]
    h = (h ^ (h >> np.uint64(33))) * _X2
    h = (h ^ (h >> np.uint64(29))) * _X3
    return h ^ (h >> np.uint64(32))


def shingle_spans(texts: list[bytes], words_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all words, lower-cased and parted by one space; begin and end of each shingle in it; and where each text's
    shingles begin and end. Fewer words are one shingle, none are none."""
    w = Words(texts, blank_bytes(), hashed=False)
    length = w.end - w.start
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    kept = ~blank_bytes()[w.buf]
    kept[w.end] = True  # a blank follows each word
    buf = w.buf[kept].copy()
    buf[ends - 1] = 32
    counts = w.counts()
    n = np.where(counts > 0, np.maximum(counts - words_each + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    begin = np.repeat(first - at[:-1], n) + np.arange(at[-1])
    last = begin + np.repeat(np.minimum(counts, words_each), n) - 1
    return buf, starts[begin], ends[last] - 1, at


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(runs, 64): how often each bit is set in each run of hashes, run k from at[k] to at[k + 1].

    Eight bits at a time are counted in the eight bytes of a sum, over 255 hashes at most, so that no byte overflows."""
    out = np.zeros((len(at) - 1, 64), dtype=np.int64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    n = -(-(at[full + 1] - at[full]) // 255)
    of = np.repeat(np.arange(len(full)), n)
    first = np.cumsum(n) - n
    cuts = at[full][of] + (np.arange(len(of)) - first[of]) * 255
    sums = np.stack([np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts) for k in range(8)], axis=1)
    bits = sums.astype("<u8").view(np.uint8).reshape(len(cuts), 8, 8).transpose(0, 2, 1).reshape(len(cuts), 64)
    out[full] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return out
