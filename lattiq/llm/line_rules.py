"""Quality rules by lines: a linear-chain conditional random field marks each line as content or boilerplate, and the share of
content decides whether a document stays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from lattiq.llm import common, quality
from lattiq.llm.hashing import Words, blank_bytes, column_chunks, pair

#: Bounds on the labelled rows that a field is fitted on, and on their bytes.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 3000, 16 << 20
#: Words of a window whose repeats count.
WINDOW = 8
SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Cuts of the features that are numbers; a value's bin is how many cuts are not above it.
CUTS = {
    "words": (2, 4, 8, 16),
    "upper": (1e-9, 0.05, 0.15, 0.5),
    "digits": (1e-9, 0.05, 0.2, 0.5),
    "symbols": (1e-9, 0.02, 0.06, 0.15),
    "shouts": (1e-9, 0.01, 0.03, 0.1),
    "word_length": (3, 4.5, 6.5, 9),
    "repeated": (1e-9, 0.5),
    "distinct": (0.3, 0.6, 0.9),
}
#: The other features: last character, first character, whether an earlier line was the same, place in the text.
KINDS = {"last": 4, "first": 3, "seen": 2, "place": 3}
_SIZES = [len(c) + 1 for c in CUTS.values()] + list(KINDS.values())
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER, _DIGIT, _SYMBOL, _END = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(SYMBOLS), _table(b".?")
_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)]) & ~blank_bytes()


def _between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over spans."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[end] - sums[start]


def repeated_words(w: Words) -> np.ndarray:
    """True for each word in a window of ``WINDOW`` words that its text holds twice or more. Windows are told apart by 64 bits of hash."""
    n = len(w.hash)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        at = np.flatnonzero(w.text[: n - WINDOW + 1] == w.text[WINDOW - 1 :])
        h = w.hash[at]
        for k in range(1, WINDOW):
            h = pair(h, w.hash[at + k])
        order = np.lexsort((h, w.text[at]))
        same = (h[order][1:] == h[order][:-1]) & (w.text[at][order][1:] == w.text[at][order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


@dataclass(frozen=True)
class Lines:
    """Of some texts the counts, and of their lines that have a word the text, span, code points of words and features."""

    counts: dict[str, np.ndarray]
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    codes: np.ndarray


def lines(texts: list[bytes]) -> Lines:
    """Counts of whole texts, and features of each of their lines."""
    w = Words(texts, blank_bytes(), lower=False)
    buf, ends = w.buf, np.cumsum([len(x) + 1 for x in texts])
    breaks = np.unique(np.concatenate([np.flatnonzero(buf == 10), ends - 1]))
    starts = np.concatenate([[0], breaks[:-1] + 1])
    first_word = np.searchsorted(w.start, starts)
    n_words = np.searchsorted(w.start, breaks) - first_word
    there = n_words > 0
    start, end, n_words, first_word = starts[there], breaks[there], n_words[there], first_word[there]
    of = np.searchsorted(ends, start, side="right")
    seen = np.zeros(len(start), dtype=bool)
    raw, before, at = buf.tobytes(), set(), -1
    for k, (t, a, b) in enumerate(zip(of.tolist(), start.tolist(), end.tolist())):
        if t != at:
            before, at = set(), t
        line = raw[a:b]
        seen[k] = line in before
        before.add(line)
    again = repeated_words(w)
    begin = ends - np.array([len(x) + 1 for x in texts])
    per_text = lambda of_text, weights=None: np.bincount(of_text, weights=weights, minlength=len(texts)).astype(np.int64)
    counts = {
        "n_words": w.counts().astype(np.int64),
        "word_chars": _between(_CHAR[buf], begin, ends),
        "n_symbols": _between(_SYMBOL[buf], begin, ends),
        "n_dup_lines": per_text(of[seen]),
        "n_repeat_words": per_text(w.text[again]),
    }
    share = lambda t: _between(t[buf], start, end) / chars
    chars = _between(_CHAR[buf], start, end)
    last_word = first_word + n_words
    last, head = buf[w.end[last_word - 1] - 1], buf[w.start[first_word]]
    line_of = np.repeat(np.arange(len(start)), n_words)
    h, n_all = w.hash, np.arange(len(w.hash))
    order = np.lexsort((h, line_of))
    fresh = np.ones(len(h), dtype=bool)
    fresh[n_all[1:]] = (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    n_fresh = np.bincount(line_of[order][fresh], minlength=len(start))
    numbers = {
        "words": n_words,
        "upper": share(_UPPER),
        "digits": share(_DIGIT),
        "symbols": share(_SYMBOL),
        "shouts": share(_table(b"!")),
        "word_length": chars / np.maximum(n_words, 1),
        "repeated": _between(again, first_word, last_word) / np.maximum(n_words, 1),
        "distinct": n_fresh / np.maximum(n_words, 1),
    }
    cols = [np.searchsorted(c, numbers[name], side="right") for name, c in CUTS.items()]
    edge = np.flatnonzero(np.diff(of)) if len(of) else np.zeros(0, dtype=np.int64)
    place = np.full(len(of), 1)
    place[np.concatenate([edge, [len(of) - 1]]).astype(np.int64) if len(of) else []] = 2
    place[np.concatenate([[0], edge + 1]).astype(np.int64) if len(of) else []] = 0
    cols.append(np.select([_END[last], last == 44, _LOWER[last] | _UPPER[last] | _DIGIT[last] | (last >= 128)], [0, 1, 2], 3))
    cols.append(np.select([_UPPER[head] | (head >= 128), _LOWER[head]], [0, 1], 2))
    cols += [seen.astype(np.int64), place]
    codes = np.stack([c + o for c, o in zip(cols, _OFFSETS)], axis=1).astype(np.uint8) if len(of) else np.zeros((0, len(_SIZES)), np.uint8)
    return Lines(counts, of, start, end, chars, codes)


@dataclass(frozen=True)
class Field:
    """Weights of the features for content against boilerplate, of the first label, and of pairs of labels (0 boilerplate, 1 content)."""

    weights: np.ndarray
    start: float
    pairs: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes].sum(axis=1)


#: Without labels of both kinds all lines are content.
PLAIN = Field(np.zeros(_OFFSETS[-1]), 1.0, np.array([[0.0, 0.0], [0.0, 1.0]]))


def viterbi(scores: Sequence[float], start: float, pairs: np.ndarray) -> list[bool]:
    """The likeliest labels of a sequence, True for content; of equally likely ones content.

    With two labels it is enough to carry by how much the best way to content beats the best way to boilerplate."""
    if not len(scores):
        return []
    (bb, bc), (cb, cc) = pairs.tolist()
    ahead = start + scores[0]
    came: list[tuple[bool, bool]] = []
    for x in scores[1:]:
        to_b, to_c = ahead + cb >= bb, ahead + cc >= bc
        came.append((to_b, to_c))
        ahead = (ahead + cc if to_c else bc) - (ahead + cb if to_b else bb) + x
    out = [ahead >= 0]
    for to_b, to_c in reversed(came):
        out.append(to_c if out[-1] else to_b)
    return out[::-1]


def marginals(scores: list[np.ndarray], start: float, pairs: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, float]:
    """(log partition summed, content's probability at each place, expected pairs, expected first labels) of sequences that are sorted by
    falling length; ``scores[t]`` has a score for each sequence that has a place t."""
    n = [len(s) for s in scores]
    alpha = [np.stack([np.zeros(n[0]), start + scores[0]], axis=1)]
    for t in range(1, len(n)):
        a = alpha[-1][: n[t]]
        step = np.logaddexp(a[:, :1] + pairs[0], a[:, 1:] + pairs[1])
        step[:, 1] += scores[t]
        alpha.append(step)
    ends = np.concatenate([alpha[t][n[t + 1] if t + 1 < len(n) else 0 :] for t in range(len(n) - 1, -1, -1)])
    log_z = np.logaddexp(ends[:, 0], ends[:, 1])  # in the order of the sequences
    beta = np.zeros((n[-1], 2))
    expected, p = np.zeros((2, 2)), [np.zeros(0)] * len(n)
    for t in range(len(n) - 1, -1, -1):
        if t + 1 < len(n):
            nxt = beta.copy()
            nxt[:, 1] += scores[t + 1]
            both = alpha[t][: n[t + 1], :, None] + pairs[None] + nxt[:, None, :] - log_z[: n[t + 1], None, None]
            expected += np.exp(both).sum(axis=0)
            now = np.zeros((n[t], 2))
            now[: n[t + 1]] = np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:])
            beta = now
        p[t] = np.exp(alpha[t][:, 1] + beta[:, 1] - log_z[: n[t]])
    return float(log_z.sum()), p, expected, float(p[0].sum())


@dataclass(frozen=True)
class FieldParams:
    rounds: int = 2
    steps: int = 120
    rate: float = 0.1
    l2: float = 1.0
    #: A longer text is several sequences in training; it is labelled as one.
    most_lines: int = 64


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], p: FieldParams = FieldParams()) -> Field:
    """The field of the greatest penalised likelihood, by Adam over all sequences (features of lines, labels of lines)."""
    cut = [(c[k : k + p.most_lines], y[k : k + p.most_lines]) for c, y in zip(sequences, labels) for k in range(0, len(c), p.most_lines)]
    cut.sort(key=lambda x: -len(x[0]))
    longest = len(cut[0][0])
    at = [np.array([k for k in range(len(cut)) if len(cut[k][0]) > t]) for t in range(longest)]
    codes = [np.stack([cut[k][0][t] for k in at[t]]) for t in range(longest)]
    truth = [np.array([cut[k][1][t] for k in at[t]], dtype=np.float64) for t in range(longest)]
    seen_pairs = np.zeros((2, 2))
    for a, b in zip(truth, truth[1:]):
        np.add.at(seen_pairs, (a[: len(b)].astype(int), b.astype(int)), 1)
    flat, y, size = np.concatenate(codes), np.concatenate(truth), int(_OFFSETS[-1])
    lengths = np.cumsum([len(c) for c in codes])[:-1]
    theta = np.zeros(size + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        scores = np.split(theta[:size][flat].sum(axis=1), lengths)
        _, probability, pairs, first = marginals(scores, theta[size], theta[size + 1 :].reshape(2, 2))
        off = y - np.concatenate(probability)
        g = np.concatenate([np.bincount(flat.ravel(), weights=np.repeat(off, flat.shape[1]), minlength=size), [truth[0].sum() - first], (seen_pairs - pairs).ravel()])
        g = (g - p.l2 * theta) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:size].copy(), float(theta[size]), theta[size + 1 :].reshape(2, 2).copy())


def fit_documents(sequences: list[np.ndarray], good: np.ndarray, p: FieldParams = FieldParams()) -> Field:
    """A field from labels of documents alone. Lines of good documents are content; those of the others begin as boilerplate and
    are then labelled anew, for a bad document may have good lines too: first by a field of single lines, as labels that never change
    within a document would only teach that labels never change. A document without a bad line left keeps its labels."""
    if not 0 < good.sum() < len(good):
        return PLAIN
    labels = [np.full(len(c), g) for c, g in zip(sequences, good)]
    field = fit(sequences, labels, replace(p, most_lines=1))
    for _ in range(p.rounds):
        for k in np.flatnonzero(~good):
            new = np.array(viterbi(field.scores(sequences[k]).tolist(), field.start, field.pairs))
            if not new.all():
                labels[k] = new
        field = fit(sequences, labels, p)
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", p: FieldParams = FieldParams()) -> Field:
    """A field fitted on a bounded sample of labelled documents; executors make the features, ten bytes or so a line, and the driver gets
    those only."""
    got = quality.labelled_sample(docs, labels, label, MAX_TRAIN_ROWS, MAX_TRAIN_BYTES)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [lines([t.encode("utf-8", "surrogatepass")]).codes.tobytes() for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__y"), pa.array(codes, pa.binary())], names=["__id", "__y", "c"])

    rows = sorted(got.mapInArrow(made, got.select("__id", "__y").schema.add("c", "binary")).collect(), key=lambda r: r[0])
    rows = [r for r in rows if len(r.c)]
    return fit_documents([np.frombuffer(r.c, np.uint8).reshape(-1, len(_SIZES)) for r in rows], np.array([r[1] >= 0.5 for r in rows], dtype=bool), p)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, field: Field, text: str = "text", least_share: float = 0.5, with_content: bool = False) -> DataFrame:
    """Adds the counts, ``base_failed``, ``content_share`` (code points of words in content lines, of all; 0 without words) and ``kept`` to
    every row, and the content lines as ``content`` if they are asked for.

    A null or empty text has counts of 0 and fails. Texts are labelled whole. Columns named like an added one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    added = [*COUNTS, "base_failed", "content_share", "kept", *(["content"] if with_content else [])]
    rest = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for first, part in column_chunks(b.column(text)):
                x = lines(part)
                scores, cuts = f.scores(x.codes).tolist(), np.searchsorted(x.text, np.arange(len(part) + 1))
                good = np.zeros(len(x.text), dtype=bool)
                for a, e in zip(cuts, cuts[1:]):
                    good[a:e] = viterbi(scores[a:e], f.start, f.pairs)
                n, again = x.counts["n_words"], x.counts["n_repeat_words"]
                failed = (n < 20) | (100 * again > 30 * n)
                share = np.bincount(x.text[good], weights=x.chars[good], minlength=len(part)) / np.maximum(x.counts["word_chars"], 1)
                new = [*(pa.array(x.counts[c]) for c in COUNTS), pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_share))]
                if with_content:
                    begin = np.cumsum([0] + [len(t) + 1 for t in part])
                    content = [b"\n".join(part[k][s - begin[k] : e - begin[k]] for s, e, g in zip(x.start[a:z], x.end[a:z], good[a:z]) if g) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
                    new.append(pa.array([c.decode("utf-8", "surrogatepass") for c in content]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(part)) for c in rest), *new], names=[*rest, *added])

    schema = docs.select(*rest).schema
    types = [LongType()] * 5 + [BooleanType(), DoubleType(), BooleanType(), StringType()]
    for name, kind in zip(added, types):
        schema = schema.add(name, kind)
    source = docs if text in rest else docs.withColumn(text, F.col(text))
    return source.mapInArrow(run, schema)


def op11_line_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null and empty texts fail, repeated rows repeat, null ids stay; without labels of both
    kinds every line is content; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, common.table(spark, sf_dir, "labels"))
    return judged(docs, field).select("doc_id", *COUNTS, "base_failed", "kept", "content_share")
