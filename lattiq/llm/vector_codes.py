"""Product codes of vectors: integer k-means by parts; the nearest entry is searched in a kd-tree of each part's codebook."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lattiq.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf of a tree.
LEAF = 8


def largest(dim: int) -> int:
    """Integers are held to this magnitude, so that the squared distance of two vectors of ``dim`` of them fits 64 bits."""
    return 1 << ((62 - max(dim, 1).bit_length()) // 2 - 1)


@dataclass(frozen=True)
class Node:
    """A box of entries: its corners, and either its entries by index or two halves."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    halves: tuple[Node, Node] | None = None


def kd_tree(points: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Halves by the median of the widest axis down to ``LEAF`` points; equal points may lie on both sides."""
    index = np.arange(len(points)) if index is None else index
    p = points[index]
    low, high = p.min(axis=0), p.max(axis=0)
    if len(index) <= LEAF or (low == high).all():
        return Node(low, high, index=np.sort(index))
    axis = int(np.argmax(high - low))
    order = index[np.argsort(p[:, axis], kind="stable")]
    half = len(order) // 2
    return Node(low, high, halves=(kd_tree(points, order[:half]), kd_tree(points, order[half:])))


def _bound(node: Node, x: np.ndarray) -> np.ndarray:
    """The least squared distance of each row to a point of the node's box."""
    out = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return (out * out).sum(axis=1)


def nearest(tree: Node, points: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest point, of equally near ones the least index.

    Branch and bound, for all rows at once: each node is visited by the rows whose bound to its box is not above their best, the nearer
    half first. A bound that equals the best is visited too, for the box may hold an equally near point of a lower index.
    """
    best = np.full(len(x), np.iinfo(np.int64).max)
    at = np.zeros(len(x), dtype=np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.halves is None:
            d = ((x[rows][:, None, :] - points[node.index][None, :, :]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)  # the first of equal ones, and a leaf's indexes ascend
            near, which = d[np.arange(len(rows)), k], node.index[k]
            better = (near < best[rows]) | ((near == best[rows]) & (which < at[rows]))
            best[rows[better]], at[rows[better]] = near[better], which[better]
            return
        left, right = node.halves
        to_left, to_right = _bound(left, x[rows]), _bound(right, x[rows])
        first = to_left <= to_right
        for half, bound, mine in ((left, to_left, first), (right, to_right, ~first)):
            visit(half, rows[mine & (bound <= best[rows])])
        for half, bound, mine in ((left, to_left, ~first), (right, to_right, first)):
            visit(half, rows[mine & (bound <= best[rows])])

    visit(tree, np.arange(len(x)))
    return at, best


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of each component, (rows, dim); every row must have ``dim`` components."""
    flat = np.asarray(pc.list_flatten(column).cast(pa.float64()), dtype=np.float64).reshape(len(column), dim)
    most = largest(dim)
    return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, finite))


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, components of a part) integers."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def part(self, x: np.ndarray, k: int) -> np.ndarray:
        width = self.entries.shape[2]
        return x[:, k * width : (k + 1) * width]


def initial(kept: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the smallest ids (equal ids by their vectors, null ids last); None without a row. At most
    ``entries`` rows reach the driver, fewer rows are fewer entries."""
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).select(F.col(vector).cast("array<double>").alias("v")).limit(entries).collect()
    if not first:
        return None
    dim = len(first[0][0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    rows = [r[0] for r in first if len(r[0]) == dim]
    x = integers(pa.array(rows, pa.list_(pa.float64())), dim)
    return Codebooks(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2).copy())


def _broadcast_trees(spark, books: Codebooks):
    """The codebooks and a tree of each; their size is parts x entries x width, whatever the rows."""
    return spark.sparkContext.broadcast([(kd_tree(e), e) for e in books.entries])


def updated(kept: DataFrame, books: Codebooks, vector: str = "embedding") -> Codebooks:
    """One round of k-means. A task sums its rows by part and entry, so at most parts x entries rows a task are shuffled and
    as many in all reach the driver; the sums are integers, and their order does not matter."""
    shared = _broadcast_trees(kept.sparkSession, books)
    n_parts, n_entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.entries.shape, np.int64)
        for b in batches:
            x = integers(b.column(0), books.dim)
            for k, (tree, entries) in enumerate(shared.value):
                mine = books.part(x, k)
                at, _ = nearest(tree, entries, mine)
                count[k] += np.bincount(at, minlength=n_entries)
                np.add.at(total[k], at, mine)
        k, e = np.nonzero(count)
        columns = [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[k, e]), *(pa.array(total[k, e, j]) for j in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    schema = "part int, entry int, n long" + "".join(f", s{j} long" for j in range(width))
    got = kept.select(vector).mapInArrow(sums, schema)
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    entries = books.entries.copy()
    for r in got.groupBy("part", "entry").agg(big("n"), *(big(f"s{j}") for j in range(width))).collect():
        entries[r["part"], r["entry"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(width)]
    return Codebooks(entries)


def fitted(kept: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` updates over all rows; None without a row."""
    books = initial(kept, vec_id, vector, parts, entries)
    if books is not None:
        kept = kept.where(F.size(vector) == books.dim)
        for _ in range(rounds):
            books = updated(kept, books, vector)
    return books


def encoded(kept: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Every row with ``codes`` (an index for each part) and ``error``, the squared distances summed over the parts. Rows of another
    length than the codebooks' are left out; columns that are named like an added one are replaced."""
    shared = _broadcast_trees(kept.sparkSession, books)
    rest = [c for c in kept.columns if c not in ("codes", "error")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(vector), books.dim)
            codes, error = np.empty((len(x), len(shared.value)), np.int32), np.zeros(len(x), np.int64)
            for k, (tree, entries) in enumerate(shared.value):
                codes[:, k], d = nearest(tree, entries, books.part(x, k))
                error += d
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists, pa.array(error)], names=[*rest, "codes", "error"])

    return kept.where(F.size(vector) == books.dim).mapInArrow(code, kept.select(*rest).schema.add("codes", ArrayType(IntegerType())).add("error", "long"))


def decoded(codes: DataFrame, books: Codebooks, out: str = "approximate") -> DataFrame:
    """Adds the vector that the codes stand for: the middles of its cells, part after part."""
    middle = (books.entries + 0.5) / SCALE
    book = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in part]) for part in middle])
    return codes.withColumn(out, F.flatten(F.transform("codes", lambda c, k: F.get(F.get(book, k), c))))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors. Rows with a null or non-finite component are dropped, as are those of another length than the
    vector of the smallest id; a length that 16 does not divide is an error. Integers are held to ``largest`` (for 64 components,
    vectors within 262,144). Equal vectors have equal codes, ids may repeat or be null, null labels are one label, and an empty
    table gives no rows; a label's error is null if it does not fit 64 bits."""
    kept = usable(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = fitted(kept)
    if books is None:
        return spark.createDataFrame([], kept.select("vec_id").schema.add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string"))
    hexes = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = common.written(encoded(kept, books).select("vec_id", "label", hexes.alias("code"), "error"), "vector-codes")
    key = F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("__label")
    sums = rows.groupBy(key).agg(F.try_sum("error").alias("label_error"))
    out = common.salted_join(rows.withColumn("__label", key), sums, "__label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_NEAREST = """
SELECT v.vec_id, v.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d FROM parts p JOIN {book} b USING (part)) v
  JOIN {book} b USING (part, entry) GROUP BY 1, 2"""


def _round(no: int) -> str:
    """SQL of one round: assignment to book b<no>, and book b<no + 1>."""
    return f"""
a{no} AS MATERIALIZED ({_NEAREST.format(book=f"b{no}")}),
m{no} AS (SELECT part, entry, i, CAST(floor_div AS BIGINT) AS v FROM (SELECT part, entry, i, (sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_div
  FROM a{no} JOIN parts USING (vec_id, part), range(1, 5) r(i) GROUP BY 1, 2, 3)),
b{no + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, b.x) AS x FROM b{no} b LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM m{no} GROUP BY 1, 2) n USING (part, entry))"""


#: For vectors of 64 components with ids that differ.
OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, k AS part, q[4 * k + 1 : 4 * k + 4] AS x FROM kept, range(16) r(k)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(0)},{_round(1)},
f AS MATERIALIZED ({_NEAREST.format(book="b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS s FROM b2)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM c JOIN kept USING (vec_id), h"""
