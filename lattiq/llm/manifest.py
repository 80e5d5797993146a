"""Merkle manifest of a dataset: a hash tree over each source's rows, and over the sources. Executors hash aligned buckets of leaves
in DuckDB, level by level; Spark combines the buckets' roots and joins their outer proofs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

from lattiq.llm import common
from lattiq.llm.common import LOWER, UPPER

#: Nodes of a run, and the levels that are hashed within a bucket: a bucket has 16**3 leaves of one source.
ARITY, INNER = 16, 3
#: A bucket's rows are held until so many are there.
ROWS = 1 << 14
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _duck() -> duckdb.DuckDBPyConnection:
    """A database in memory, of one thread and without files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _answer(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in con.execute(sql).to_arrow_reader(ROWS):
        yield from pa.Table.from_batches([b]).cast(schema).to_batches()


def _value(column: str) -> str:
    """SQL of a column in a leaf: `-` if null, else its bytes, a colon and itself."""
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen({column}), ':', {column}) END"


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, doc_id: str = "doc_id", source: str = "source", text: str = "text", changed: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, other): the digest of each row, and that of the row with A-Z of its text in lower case where
    ``changed`` holds. Texts are hashed where they are read; none is shuffled."""
    cast = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(changed if changed is not None else F.lit(False), F.lit(False)).alias("changed"), *cast)
    schema = StructType([*rows.schema.fields[:2]]).add("leaf", StringType()).add("other", StringType())
    sql = "SELECT {ids}, sha256(concat({whole})) AS leaf, CASE WHEN changed THEN sha256(concat({lower})) ELSE NULL END AS other FROM b"
    lower = [f"translate(v{i}, '{UPPER}', '{LOWER}')" if c == text else f"v{i}" for i, c in enumerate(columns)]
    sql = sql.format(ids="doc_id, source", whole=", ".join(_value(f"v{i}") for i in range(len(columns))), lower=", ".join(_value(x) for x in lower))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for b in batches:
            out = pa.schema([b.schema.field(0), b.schema.field(1), pa.field("leaf", pa.string()), pa.field("other", pa.string())])
            for k in range(0, b.num_rows, 1024):
                con.register("b", pa.Table.from_batches([b.slice(k, 1024)]))
                yield from _answer(con, sql, out)

    return rows.mapInArrow(hashed, schema).withColumn("other", F.coalesce("other", "leaf"))


def numbered(df: DataFrame, *order: str, out: str = "place") -> DataFrame:
    """Adds 0, 1, 2, ... in ascending order, nulls first; rows that are equal in ``order`` are numbered as they come.

    The rows are sorted in ranges and written once, so that a row keeps its place; a salt parts rows that are equal. What is added to a
    range's own numbers is one number for each range.
    """
    rows = df.withColumn("__salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    rows = common.written(rows.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part).agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")


def _up(n: Column | str) -> Column:
    """Runs of n nodes."""
    return F.floor(((F.col(n) if isinstance(n, str) else n) + (ARITY - 1)) / ARITY).cast("bigint")


def _depth(n: int) -> int:
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches that are sorted by bucket; a table has some ``ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= ROWS:  # all but the last bucket are whole
            t = pa.Table.from_batches(held)
            last = [t.column(k)[-1].as_py() for k in keys]
            low, high = 0, t.num_rows - 1  # the last bucket's first row
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if [t.column(k)[mid].as_py() for k in keys] == last else (mid + 1, high)
            if low:
                yield t.slice(0, low)
                held, size = t.slice(low).to_batches(), t.num_rows - low
        held.append(b)
        size += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _level(k: int) -> str:
    """SQL of a level of the buckets: runs of 16 nodes of the sources that have several nodes."""
    return f"CREATE OR REPLACE TABLE l{k + 1} AS SELECT src, pos // {ARITY} AS pos, (n + {ARITY - 1}) // {ARITY} AS n, string_agg(h, '' ORDER BY pos) AS s, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{k} WHERE n > 1 GROUP BY ALL UNION ALL SELECT src, pos, n, NULL, h FROM l{k} WHERE n = 1"


def _hashed_levels(con: duckdb.DuckDBPyConnection, inner: int) -> None:
    con.execute("CREATE OR REPLACE TABLE l0 AS SELECT src, pos, n, NULL::VARCHAR AS s, leaf AS h FROM b WHERE leaf IS NOT NULL")
    for k in range(inner):
        con.execute(_level(k))


def bucket_roots(placed: DataFrame, inner: int = INNER) -> DataFrame:
    """(src, pos, n, h): the root of each aligned bucket of ARITY**inner leaves, its place in its source, and the source's number of such."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        out = pa.schema([("src", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
        for t in _whole_buckets(batches, ("src", "bucket")):
            con.register("b", t)
            _hashed_levels(con, inner)
            yield from _answer(con, f"SELECT src, pos, n, h FROM l{inner}", out)

    return placed.select("src", "bucket", "pos", "n", "leaf").repartition("src", "bucket").sortWithinPartitions("src", "bucket").mapInArrow(roots, "src long, pos long, n long, h string")


def _climbed(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, roots) of trees over nodes (src, pos, n, h). A run gathers 16 digests at most."""
    levels = []
    for _ in range(depth):
        run = F.sort_array(F.collect_list(F.struct("pos", "h")))
        runs = nodes.where("n > 1").groupBy("src", F.floor(F.col("pos") / ARITY).cast("bigint").alias("up"), "n").agg(F.array_join(run["h"], "").alias("s"))
        runs = common.written(runs.select("src", F.col("up").alias("pos"), _up("n").alias("n"), "s"), "runs")
        levels.append(runs)
        nodes = runs.select("src", "pos", "n", F.sha2("s", 256).alias("h")).unionByName(nodes.where("n <= 1"))
    return levels, nodes


def _descended(paths: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """Paths (src, pos, path) of roots carried down to the nodes: to a node's path comes its run and its place in that."""
    for runs in reversed(levels):
        step = paths.join(runs.select("src", "pos", "s"), ["src", "pos"], "left")
        places = F.when(F.col("s").isNotNull(), F.sequence(F.lit(0), (F.length("s") / 64 - 1).cast("int"))).otherwise(F.array(F.lit(0)))
        step = step.withColumn("j", F.explode(places))
        grown = F.when(F.col("s").isNotNull(), F.concat(F.array(F.struct("s", "j")), "path")).otherwise(F.col("path"))
        paths = step.select("src", F.when(F.col("s").isNotNull(), F.col("pos") * ARITY + F.col("j")).otherwise(F.col("pos")).alias("pos"), grown.alias("path"))
    return paths


@dataclass(frozen=True)
class Manifest:
    """placed (doc_id, leaf, other, src, pos, n, bucket), sources (src, source, n, subroot), the paths of buckets to the root, and the root."""

    placed: DataFrame
    sources: DataFrame
    buckets: DataFrame
    root: str | None
    inner: int = INNER


def build(hashed: DataFrame, inner: int = INNER) -> Manifest:
    """The manifest of (doc_id, source, leaf, other). A source's leaves ascend by doc_id, nulls first, equal ids by their digest; sources
    ascend bytewise, null first. Without rows there is no root."""
    spark = hashed.sparkSession
    rows = numbered(hashed, "source", "doc_id", "leaf", "other", out="g")
    sources = numbered(rows.groupBy("source").agg(F.min("g").alias("first"), F.count("*").alias("n")), "first", out="src")
    sources = common.written(sources.withColumn("__key", _source_key()), "sources")
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = common.salted_join(rows.withColumn("__key", _source_key()).drop("source"), sources.drop("source"), "__key")
    pos = F.col("g") - F.col("first")
    placed = placed.select("doc_id", "leaf", "other", "src", pos.alias("pos"), "n", F.floor(pos / ARITY**inner).cast("bigint").alias("bucket"))
    placed = common.written(placed, "placed-leaves")
    levels, tops = _climbed(bucket_roots(placed, inner), max(0, _depth(most) - inner))
    subroots = common.written(tops.select(F.lit(0).cast("bigint").alias("src"), F.col("src").alias("pos"), F.lit(n_sources).cast("bigint").alias("n"), "h"), "subroots")
    above, root = _climbed(subroots, _depth(n_sources))
    first = root.select("h").first()
    empty = F.array().cast("array<struct<s:string,j:int>>")
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("pos"), empty.alias("path"))
    of_sources = _descended(start, above).select(F.col("pos").alias("src"), F.lit(0).cast("bigint").alias("pos"), "path")
    named = subroots.select(F.col("pos").alias("src"), F.col("h").alias("subroot"))
    buckets = _descended(of_sources, levels).withColumnRenamed("pos", "bucket").join(named, "src")
    return Manifest(placed, sources.join(named, "src").select("src", "source", "n", "subroot"), buckets, first[0] if first else None, inner)


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _around(s: str, j: str, mine: str) -> str:
    """SQL of a run's digests with the j-th replaced."""
    return f"substr({s}, 1, 64 * ({j})) || {mine} || substr({s}, 64 * ({j}) + 65)"


def _siblings(levels: Sequence[tuple[str, str, str]]) -> str:
    """SQL of a proof: the other digests of each level's run, for levels (condition, run, place) from the leaf up."""
    parts = [f"CASE WHEN {there} THEN {_around(s, j, chr(39) * 2)} ELSE '' END" for there, s, j in levels]
    return f"concat({', '.join([*parts, chr(39) * 2])})"


def _folded(query: str, levels: Sequence[tuple[str, str, str]]) -> str:
    """SQL of a query's rows with their ``f`` hashed up the levels."""
    for there, s, j in levels:
        query = f"SELECT * REPLACE (CASE WHEN {there} THEN sha256({_around(s, j, 'f')}) ELSE f END AS f) FROM ({query})"
    return query


def proofs(m: Manifest, with_proof: bool = False) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, proof_sha256, folded_root) of each row, and its proof (the digests of its siblings up to the
    root) if it is asked for.

    ``folded_root`` is hashed anew from ``other`` and the row's siblings. A bucket's leaves meet its outer path by one shuffle of digests; a task
    hashes the bucket's levels again, so no proof is stored or shuffled.
    """
    root = m.root or ""
    leaf = m.placed.select("src", "bucket", "doc_id", "leaf", "other", "pos", "n")
    outer = m.buckets.select("src", "bucket", "subroot", F.transform("path", lambda p: p["s"]).alias("ss"), F.transform("path", lambda p: p["j"]).alias("js"))
    both = leaf.unionByName(outer, allowMissingColumns=True).repartition("src", "bucket").sortWithinPartitions("src", "bucket")
    id_type = m.placed.schema["doc_id"]
    schema = StructType([id_type])
    names = ["leaf", "other", "subroot", "proof_sha256", "folded_root", *(["proof"] if with_proof else [])]
    for c in names:
        schema = schema.add(c, StringType())
    inner = m.inner

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for t in _whole_buckets(batches, ("src", "bucket")):
            con.register("b", t)
            _hashed_levels(con, inner)
            outside = con.execute("SELECT coalesce(max(len(ss)), 0) FROM b").fetchone()[0]
            above = [(f"len(ss) >= {i}", f"ss[{i}]", f"js[{i}]") for i in range(1, outside + 1)]
            below = [(f"s{k} IS NOT NULL", f"s{k}", f"pos // {ARITY ** (k - 1)} % {ARITY}") for k in range(1, inner + 1)]
            con.execute(f"CREATE OR REPLACE TABLE o AS SELECT src, bucket, subroot, ss, js, {_siblings(above)} AS p FROM b WHERE subroot IS NOT NULL")
            runs = ", ".join(f"l{k}.s AS s{k}" for k in range(1, inner + 1))
            met = " ".join(f"LEFT JOIN l{k} ON l{k}.src = b.src AND l{k}.pos = b.pos // {ARITY**k}" for k in range(1, inner + 1))
            rows = f"SELECT doc_id, leaf, other, b.pos, o.subroot, o.ss, o.js, o.p, other AS f, {runs} FROM b JOIN o ON o.src = b.src AND o.bucket = b.bucket {met} WHERE leaf IS NOT NULL"
            sql = f"SELECT doc_id, leaf, other, subroot, sha256(proof) AS proof_sha256, f AS folded_root, proof FROM (SELECT *, {_siblings(below)} || p AS proof FROM ({_folded(rows, below + above)}))"
            yield from _answer(con, f"SELECT {', '.join(schema.fieldNames())} FROM ({sql})", pa.schema([t.schema.field("doc_id"), *((c, pa.string()) for c in names)]))

    return both.mapInArrow(proven, schema).withColumn("root", F.lit(root))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """Digests, proofs and the check of a tampered copy of every document; a null id is never tampered with and comes first, equal
    ids are in the order of their digests, a null or empty text is a value like any other, and an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = build(common.written(leaves(docs, changed=tampered), "leaves"))
    out = proofs(m)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, start: str) -> str:
    """SQL of a tree over nodes (lv, src, pos, n, h): its nodes, and its runs."""
    return f"""{name} AS ({start} UNION ALL SELECT lv + 1, src, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lv, src, pos // 16, n),
{name}_runs AS (SELECT lv, src, pos // 16 AS up, string_agg(h, '' ORDER BY pos) AS s FROM {name} WHERE n > 1 GROUP BY 1, 2, 3)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """SQL of rows (doc_id, lv, src, pos, n, f, proof) on their way up a tree."""
    around = "substr(s, 1, 64 * (pos % 16)) || {} || substr(s, 64 * (pos % 16) + 65)"
    return f"{name} AS ({start} UNION ALL SELECT w.doc_id, w.lv + 1, w.src, pos // 16, (n + 15) // 16, sha256({around.format('f')}), proof || {around.format(chr(39) * 2)} FROM {name} w JOIN {tree}_runs r ON r.lv = w.lv AND r.src = w.src AND r.up = pos // 16 WHERE n > 1)"


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in (*COLUMNS[:-1], text)) + "))"


#: For ids that differ and are not null. The checksum goes bit by bit over the bytes of an id's digits.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
  xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 5 = 0 AS hit FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
{_tree_sql('t', 'SELECT 0 AS lv, src, pos, n, leaf AS h FROM p')},
{_tree_sql('u', 'SELECT 0 AS lv, 0 AS src, src AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1')},
{_walk_sql('w', 't', "SELECT doc_id, 0 AS lv, src, pos, n, CASE WHEN hit THEN low ELSE leaf END AS f, '' AS proof FROM p")},
{_walk_sql('x', 'u', 'SELECT doc_id, 0 AS lv, 0 AS src, src AS pos, (SELECT count(*) FROM t WHERE n = 1) AS n, f, proof FROM w WHERE n = 1')}
SELECT x.doc_id, p.leaf, t.h AS subroot, u.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = u.h AS verified
FROM x JOIN p USING (doc_id) JOIN t ON t.src = p.src AND t.n = 1 JOIN u ON u.n = 1 WHERE x.n = 1"""
