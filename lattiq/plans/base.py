"""How queries are registered, and views of the driver's tables as arrays and series."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: name: (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {}

#: Embeddings are 8 x 8 images; these are their pixels.
PIXELS = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS px FROM embeddings"
#: The shuffle order's hash, of keys of any sign and 64 bits.
HASH = "CAST((({0}::BIGINT & 4294967295)::HUGEINT * 2654435761 + (({0}::BIGINT >> 32) & 4294967295)::HUGEINT * 2246822519) % 4294967296 AS BIGINT)"
SHAPE = (8, 8)


def draw_sql(key: str, number: str, seed: int = 0) -> str:
    """SQL of ``draws.drawn``."""
    return f"(('0x' || substr(md5(concat({key}, ':{seed}:', {number})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("data"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", "label", F.posexplode("data").alias("px", "v"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*[(F.round(c, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lattiq-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
