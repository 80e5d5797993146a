"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, shards. Each stage is a function of
(spark, docs, sf_dir); ``run`` writes each stage's result to the shared checkpoint folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import common, decontamination, jaccard, mixing, quality, sharding

N_SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores 0.5 or more. Null and empty texts are scored as empty ones, rows
    with a null id are scored as any, and repeated rows stay repeated; without labels of both kinds all have the mean's score."""
    scored = quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")), out="__quality")
    return scored.where("__quality >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pigeonring chains over SimHash fingerprints bring together and that share 0.8 of their five-word shingles are one; op3's links by
    2 bits are narrower and stay op3's own. Of each group the row with the smallest id stays, of equal ids the one with the smallest hash; null
    and empty texts are one text, and rows with a null id all stay."""
    return jaccard.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, ids play no part, repeated rows go or stay together; without
    items all stay."""
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source, the last one; texts without words, null ones too, weigh
    nothing and are not taken; equal rows are queued as rows of their own."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot. A null text has 8 bytes, each of several equal rows has a slot, and columns named like an
    added one are replaced."""
    return sharding.assign_shards(docs, N_SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: A trained classifier and 64-bit hashes are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
