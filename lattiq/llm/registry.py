"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm.decontamination import op9_decontamination
from lattiq.llm.embeddings import OP4_SQL, op4_embeddings
from lattiq.llm.licenses import op8_licenses
from lattiq.llm.line_rules import op11_line_rules
from lattiq.llm.manifest import OP12_SQL, op12_manifest
from lattiq.llm.mixing import OP10_SQL, op10_mixing
from lattiq.llm.ngram_lm import op6_ngram_lm
from lattiq.llm.pii import op5_pii
from lattiq.llm.quality import op1_quality_classifier
from lattiq.llm.sharding import op2_sharding
from lattiq.llm.simhash import op3_simhash
from lattiq.llm.toxicity import op7_toxicity
from lattiq.llm.vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_sharding, op3_simhash, op4_embeddings, op5_pii, op6_ngram_lm, op7_toxicity, op8_licenses, op9_decontamination, op10_mixing, op11_line_rules, op12_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": OP4_SQL, "op10_mixing": OP10_SQL, "op12_manifest": OP12_SQL, "op13_vector_codes": OP13_SQL}
