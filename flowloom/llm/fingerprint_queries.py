"""op1: fingerprints of every document and of an edited copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.fingerprint import fingerprint_table
from flowloom.llm.registry import query, read_table


@query("op1_locally_consistent_parsing")
def locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(read_table(spark, sf_dir, "documents"))
