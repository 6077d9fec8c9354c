"""op5: quality score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.additive_model import quality_scores
from flowloom.llm.registry import query, read_table


@query("op5_additive_quality")
def additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
