"""op7: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.jaccard import Likeness, near_components
from flowloom.llm.registry import query, read_table


@query("op7_heavy_light_jaccard")
def heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_components(docs, Likeness(width=4, percent=85))
