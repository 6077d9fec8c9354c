"""op2: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.page_text import main_text
from flowloom.llm.registry import query, read_table


@query("op2_max_subsequence_text")
def max_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
