"""op6: spans of secrets in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm.registry import query, read_table
from flowloom.llm.secret_scan import KINDS, secret_spans


def joined(spans: str) -> Column:
    parts = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long")


@query("op6_secret_worklist")
def secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_kind(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
