"""op10: pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.registry import query, read_table
from flowloom.llm.warc import read_archives, write_archives
from flowloom.plans.staging import new_path

SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
),
m AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN octet_length(body) >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(body) >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END
    AS refers_to
FROM m
"""


@query("op10_warc_segments", SQL)
def warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_archives(read_table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path)
    full = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
