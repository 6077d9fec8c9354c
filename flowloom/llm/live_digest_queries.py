"""op13: groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.live_digests import exact_groups
from flowloom.llm.registry import query, read_table

SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept,
  text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""


@query("op13_cuckoo_index", SQL)
def cuckoo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))
