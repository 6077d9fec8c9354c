"""op4: documents without passages that occur earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.registry import query, read_table
from flowloom.llm.substrings import without_repeats

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, s, sha256(array_to_string(words[s : s + 19], ' ')) AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)
),
ordered AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS place FROM windows
),
gone AS (
  SELECT DISTINCT doc_id, s + k AS i
  FROM ordered, (SELECT unnest(range(0, 20)) AS k) WHERE place > 1
),
gone_by AS (
  SELECT doc_id, list(i) AS at FROM gone GROUP BY doc_id
),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(g.at), 0) AS n_removed,
    CASE WHEN g.at IS NULL THEN words
      ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(g.at, i)))
    END AS words
  FROM w LEFT JOIN gone_by g USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept
"""


@query("op4_seed_extend_dedup", SQL)
def seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
