"""op3: base counts and cascade verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.quality import quality_table
from flowloom.llm.registry import query, read_table

SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM base
),
positions AS (
  SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
),
repeated AS (
  SELECT doc_id, i FROM positions QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
counts AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
    len(list_distinct(w)) AS n_distinct
  FROM split s LEFT JOIN covered c USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines
    OR 10 * n_upper > 3 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 10 * n_distinct < n_words) AS kept
FROM judged
"""


@query("op3_quality_cascade", SQL)
def quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(read_table(spark, sf_dir, "documents"))
