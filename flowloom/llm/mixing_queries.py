"""op9: words each document gives to a mix of all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.mixing import mix_table
from flowloom.llm.registry import query, read_table

SEED = 11
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
      + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
),
leveled AS (
  SELECT *, cap / weight::DOUBLE AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER r, 0)::DOUBLE)
    / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER r, 0)::DOUBLE) AS level
  FROM sources
  WINDOW r AS (ORDER BY cap / weight::DOUBLE, source ASC NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(
    (SELECT level FROM leveled WHERE ratio >= level ORDER BY ratio, level LIMIT 1) * weight,
    'Infinity'::DOUBLE)) AS target
  FROM leveled
),
placed AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN source_size = 0 THEN 0 ELSE least(2.0::DOUBLE, target / source_size) END AS expected
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
ranked AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS copies, expected - floor(expected) AS chance
  FROM placed
),
ordered AS (
  SELECT *, CASE WHEN chance = 0 THEN 'Infinity'::DOUBLE
    ELSE (draw / (1 - draw)) / (chance / (1 - chance)) END AS rank,
    sum(size * copies) OVER (PARTITION BY source) AS sure
  FROM ranked
),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ASC NULLS FIRST, size
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle
  FROM ordered
)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN chance > 0 AND middle <= target - sure THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM run
"""


@query("op9_pareto_mix", SQL)
def pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(read_table(spark, sf_dir, "documents"), seed=SEED)
