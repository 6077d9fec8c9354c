"""op12: the best phrases of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.collocations import collocations
from flowloom.llm.registry import query, read_table

SQL = r"""
WITH pieces AS (
  SELECT lang, doc, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (
    SELECT lang, doc, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece
    FROM (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]') AS ps
      FROM documents
    )
  )
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size)
  )
  GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
  SELECT g.lang, g.size, g.phrase, g.f AS a, k,
    array_to_string(string_split(g.phrase, ' ')[1 : k], ' ') AS first,
    array_to_string(string_split(g.phrase, ' ')[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1) g
),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first
    JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
    JOIN totals t ON t.lang = c.lang
),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_phrases AS (
  SELECT DISTINCT lang, f,
    array_to_string(string_split(phrase, ' ')[i : i + len - 1], ' ') AS phrase
  FROM (
    SELECT *, unnest(range(1, size - len + 2)) AS i
    FROM (SELECT *, unnest(range(2, size)) AS len FROM grams WHERE size > 2)
  )
),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrases i
    WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
WHERE rank <= 2000
"""


@query("op12_rabin_karp_phrases", SQL)
def rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
