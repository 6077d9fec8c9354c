"""op11: repair of damaged conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.registry import query, read_table
from flowloom.llm.turn_repair import damaged, repair_report


def more(value: str, cost: str, edit: str) -> str:
    """SQL: a best value (six digits of cost, then the audit) after one more edit before it."""
    return f"lpad(CAST(CAST(substr({value}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || '{edit}' || substr({value}, 7)"


def without_insert(state: int) -> str:
    """SQL: the least value of a state over deleting, keeping and renaming the row."""
    keep = {0: "WHEN 's' THEN v1 WHEN 'u' THEN v2", 1: "WHEN 'u' THEN v2", 2: "WHEN 'a' THEN v3", 3: "WHEN 'u' THEN v2"}
    target = "v3" if state == 2 else "v2"
    kept = f"(CASE initial {keep[state]} END)"
    return (
        f"least({more(f'v{state}', '2', 'D')}, CASE WHEN fault <> 1 AND fault <> 2 THEN least("
        f"{more(kept, '5 * (fault // 3)', 'K')}, {more(target, '1 + 5 * (fault // 3)', 'R')}) END)"
    )


SQL = rf"""
WITH RECURSIVE named AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
marked AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, 3988292384::BIGINT * (x & 1)) END)) % 20 AS kind
  FROM named
),
rows AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM rows
),
faulty AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
    CASE WHEN ended = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2
      WHEN ended[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END) OVER (PARTITION BY conv ORDER BY pos) AS previous
  FROM placed
),
best AS (
  SELECT conv, max(pos) + 1 AS pos, '000000' AS v0, '000010II' AS v1, '000005I' AS v2, '000000' AS v3
  FROM faulty GROUP BY conv
  UNION ALL
  SELECT conv, pos, least(b0, {more("c2", "5", "I")}), least(b1, {more("c2", "5", "I")}), c2, c3
  FROM (
    SELECT conv, pos, b0, b1, least(b2, {more("b3", "5", "I")}) AS c2, least(b3, {more("b2", "5", "I")}) AS c3
    FROM (
      SELECT f.conv, f.pos, {", ".join(f"{without_insert(s)} AS b{s}" for s in range(4))}
      FROM best JOIN faulty f ON f.conv = best.conv AND f.pos = best.pos - 1
    )
  )
),
audits AS (
  SELECT conv, CAST(substr(v0, 1, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM best WHERE pos = 1
),
walk AS (
  SELECT conv, audit, 0 AS i, 1::BIGINT AS pos, 0 AS state, NULL::VARCHAR AS made FROM audits
  UNION ALL
  SELECT w.conv, audit, i + 1, CASE WHEN edit = 'I' THEN w.pos ELSE w.pos + 1 END,
    CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE edit WHEN 'D' THEN made ELSE coalesce(made || chr(10), '')
      || CASE edit WHEN 'K' THEN role WHEN 'R' THEN put WHEN 'I' THEN put END || ':'
      || CASE edit WHEN 'I' THEN '' ELSE text END END
  FROM (
    SELECT *, audit[i + 1] AS edit, CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END AS put
    FROM walk WHERE i < length(audit)
  ) w LEFT JOIN faulty f ON f.conv = w.conv AND f.pos = w.pos
),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(a.audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv = coalesce(CAST(o.conv_id AS VARCHAR), ' ')
LEFT JOIN audits a ON a.conv = c.conv
LEFT JOIN walk w ON w.conv = a.conv AND w.i = length(a.audit)
"""


@query("op11_suffix_shared_repair", SQL)
def suffix_shared_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)
