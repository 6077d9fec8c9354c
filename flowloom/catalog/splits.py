"""Queries on split assignment and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import graphs as graph_queries
from flowloom.catalog import sequences as sequence_queries
from flowloom.catalog.base import (
    EVENT_GROUPS, EVENT_SPLIT, FLOWS, GRAPH_SPLIT, GRAPHS, SEED, TOKEN_GROUPS, TOKEN_SPLIT,
    TOKENS, TRAJECTORIES, query, split_case, tidy, tidy_sql, with_ctes,
)
from flowloom.operators import graphs, sequences, splits, validation
from flowloom.plans.staging import new_path, stage
from flowloom.sources import sinks

LEGACY_SQL = f"""
legacy AS (
  SELECT *, {split_case("pr")} AS legacy_split FROM (
    SELECT *, percent_rank() OVER (PARTITION BY day, group_y
      ORDER BY md5('{SEED}|' || split_group_id), split_group_id) AS pr FROM token_groups)
)"""
TOKEN_PARTS = [FLOWS, TOKENS, TOKEN_GROUPS, TOKEN_SPLIT]
EVENT_PARTS = [FLOWS, TRAJECTORIES, EVENT_GROUPS, EVENT_SPLIT]


def token_groups(spark, sf_dir):
    return sequences.token_groups(sequence_queries.token_sequences_(spark, sf_dir))


def event_groups(spark, sf_dir):
    return sequences.event_groups(sequence_queries.trajectories_(spark, sf_dir))


def both_splits(spark, sf_dir):
    applied = splits.temporal_split(token_groups(spark, sf_dir))
    legacy = splits.stratified_split(applied, "split_group_id", "group_y", SEED)
    return splits.join_assignments(applied, legacy, ["day", "split_group_id"])


@query("split_temporal", f"""{with_ctes(*TOKEN_PARTS)}
SELECT day, split_group_id, split FROM token_split""")
def split_temporal(spark, sf_dir):
    assigned = splits.temporal_split(token_groups(spark, sf_dir))
    return assigned.select("day", "split_group_id", "split")


@query("split_stratified", f"""{with_ctes(FLOWS, TOKENS, TOKEN_GROUPS, LEGACY_SQL)}
SELECT day, split_group_id, legacy_split FROM legacy""")
def split_stratified(spark, sf_dir):
    assigned = splits.stratified_split(
        token_groups(spark, sf_dir), "split_group_id", "group_y", SEED
    )
    return assigned.select("day", "split_group_id", "legacy_split")


@query("assignments_both", f"""{with_ctes(*TOKEN_PARTS, LEGACY_SQL)}
SELECT s.day, s.split_group_id, s.split, l.legacy_split
FROM token_split s LEFT JOIN legacy l USING (day, split_group_id)""")
def assignments_both(spark, sf_dir):
    return both_splits(spark, sf_dir).select("day", "split_group_id", "split", "legacy_split")


def _gain_sql(target, filled, size):
    scale = f"greatest({target}, 1.0::DOUBLE)"
    return (
        f"(greatest({target} - {filled}, 0.0::DOUBLE) / {scale}"
        f" - greatest({filled} + {size} - {target}, 0.0::DOUBLE) / {scale})"
    )


_RATIO = "[0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE][i]"
_EMPTY = "[0.0::DOUBLE, 0, 0]"


def _add(column, amount):
    return (
        f"list_transform([1, 2, 3], lambda i: {column}[i]"
        f" + CASE WHEN i = pick THEN {amount} ELSE 0 END) AS {column}"
    )


def greedy_sql(ctes, table, rule):
    """The greedy choice as a recursion over the units of a day, one unit per step."""
    unit, target, measures = rule.unit, rule.target, list(rule.measures)
    by_class = _gain_sql(f"(t_class * {_RATIO})", "f_class[i]", "1.0::DOUBLE")
    by_unit = _gain_sql(f"(t_units * {_RATIO})", "f_units[i]", "1.0::DOUBLE")
    gains = {m: _gain_sql(f"(t_{m} * {_RATIO})", f"f_{m}[i]", m) for m in measures}
    total = f"4.0::DOUBLE * {by_class} + 2.5::DOUBLE * {by_unit}"
    for m, weight in rule.measures.items():
        total += f" + {weight}::DOUBLE * {gains[m]}"
    key = [f"'total': round({total}, 12)", f"'class': round({by_class}, 12)"]
    key += [f"'{m}': round({gains[m]}, 12)" for m in rule.ties]
    key += [f"'load': -f_{rule.load}[i]", "'units': -f_units[i]", "'rank': -i"]
    visit = [f"{c} DESC" for c in (target, *rule.visit)]
    if rule.hashed_ties:
        visit.append(f"md5('{SEED}|' || {unit})")
    filled = ["f_units", "f_zero", "f_one", *[f"f_{m}" for m in measures]]
    return f"""WITH RECURSIVE {with_ctes(*ctes).removeprefix('WITH ')},
queue AS (
  SELECT {unit} AS unit, day, {target} AS target,
    {', '.join(f'{m}::DOUBLE AS {m}' for m in measures)},
    count(*) OVER (PARTITION BY day)::DOUBLE AS t_units,
    count(*) OVER (PARTITION BY day, {target})::DOUBLE AS t_class,
    {', '.join(f'sum({m}) OVER (PARTITION BY day)::DOUBLE AS t_{m}' for m in measures)},
    row_number() OVER (PARTITION BY day ORDER BY {', '.join(visit)}, {unit}) AS step
  FROM {table}
),
walk AS (
  SELECT DISTINCT day, 0::BIGINT AS step, '' AS unit, 0 AS target, 0 AS pick,
    {', '.join(f'{_EMPTY} AS {f}' for f in filled)}
  FROM queue
  UNION ALL
  SELECT day, step, unit, target, pick, {_add('f_units', '1')},
    {_add('f_zero', '1 - target')}, {_add('f_one', 'target')},
    {', '.join(_add(f'f_{m}', m) for m in measures)}
  FROM (
    SELECT *, -list_reverse_sort(list_transform([1, 2, 3], lambda i:
      {{{', '.join(key)}}}))[1]['rank'] AS pick
    FROM (
      SELECT q.*, {', '.join(f'w.{f}' for f in filled)},
        CASE WHEN q.target = 1 THEN w.f_one ELSE w.f_zero END AS f_class
      FROM walk w JOIN queue q ON q.day = w.day AND q.step = w.step + 1))
)
SELECT unit AS {unit}, day, target AS {target}, ['train', 'val', 'test'][pick] AS split,
  '{rule.strategy}' AS split_strategy, {SEED} AS split_seed
FROM walk WHERE step > 0"""


@query("split_balanced", greedy_sql([FLOWS, GRAPHS], "graphs", splits.GRAPH_RULE))
def split_balanced(spark, sf_dir):
    units = graphs.graph_summary(graph_queries.keyed(spark, sf_dir))
    return splits.balanced_split(units, splits.GRAPH_RULE).select(
        "graph_id", "day", "graph_y", "split", "split_strategy", "split_seed"
    )


@query(
    "split_balanced_tokens",
    greedy_sql([FLOWS, TOKENS, TOKEN_GROUPS], "token_groups", splits.TOKEN_RULE),
)
def split_balanced_tokens(spark, sf_dir):
    return splits.balanced_split(token_groups(spark, sf_dir), splits.TOKEN_RULE).select(
        "day", "split_group_id", "group_y", "split", "split_strategy", "split_seed"
    )


@query(
    "split_balanced_events",
    greedy_sql([FLOWS, TRAJECTORIES, EVENT_GROUPS], "event_groups", splits.EVENT_RULE),
)
def split_balanced_events(spark, sf_dir):
    return splits.balanced_split(event_groups(spark, sf_dir), splits.EVENT_RULE).select(
        "day", "split_group_id", "group_y", "split", "split_strategy", "split_seed"
    )


_SHARES = "(VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE))"


@query("split_targets", f"""{with_ctes(FLOWS, GRAPHS)},
totals AS (SELECT day, graph_y, count(*) AS n, sum(n_nodes) AS nodes, sum(n_pos_nodes) AS pos
  FROM graphs GROUP BY GROUPING SETS ((day), (day, graph_y)))
SELECT day, graph_y AS target_class, s.split, {tidy_sql('n * s.ratio')} AS target_n_units,
  {tidy_sql('nodes * s.ratio')} AS target_n_nodes,
  {tidy_sql('pos * s.ratio')} AS target_n_pos_nodes
FROM totals, {_SHARES} AS s(split, ratio)""")
def split_targets(spark, sf_dir):
    units = graphs.graph_summary(graph_queries.keyed(spark, sf_dir))
    targets = splits.split_targets(units, splits.GRAPH_RULE)
    names = ["target_n_units", "target_n_nodes", "target_n_pos_nodes"]
    return targets.select("day", "target_class", "split", *[tidy(c) for c in names])


SUMMARY_COLUMNS = """
  count(*) AS n_groups, count(*) FILTER (WHERE group_y = 1) AS n_attack_groups,
  count(*) FILTER (WHERE group_y = 0) AS n_benign_groups,
  CAST(sum(n_sequences) AS BIGINT) AS n_sequences,
  CAST(sum(n_attack_sequences) AS BIGINT) AS n_attack_sequences,
  CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
  round(sum(n_attack_sequences) / greatest(sum(n_sequences), 1)::DOUBLE, 6)
    AS positive_sequence_rate"""


def _summary(table, column, label):
    return f"""SELECT '{label}' AS summary_label, {column} AS split, coalesce(day, 'ALL') AS day,
  {SUMMARY_COLUMNS} FROM {table}
  GROUP BY GROUPING SETS ((day, {column}), ({column}))"""


@query("split_summary", f"""{with_ctes(*TOKEN_PARTS)}
{_summary('token_split', 'split', splits.TEMPORAL)}""")
def split_summary(spark, sf_dir):
    assigned = splits.temporal_split(token_groups(spark, sf_dir))
    summary = splits.split_summary(
        assigned, splits.TOKEN_RULE, splits.TEMPORAL, rates=splits.TOKEN_RATES
    )
    return summary.withColumn(
        "positive_sequence_rate", F.round("positive_sequence_rate", 6)
    )


@query("files_split_summary", f"""{with_ctes(*TOKEN_PARTS)}
{_summary('token_split', 'split', splits.TEMPORAL)}""")
def files_split_summary(spark, sf_dir):
    """The summary written as CSV and read back, and a build without one, which adds no row."""
    summary = split_summary(spark, sf_dir)
    path = new_path(spark)
    sinks.write_table(summary, path, "csv")
    there = sinks.read_split_summary(spark, path, summary.schema)
    return there.unionByName(sinks.read_split_summary(spark, f"{path}-none", summary.schema))


@query("split_summary_graphs", f"""{with_ctes(FLOWS, GRAPHS, GRAPH_SPLIT)}
SELECT '{splits.LEGACY_GRAPHS}' AS summary_label, split, coalesce(day, 'ALL') AS day,
  count(*) AS n_graphs, count(*) FILTER (WHERE graph_y = 1) AS n_attack_graphs,
  count(*) FILTER (WHERE graph_y = 0) AS n_benign_graphs,
  CAST(sum(n_nodes) AS BIGINT) AS n_nodes, CAST(sum(n_pos_nodes) AS BIGINT) AS n_pos_nodes,
  round(sum(n_pos_nodes) / greatest(sum(n_nodes), 1)::DOUBLE, 6) AS positive_node_rate
FROM graph_split GROUP BY GROUPING SETS ((day, split), (split))""")
def split_summary_graphs(spark, sf_dir):
    summary = splits.split_summary(
        graph_queries.graphs_split(spark, sf_dir),
        splits.GRAPH_RULE,
        splits.LEGACY_GRAPHS,
        noun="graphs",
        rates=splits.GRAPH_RATES,
    )
    return summary.withColumn("positive_node_rate", F.round("positive_node_rate", 6))


def comparison(spark, sf_dir):
    return splits.split_comparison(
        both_splits(spark, sf_dir),
        splits.TOKEN_RULE,
        splits.TEMPORAL,
        splits.LEGACY_GROUPS,
        rates=splits.TOKEN_RATES,
    )


COMPARISON_SQL = f"""
comparison AS (
  SELECT * FROM ({_summary('token_split', 'split', splits.TEMPORAL)})
  UNION ALL SELECT * FROM ({_summary('legacy', 'legacy_split', splits.LEGACY_GROUPS)}))"""


@query("split_comparison", f"""{with_ctes(*TOKEN_PARTS, LEGACY_SQL, COMPARISON_SQL)}
SELECT * FROM comparison""")
def split_comparison(spark, sf_dir):
    return comparison(spark, sf_dir).withColumn(
        "positive_sequence_rate", F.round("positive_sequence_rate", 6)
    )


def _error(metric):
    shares = " + ".join(
        f"abs(coalesce(sum({metric}) FILTER (WHERE split = '{s}'), 0) / sum({metric})::DOUBLE"
        f" - {r})"
        for s, r in splits.RATIOS.items()
    )
    return f"{tidy_sql(shares)} AS {metric}"


METRICS = ["n_groups", "n_sequences", "n_attack_sequences", "n_tokens"]


@query("balance_error", f"""{with_ctes(*TOKEN_PARTS, LEGACY_SQL, COMPARISON_SQL)}
SELECT summary_label, {', '.join(_error(m) for m in METRICS)}
FROM comparison WHERE day = 'ALL' GROUP BY summary_label""")
def balance_error(spark, sf_dir):
    errors = validation.balance_error(comparison(spark, sf_dir), METRICS)
    return errors.select("summary_label", *[tidy(m) for m in METRICS])


@query("leakage_check", f"""{with_ctes(*TOKEN_PARTS)}
SELECT count(*) AS groups_total, max(n) AS max_splits_per_group,
  count(*) FILTER (WHERE n > 1) AS leaking_groups
FROM (SELECT split_group_id, count(DISTINCT split) AS n FROM split_seqs GROUP BY ALL)""")
def leakage_check(spark, sf_dir):
    assigned = sequence_queries.split_token_sequences(spark, sf_dir)
    return validation.leakage_check(assigned, "split_group_id")


EVENT_SUMMARY = f"""
event_summary AS (
  SELECT '{splits.TEMPORAL}' AS summary_label, split, coalesce(day, 'ALL') AS day,
    CAST(sum(n_sequences) AS BIGINT) AS n_sequences,
    CAST(sum(n_attack_sequences) AS BIGINT) AS n_attack_sequences,
    CAST(sum(n_events) AS BIGINT) AS n_events,
    CAST(sum(n_attack_events) AS BIGINT) AS n_attack_events
  FROM event_split GROUP BY GROUPING SETS ((day, split), (split)))"""


def event_summary(spark, sf_dir):
    assigned = splits.temporal_split(event_groups(spark, sf_dir))
    return splits.split_summary(
        assigned, splits.EVENT_RULE, splits.TEMPORAL, rates=splits.EVENT_RATES
    )


@query("class_coverage", f"""{with_ctes(*EVENT_PARTS, EVENT_SUMMARY)}
SELECT split, n_sequences, n_attack_sequences, n_sequences - n_attack_sequences
    AS n_benign_sequences,
  n_attack_sequences > 0 AND n_sequences > n_attack_sequences AS sequence_has_both_classes,
  n_events, n_attack_events, n_events - n_attack_events AS n_benign_events,
  n_attack_events > 0 AND n_events > n_attack_events AS event_has_both_classes
FROM event_summary WHERE day = 'ALL'""")
def class_coverage(spark, sf_dir):
    return validation.class_coverage(event_summary(spark, sf_dir))


@query("split_summary_events", f"""{with_ctes(*EVENT_PARTS, EVENT_SUMMARY)}
SELECT *, n_attack_events > n_events AS is_impossible FROM event_summary""")
def split_summary_events(spark, sf_dir):
    summary = stage(event_summary(spark, sf_dir))
    columns = ["n_sequences", "n_attack_sequences", "n_events", "n_attack_events"]
    wrong = validation.impossible_summary_rows(summary).select(
        "summary_label", "split", "day", F.lit(True).alias("is_impossible")
    )
    # A summary has a row for each day and split.
    marked = summary.join(wrong, ["summary_label", "split", "day"], "left")
    return marked.select(
        "summary_label", "split", "day", *columns,
        F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"),
    )


@query("traj_integrity", f"""{with_ctes(FLOWS, TRAJECTORIES)}
SELECT *, n_sequences_checked > 0 AND n_attack_events_gt_n_events + n_events_ne_seq_len
  + n_attack_events_ne_sum_y_seq + seq_y_ne_max_y_seq + full_seq_len_lt_seq_len
  + full_n_attack_events_lt_n_attack_events = 0 AS passed FROM (
SELECT count(*) AS n_sequences_checked,
  count(*) FILTER (WHERE n_attack_events > n_events) AS n_attack_events_gt_n_events,
  count(*) FILTER (WHERE n_events <> seq_len) AS n_events_ne_seq_len,
  count(*) FILTER (WHERE n_attack_events <> list_sum(y_seq)) AS n_attack_events_ne_sum_y_seq,
  count(*) FILTER (WHERE seq_y <> list_max(y_seq)) AS seq_y_ne_max_y_seq,
  count(*) FILTER (WHERE full_seq_len < seq_len) AS full_seq_len_lt_seq_len,
  count(*) FILTER (WHERE full_n_attack_events < n_attack_events)
    AS full_n_attack_events_lt_n_attack_events
FROM traj_seqs)""")
def traj_integrity(spark, sf_dir):
    return validation.trajectory_integrity(sequence_queries.trajectories_(spark, sf_dir))
