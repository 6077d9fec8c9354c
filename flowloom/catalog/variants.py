"""The same operators under the other settings they have: edge families, entities, faulty input."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import graphs as graph_queries
from flowloom.catalog import sequences as sequence_queries
from flowloom.catalog.base import (
    DAY_SECONDS, EVENT_GROUPS, FLOWS, GRAPHS, RAW, TOKEN_GROUPS, TOKEN_MIN,
    TOKENS, TRAJECTORIES, chain_cte, query, tidy, tidy_sql, with_ctes,
)
from flowloom.catalog.evaluation import rates_sql, sweep_sql, tidy_metrics
from flowloom.functions.keys import ENTITY_MODES
from flowloom.operators import encoding, graphs, metrics, sequences, splits
from flowloom.sources.adapters import read_flows, read_raw_flows

CHAIN_COLUMNS = {"src": "source_ip", "dst": "destination_ip", "svc": "destination_port, protocol"}


def _edge_family(name, family, k):
    chains = graphs.EDGE_FAMILIES[family]
    parts = [chain_cte(f"chain_{c}", CHAIN_COLUMNS[c], k) for c in chains]
    both = " UNION ALL ".join(
        f"SELECT graph_id, {a}, {b} FROM chain_{c}"
        for c in chains
        for a, b in (("src", "dst"), ("dst", "src"))
    )

    def run(spark, sf_dir):
        return graph_queries.edges_of_nodes(spark, sf_dir, family=family, k=k)

    sql = f"{with_ctes(FLOWS, GRAPHS, *parts)} SELECT DISTINCT graph_id, src, dst FROM ({both})"
    query(name, sql)(run)


_edge_family("graph_edges_src_k5", "src_only", 5)
_edge_family("graph_edges_src_dst_k10", "src+dst", 10)


def _entity_mode(mode):
    entity = " || '::' || ".join(
        f"coalesce(CAST({c} AS VARCHAR), 'NA')" for c in ENTITY_MODES[mode]
    )

    def run(spark, sf_dir):
        events = sequences.token_events(read_flows(spark, sf_dir), mode, DAY_SECONDS)
        built = sequences.long_enough(sequences.token_sequences(events), 1)
        return built.select("seq_id", "entity", "seq_y", "n_flows", "seq_len")

    query(f"token_sequences_{mode}", f"""{with_ctes(FLOWS)}
SELECT day || '_' || CAST(ts_unix // {DAY_SECONDS} AS VARCHAR) || '_' || entity AS seq_id, entity,
  max(y) AS seq_y, count(*) AS n_flows, CAST(least(count(*), {sequences.TOKEN_CAP}) AS INTEGER)
    AS seq_len
FROM (SELECT *, {entity} AS entity FROM flows) GROUP BY day, ts_unix // {DAY_SECONDS}, entity""")(run)


for _mode in ENTITY_MODES:
    _entity_mode(_mode)

MEASURES = ["flow_duration", "total_fwd_packets"]
FINITE = {
    c: f"CASE WHEN {c} IS NULL THEN NULL WHEN isfinite({c}) THEN {c} ELSE 0.0::DOUBLE END"
    for c in MEASURES
}


@query("feature_stats_faulty", f"""{with_ctes(FLOWS, RAW)}
SELECT {', '.join(f"{tidy_sql(f'avg({x})', 3)} AS {c}_mean, "
                  f"{tidy_sql(f'stddev_pop({x})', 3)} AS {c}_std" for c, x in FINITE.items())}
FROM raw""")
def feature_stats_faulty(spark, sf_dir):
    """Statistics of raw measures that hold NaN, infinities and nulls."""
    stats = encoding.feature_stats(read_raw_flows(spark, sf_dir), MEASURES)
    return stats.select(*[tidy(c, 3) for c in stats.columns])


@query("vectors_scaled_faulty", f"""{with_ctes(FLOWS, RAW)},
v AS (SELECT event_id, {', '.join(f'coalesce({x}, 0.0::DOUBLE) AS {c}' for c, x in FINITE.items())}
  FROM raw),
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-6) AS s_{c}'
                        for c in MEASURES)} FROM v)
SELECT CAST(event_id AS BIGINT) AS event_id, {', '.join(
    tidy_sql(f'greatest(least(({c} - m_{c}) / s_{c}, 5.0::DOUBLE), -5.0::DOUBLE)', 4)
    + f' AS {c}_z' for c in MEASURES)}
FROM v, s""")
def vectors_scaled_faulty(spark, sf_dir):
    """Trajectory vectors of raw measures, scaled."""
    rows = read_raw_flows(spark, sf_dir).select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.array(F.array(*[F.col(c).cast("double") for c in MEASURES])).alias("x"),
    )
    scaled = encoding.standardise_vectors(rows, encoding.vector_stats(rows, len(MEASURES)))
    values = [F.col("x")[0][d].alias(f"{c}_z") for d, c in enumerate(MEASURES)]
    return scaled.select("event_id", *values).select("event_id", *[tidy(f"{c}_z", 4) for c in MEASURES])


FAULTY_SCORES = """
scores AS (
  SELECT y, CASE event_id % 40 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
    WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN 1e300::DOUBLE ELSE value / 400.0::DOUBLE END AS score
  FROM flows
)"""


@query("threshold_sweep_faulty", f"""{with_ctes(FLOWS, FAULTY_SCORES)},
c AS ({sweep_sql('scores', metrics.GRID)}) {rates_sql('c', 'threshold')}""")
def threshold_sweep_faulty(spark, sf_dir):
    """Scores with NaN, infinities and numbers far beyond the grid."""
    score = F.expr(
        "CASE event_id % 40 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity')"
        " WHEN 2 THEN double('-Infinity') WHEN 3 THEN 1e300D ELSE value / 400.0D END"
    )
    y = F.when(F.col("label") == "BENIGN", 0).otherwise(1)
    rows = read_flows(spark, sf_dir).select(score.alias("score"), y.alias("y"))
    return tidy_metrics(metrics.threshold_sweep(rows, "score", "y"), ["threshold"])


@query("prep_stats_tokens", f"""{with_ctes(FLOWS, TOKENS)},
kept_groups AS (SELECT day, split_group_id, max(seq_y) AS group_y FROM token_seqs GROUP BY ALL)
SELECT CAST(sum(full_seq_len) AS BIGINT) AS rows_after_timestamp_filter,
  count(*) AS sequences_before_min_len_filter,
  (SELECT count(*) FROM token_seqs) AS sequences_after_min_len_filter,
  count(*) - (SELECT count(*) FROM token_seqs) AS sequences_dropped_short,
  (SELECT count(*) FROM token_seqs WHERE was_truncated) AS sequences_truncated_after_filter,
  (SELECT count(*) FROM kept_groups) AS n_split_groups,
  (SELECT count(*) FROM kept_groups WHERE group_y = 1) AS n_attack_split_groups,
  (SELECT count(*) FROM kept_groups WHERE group_y = 0) AS n_benign_split_groups
FROM token_all""")
def prep_stats_tokens(spark, sf_dir):
    built = sequence_queries.all_token_sequences(spark, sf_dir)
    return sequences.preparation_counts(built, TOKEN_MIN).drop("truncated_attack_events_removed")


def _targets(name, parts, table, rule, groups):
    measures = list(rule.measures)
    sums = ", ".join(f"sum({m}) AS {m}" for m in measures)
    shares = "(VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE))"
    wanted = ", ".join(f"{tidy_sql(f'{m} * s.ratio', 3)} AS target_{m}" for m in measures)

    def run(spark, sf_dir):
        targets = splits.split_targets(groups(spark, sf_dir), rule)
        names = ["target_n_units", *[f"target_{m}" for m in measures]]
        return targets.select("day", "target_class", "split", *[tidy(c, 3) for c in names])

    query(name, f"""{with_ctes(*parts)},
totals AS (SELECT day, group_y, count(*) AS n, {sums} FROM {table}
  GROUP BY GROUPING SETS ((day), (day, group_y)))
SELECT day, group_y AS target_class, s.split, {tidy_sql('n * s.ratio', 3)} AS target_n_units, {wanted}
FROM totals, {shares} AS s(split, ratio)""")(run)


_targets(
    "split_targets_tokens", [FLOWS, TOKENS, TOKEN_GROUPS], "token_groups", splits.TOKEN_RULE,
    lambda spark, sf_dir: sequences.token_groups(sequence_queries.token_sequences_(spark, sf_dir)),
)
_targets(
    "split_targets_events", [FLOWS, TRAJECTORIES, EVENT_GROUPS], "event_groups", splits.EVENT_RULE,
    lambda spark, sf_dir: sequences.event_groups(sequence_queries.trajectories_(spark, sf_dir)),
)
