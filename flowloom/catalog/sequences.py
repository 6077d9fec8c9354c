"""Queries on token sequences and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import (
    DAY_SECONDS, EVENT_GROUPS, FLOWS, SHORT_TAIL, SHORT_TRAJECTORY, TOKEN_CAP, TOKEN_GROUPS,
    TOKEN_MIN, TOKEN_SPLIT, TOKENS, TRAJECTORIES, TRAJECTORY_CAP, TRAJECTORY_MIN, query,
    trajectories_sql, with_ctes,
)
from flowloom.functions.tokens import tail
from flowloom.operators import sequences, splits
from flowloom.plans.staging import stage
from flowloom.sources.adapters import read_flows

FEATURES = ["value", "k"]
TOKEN_SQL = with_ctes(FLOWS, TOKENS)
TRAJECTORY_SQL = with_ctes(FLOWS, TRAJECTORIES)
SHORT_SQL = with_ctes(FLOWS, trajectories_sql(SHORT_TRAJECTORY))


def token_events(spark, sf_dir):
    return sequences.token_events(read_flows(spark, sf_dir), ["source_ip"], DAY_SECONDS)


def all_token_sequences(spark, sf_dir):
    return sequences.token_sequences(token_events(spark, sf_dir), TOKEN_CAP)


def token_sequences_(spark, sf_dir):
    return sequences.long_enough(all_token_sequences(spark, sf_dir), TOKEN_MIN)


def split_token_sequences(spark, sf_dir):
    kept = stage(token_sequences_(spark, sf_dir))
    assigned = splits.temporal_split(sequences.token_groups(kept))
    return sequences.with_split(kept, assigned)


def trajectory_events(spark, sf_dir):
    flows = read_flows(spark, sf_dir).withColumn(
        "label", F.when(F.col("value") > 150, "ATTACK").otherwise("BENIGN")
    )
    return sequences.trajectory_events(
        flows, ["destination_port", "protocol"], FEATURES, DAY_SECONDS
    )


def all_trajectories(spark, sf_dir, cap=TRAJECTORY_CAP):
    return sequences.trajectories(trajectory_events(spark, sf_dir), cap)


def trajectories_(spark, sf_dir):
    return sequences.long_enough(all_trajectories(spark, sf_dir), TRAJECTORY_MIN)


def split_trajectories(spark, sf_dir):
    kept = stage(trajectories_(spark, sf_dir))
    assigned = splits.temporal_split(sequences.event_groups(kept))
    return sequences.with_split(kept, assigned)


def seconds(column):
    return F.unix_seconds(column).alias(column)


def sql_seconds(column):
    return f"CAST(floor(epoch({column})) AS BIGINT) AS {column}"


@query("token_sequences", f"""{TOKEN_SQL}
SELECT seq_id, day, window_id, entity, split_group_id, seq_y, n_flows, full_seq_len,
  was_truncated, seq_len, {sql_seconds('seq_start_ts')}, {sql_seconds('seq_end_ts')},
  array_to_string(tokens, ' ') AS tokens FROM token_seqs""")
def token_sequences(spark, sf_dir):
    return token_sequences_(spark, sf_dir).select(
        "seq_id", "day", "window_id", "entity", "split_group_id", "seq_y", "n_flows",
        "full_seq_len", "was_truncated", "seq_len", seconds("seq_start_ts"),
        seconds("seq_end_ts"), F.array_join("tokens", " ").alias("tokens"),
    )


@query("tail_cap", f"""{TOKEN_SQL}
SELECT seq_id, flow_id, token FROM token_ranked WHERE tail_rank <= {SHORT_TAIL}""")
def tail_cap(spark, sf_dir):
    order = ["timestamp", "flow_id", "token"]
    kept = sequences.tail_cap(token_events(spark, sf_dir), order, SHORT_TAIL)
    return kept.select("seq_id", "flow_id", "token")


@query("tail_slice", f"""{TOKEN_SQL}
SELECT seq_id, array_to_string(list_slice(tokens, -2, -1), ' ') AS last_tokens FROM token_seqs""")
def tail_slice(spark, sf_dir):
    kept = token_sequences_(spark, sf_dir)
    return kept.select("seq_id", F.array_join(tail("tokens", 2), " ").alias("last_tokens"))


META = """seq_id, day, window_id, entity, split_group_id, seq_y, n_flows, full_seq_len,
  was_truncated, seq_len"""


@query("seq_meta", f"{TOKEN_SQL} SELECT {META} FROM token_seqs")
def seq_meta(spark, sf_dir):
    meta = sequences.sequence_meta(token_sequences_(spark, sf_dir))
    return meta.drop("seq_start_ts", "seq_end_ts")


@query("meta_dedupe", f"{TOKEN_SQL} SELECT {META} FROM token_seqs")
def meta_dedupe(spark, sf_dir):
    meta = seq_meta(spark, sf_dir)
    return sequences.unique_meta(meta.unionByName(meta))


@query("seq_with_split", f"""{with_ctes(FLOWS, TOKENS, TOKEN_GROUPS, TOKEN_SPLIT)}
SELECT seq_id, day, split_group_id, seq_y, seq_len, split FROM split_seqs""")
def seq_with_split(spark, sf_dir):
    return split_token_sequences(spark, sf_dir).select(
        "seq_id", "day", "split_group_id", "seq_y", "seq_len", "split"
    )


@query("group_stats_tokens", f"""{with_ctes(FLOWS, TOKENS, TOKEN_GROUPS)}
SELECT day, split_group_id, entity, group_y, n_sequences, n_attack_sequences,
  n_truncated_sequences, {sql_seconds('group_start_ts')}, {sql_seconds('group_end_ts')},
  n_tokens, round(attack_ratio, 6) AS attack_ratio FROM token_groups""")
def group_stats_tokens(spark, sf_dir):
    groups = sequences.token_groups(token_sequences_(spark, sf_dir))
    return groups.select(
        "day", "split_group_id", "entity", "group_y", "n_sequences", "n_attack_sequences",
        "n_truncated_sequences", seconds("group_start_ts"), seconds("group_end_ts"), "n_tokens",
        F.round("attack_ratio", 6).alias("attack_ratio"),
    )


@query("traj_full_stats", f"{TRAJECTORY_SQL} SELECT * FROM traj_full")
def traj_full_stats(spark, sf_dir):
    return sequences.full_stats(trajectory_events(spark, sf_dir), TRAJECTORY_CAP)


@query("traj_build", f"""{TRAJECTORY_SQL}
SELECT seq_id, day, window_id, entity, split_group_id, full_seq_len, full_n_attack_events,
  was_truncated, {sql_seconds('seq_start_ts')}, {sql_seconds('seq_end_ts')}, seq_y, seq_len,
  n_events, n_attack_events, array_to_string(t, ',') AS t, array_to_string(y_seq, ',') AS y_seq,
  round(list_sum(xv), 4) AS value_sum, round(list_sum(xk), 4) AS k_sum,
  round(xv[-1], 4) AS last_value FROM traj_seqs""")
def traj_build(spark, sf_dir):
    def total(d):
        values = F.transform("x", lambda v: v[d])
        return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 4)

    return trajectories_(spark, sf_dir).select(
        *sequences.KEYS, "full_seq_len", "full_n_attack_events", "was_truncated",
        seconds("seq_start_ts"), seconds("seq_end_ts"), "seq_y", "seq_len", "n_events",
        "n_attack_events",
        F.array_join(F.col("t").cast("array<string>"), ",").alias("t"),
        F.array_join(F.col("y_seq").cast("array<string>"), ",").alias("y_seq"),
        total(0).alias("value_sum"),
        total(1).alias("k_sum"),
        F.round(F.element_at("x", -1)[0], 4).alias("last_value"),
    )


@query("group_stats_events", f"""{with_ctes(FLOWS, TRAJECTORIES, EVENT_GROUPS)}
SELECT day, split_group_id, entity, group_y, n_sequences, n_attack_sequences,
  n_truncated_sequences, {sql_seconds('group_start_ts')}, {sql_seconds('group_end_ts')},
  n_events, n_attack_events, round(attack_ratio, 6) AS attack_ratio,
  round(positive_event_rate, 6) AS positive_event_rate FROM event_groups""")
def group_stats_events(spark, sf_dir):
    groups = sequences.event_groups(trajectories_(spark, sf_dir))
    return groups.select(
        "day", "split_group_id", "entity", "group_y", "n_sequences", "n_attack_sequences",
        "n_truncated_sequences", seconds("group_start_ts"), seconds("group_end_ts"),
        "n_events", "n_attack_events", F.round("attack_ratio", 6).alias("attack_ratio"),
        F.round("positive_event_rate", 6).alias("positive_event_rate"),
    )


@query("traj_capped", f"""{SHORT_SQL}
SELECT seq_id, full_seq_len, was_truncated, seq_len, full_n_attack_events, n_attack_events,
  array_to_string(t, ',') AS t, array_to_string(y_seq, ',') AS y_seq FROM traj_all""")
def traj_capped(spark, sf_dir):
    """The tail cap at work: a cap below the length of most trajectories."""
    capped = all_trajectories(spark, sf_dir, SHORT_TRAJECTORY)
    return capped.select(
        "seq_id", "full_seq_len", "was_truncated", "seq_len", "full_n_attack_events",
        "n_attack_events", F.array_join(F.col("t").cast("array<string>"), ",").alias("t"),
        F.array_join(F.col("y_seq").cast("array<string>"), ",").alias("y_seq"),
    )


@query("prep_stats", f"""{SHORT_SQL},
kept_groups AS (SELECT day, split_group_id, max(seq_y) AS group_y FROM traj_seqs GROUP BY ALL)
SELECT CAST(sum(full_seq_len) AS BIGINT) AS rows_after_timestamp_filter,
  count(*) AS sequences_before_min_len_filter,
  (SELECT count(*) FROM traj_seqs) AS sequences_after_min_len_filter,
  count(*) - (SELECT count(*) FROM traj_seqs) AS sequences_dropped_short,
  (SELECT count(*) FROM traj_seqs WHERE was_truncated) AS sequences_truncated_after_filter,
  (SELECT CAST(sum(full_n_attack_events - n_attack_events) AS BIGINT) FROM traj_seqs)
    AS truncated_attack_events_removed,
  (SELECT count(*) FROM kept_groups) AS n_split_groups,
  (SELECT count(*) FROM kept_groups WHERE group_y = 1) AS n_attack_split_groups,
  (SELECT count(*) FROM kept_groups WHERE group_y = 0) AS n_benign_split_groups
FROM traj_all""")
def prep_stats(spark, sf_dir):
    return sequences.preparation_counts(
        all_trajectories(spark, sf_dir, SHORT_TRAJECTORY), TRAJECTORY_MIN
    )


@query("dataset_counts", f"""{with_ctes(FLOWS, TOKENS, TOKEN_GROUPS, TOKEN_SPLIT)}
SELECT split, count(*) AS n_total, count(*) FILTER (WHERE seq_y = 0) AS n_benign,
  count(*) FILTER (WHERE seq_y = 1) AS n_attack FROM split_seqs GROUP BY split""")
def dataset_counts(spark, sf_dir):
    return sequences.dataset_counts(split_token_sequences(spark, sf_dir))
