"""Registry of the queries and the SQL building blocks they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its equivalent."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def tidy(name: str, digits: int = 5) -> Column:
    """Rounded column. The small shift keeps exact halves from depending on the engine."""
    return F.round(F.col(name) + F.lit(1e-9), digits).alias(name)


def tidy_sql(expression: str, digits: int = 5) -> str:
    return f"round({expression} + 1e-9::DOUBLE, {digits})"


GRAPH_SECONDS = 3600
DAY_SECONDS = 86400
TOKEN_CAP = 2048
# A tail short enough to cut sequences of the tables, for the queries about cutting.
SHORT_TAIL = 4
TOKEN_MIN = 2
TRAJECTORY_CAP = 2000
SHORT_TRAJECTORY = 40
TRAJECTORY_MIN = 5
SEED = 42

FLOWS = """
flows AS (
  SELECT event_id, user_id, event_type, value, k,
    CAST(event_id AS VARCHAR) AS flow_id,
    'u' || CAST(user_id AS VARCHAR) AS source_ip,
    CAST(1024 + event_id % 50000 AS INTEGER) AS source_port,
    'h' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS destination_ip,
    CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8443
      WHEN 'signup' THEN 22 WHEN 'error' THEN 53 ELSE 0 END AS destination_port,
    CASE event_type WHEN 'error' THEN 17 WHEN 'click' THEN 6 WHEN 'view' THEN 6
      WHEN 'purchase' THEN 6 WHEN 'signup' THEN 6 ELSE 0 END AS protocol,
    ts AS "timestamp",
    CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix,
    strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN event_type = 'error' THEN 'ATTACK' ELSE 'BENIGN' END AS label,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
    value * 1000.0::DOUBLE AS flow_duration,
    k AS total_fwd_packets,
    floor(value / 10.0::DOUBLE) AS total_backward_packets,
    value * 100.0::DOUBLE AS total_length_of_fwd_packets,
    k * 1000.0::DOUBLE AS total_length_of_bwd_packets,
    value * k AS flow_packets_s,
    CAST(event_id % 2 AS DOUBLE) AS fin_flag_count,
    k % 2 AS syn_flag_count,
    k % 3 AS rst_flag_count,
    CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END AS psh_flag_count,
    CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS ack_flag_count,
    0.0 AS urg_flag_count
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events)
)"""

RAW = """
raw AS (
  SELECT event_id,
    CASE WHEN event_id % 13 <> 0 THEN flow_id END AS flow_id,
    CASE WHEN event_id % 17 <> 0 THEN source_ip END AS source_ip,
    CASE WHEN event_id % 19 <> 0 THEN source_port END AS source_port,
    destination_ip,
    CASE WHEN event_id % 23 <> 0 THEN destination_port END AS destination_port,
    CASE WHEN event_id % 29 <> 0 THEN protocol END AS protocol,
    CASE WHEN event_id % 31 = 0 THEN NULL
      WHEN event_id % 2 = 0 THEN date_trunc('second', "timestamp")
      ELSE date_trunc('minute', "timestamp") END AS parsed,
    CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN '  '
      WHEN event_id % 43 = 0 THEN ' ' || label || ' ' ELSE label END AS label,
    CASE WHEN event_id % 47 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 53 = 0 THEN 'Infinity'::DOUBLE
      WHEN event_id % 59 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 61 = 0 THEN NULL
      WHEN event_id % 67 = 0 THEN -flow_duration ELSE flow_duration END AS flow_duration,
    CASE WHEN event_id % 71 <> 0 THEN total_fwd_packets END AS total_fwd_packets,
    total_backward_packets,
    total_backward_packets AS copied_packets,
    CASE WHEN event_id % 997 = 0 THEN -1.0 ELSE total_backward_packets END AS changed_packets,
    CASE event_id % 4 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Friday'
      ELSE 'Sunday' END
      || CASE event_id % 3 WHEN 0 THEN '-Morning' WHEN 1 THEN '-Afternoon' ELSE '' END
      || '.csv' AS source_file
  FROM flows
)"""

GRAPHS = f"""
keyed AS (
  SELECT *, ts_unix // {GRAPH_SECONDS} AS window_id,
    day || '_' || CAST(ts_unix // {GRAPH_SECONDS} AS VARCHAR) AS graph_id
  FROM flows
),
nodes AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY graph_id ORDER BY "timestamp", flow_id) - 1 AS INTEGER) AS node_id
  FROM keyed
),
graphs AS (
  SELECT graph_id, day, window_id, max(y) AS graph_y, count(*) AS n_nodes,
    CAST(sum(y) AS BIGINT) AS n_pos_nodes, sum(y) / count(*)::DOUBLE AS attack_ratio
  FROM keyed GROUP BY graph_id, day, window_id
)"""


def chain_cte(name: str, columns: str, k: int) -> str:
    hops = " UNION ALL ".join(
        f"""SELECT graph_id, node_id AS src, lead(node_id, {hop}) OVER (
          PARTITION BY graph_id, {columns} ORDER BY "timestamp", node_id) AS dst FROM nodes"""
        for hop in range(1, k + 1)
    )
    return f"{name} AS (SELECT * FROM ({hops}) WHERE dst IS NOT NULL)"


EDGE_K = 3
EDGES = ",\n".join(
    [
        chain_cte("chain_src", "source_ip", EDGE_K),
        chain_cte("chain_dst", "destination_ip", EDGE_K),
        chain_cte("chain_svc", "destination_port, protocol", EDGE_K),
        """
edges AS (
  SELECT DISTINCT graph_id, src, dst FROM (
    SELECT * FROM (SELECT * FROM chain_src UNION ALL SELECT * FROM chain_dst
      UNION ALL SELECT * FROM chain_svc)
    UNION ALL
    SELECT graph_id, dst, src FROM (SELECT * FROM chain_src UNION ALL SELECT * FROM chain_dst
      UNION ALL SELECT * FROM chain_svc)
  )
)""",
    ]
)


def split_case(rank: str) -> str:
    return f"CASE WHEN {rank} < 0.7 THEN 'train' WHEN {rank} < 0.85 THEN 'val' ELSE 'test' END"


GRAPH_SPLIT = f"""
graph_split AS (
  SELECT *, {split_case("pr")} AS split FROM (
    SELECT *, percent_rank() OVER (PARTITION BY day, graph_y
      ORDER BY md5('{SEED}|' || graph_id), graph_id) AS pr FROM graphs)
)"""

BUCKETS = {
    "DUR_": [0, 1, 10, 100, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1.2e8],
    "PKT": [0, 1, 2, 5, 10, 20, 50, 100, 1e3, 1e4, 1e5, 3e5],
    "BYT_": [0, 1, 64, 512, 4096, 65536, 1048576, 10485760, 104857600, 524288000, 7e8],
    "PPS_": [0, 1, 10, 100, 1e3, 1e4, 1e5, 1e6, 1e7],
}


def bucket_case(value: str, edges: list[float], prefix: str) -> str:
    arms = " ".join(
        f"WHEN {value} >= {edges[i]} AND {value} < {edges[i + 1]} THEN '{prefix}B{i}'"
        for i in range(len(edges) - 1)
    )
    return f"CASE {arms} ELSE '{prefix}B{len(edges) - 1}' END"


FLAGS = """coalesce(nullif(
    CASE WHEN fin_flag_count > 0 THEN 'F' ELSE '' END
    || CASE WHEN syn_flag_count > 0 THEN 'S' ELSE '' END
    || CASE WHEN rst_flag_count > 0 THEN 'R' ELSE '' END
    || CASE WHEN psh_flag_count > 0 THEN 'P' ELSE '' END
    || CASE WHEN ack_flag_count > 0 THEN 'A' ELSE '' END
    || CASE WHEN urg_flag_count > 0 THEN 'U' ELSE '' END, ''), 'N')"""

TOKEN = f"""concat_ws('|', 'PR_' || protocol, 'DP_' || destination_port,
    {bucket_case("flow_duration", BUCKETS["DUR_"], "DUR_")},
    {bucket_case("total_fwd_packets", BUCKETS["PKT"], "FWD_")},
    {bucket_case("total_backward_packets", BUCKETS["PKT"], "BWD_")},
    {bucket_case("(total_length_of_fwd_packets + total_length_of_bwd_packets)",
                 BUCKETS["BYT_"], "BYT_")},
    {bucket_case("flow_packets_s", BUCKETS["PPS_"], "PPS_")},
    'FL_' || {FLAGS})"""

# Sequences of a user on a day; the service column is left out so that they have a length.
TOKENS = f"""
token_events AS (
  SELECT day || '_' || CAST(ts_unix // {DAY_SECONDS} AS VARCHAR) || '_' || source_ip AS seq_id,
    day, ts_unix // {DAY_SECONDS} AS window_id, source_ip AS entity,
    day || '::' || source_ip AS split_group_id, "timestamp", flow_id, y, {TOKEN} AS token
  FROM flows
),
token_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq_id
      ORDER BY "timestamp" DESC, flow_id DESC, token DESC) AS tail_rank,
    count(*) OVER (PARTITION BY seq_id) AS n_flows
  FROM token_events
),
token_all AS (
  SELECT seq_id, day, window_id, entity, split_group_id, max(y) AS seq_y,
    count(*) AS n_flows, min("timestamp") AS seq_start_ts, max("timestamp") AS seq_end_ts,
    list(token ORDER BY tail_rank DESC) FILTER (WHERE tail_rank <= {TOKEN_CAP}) AS tokens,
    CAST(count(*) AS INTEGER) AS full_seq_len, count(*) > {TOKEN_CAP} AS was_truncated,
    CAST(count(*) FILTER (WHERE tail_rank <= {TOKEN_CAP}) AS INTEGER) AS seq_len
  FROM token_ranked GROUP BY seq_id, day, window_id, entity, split_group_id
),
token_seqs AS (SELECT * FROM token_all WHERE seq_len >= {TOKEN_MIN})"""

TOKEN_GROUPS = """
token_groups AS (
  SELECT day, split_group_id, min(entity) AS entity, max(seq_y) AS group_y,
    count(*) AS n_sequences, CAST(sum(seq_y) AS BIGINT) AS n_attack_sequences,
    count(*) FILTER (WHERE was_truncated) AS n_truncated_sequences,
    min(seq_start_ts) AS group_start_ts, max(seq_end_ts) AS group_end_ts,
    CAST(sum(seq_len) AS BIGINT) AS n_tokens, sum(seq_y) / count(*)::DOUBLE AS attack_ratio
  FROM token_seqs GROUP BY day, split_group_id
)"""

TOKEN_SPLIT = f"""
token_split AS (
  SELECT *, {split_case("pr")} AS split FROM (
    SELECT *, percent_rank() OVER (ORDER BY group_start_ts, day, split_group_id) AS pr
    FROM token_groups)
),
split_seqs AS (
  SELECT s.*, g.split FROM token_seqs s JOIN token_split g USING (day, split_group_id)
)"""

# Trajectories of a service on a day; large values count as attacks, so labels vary inside.


def trajectories_sql(cap: int) -> str:
    return f"""
traj_events AS (
  SELECT day || '_' || CAST(ts_unix // {DAY_SECONDS} AS VARCHAR) || '_' || entity AS seq_id,
    day, ts_unix // {DAY_SECONDS} AS window_id, entity, day || '::' || entity AS split_group_id,
    "timestamp", ts_unix, flow_id, value, k, y
  FROM (SELECT * REPLACE (CASE WHEN value > 150 THEN 1 ELSE 0 END AS y),
      CAST(destination_port AS VARCHAR) || '::' || CAST(protocol AS VARCHAR) AS entity FROM flows)
),
traj_full AS (
  SELECT seq_id, day, window_id, entity, split_group_id, count(*) AS full_seq_len,
    CAST(sum(y) AS BIGINT) AS full_n_attack_events, count(*) > {cap} AS was_truncated
  FROM traj_events GROUP BY ALL
),
traj_kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id
      ORDER BY ts_unix DESC, flow_id DESC) AS tail_rank FROM traj_events)
  WHERE tail_rank <= {cap}
),
traj_payload AS (
  SELECT seq_id, min("timestamp") AS seq_start_ts, max("timestamp") AS seq_end_ts,
    CAST(count(*) AS INTEGER) AS seq_len, CAST(count(*) AS INTEGER) AS n_events,
    CAST(sum(y) AS INTEGER) AS n_attack_events, max(y) AS seq_y,
    list(ts_unix ORDER BY tail_rank DESC) AS t,
    list(value ORDER BY tail_rank DESC) AS xv, list(k ORDER BY tail_rank DESC) AS xk,
    list(y ORDER BY tail_rank DESC) AS y_seq
  FROM traj_kept GROUP BY seq_id
),
traj_all AS (SELECT * FROM traj_full JOIN traj_payload USING (seq_id)),
traj_seqs AS (SELECT * FROM traj_all WHERE seq_len >= {TRAJECTORY_MIN})"""


TRAJECTORIES = trajectories_sql(TRAJECTORY_CAP)

EVENT_GROUPS = """
event_groups AS (
  SELECT day, split_group_id, min(entity) AS entity, max(seq_y) AS group_y,
    count(*) AS n_sequences, CAST(sum(seq_y) AS BIGINT) AS n_attack_sequences,
    count(*) FILTER (WHERE was_truncated) AS n_truncated_sequences,
    min(seq_start_ts) AS group_start_ts, max(seq_end_ts) AS group_end_ts,
    CAST(sum(n_events) AS BIGINT) AS n_events,
    CAST(sum(n_attack_events) AS BIGINT) AS n_attack_events,
    sum(seq_y) / count(*)::DOUBLE AS attack_ratio,
    sum(n_attack_events) / greatest(sum(n_events), 1)::DOUBLE AS positive_event_rate
  FROM traj_seqs GROUP BY day, split_group_id
)"""

EVENT_SPLIT = f"""
event_split AS (
  SELECT *, {split_case("pr")} AS split FROM (
    SELECT *, percent_rank() OVER (ORDER BY group_start_ts, day, split_group_id) AS pr
    FROM event_groups)
),
split_trajs AS (
  SELECT s.*, g.split FROM traj_seqs s JOIN event_split g USING (day, split_group_id)
),
traj_rows AS (
  SELECT seq_id, day, split, seq_y, unnest(t) AS t, unnest(xv) AS value, unnest(xk) AS k,
    unnest(y_seq) AS y, generate_subscripts(t, 1) - 1 AS pos
  FROM split_trajs
)"""

SCORES = """
scores AS (
  SELECT event_id, day, y,
    floor((draw + y * 0.5::DOUBLE) / 1.5::DOUBLE * 1000) / 1000::DOUBLE AS score
  FROM (SELECT *, CAST('0x' || substr(md5('score|' || flow_id), 1, 8) AS BIGINT)
      / 4294967296.0::DOUBLE AS draw FROM flows)
)"""
