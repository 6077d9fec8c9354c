"""Queries on reading, cleaning and keying flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import (
    DAY_SECONDS, FLAGS, FLOWS, GRAPH_SECONDS, RAW, SEED, TOKEN, bucket_case, BUCKETS, query,
    with_ctes,
)
from flowloom.functions import keys, tokens
from flowloom.operators import cleaning
from flowloom.plans.lookups import attach_row
from flowloom.plans.staging import new_path
from flowloom.sources import flows as flow_files
from flowloom.sources import sinks
from flowloom.sources.adapters import (
    lineitems_as_flows, read_flows, read_raw_flows, read_table,
)

RAW_SQL = with_ctes(FLOWS, RAW)
FLOW_SQL = with_ctes(FLOWS)


@query("src_flows", f"""{FLOW_SQL}
SELECT event_id, flow_id, source_ip, source_port, destination_ip, destination_port, protocol,
  ts_unix, day, label, flow_duration, total_fwd_packets FROM flows""")
def src_flows(spark, sf_dir):
    return read_flows(spark, sf_dir).select(
        "event_id", "flow_id", "source_ip", "source_port", "destination_ip", "destination_port",
        "protocol", F.unix_seconds("timestamp").alias("ts_unix"), "day", "label",
        "flow_duration", "total_fwd_packets",
    )


@query("filter_valid_port", f"""{RAW_SQL}
SELECT event_id, destination_port FROM raw WHERE destination_port IS NOT NULL""")
def filter_valid_port(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir)
    return flow_files.valid_port(raw, "destination_port").select("event_id", "destination_port")


@query("parse_ts_multi", f"""{RAW_SQL}
SELECT event_id, CAST(floor(epoch(parsed)) AS BIGINT) AS ts_unix,
  strftime(parsed, '%Y-%m-%d %H:%M:%S') AS ts_text FROM raw""")
def parse_ts_multi(spark, sf_dir):
    parsed = flow_files.parse_timestamp(F.col("timestamp_text"))
    return (
        read_raw_flows(spark, sf_dir)
        .withColumn("parsed", parsed)
        .select(
            "event_id",
            F.unix_seconds("parsed").alias("ts_unix"),
            F.date_format("parsed", flow_files.CLEAN_FORMAT).alias("ts_text"),
        )
    )


@query("tag_day_part", f"""{RAW_SQL}
SELECT event_id,
  CASE WHEN source_file LIKE '%Monday%' THEN 'Monday' WHEN source_file LIKE '%Tuesday%'
    THEN 'Tuesday' WHEN source_file LIKE '%Friday%' THEN 'Friday' ELSE 'Unknown' END AS day,
  CASE WHEN source_file LIKE '%Morning%' THEN 'Morning'
    WHEN source_file LIKE '%Afternoon%' THEN 'Afternoon' ELSE 'AllDay' END AS time_of_day
FROM raw""")
def tag_day_part(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir)
    tagged = flow_files.tag_source(raw, F.col("source_file"))
    return tagged.select("event_id", "day", "time_of_day")


@query("union_sources", f"""{FLOW_SQL}
SELECT source_ip, destination_ip, label, count(*) AS n_flows FROM (
  SELECT source_ip, destination_ip, label FROM flows UNION ALL
  SELECT 's' || l_suppkey, 'p' || l_partkey,
    CASE WHEN l_returnflag = 'R' THEN 'ATTACK' ELSE 'BENIGN' END FROM lineitem)
GROUP BY ALL""")
def union_sources(spark, sf_dir):
    columns = ["source_ip", "destination_ip", "label"]
    events = read_flows(spark, sf_dir).select(*columns)
    orders = lineitems_as_flows(read_table(spark, sf_dir, "lineitem")).select(*columns[::-1])
    both = flow_files.union_sources([events, orders])
    return both.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_flows"))


@query("source_row_audit", f"""{RAW_SQL}
SELECT CASE WHEN grouping(source_file) = 1 THEN 'ALL' ELSE source_file END AS source_file,
  count(*) AS n_rows
FROM raw WHERE destination_port IS NOT NULL GROUP BY ROLLUP (source_file)""")
def source_row_audit(spark, sf_dir):
    raw = flow_files.valid_port(read_raw_flows(spark, sf_dir), "destination_port")
    return flow_files.source_row_audit(raw)


CLEANED = """
cleaned AS (
  SELECT * FROM raw WHERE trim(label) <> '' AND isfinite(flow_duration)
    AND source_port IS NOT NULL AND destination_port IS NOT NULL AND protocol IS NOT NULL
    AND total_fwd_packets IS NOT NULL
)"""
CLEAN_COLUMNS = "event_id, flow_id, source_ip, destination_port, protocol, label, flow_duration"


@query("scan_clean", f"""{with_ctes(FLOWS, RAW, CLEANED)}
SELECT {CLEAN_COLUMNS} FROM cleaned""")
def scan_clean(spark, sf_dir):
    path = new_path(spark)
    sinks.write_table(cleaning.clean_flows(read_raw_flows(spark, sf_dir)), path)
    return flow_files.read_clean(spark, path).select(*CLEAN_COLUMNS.split(", "))


@query("clean_all_null", f"""{RAW_SQL}
SELECT label, source_port, protocol, count(*) AS n_rows FROM raw
WHERE label IS NOT NULL OR source_port IS NOT NULL OR protocol IS NOT NULL GROUP BY ALL""")
def clean_all_null(spark, sf_dir):
    columns = ["label", "source_port", "protocol"]
    kept = cleaning.drop_empty_rows(read_raw_flows(spark, sf_dir).select(*columns))
    return kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


@query("clean_unlabelled", f"""{RAW_SQL}
SELECT event_id, label FROM raw WHERE label IS NOT NULL AND trim(label) <> ''""")
def clean_unlabelled(spark, sf_dir):
    return cleaning.drop_unlabelled(read_raw_flows(spark, sf_dir)).select("event_id", "label")


@query("clean_nonfinite", f"""{RAW_SQL}
SELECT event_id, CASE WHEN isfinite(flow_duration) THEN flow_duration END AS flow_duration
FROM raw""")
def clean_nonfinite(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir).select("event_id", "flow_duration")
    return cleaning.nonfinite_to_null(raw)


@query("clean_dropna", f"""{RAW_SQL}
SELECT event_id, flow_duration, total_fwd_packets FROM raw
WHERE flow_duration IS NOT NULL AND NOT isnan(flow_duration) AND total_fwd_packets IS NOT NULL""")
def clean_dropna(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir).select("event_id", "flow_duration", "total_fwd_packets")
    return cleaning.drop_incomplete(raw)


@query("dup_column_check", f"""{RAW_SQL}
SELECT 'total_backward_packets' AS kept_column, other_column, n_mismatches,
  n_mismatches = 0 AS is_duplicate
FROM (
  SELECT 'copied_packets' AS other_column, count(*) FILTER (
    WHERE total_backward_packets IS DISTINCT FROM copied_packets) AS n_mismatches FROM raw
  UNION ALL
  SELECT 'changed_packets', count(*) FILTER (
    WHERE total_backward_packets IS DISTINCT FROM changed_packets) FROM raw)""")
def dup_column_check(spark, sf_dir):
    kept = "total_backward_packets"
    pairs = [(kept, "copied_packets"), (kept, "changed_packets")]
    return cleaning.duplicate_column_audit(read_raw_flows(spark, sf_dir), pairs)


@query("clean_audit", f"""{with_ctes(FLOWS, RAW, CLEANED)}
SELECT *, rows_before - rows_after AS rows_dropped FROM (
  SELECT count(*) AS rows_before, 0::BIGINT AS rows_empty,
    count(*) FILTER (WHERE label IS NULL OR trim(label) = '') AS rows_unlabelled,
    count(*) FILTER (WHERE label IS NOT NULL AND trim(label) <> '')
      - (SELECT count(*) FROM cleaned) AS rows_incomplete,
    (SELECT count(*) FROM cleaned) AS rows_after
  FROM raw)""")
def clean_audit(spark, sf_dir):
    return cleaning.cleaning_audit(read_raw_flows(spark, sf_dir))


@query("ts_policy", f"""{RAW_SQL}
SELECT count(*) AS rows_input, count(*) FILTER (WHERE parsed IS NULL)
    AS rows_dropped_invalid_timestamp,
  count(parsed) AS rows_kept,
  count(*) FILTER (WHERE parsed IS NULL) > 0 AS invalid_timestamp_drop_detected FROM raw""")
def ts_policy(spark, sf_dir):
    from flowloom.operators.sequences import timestamp_counts

    raw = read_raw_flows(spark, sf_dir).select(
        flow_files.parse_timestamp(F.col("timestamp_text")).alias("timestamp")
    )
    kept = cleaning.valid_timestamps(raw).agg(F.count("*").alias("rows_kept"))
    return attach_row(timestamp_counts(raw), kept)


@query("flow_id_fallback", f"""{RAW_SQL}
SELECT event_id, coalesce(flow_id, concat_ws('-', coalesce(source_ip, 'NA'),
    coalesce(destination_ip, 'NA'), coalesce(CAST(source_port AS VARCHAR), 'NA'),
    coalesce(CAST(destination_port AS VARCHAR), 'NA'),
    coalesce(CAST(protocol AS VARCHAR), 'NA'))) AS flow_id,
  coalesce(destination_port, -1) AS destination_port, coalesce(protocol, -1) AS protocol
FROM raw""")
def flow_id_fallback(spark, sf_dir):
    filled = cleaning.fill_identifiers(read_raw_flows(spark, sf_dir))
    return filled.select("event_id", "flow_id", "destination_port", "protocol")


@query("numeric_repair", f"""{RAW_SQL}
SELECT event_id,
  CASE WHEN flow_duration IS NULL OR isnan(flow_duration) OR flow_duration < 0 THEN 0.0::DOUBLE
    ELSE flow_duration END AS flow_duration,
  CASE WHEN total_fwd_packets IS NULL OR total_fwd_packets < 0 THEN 0.0::DOUBLE
    ELSE total_fwd_packets END AS total_fwd_packets
FROM raw""")
def numeric_repair(spark, sf_dir):
    columns = ["flow_duration", "total_fwd_packets"]
    raw = read_raw_flows(spark, sf_dir).select("event_id", *columns)
    return cleaning.repair_measures(raw, columns)


@query("label_binary", f"""{RAW_SQL}
SELECT event_id, CASE WHEN trim(label) = 'BENIGN' THEN 0 ELSE 1 END AS y FROM raw""")
def label_binary(spark, sf_dir):
    return read_raw_flows(spark, sf_dir).select("event_id", keys.attack_label().alias("y"))


@query("feature_array", f"""{FLOW_SQL}
SELECT event_id, list_aggregate([value, k, CAST(source_port AS DOUBLE)], 'sum') AS x_sum,
  3 AS x_size FROM flows""")
def feature_array(spark, sf_dir):
    x = cleaning.feature_array(["value", "k", "source_port"])
    rows = read_flows(spark, sf_dir).select("event_id", x.alias("x"))
    return rows.select(
        "event_id",
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
        F.size("x").alias("x_size"),
    )


@query("window_id", f"""{FLOW_SQL}
SELECT event_id, ts_unix // 300 AS window_300, ts_unix // {GRAPH_SECONDS} AS window_id,
  day || '_' || CAST(ts_unix // {GRAPH_SECONDS} AS VARCHAR) AS graph_id FROM flows""")
def window_id(spark, sf_dir):
    flows = read_flows(spark, sf_dir)
    return flows.select(
        "event_id",
        "day",
        keys.window_id("timestamp", 300).alias("window_300"),
        keys.window_id("timestamp", GRAPH_SECONDS).alias("window_id"),
    ).select("event_id", "window_300", "window_id", keys.graph_key().alias("graph_id"))


def _text(column):
    return f"coalesce(CAST({column} AS VARCHAR), 'NA')"


_MODES_SQL = ", ".join(
    f"concat_ws('::', {', '.join(_text(c) for c in columns)}) AS {mode}"
    for mode, columns in keys.ENTITY_MODES.items()
)


@query("entity_keys", f"""{RAW_SQL},
keyed AS (SELECT event_id, CAST(floor(epoch(parsed)) AS BIGINT) // {DAY_SECONDS} AS window_id,
  strftime(parsed, '%Y-%m-%d') AS day, {_MODES_SQL} FROM raw WHERE parsed IS NOT NULL)
SELECT event_id, {', '.join(keys.ENTITY_MODES)},
  day || '::' || src_plus_dst AS split_group_id,
  day || '_' || CAST(window_id AS VARCHAR) || '_' || src_plus_dst AS seq_id FROM keyed""")
def entity_keys(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir).withColumn(
        "timestamp", flow_files.parse_timestamp(F.col("timestamp_text"))
    )
    keyed = raw.where(F.col("timestamp").isNotNull()).withColumns(
        {
            "day": F.date_format("timestamp", "yyyy-MM-dd"),
            "window_id": keys.window_id("timestamp", DAY_SECONDS),
            **{mode: keys.entity_key(mode) for mode in keys.ENTITY_MODES},
        }
    )
    return keyed.select(
        "event_id",
        *keys.ENTITY_MODES,
        keys.split_group_key(entity="src_plus_dst").alias("split_group_id"),
        keys.sequence_key(entity="src_plus_dst").alias("seq_id"),
    )


@query("bucketize", f"""{RAW_SQL}
SELECT event_id, {bucket_case("flow_duration", BUCKETS["DUR_"], "DUR_")} AS duration_bucket,
  {bucket_case("total_fwd_packets", BUCKETS["PKT"], "FWD_")} AS packet_bucket
FROM raw""")
def bucketize(spark, sf_dir):
    return read_raw_flows(spark, sf_dir).select(
        "event_id",
        tokens.bucket("flow_duration", tokens.DURATION_EDGES, "DUR_").alias(
            "duration_bucket"
        ),
        tokens.bucket("total_fwd_packets", tokens.PACKET_EDGES, "FWD_").alias(
            "packet_bucket"
        ),
    )


@query("flag_signature", f"{FLOW_SQL} SELECT event_id, {FLAGS} AS flags FROM flows")
def flag_signature(spark, sf_dir):
    return read_flows(spark, sf_dir).select("event_id", tokens.flag_letters().alias("flags"))


@query("flow_tokens", f"{FLOW_SQL} SELECT event_id, {TOKEN} AS token FROM flows")
def flow_tokens(spark, sf_dir):
    return read_flows(spark, sf_dir).select("event_id", tokens.flow_token().alias("token"))


@query("sample_n", f"""{FLOW_SQL}
SELECT event_id, source_ip, label FROM flows
ORDER BY md5('{SEED}|' || event_id) LIMIT 1000""")
def sample_n(spark, sf_dir):
    flows = read_flows(spark, sf_dir)
    sample = flow_files.sample_rows(flows, 1000, keys.seeded_hash(SEED, "event_id"))
    return sample.select("event_id", "source_ip", "label")


def _sliced(flows):
    return flows.select(
        "event_id",
        keys.attack_label().alias("seq_y"),
        "day",
        F.when(F.col("k") < 70, "train").when(F.col("k") < 85, "val").otherwise("test").alias(
            "split"
        ),
        "value",
    )


SLICED = """
sliced AS (SELECT event_id, y AS seq_y, day, value,
  CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'val' ELSE 'test' END AS split FROM flows)"""


@query("roundtrip_partitioned", f"""{with_ctes(FLOWS, SLICED)}
SELECT event_id, seq_y, day, split, value FROM sliced""")
def roundtrip_partitioned(spark, sf_dir):
    path = new_path(spark)
    sinks.write_partitioned(_sliced(read_flows(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return back.withColumn("day", F.col("day").cast("string"))


@query("pruned_scan", f"""{with_ctes(FLOWS, SLICED)}
SELECT event_id, value FROM sliced WHERE split = 'train' AND day = '2024-01-05' AND seq_y = 0""")
def pruned_scan(spark, sf_dir):
    path = new_path(spark)
    sinks.write_partitioned(_sliced(read_flows(spark, sf_dir)), path)
    return sinks.read_slice(spark, path, "train", "2024-01-05", 0, ["event_id", "value"])

