"""Queries that write and read the file formats: raw CSV, clean tables, runs, reports, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, RAW, SEED, query, tidy, tidy_sql, with_ctes
from flowloom.catalog.evaluation import run_document_columns
from flowloom.operators import cleaning, validation
from flowloom.operators.sequences import dataset_counts
from flowloom.plans.staging import new_path, stage
from flowloom.sources import flows, runs, sinks
from flowloom.sources.adapters import read_flows, read_raw_flows, read_table, score_table
from flowloom.sources.schemas import ENDPOINTS, FLOW_STATISTICS, flow_schema

RAW_SQL = with_ctes(FLOWS, RAW)
# Where the raw columns go in a file record; other statistics repeat the backward packets.
IN_FILE = {
    "Flow ID": "flow_id",
    " Source IP": "source_ip",
    " Source Port": "source_port",
    " Destination IP": "destination_ip",
    " Destination Port": "destination_port",
    " Protocol": "protocol",
    " Timestamp": "timestamp_text",
    " Flow Duration": "flow_duration",
    " Total Fwd Packets": "total_fwd_packets",
    " Idle Min": "event_id",
    " Label": "label",
}


def file_records(spark, sf_dir):
    raw = read_raw_flows(spark, sf_dir)
    names = flow_schema(timestamps_as_text=True).fieldNames()
    columns = [F.col(IN_FILE.get(n, "total_backward_packets")).alias(n) for n in names]
    return raw.select(*columns, "source_file", "event_id")


def write_records(df, path, **options):
    """CSV with a header line in every file, one folder per source."""
    writer = df.write.option("header", True).options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    )
    writer.partitionBy("source_file").csv(path)


def raw_folder(spark, sf_dir):
    """The raw files, with a blank record for every hundredth flow."""
    records = file_records(spark, sf_dir)
    names = [c for c in records.columns if c not in ("source_file", "event_id")]
    blank = records.where(F.col("event_id") % 100 == 0).select(
        *[F.lit(None).cast("string").alias(n) for n in names], "source_file"
    )
    path = new_path(spark)
    write_records(records.drop("event_id").unionByName(blank), path)
    return path


def strict_rows(spark, sf_dir):
    """All raw records, their times in the one format that keeps seconds, read by the strict reader."""
    one_format = flows.RAW_FORMATS[0]
    records = file_records(spark, sf_dir).drop("event_id", "source_file")
    time = F.date_format(flows.parse_timestamp(F.col(" Timestamp")), one_format)
    path = new_path(spark)
    records.withColumn(" Timestamp", time).write.option("header", True).csv(path)
    rows = flows.read_flows_strict(spark, path, survey=False, timestamp_format=one_format)
    return rows.select(
        F.col(" Idle Min").cast("bigint").alias("event_id"),
        F.unix_seconds(F.col(" Timestamp")).alias("ts_unix"),
        F.col(" Destination Port").alias("destination_port"),
    )


def finite(column):
    value = F.abs(F.col(column))
    return F.when(~F.isnan(value) & (value < float("inf")), F.col(column))


DAY_SQL = """CASE WHEN source_file LIKE '%Monday%' THEN 'Monday' WHEN source_file LIKE '%Tuesday%'
    THEN 'Tuesday' WHEN source_file LIKE '%Friday%' THEN 'Friday' ELSE 'Unknown' END"""


@query("files_raw_scan", f"""{RAW_SQL}
SELECT CAST(event_id AS BIGINT) AS event_id, flow_id, source_ip, source_port, destination_port,
  CAST(floor(epoch(parsed)) AS BIGINT) AS ts_unix, trim(label) AS label, source_file,
  {DAY_SQL} AS day, CASE WHEN isfinite(flow_duration) THEN flow_duration END AS flow_duration
FROM raw WHERE destination_port IS NOT NULL""")
def files_raw_scan(spark, sf_dir):
    rows = flows.read_flows(spark, raw_folder(spark, sf_dir))
    return rows.select(
        F.col(" Idle Min").cast("bigint").alias("event_id"),
        F.col("Flow ID").alias("flow_id"),
        F.col(" Source IP").alias("source_ip"),
        F.col(" Source Port").alias("source_port"),
        F.col(" Destination Port").alias("destination_port"),
        F.unix_seconds(F.col(" Timestamp")).alias("ts_unix"),
        F.trim(" Label").alias("label"),
        "source_file",
        "day",
        finite(" Flow Duration").alias("flow_duration"),
    )


@query("files_malformed", f"""{RAW_SQL}
SELECT source_file, count(*) FILTER (WHERE parsed IS NULL) AS n_malformed, count(*) AS n_rows
FROM raw GROUP BY source_file""")
def files_malformed(spark, sf_dir):
    path = new_path(spark)
    write_records(file_records(spark, sf_dir).drop("event_id"), path)
    return flows.malformed_rows(spark, path)


@query("files_strict_scan", f"""{RAW_SQL}
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(floor(epoch(parsed)) AS BIGINT) AS ts_unix,
  destination_port FROM raw""")
def files_strict_scan(spark, sf_dir):
    return strict_rows(spark, sf_dir)


CLEAN_WHERE = """trim(label) <> '' AND isfinite(flow_duration) AND source_port IS NOT NULL
    AND destination_port IS NOT NULL AND protocol IS NOT NULL AND total_fwd_packets IS NOT NULL"""


@query("files_clean_table", f"""{RAW_SQL}
SELECT file_format, CAST(event_id AS BIGINT) AS event_id,
  CAST(floor(epoch(parsed)) AS BIGINT) AS ts_unix, flow_duration, {DAY_SQL} AS day
FROM raw, (SELECT unnest(['csv', 'parquet']) AS file_format) WHERE {CLEAN_WHERE}""")
def files_clean_table(spark, sf_dir):
    """Raw files cleaned, written in both formats and read back."""
    rows = flows.read_flows(spark, raw_folder(spark, sf_dir)).drop("source_file")
    # Stored, so that the raw text is parsed once and not for the audit and for each format.
    cleaned = stage(cleaning.clean_flows(cleaning.undot_names(rows), " Label"))
    cleaned = cleaning.drop_duplicate_column(cleaned, " Fwd Header Length", " Fwd Header Length_1")
    both = []
    for kind in ("parquet", "csv"):
        path = new_path(spark)
        sinks.write_table(cleaned, path, kind)
        both.append(flows.read_clean(spark, path, file_format=kind).select(
            F.lit(kind).alias("file_format"),
            F.col(" Idle Min").cast("bigint").alias("event_id"),
            F.unix_seconds(F.col(" Timestamp")).alias("ts_unix"),
            F.col(" Flow Duration").alias("flow_duration"),
            "day",
        ))
    return flows.union_sources(both)


def _snake(name):
    import re

    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


FEATURE_NAMES = [_snake(c) for c in FLOW_STATISTICS]


@query("files_feature_columns", f"""{RAW_SQL}
SELECT name, CASE name WHEN 'flow_duration' THEN count(flow_duration)
    WHEN 'total_fwd_packets' THEN count(total_fwd_packets) ELSE count(*) END AS n_values
FROM (SELECT * FROM raw WHERE destination_port IS NOT NULL),
  (SELECT unnest({FEATURE_NAMES!r}) AS name)
GROUP BY name""")
def files_feature_columns(spark, sf_dir):
    """Feature columns found by type after names are made plain, and how many values each has."""
    rows = flows.read_flows(spark, raw_folder(spark, sf_dir))
    rows = cleaning.snake_names(cleaning.strip_names(cleaning.undot_names(rows)))
    ends = [_snake(c) for c, _ in ENDPOINTS]
    names = cleaning.numeric_columns(rows, exclude=ends)
    counted = rows.agg(*[F.count(c).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_values")) for c in names])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


FOLDER_RUNS = """
folder_runs AS (
  SELECT event_type, hour(ts) AS hour, count(*) AS n, min(value) AS low, max(value) AS high,
    avg(value) AS mean_value
  FROM events GROUP BY ALL
)"""


@query("files_run_folders", f"""{with_ctes(FOLDER_RUNS)}
SELECT '20240101_' || lpad(CAST(hour AS VARCHAR), 2, '0') || '_' || event_type AS run_name,
  CAST(hour % 5 AS VARCHAR) AS seed, event_type AS edge_family, mode AS evaluation_mode,
  CASE WHEN hour % 4 <> 0 THEN {tidy_sql('1 / (1 + low)', 6)} END AS roc_auc,
  {tidy_sql('1 / (1 + mean_value)', 6)} AS pr_auc, {tidy_sql('f1', 6)} AS f1,
  CAST(n AS INTEGER) AS best_epoch
FROM (SELECT *, 'threshold_0_5' AS mode, 1 / (1 + high) AS f1 FROM folder_runs
  UNION ALL SELECT *, 'threshold_tuned', 1 / (2 + high) FROM folder_runs)""")
def files_run_folders(spark, sf_dir):
    """Run folders with three files each, a quarter of them with a bare NaN, read and flattened."""
    base = (
        read_table(spark, sf_dir, "events")
        .groupBy("event_type", F.hour("ts").alias("hour"))
        .agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.avg("value").alias("mean_value"),
        )
    )
    documents = run_document_columns(F.col("hour") % 5, F.col("event_type"), F.lit("v"), F.lit(1))
    bare = F.regexp_replace("metrics", r'("roc_auc":)[^,}]*', "$1 NaN")
    rows = base.select(
        F.concat_ws("_", F.lit("20240101"), F.lpad(F.col("hour").cast("string"), 2, "0"), "event_type")
        .alias("run_name"),
        "hour",
        *documents,
    ).withColumn("metrics", F.when(F.col("hour") % 4 == 0, bare).otherwise(F.col("metrics")))
    names = {"config": runs.CONFIG, "metrics": runs.METRICS, "summary": runs.SUMMARY}
    files = F.array(*[
        F.struct(F.lit(name).alias("file"), F.col(c).alias("value")) for c, name in names.items()
    ])
    path = new_path(spark)
    one_each = rows.select("run_name", F.explode(files).alias("f")).select("run_name", "f.*")
    one_each.repartition("run_name").write.partitionBy("run_name", "file").text(path)
    found = runs.flatten_runs(runs.read_run_files(spark, path), "gnn", runs.GRAPH_RUNS)
    return found.select(
        "run_name", "seed", "edge_family", "evaluation_mode", tidy("roc_auc", 6), tidy("pr_auc", 6),
        tidy("f1", 6), "best_epoch",
    )


@query("files_report", f"""{RAW_SQL}
SELECT file_format, CAST(event_id AS BIGINT) AS event_id,
  CASE WHEN isfinite(flow_duration) THEN flow_duration END AS flow_duration
FROM raw, (SELECT unnest(['csv', 'json']) AS file_format)""")
def files_report(spark, sf_dir):
    """A report of values with NaN, infinities and nulls, in both formats."""
    report = read_raw_flows(spark, sf_dir).select("event_id", "flow_duration")
    both = []
    for kind in ("json", "csv"):
        path = new_path(spark)
        sinks.write_report(report, path, kind)
        reader = spark.read.schema("event_id long, flow_duration double")
        back = reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
        both.append(back.select(F.lit(kind).alias("file_format"), "*"))
    return flows.union_sources(both)


@query("files_scores", """
SELECT CAST(event_id AS BIGINT) AS event_id, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events""")
def files_scores(spark, sf_dir):
    path = new_path(spark)
    sinks.write_table(score_table(read_flows(spark, sf_dir)), path)
    return spark.read.parquet(path).select(F.col("event_id").cast("bigint").alias("event_id"), "day", "y")


@query("files_scores_by_split", f"""{with_ctes(FLOWS)}
SELECT CAST(event_id AS BIGINT) AS event_id, split, y FROM (
  SELECT event_id, y, CASE event_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
  FROM flows) WHERE split <> 'test' OR y = 1""")
def files_scores_by_split(spark, sf_dir):
    """Scores in a folder per split; whole splits, and one class of another, read back."""
    split = F.expr("CASE event_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END")
    scores = score_table(read_flows(spark, sf_dir)).withColumn("split", split).withColumnRenamed("y", "seq_y")
    path = new_path(spark)
    sinks.write_partitioned(scores, path, by=["split"])
    columns = ["event_id", "split", "seq_y"]
    parts = [sinks.read_slice(spark, path, name, columns=columns) for name in ("train", "val")]
    parts.append(sinks.read_slice(spark, path, "test", seq_y=1, columns=columns))
    return flows.union_sources(parts).select(
        F.col("event_id").cast("bigint").alias("event_id"), "split", F.col("seq_y").alias("y")
    )


@query("files_manifest", f"""{with_ctes(FLOWS)}
SELECT '{{"seed": {SEED}, "window_seconds": 300}}' AS config, count(*) AS rows_input FROM flows""")
def files_manifest(spark, sf_dir):
    path = new_path(spark)
    counters = read_flows(spark, sf_dir).agg(F.count("*").alias("rows_input"))
    sinks.write_manifest(spark, path, {"window_seconds": 300, "seed": SEED}, counters)
    return sinks.read_manifest(spark, path).select("config", "rows_input")


@query("files_rebuilt_table", f"""{with_ctes(FLOWS)}
SELECT CAST(event_id AS BIGINT) AS event_id, CASE event_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test'
  ELSE 'train' END AS split, day FROM flows""")
def files_rebuilt_table(spark, sf_dir):
    """A table written with one assignment and then with another: only the second stays."""
    rows = read_flows(spark, sf_dir).select(F.col("event_id").cast("bigint").alias("event_id"), "day")
    path = new_path(spark)
    for shift in (1, 0):
        names = F.array(*[F.lit(s) for s in ("val", "test", "train")])
        split = F.get(names, ((F.col("event_id") + shift) % 3).cast("int"))
        sinks.write_partitioned(rows.withColumn("split", split), path)
    back = spark.read.parquet(path)
    return back.select("event_id", "split", F.col("day").cast("string").alias("day"))


@query("split_guards", f"""{with_ctes(FLOWS)}
SELECT CASE event_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split,
  count(*) AS n_total, count(*) FILTER (WHERE y = 0) AS n_benign,
  count(*) FILTER (WHERE y = 1) AS n_attack FROM flows GROUP BY 1""")
def split_guards(spark, sf_dir):
    """Counts of a split that passes the guards against empty parts."""
    split = F.expr("CASE event_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END")
    rows = cleaning.require_rows(read_flows(spark, sf_dir), "flows").select(
        split.alias("split"), F.when(F.col("label") == "BENIGN", 0).otherwise(1).alias("seq_y")
    )
    return validation.require_splits(dataset_counts(rows))
