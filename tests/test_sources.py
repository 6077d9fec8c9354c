"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.catalog.files import strict_rows
from flowloom.operators import cleaning
from flowloom.sources import flows, runs, sinks
from flowloom.sources.adapters import read_raw_flows
from flowloom.sources.schemas import FLOW_STATISTICS, flow_schema


def record(ts, label="BENIGN", port="80", fill="1"):
    return ",".join(["id", "1.1.1.1", "5", "2.2.2.2", port, "6", ts, *[fill] * 77, label])


@pytest.fixture
def folder(tmp_path):
    header = ",".join(f.name for f in flow_schema().fields)
    monday = [header, record("03/07/2017 08:55:58"), ",".join([""] * 85)]
    friday = [header, record("7/7/2017 8:54", "DDoS"), record("no time")]
    (tmp_path / "Monday-WorkingHours.csv").write_text("\n".join(monday) + "\n")
    (tmp_path / "Friday-WorkingHours-Afternoon-DDos.CSV").write_text("\n".join(friday) + "\n")
    (tmp_path / "notes.txt").write_text("not a flow\n")
    return str(tmp_path)


def test_schema_sizes():
    assert len(FLOW_STATISTICS) == 77
    assert len(flow_schema().fields) == 85
    assert len(flow_schema("statistics").fields) == 79
    assert len(flow_schema(stage="full").fields) == 87
    assert len(flow_schema(stage="clean").fields) == 86
    assert " Fwd Header Length61" in flow_schema(survey=True).fieldNames()


def test_read_folder(spark, folder):
    df = flows.read_flows(spark, folder)
    got = {
        (r["day"], r["time_of_day"], r["ts"], r[" Label"])
        for r in df.withColumn("ts", F.date_format(" Timestamp", flows.CLEAN_FORMAT)).collect()
    }
    assert got == {
        ("Monday", "AllDay", "2017-07-03 08:55:58", "BENIGN"),
        ("Friday", "Afternoon", "2017-07-07 08:54:00", "DDoS"),
        ("Friday", "Afternoon", None, "BENIGN"),
    }
    audit = {r["source_file"]: r["n_rows"] for r in flows.source_row_audit(df).collect()}
    assert audit == {
        "Monday-WorkingHours.csv": 1, "Friday-WorkingHours-Afternoon-DDos.CSV": 2, "ALL": 3,
    }


def test_strict_read_refuses_bad_records(spark, tmp_path):
    header = ",".join(f.name for f in flow_schema(survey=True).fields)
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("\n".join([header, record("7/7/2017 8:54")]) + "\n")
    bad.write_text("\n".join([header, record("7/7/2017 8:54", fill="x")]) + "\n")
    assert flows.read_flows_strict(spark, str(good)).count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        flows.read_flows_strict(spark, str(bad)).collect()
    counts = flows.malformed_rows(spark, str(bad)).first()
    assert (counts["n_malformed"], counts["n_rows"]) == (1, 1)


def test_strict_scan_reads_every_event(spark):
    folder = "/root/testdata/sf0.001"
    raw = read_raw_flows(spark, folder)
    wanted = {
        r["event_id"]: (r["ts_unix"], r["destination_port"])
        for r in raw.select(
            F.col("event_id").cast("bigint").alias("event_id"),
            F.unix_seconds(flows.parse_timestamp(F.col("timestamp_text"))).alias("ts_unix"),
            "destination_port",
        ).collect()
    }
    rows = strict_rows(spark, folder).collect()
    assert len(rows) == len(wanted)
    assert {r["event_id"]: (r["ts_unix"], r["destination_port"]) for r in rows} == wanted
    assert any(t is None for t, _ in wanted.values()) and any(t and t % 60 for t, _ in wanted.values())


def test_clean_table_round_trip(spark, folder, tmp_path):
    named = cleaning.undot_names(flows.read_flows(spark, folder).drop("source_file"))
    assert " Fwd Header Length_1" in named.columns
    cleaned = cleaning.clean_flows(named, " Label")
    cleaned = cleaning.drop_duplicate_column(cleaned, " Fwd Header Length", " Fwd Header Length_1")
    assert " Fwd Header Length_1" not in cleaned.columns
    for kind in ("parquet", "csv"):
        path = str(tmp_path / f"clean-{kind}")
        sinks.write_table(cleaned, path, kind)
        back = flows.read_clean(spark, path, file_format=kind)
        assert back.count() == 3
        assert set(back.columns) == set(flow_schema(stage="clean").fieldNames())


def test_partitioned_sink_leaves_no_rows_of_the_table_before(spark, tmp_path):
    path = str(tmp_path / "seq")
    for split in ("val", "train"):
        rows = [(split, "Mon", 2)]
        sinks.write_partitioned(spark.createDataFrame(rows, "split string, day string, id int"), path)
    assert [(r["id"], r["split"]) for r in spark.read.parquet(path).collect()] == [(2, "train")]


def test_partitioned_sink_adds_days_on_request(spark, tmp_path):
    path = str(tmp_path / "seq")
    rows = [("train", "Mon", 0, 1), ("train", "Tue", 1, 2), ("val", "Mon", 1, 3)]
    df = spark.createDataFrame(rows, "split string, day string, seq_y int, v int")
    sinks.write_partitioned(df, path)
    sinks.write_partitioned(df.where("v = 2").withColumn("v", F.lit(9)), path, keep_others=True)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    part = sinks.read_slice(spark, path, "train", "Mon", 0, ["v"])
    assert [r["v"] for r in part.collect()] == [1]
    plan = part._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "PushedFilters: [IsNotNull(seq_y), EqualTo(seq_y,0)]" in plan
    assert "ReadSchema: struct<seq_y:int,v:int>" in plan


def test_report_has_no_infinities(spark, tmp_path):
    df = spark.createDataFrame([(float("inf"), 1.5), (float("nan"), None)], "a double, b double")
    for kind in ("json", "csv"):
        sinks.write_report(df, str(tmp_path / kind), kind)
    back = spark.read.schema("a double, b double").json(str(tmp_path / "json")).collect()
    assert sorted((r["a"], r["b"] or 0.0) for r in back) == [(None, 0.0), (None, 1.5)] or {
        (r["a"], r["b"]) for r in back
    } == {(None, 1.5), (None, None)}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert sinks.read_manifest(spark, path).count() == 0
    counters = spark.range(5).agg(F.count("*").alias("rows_input"))
    sinks.write_manifest(spark, path, {"window_seconds": 300}, counters)
    row = sinks.read_manifest(spark, path).first()
    assert json.loads(row["config"]) == {"window_seconds": 300}
    assert row["rows_input"] == 5
    sinks.write_manifest(spark, path, {"window_seconds": 60})
    assert json.loads(sinks.read_manifest(spark, path).first()["config"])["window_seconds"] == 60


def test_split_summary_file(spark, tmp_path):
    df = spark.createDataFrame([("ALL", "train", 3)], "day string, split string, n_groups long")
    path = str(tmp_path / "summary")
    assert sinks.read_split_summary(spark, path, df.schema).count() == 0
    sinks.write_report(df, path, "csv")
    assert sinks.read_split_summary(spark, path, df.schema).collect() == df.collect()


def run_folder(root, name, seed, f1, old=False, build=None):
    path = root / name
    path.mkdir()
    config = {"seed": seed, "data_root": "/d/variant_a", "graph_build_config": build or {}}
    test = {
        "threshold_free": {"roc_auc": 0.9, "pr_auc": None},
        "at_threshold_0.5": {"threshold": 0.5, "f1": f1, "precision": 1.0},
        "at_threshold_tuned": {"threshold": 0.7, "f1": f1 + 0.1, "precision": 0.5},
    }
    if old:
        test = {"roc_auc": 0.1}
    (path / "run_config.json").write_text(json.dumps(config, indent=2))
    (path / "test_metrics.json").write_text(json.dumps(test, indent=2))
    (path / "summary.json").write_text(json.dumps({"best_epoch": 3, "best_val_pr_auc": 0.8}))


def test_runs_from_files(spark, tmp_path):
    build = {"variant_id": "k5", "edge_family": "src+dst", "chain_k": 5}
    run_folder(tmp_path, "20260101_000000_a", 0, 0.1, build=build)
    run_folder(tmp_path, "20260102_000000_a", 0, 0.2, build=build)
    run_folder(tmp_path, "20260102_000000_b", 1, 0.4, build=build)
    run_folder(tmp_path, "20250101_000000_old", 1, 0.4, old=True)
    run_folder(tmp_path, "20260103_000000_plain", 1, 0.4)
    (tmp_path / "partial").mkdir()
    (tmp_path / "partial" / "summary.json").write_text("{}")
    rows = runs.flatten_runs(runs.read_run_files(spark, str(tmp_path)), "gnn", runs.GRAPH_RUNS)
    assert rows.count() == 8
    assert {r["variant_id"] for r in rows.collect()} == {"k5", "variant_a"}
    latest = runs.latest_runs(rows.where("variant_id = 'k5'"), runs.GRAPH_RUNS.latest_keys)
    assert {r["run_name"] for r in latest.collect()} == {
        "20260102_000000_a", "20260102_000000_b",
    }
    table = runs.aggregate_runs(
        latest, runs.GRAPH_RUNS.group_keys, runs.GRAPH_RUNS.metric_columns
    )
    half = table.where("evaluation_mode = 'threshold_0_5'").first()
    assert half["n_runs"] == 2
    assert half["f1_mean"] == pytest.approx(0.3)
    assert half["f1_std"] == pytest.approx(0.02**0.5)
    assert half["pr_auc_mean"] is None and half["pr_auc_std"] is None
    one = runs.aggregate_runs(latest.limit(1), ["model_name"], ["f1"]).first()
    assert one["f1_std"] == 0.0


@pytest.mark.parametrize(
    "layout, columns", [(runs.GRAPH_RUNS, 19), (runs.TOKEN_RUNS, 39), (runs.TRAJECTORY_RUNS, 41)]
)
def test_run_layouts(spark, layout, columns):
    empty = spark.createDataFrame(
        [], "run_name string, config string, metrics string, summary string"
    )
    rows = runs.flatten_runs(empty, "m", layout)
    assert len(rows.columns) == columns
    assert set(layout.latest_keys) | set(layout.group_keys) <= set(rows.columns)
    runs.aggregate_runs(rows, layout.group_keys, layout.metric_columns)


def test_timestamp_formats_are_tried_where_they_can_fit(spark):
    from pyspark.sql import functions as F

    from flowloom.sources import flows

    texts = ["05/07/2017 08:09:10", "5/7/2017 8:09", "05/07/2017 08:09", "n/a", "", None, "1:2:3:4",
             "32/01/2017 08:09:10", "5/7/2017 8:09:10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in flows.RAW_FORMATS])
    parsed = flows.parse_timestamp(F.col("t"))
    assert df.where(~parsed.eqNullSafe(plain)).count() == 0 and df.where(parsed.isNotNull()).count() == 3
    assert "CASE WHEN" in str(df.select(parsed)._jdf.queryExecution().optimizedPlan())
