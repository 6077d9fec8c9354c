import math

import pytest
from pyspark.sql import functions as F

from flowloom.functions import keys, tokens
from flowloom.operators import cleaning

INF, NAN = float("inf"), float("nan")


def test_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "` Source Port` int, `Len.1` double, `Label ` string")
    assert cleaning.strip_names(df).columns == ["Source Port", "Len.1", "Label"]
    assert cleaning.undot_names(df).columns == [" Source Port", "Len_1", "Label "]
    assert cleaning.snake_names(df).columns == ["source_port", "len_1", "label"]
    plain = cleaning.snake_names(df)
    assert cleaning.numeric_columns(plain) == ["source_port", "len_1"]
    assert cleaning.numeric_columns(plain, ["source_port"]) == ["len_1"]


def test_clean_and_audit(spark):
    rows = [
        (1, 1.0, "BENIGN"), (2, INF, "BENIGN"), (3, -INF, "X"), (4, NAN, "X"), (5, None, "X"),
        (6, 1.0, None), (7, 1.0, "  "), (None, None, None), (None, 2.0, "X"), (8, -1.0, " X "),
    ]
    df = spark.createDataFrame(rows, "port int, v double, label string")
    assert {r["port"] for r in cleaning.clean_flows(df).collect()} == {1, 8}
    audit = cleaning.cleaning_audit(df).first().asDict()
    assert audit == {
        "rows_before": 10, "rows_empty": 1, "rows_unlabelled": 2, "rows_incomplete": 5,
        "rows_after": 2, "rows_dropped": 8,
    }


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 1, 1), (None, None, 2)], "a int, b int, c int")
    found = {
        r["other_column"]: r["n_mismatches"]
        for r in cleaning.duplicate_column_audit(df, [("a", "b"), ("a", "c")]).collect()
    }
    assert found == {"b": 0, "c": 1}
    assert cleaning.drop_duplicate_column(df, "a", "b").columns == ["a", "c"]
    assert cleaning.drop_duplicate_column(df, "a", "c").columns == ["a", "b", "c"]
    assert cleaning.drop_duplicate_column(df, "a", "missing").columns == ["a", "b", "c"]


def test_timestamp_policy(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS timestamp UNION ALL SELECT NULL")
    assert cleaning.valid_timestamps(df).count() == 1
    with pytest.raises(ValueError, match="1 rows"):
        cleaning.valid_timestamps(df, policy="error")
    with pytest.raises(ValueError, match="unknown"):
        cleaning.valid_timestamps(df, policy="keep")
    with pytest.raises(ValueError, match="no flows"):
        cleaning.require_rows(df.where("false"), "flows")


def test_identifiers(spark):
    df = spark.createDataFrame(
        [(None, "1.1.1.1", "2.2.2.2", None, None, 6), ("x", None, None, 1, 2, None)],
        "flow_id string, source_ip string, destination_ip string, source_port int,"
        "destination_port int, protocol int",
    )
    got = {tuple(r) for r in cleaning.fill_identifiers(df).select(
        "flow_id", "destination_port", "protocol").collect()}
    assert got == {("1.1.1.1-2.2.2.2-NA-NA-6", -1, 6), ("x", 2, -1)}
    entity = df.select(keys.entity_key("src_plus_dst").alias("e")).collect()
    assert {r["e"] for r in entity} == {"1.1.1.1::2.2.2.2::6", "NA::NA::NA"}


def test_repair(spark):
    df = spark.createDataFrame([(None,), (NAN,), (-2.0,), (3.0,), (INF,)], "v double")
    got = sorted(r["v"] for r in cleaning.repair_measures(df, ["v"]).collect())
    assert got == [0.0, 0.0, 0.0, 3.0, INF]


def test_buckets(spark):
    edges = tokens.DURATION_EDGES
    values = [0.0, 0.5, 1.0, 9.9, 10.0, 1.2e8 - 1, 1.2e8, 5e9, -1.0, NAN, INF, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["b"] for r in df.select(tokens.bucket("v", edges, "D_").alias("b")).collect()]

    def want(v):
        for i in range(len(edges) - 1):
            if v is not None and not math.isnan(v) and edges[i] <= v < edges[i + 1]:
                return f"D_B{i}"
        return f"D_B{len(edges) - 1}"

    assert got == [want(v) for v in values]


def test_flags_and_token(spark):
    flags = dict.fromkeys(tokens.FLAG_LETTERS, 0.0)
    row = {
        "protocol": 6, "destination_port": 443, "flow_duration": 15.0, "total_fwd_packets": 2.0,
        "total_backward_packets": 0.0, "total_length_of_fwd_packets": 60.0,
        "total_length_of_bwd_packets": 10.0, "flow_packets_s": 1e9,
    }
    schema = "protocol int, destination_port int, " + ", ".join(
        f"{c} double" for c in [*list(row)[2:], *flags]
    )
    some = {**flags, "syn_flag_count": 1.0, "ack_flag_count": 2.0}
    data = [tuple({**row, **f}.values()) for f in (flags, some)]
    df = spark.createDataFrame(data, schema)
    got = [r["t"] for r in df.select(tokens.flow_token().alias("t")).collect()]
    head = "PR_6|DP_443|DUR_B2|FWD_B2|BWD_B0|BYT_B2|PPS_B8|FL_"
    assert got == [head + "N", head + "SA"]


def test_labels(spark):
    df = spark.createDataFrame([("BENIGN",), (" BENIGN ",), ("Bot",), (None,)], "label string")
    got = [r["y"] for r in df.select(keys.attack_label().alias("y")).collect()]
    assert got == [0, 0, 1, 1]


def test_window_and_graph_key_before_the_epoch(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:59:59' AS ts, 'Mon' AS day")
    row = df.select(keys.window_id("ts", 300).alias("window_id"), "day").withColumn(
        "g", keys.graph_key()
    ).first()
    assert (row["window_id"], row["g"]) == (-1, "Mon_-1")


def test_unit_interval(spark):
    df = spark.range(2000).select(keys.unit_interval(keys.seeded_hash(1, "id")).alias("u"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and 0.47 < row[2] < 0.53
