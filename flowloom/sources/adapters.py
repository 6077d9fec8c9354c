"""Flow tables derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.session import prepare

# Service of an event type: destination port and protocol number.
SERVICES = {
    "click": (80, 6),
    "view": (443, 6),
    "purchase": (8443, 6),
    "signup": (22, 6),
    "error": (53, 17),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _service(part: int) -> str:
    arms = " ".join(f"WHEN '{t}' THEN {s[part]}" for t, s in SERVICES.items())
    return f"CASE event_type {arms} ELSE 0 END"


def events_as_flows(events: DataFrame) -> DataFrame:
    """One flow per event: user to host ``k``, service by event type, errors are attacks."""
    with_k = events.withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS DOUBLE)"))
    return with_k.selectExpr(
        "event_id",
        "CAST(event_id AS STRING) AS flow_id",
        "concat('u', user_id) AS source_ip",
        "CAST(1024 + event_id % 50000 AS INT) AS source_port",
        "concat('h', CAST(k AS INT)) AS destination_ip",
        f"{_service(0)} AS destination_port",
        f"{_service(1)} AS protocol",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "date_format(ts, 'yyyy-MM-dd') AS day",
        "if(event_type = 'error', 'ATTACK', 'BENIGN') AS label",
        "value * 1000.0D AS flow_duration",
        "k AS total_fwd_packets",
        "CAST(floor(value / 10.0D) AS DOUBLE) AS total_backward_packets",
        "value * 100.0D AS total_length_of_fwd_packets",
        "k * 1000.0D AS total_length_of_bwd_packets",
        "value * k AS flow_packets_s",
        "CAST(event_id % 2 AS DOUBLE) AS fin_flag_count",
        "k % 2 AS syn_flag_count",
        "k % 3 AS rst_flag_count",
        "if(value > 100, 1.0D, 0.0D) AS psh_flag_count",
        "if(value > 50, 1.0D, 0.0D) AS ack_flag_count",
        "0.0D AS urg_flag_count",
        "value",
        "k",
    )


def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_flows(read_table(spark, sf_dir, "events"))


def read_raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as delivered: with blanks, gaps and two timestamp formats put in.

    The faults depend on ``event_id`` alone, so a query in another engine can make the
    same table.
    """
    flows = read_flows(spark, sf_dir)
    n = F.col("event_id")

    def every(step: int, offset: int = 0) -> Column:
        return n % step == offset

    with_seconds = F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss")
    minutes_only = F.date_format("timestamp", "d/M/yyyy H:mm")
    file_name = F.concat(
        F.element_at(
            F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Friday", "Sunday")]),
            (n % 4 + 1).cast("int"),
        ),
        F.when(n % 3 == 0, "-Morning").when(n % 3 == 1, "-Afternoon").otherwise(""),
        F.lit(".csv"),
    )
    return flows.select(
        "event_id",
        F.when(~every(13), F.col("flow_id")).alias("flow_id"),
        F.when(~every(17), F.col("source_ip")).alias("source_ip"),
        F.when(~every(19), F.col("source_port")).alias("source_port"),
        "destination_ip",
        F.when(~every(23), F.col("destination_port")).alias("destination_port"),
        F.when(~every(29), F.col("protocol")).alias("protocol"),
        F.when(every(31), F.lit("n/a"))
        .when(every(2), with_seconds)
        .otherwise(minutes_only)
        .alias("timestamp_text"),
        F.when(every(37), F.lit(None))
        .when(every(41), F.lit("  "))
        .when(every(43), F.concat(F.lit(" "), F.col("label"), F.lit(" ")))
        .otherwise(F.col("label"))
        .alias("label"),
        F.when(every(47), F.lit(float("nan")))
        .when(every(53), F.lit(float("inf")))
        .when(every(59), F.lit(float("-inf")))
        .when(every(61), F.lit(None))
        .when(every(67), -F.col("flow_duration"))
        .otherwise(F.col("flow_duration"))
        .alias("flow_duration"),
        F.when(~every(71), F.col("total_fwd_packets")).alias("total_fwd_packets"),
        "total_backward_packets",
        F.col("total_backward_packets").alias("copied_packets"),
        F.when(every(997), F.lit(-1.0))
        .otherwise(F.col("total_backward_packets"))
        .alias("changed_packets"),
        file_name.alias("source_file"),
    )


def lineitems_as_flows(lineitem: DataFrame) -> DataFrame:
    """Order lines as flows from supplier to part; for aggregates that ignore order."""
    return lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_ip"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("destination_ip"),
        F.concat("l_returnflag", "l_linestatus").alias("service"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.date_format("l_shipdate", "yyyy").alias("day"),
        F.when(F.col("l_returnflag") == "R", "ATTACK").otherwise("BENIGN").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def score_table(flows: DataFrame) -> DataFrame:
    """Flows with a score in [0, 1), higher for attacks, on a grid of 1/1000 so it ties."""
    y = F.when(F.col("label") == "BENIGN", 0).otherwise(1)
    digest = F.md5(F.concat(F.lit("score|"), F.col("flow_id")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return flows.select(
        "event_id",
        "day",
        y.alias("y"),
        (F.floor((draw + y * 0.5) / 1.5 * 1000) / 1000).alias("score"),
    )
