"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tail caps go up to 2048 rows; the default of 1000 would disable map-side pruning.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
    # The JVM never compiles methods above 8000 bytes; token expressions exceed that when
    # fused with their neighbours, so let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Call sites of column expressions cost more than the small local queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started.

    Window ids come from epoch seconds, so the time zone has to be fixed.
    """
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark
