"""Writing tables, reports and manifests, and reading them back."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom.sources.flows import CLEAN_FORMAT


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("split", "day"), keep_others: bool = False
) -> None:
    """Parquet in one folder per value of ``by``; the table is replaced as a whole.

    ``keep_others`` replaces only the folders that ``df`` has rows for, to add days to a table.
    It must not be used to rebuild one: rows that moved to another split would stay behind.

    The rebalance hint lets Spark split a large folder over several tasks and merge small
    ones, so there is neither one huge file nor a file per task and folder.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(*by)
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Parquet, or CSV with a header; as many files as the data has partitions."""
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        # The format ``read_clean`` expects.
        writer.option("header", True).option("timestampFormat", CLEAN_FORMAT).csv(path)
    else:
        writer.parquet(path)


def read_slice(
    spark: SparkSession,
    path: str,
    split: str,
    day: str | None = None,
    seq_y: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One split, optionally one day and class: folders are pruned, the class pushed down."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    if day is not None:
        df = df.where(F.col("day").cast("string") == day)
    if seq_y is not None:
        df = df.where(F.col("seq_y") == seq_y)
    return df.select(*columns) if columns else df


def finite_values(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON can hold."""
    fixes = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            value = F.abs(F.col(name))
            fixes[name] = F.when(~F.isnan(value) & (value < float("inf")), F.col(name))
    return df.withColumns(fixes) if fixes else df


def write_report(df: DataFrame, path: str, file_format: str = "json") -> None:
    """A report as JSON lines or CSV, nulls kept."""
    writer = finite_values(df).write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def write_manifest(
    spark: SparkSession, path: str, config: Mapping[str, object], counters: DataFrame | None = None
) -> None:
    """Settings of a build, and its one-row counters, as one JSON row."""
    settings = F.lit(json.dumps(dict(config), sort_keys=True)).alias("config")
    row = spark.range(1).select(settings) if counters is None else counters.select(settings, "*")
    row.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def missing(error: AnalysisException) -> bool:
    """The path does not exist; any other error is the caller's."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, or an empty table when there is none."""
    try:
        return spark.read.json(path)
    except AnalysisException as error:
        if not missing(error):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("config", T.StringType())]))


def read_split_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A split summary written as CSV, or an empty table when there is none."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if not missing(error):
            raise
        return spark.createDataFrame([], schema)
