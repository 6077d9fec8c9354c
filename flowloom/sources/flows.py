"""Reading raw and cleaned flow files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowloom.sources.schemas import flow_schema

# Timestamp formats of the raw files, the format after merging, and the
# words looked for in file names.
RAW_FORMATS = ["dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm"]
CLEAN_FORMAT = "yyyy-MM-dd HH:mm:ss"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
DAY_PARTS = ["Morning", "Afternoon"]


def parse_timestamp(text: Column, formats: Sequence[str] = tuple(RAW_FORMATS)) -> Column:
    """First format that fits; null if none does.

    A format of numbers only fits texts with as many colons as it has. Others are not tried with
    it, as a text that doesn't fit costs an exception.
    """
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    parsed = []
    for fmt in formats:
        value = F.try_to_timestamp(text, F.lit(fmt))
        numbers_only = set(fmt) <= set("yMdHms/-.: ")
        parsed.append(F.when(colons == fmt.count(":"), value) if numbers_only else value)
    return F.coalesce(*parsed)


def first_word(text: Column, words: Sequence[str], default: str) -> Column:
    found = [F.when(text.contains(w), F.lit(w)) for w in words]
    return F.coalesce(*found, F.lit(default))


def tag_source(df: DataFrame, file_name: Column) -> DataFrame:
    """Day of week and part of day named in the file name."""
    return df.withColumns(
        {
            "day": first_word(file_name, WEEKDAYS, "Unknown"),
            "time_of_day": first_word(file_name, DAY_PARTS, "AllDay"),
        }
    )


def source_name() -> Column:
    """Name of the source a row was read from: its file, or the folder its part files are in.

    A table that Spark writes under a name is a folder of part files, and one that it splits
    by a column has folders called ``column=name``.
    """
    path = F.col("_metadata.file_path")
    return F.regexp_extract(path, r"([^/=]+\.[cC][sS][vV])(?:/part-[^/]*)?$", 1)


def valid_port(df: DataFrame, port: str) -> DataFrame:
    """Header lines and blank lines have no integer port."""
    return df.where(F.col(port).isNotNull())


def read_flows(spark: SparkSession, path: str, variant: str = "traffic") -> DataFrame:
    """All raw files of a folder in one scan, tagged by file, without header lines.

    Files carry a header that is read as data and falls to ``valid_port``. Both
    timestamp formats are tried, so no file needs its own scan.
    """
    schema = flow_schema(variant, timestamps_as_text=True)
    raw = (
        spark.read.schema(schema)
        .option("header", False)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", True)
        .csv(path)
        .select("*", source_name().alias("source_file"))
    )
    kept = valid_port(raw, " Destination Port")
    if variant == "traffic":
        kept = kept.withColumn(" Timestamp", parse_timestamp(F.col(" Timestamp")))
    return tag_source(kept, F.col("source_file"))


def read_flows_strict(
    spark: SparkSession,
    path: str,
    variant: str = "traffic",
    survey: bool = True,
    timestamp_format: str = RAW_FORMATS[1],
) -> DataFrame:
    """Files with a header line, refusing any record that does not fit the schema."""
    return (
        spark.read.schema(flow_schema(variant, survey=survey))
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("timestampFormat", timestamp_format)
        .csv(path)
    )


def malformed_rows(spark: SparkSession, path: str, variant: str = "traffic") -> DataFrame:
    """Per file: records, and records with a value that does not fit its column."""
    schema = flow_schema(variant)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", True)
        .csv(path)
        .select("*", source_name().alias("source_file"))
    )
    misfits = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            misfits.append(value.isNotNull() & parse_timestamp(value).isNull())
        elif not isinstance(field.dataType, T.StringType):
            misfits.append(value.isNotNull() & value.try_cast(field.dataType).isNull())
    return raw.groupBy("source_file").agg(
        F.count_if(reduce(lambda a, b: a | b, misfits)).alias("n_malformed"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def read_clean(
    spark: SparkSession, path: str, variant: str = "traffic", file_format: str = "parquet"
) -> DataFrame:
    """The cleaned table; CSV with a header for tables written elsewhere."""
    if file_format == "parquet":
        return spark.read.parquet(path)
    return (
        spark.read.schema(flow_schema(variant, "clean"))
        .option("header", True)
        .option("sep", ",")
        .option("timestampFormat", CLEAN_FORMAT)
        .csv(path)
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Rows of all sources, columns matched by name."""
    return reduce(DataFrame.unionByName, sources)


def source_row_audit(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per source, and in total under ``ALL``, in one pass."""
    return (
        df.rollup(source)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(source).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col(source)).alias(source), "n_rows"
        )
    )


def sample_rows(df: DataFrame, n: int, digest: Column) -> DataFrame:
    """A reproducible random sample: the ``n`` rows with the smallest digest."""
    return df.withColumn("_draw", digest).orderBy("_draw").limit(n).drop("_draw")
