"""Joins of a large table with a lookup table whose size is measured, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.plans.staging import stage, stage_measured

BROADCAST_ROWS_SETTING = "flowloom.broadcastRows"
DEFAULT_BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
HEAVY_ROWS_SETTING = "flowloom.heavyRows"
DEFAULT_HEAVY_ROWS = 1_000_000
SALTS = 32


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_SETTING, str(DEFAULT_BROADCAST_ROWS)))


def heavy_rows(spark: SparkSession) -> int:
    """Facts of one key beyond which the key is spread over several tasks."""
    return int(spark.conf.get(HEAVY_ROWS_SETTING, str(DEFAULT_HEAVY_ROWS)))


def fits_in_memory(table: DataFrame, rows: int | None = None) -> bool:
    """A stored table small enough, in rows and in bytes, to be sent to every task."""
    stats = table._jdf.queryExecution().optimizedPlan().stats()
    if int(str(stats.sizeInBytes())) > BROADCAST_BYTES:
        return False
    return (table.count() if rows is None else rows) <= broadcast_rows(table.sparkSession)


def spread_lookup(
    facts: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``facts`` with a salt, and ``table`` with the salts its rows are wanted under.

    Only keys with many facts have more than one salt. They are counted over all facts, with
    partial sums, and there is at most one for each ``heavy_rows`` facts.
    """
    spark = facts.sparkSession
    heavy, found = stage_measured(
        facts.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > heavy_rows(spark))
        .select(*keys, F.lit(True).alias("_heavy"))
    )
    if fits_in_memory(heavy, found["rows"]):
        heavy = F.broadcast(heavy)
    draw = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salted = facts.join(heavy, keys, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), draw).otherwise(0)
    )
    last = F.when(F.col("_heavy"), SALTS - 1).otherwise(0)
    copies = table.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), last))
    )
    return salted.drop("_heavy"), copies.drop("_heavy")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    staged: bool = False,
) -> DataFrame:
    """Join ``facts`` with a ``lookup`` table that is unique on ``on``.

    The lookup is staged and measured; ``staged`` says that it is stored already, or so
    cheap to derive from a stored table that it may run twice. Up to ``flowloom.broadcastRows``
    rows and ``BROADCAST_BYTES`` it is broadcast. Beyond that the join is shuffled. Keys with
    more than ``flowloom.heavyRows`` facts are spread over ``SALTS`` tasks: the salt of such a
    fact is a hash of its ``spread`` columns, and the key's lookup row is there under each
    salt. All other keys are joined plainly.
    """
    table, found = (lookup, {}) if staged else stage_measured(lookup)
    keys = list(on)
    if fits_in_memory(table, found.get("rows")):
        return facts.join(F.broadcast(table), keys, how)
    salted, copies = spread_lookup(facts, table, keys, spread)
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_with_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key meets a null key; the key columns appear once."""
    names = {c: f"_right_{c}" for c in keys}
    other = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(other[n]) for c, n in names.items()]
    return left.join(other, same).drop(*names.values())


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) to every row."""
    left = df.withColumn("_one", F.lit(1))
    right = one_row.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")
