"""Exact ordered computations that do not need a whole group in one task.

A plain window function sorts each partition of the window in one task. That is
the best plan while groups are small, and the wrong one when a single graph,
day or score column holds a third of all rows. Every function here counts the
groups first (a narrow count with map-side combine). Groups of up to
``flowloom.taskRows`` rows take one window. Larger ones, and only their rows, are
range partitioned on (group, order) into chunks, each chunk is processed on its own,
and the totals of the chunks before it are added. A chunk can continue only the one
group that its predecessor ended with, so the table of carried totals has at
most one row per chunk. There are at most ``MOST_CHUNKS`` chunks, whatever the
size of the table, so that table may be broadcast.

The order given must be total, apart from rows that may be swapped freely.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowloom.plans.lookups import fits_in_memory
from flowloom.plans.staging import stage, stage_measured

TASK_ROWS_SETTING = "flowloom.taskRows"
DEFAULT_TASK_ROWS = 2_000_000
SALTS = 64
MOST_CHUNKS = 20_000


def task_rows(spark: SparkSession) -> int:
    """Most rows of one group that a single window task may receive."""
    return int(spark.conf.get(TASK_ROWS_SETTING, str(DEFAULT_TASK_ROWS)))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows of the table)."""
    if not keys:
        rows = df.count()
        return rows, rows
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("rows")).first()
    return row["largest"] or 0, row["rows"] or 0


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    largest: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` within ``keys`` along ``order``.

    Nothing is measured when the caller knows that the ``largest`` group is small enough.
    """
    limit = task_rows(df.sparkSession)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(upto).alias(n) for n, c in totals.items()]
    if largest is not None and largest <= limit:
        return df.select("*", *sums)
    if not keys:
        rows = df.count()
        return _chunked_totals(df, [], list(order), totals, rows) if rows > limit else df.select("*", *sums)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large, found = stage_measured(sizes, rows_inside=F.sum("_n"))
    if not found["rows"]:
        return df.select("*", *sums)
    other = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    if fits_in_memory(other, found["rows"]):
        other = F.broadcast(other)
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    )
    small = df.join(other, same, "left_anti").select("*", *sums)
    chunked = df.join(other, same, "left_semi")
    return small.unionByName(
        _chunked_totals(chunked, list(keys), list(order), totals, found["rows_inside"])
    )


def _chunked_totals(df, keys, order, totals, size):
    chunks = min(1 + math.ceil(2 * size / task_rows(df.sparkSession)), MOST_CHUNKS)
    by = [F.col(k) for k in keys] + order
    inputs = {f"_in_{name}": c for name, c in totals.items()}
    # Staged, because both reads below must see the same chunk numbers.
    rows = stage(
        df.select("*", *[c.alias(n) for n, c in inputs.items()])
        .repartitionByRange(chunks, *by)
        .withColumn("_chunk", F.spark_partition_id())
    )
    upto = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in totals], F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_chunk").alias("_key__chunk"),
            F.sum("_n").over(before).alias("_before"),
            *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals],
        )
        .where(F.col("_before").isNotNull())
    )
    local = rows.select("*", *[F.sum(f"_in_{n}").over(upto).alias(f"_local_{n}") for n in totals])
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*keys, "_chunk"]],
    )
    return local.join(F.broadcast(carried), same, "left").select(
        *df.columns,
        *[
            (F.col(f"_local_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, largest: int | None = None
) -> DataFrame:
    """Number the rows of each group from 0 along ``order``."""
    counted = running_totals(df, keys, order, {name: F.lit(1)}, largest)
    return counted.withColumn(name, F.col(name) - 1)


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    k: int,
    name: str,
    largest: int | None = None,
) -> DataFrame:
    """Add an array of ``value`` in the next ``k`` rows of the group (null past its end)."""
    limit = task_rows(df.sparkSession)
    if largest is None or largest > limit:
        largest, _ = group_sizes(df, keys)
    if largest <= limit:
        ahead = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(
            name, F.array(*[F.lead(value, hop).over(ahead) for hop in range(1, k + 1)])
        )
    # Blocks of equal length along the position, each extended by the first k rows
    # of the next block.
    block = max(limit, k)
    placed = positions(df, keys, order, "_pos").withColumn(
        "_home", F.floor(F.col("_pos") / F.lit(block))
    )
    spread = placed.withColumn(
        "_block",
        F.explode(
            F.when(
                (F.col("_home") > 0) & (F.col("_pos") % block < k),
                F.array(F.col("_home"), F.col("_home") - 1),
            ).otherwise(F.array(F.col("_home")))
        ),
    )
    ahead = Window.partitionBy(*keys, "_block").orderBy("_pos")
    return (
        spread.withColumn(
            name, F.array(*[F.lead(value, hop).over(ahead) for hop in range(1, k + 1)])
        )
        .where(F.col("_block") == F.col("_home"))
        .select(*df.columns, name)
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    largest: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group along ``order``.

    Small groups take one window. When a group is large, its rows are ranked in
    ``SALTS`` slices first and the at most ``SALTS * n`` survivors are ranked again.
    ``largest`` saves the measuring pass when the caller knows the largest group.
    """
    limit = task_rows(df.sparkSession)
    if largest is None:
        largest, _ = group_sizes(df, keys)
    kept = df
    if largest > limit:
        kept = kept.withColumn("_salt", F.pmod(F.xxhash64(*order_inputs(df, keys)), F.lit(SALTS)))
        slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
        kept = (
            kept.withColumn("_rank", F.row_number().over(slices))
            .where(F.col("_rank") <= n)
            .drop("_rank", "_salt")
        )
    group = Window.partitionBy(*keys).orderBy(*order)
    return (
        kept.withColumn("_rank", F.row_number().over(group))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def order_inputs(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns that tell rows of one group apart."""
    return [c for c in df.columns if c not in set(keys)] or list(keys)


#: Parts of a doubling that the first histogram of values tells apart, and of an interval later.
LOG_PARTS = 256
PARTS = 1 << 16
#: Beyond the logarithm of any finite double, in those parts.
FAR = 1100 * LOG_PARTS


def log_bin(value: Column) -> Column:
    """Number of a value's bin; a larger value never has a smaller number, NaN has the largest."""
    v = value.cast("double")
    size = F.abs(v)
    part = F.when(size == float("inf"), 2 * FAR).otherwise(FAR + F.floor(F.log2(size) * LOG_PARTS))
    return (
        F.when(F.isnan(v), 3 * FAR).when(v == 0, 0).when(v > 0, part).otherwise(-part).cast("long")
    )


def ranks(fraction: float) -> tuple[Column, Column, Column]:
    """Whole ranks around a percentile in ``_total`` values, and the part of the way between."""
    rank = (F.col("_total") - 1) * F.lit(float(fraction))
    return F.floor(rank), F.ceil(rank), rank - F.floor(rank)


def _intervals(bins: DataFrame, group: list[str], within: list[str], wanted) -> DataFrame:
    """Bins that hold a wanted rank: least and largest value, rows, rows before, rows of the group.

    ``bins`` has ``_bin``, ``_n``, ``_low``, ``_high``; bins inside an interval have its ``_base`` and
    ``_total`` too.
    """
    upto = Window.partitionBy(*group, *within).orderBy("_bin")
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_n").over(upto) - F.col("_n")
    if within:
        before = before + F.col("_base")
    else:
        bins = bins.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    placed = bins.withColumn("_before", before)
    inside = [
        (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
        for fraction in wanted.values()
        for rank in ranks(fraction)[:2]
    ]
    return placed.where(reduce(lambda a, b: a | b, inside)).select(
        *group, "_low", "_high", "_n", F.col("_before").alias("_base"), "_total"
    )


def _inside(rows: DataFrame, group: list[str], value: str, intervals: DataFrame) -> DataFrame:
    """Rows with a value in one of their group's intervals, with its ``_low``, ``_high``, ``_base``, ``_total``.

    A group has at most two intervals a percentile, and they do not overlap.
    """
    table = intervals.drop("_n")
    if fits_in_memory(table):
        table = F.broadcast(table)
    return rows.join(table, group).where(F.col(value).between(F.col("_low"), F.col("_high")))


def _narrowed(rows: DataFrame, group: list[str], value: str, wanted) -> tuple[DataFrame, int]:
    """Intervals of values that hold the wanted ranks, and the rows of the largest one.

    A histogram finds the bins with the ranks, and those with too many rows for one task are
    cut into finer ones, until they are small or hold one value only.
    """
    limit = task_rows(rows.sparkSession)
    figures = [
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"),
    ]
    bins = rows.groupBy(*group, log_bin(F.col(value)).alias("_bin")).agg(*figures)
    most = F.max(F.when(F.col("_low") < F.col("_high"), F.col("_n")))
    found, seen = stage_measured(_intervals(bins, group, [], wanted), most=most)
    largest, last = seen["most"] or 0, None
    while largest > limit and largest != last:
        low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
        part = F.when(low < high, F.floor((F.col(value).cast("double") - low) / (high - low) * PARTS))
        inner = _inside(rows, group, value, found).select(
            *group, value, F.col("_low").alias("_from"), "_base", "_total",
            F.coalesce(part, F.lit(0)).alias("_bin"),
        )
        bins = inner.groupBy(*group, "_from", "_base", "_total", "_bin").agg(*figures)
        found, seen = stage_measured(_intervals(bins, group, ["_from"], wanted), most=most)
        largest, last = seen["most"] or 0, largest
    return found, largest


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    staged: bool = False,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    Tables of up to ``flowloom.taskRows`` rows are ordered as they are. In larger ones, histograms
    with map-side sums find the narrow intervals of values that hold the wanted ranks, for all
    groups and percentiles at once, and only the values inside them are ordered. Groups
    with a null key are left out. NaN counts as the largest value.
    ``wanted`` maps output names to fractions in [0, 1]; ``staged`` says that ``df`` is stored.
    """
    group = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    rows = rows.select(*group, value).dropna("any", subset=group).where(F.col(value).isNotNull())
    if not staged:
        rows = stage(rows)
    limit = task_rows(df.sparkSession)
    ordered = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    if (df if staged else rows).count() <= limit:
        counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
        ranked = counted.select(
            *group,
            value,
            F.sum("_n").over(ordered.partitionBy(*group)).alias("_upto"),
            F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
        )
    else:
        intervals, largest = _narrowed(rows, group, value, wanted)
        within = [*group, "_low", "_base", "_total"]
        counted = (
            _inside(rows, group, value, intervals)
            .groupBy(*within, value)
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        if largest <= limit:
            placed = counted.withColumn("_upto", F.sum("_n").over(ordered.partitionBy(*within)))
        else:
            placed = running_totals(stage(counted), within, [F.col(value)], {"_upto": F.col("_n")})
        ranked = placed.withColumn("_upto", F.col("_upto") + F.col("_base"))
    picks, results = [], []
    for name, fraction in wanted.items():
        below, above, part = ranks(fraction)
        picks += [
            F.min(F.when(F.col("_upto") > below, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > above, F.col(value))).alias(f"_hi_{name}"),
            F.max(part).alias(f"_part_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((low + (high - low) * F.col(f"_part_{name}")).alias(name))
    return ranked.groupBy(*group).agg(*picks).select(*keys, *results)
