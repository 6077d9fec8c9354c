"""Cleaning of raw flow tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions.keys import flow_identifier
from flowloom.functions.tokens import TOKEN_MEASURES

NUMERIC_TYPES = ("double", "float", "int", "bigint")


def strip_names(df: DataFrame) -> DataFrame:
    """Remove blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def undot_names(df: DataFrame) -> DataFrame:
    """Replace dots in column names, which Spark reads as struct access."""
    return df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns if "." in c})


def snake_names(df: DataFrame) -> DataFrame:
    """Lower-case names with every run of other characters turned into one underscore."""
    return df.toDF(*[re.sub(r"[^0-9a-z]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Feature columns chosen by type, without the excluded names."""
    return [c for c, kind in df.dtypes if kind in NUMERIC_TYPES and c not in set(exclude)]


def floating_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("double", "float")]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.trim(F.col(label)) != "")


def is_finite(name: str) -> Column:
    """False for NaN and both infinities; null for null."""
    value = F.abs(F.col(name))
    return ~F.isnan(value) & (value != F.lit(float("inf")))


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """Set NaN and infinities to null in one projection over all floating columns."""
    fixes = {c: F.when(is_finite(c), F.col(c)) for c in floating_columns(df)}
    return df.withColumns(fixes) if fixes else df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any numeric column."""
    return df.dropna(subset=list(columns or numeric_columns(df)))


def clean_flows(df: DataFrame, label: str = "label") -> DataFrame:
    """Empty rows, unlabelled rows and rows with a missing or non-finite number go."""
    return drop_incomplete(nonfinite_to_null(drop_unlabelled(drop_empty_rows(df), label)))


def cleaning_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows before and after each cleaning rule, from one aggregate over the raw table."""
    numbers = numeric_columns(df)
    floats = set(floating_columns(df))
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    labelled = F.coalesce(F.trim(F.col(label)) != "", F.lit(False))
    whole = [
        F.coalesce(is_finite(c), F.lit(False)) if c in floats else F.col(c).isNotNull()
        for c in numbers
    ]
    complete = reduce(lambda a, b: a & b, whole, F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(empty).alias("rows_empty"),
        F.count_if(~empty & ~labelled).alias("rows_unlabelled"),
        F.count_if(labelled & ~complete).alias("rows_incomplete"),
        F.count_if(labelled & complete).alias("rows_after"),
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def duplicate_column_audit(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which two supposedly equal columns differ, for all pairs in one pass."""
    counts = df.agg(
        *[
            F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"pair_{number}")
            for number, (a, b) in enumerate(pairs)
        ]
    )
    rows = [
        F.struct(
            F.lit(a).alias("kept_column"),
            F.lit(b).alias("other_column"),
            F.col(f"pair_{number}").alias("n_mismatches"),
            (F.col(f"pair_{number}") == 0).alias("is_duplicate"),
        )
        for number, (a, b) in enumerate(pairs)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def drop_duplicate_column(df: DataFrame, kept: str, other: str) -> DataFrame:
    """Drop ``other`` if it equals ``kept`` in every row; stops at the first difference."""
    if kept not in df.columns or other not in df.columns:
        return df
    differs = df.where(~F.col(kept).eqNullSafe(F.col(other))).limit(1).count()
    return df if differs else df.drop(other)


def valid_timestamps(df: DataFrame, ts: str = "timestamp", policy: str = "drop") -> DataFrame:
    """Keep rows with a timestamp. ``policy='error'`` refuses a table that has others."""
    if policy not in ("drop", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "error":
        missing = df.where(F.col(ts).isNull()).count()
        if missing:
            raise ValueError(f"{missing} rows have no {ts}")
    return df.where(F.col(ts).isNotNull())


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a table that must not be empty is."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def fill_identifiers(df: DataFrame) -> DataFrame:
    """Fallback flow id, -1 for a missing port or protocol."""
    named = df.withColumn("flow_id", flow_identifier())
    return named.withColumns(
        {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("destination_port", "protocol")}
    )


def repair_measures(df: DataFrame, columns: Sequence[str] = tuple(TOKEN_MEASURES)) -> DataFrame:
    """Null, NaN and negative measures become 0.0."""
    return df.withColumns(
        {
            c: F.expr(f"CASE WHEN {c} >= 0 AND NOT isnan({c}) THEN {c} ELSE 0.0D END")
            for c in columns
        }
    )


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
