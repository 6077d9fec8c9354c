"""Checks of finished splits and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom.operators.splits import RATIOS


def leakage_check(assignments: DataFrame, group: str) -> DataFrame:
    """Groups in total, most splits of one group, and groups in more than one split."""
    return (
        assignments.groupBy(group)
        .agg(F.count_distinct("split").alias("n_splits"))
        .agg(
            F.count(F.lit(1)).alias("groups_total"),
            F.max("n_splits").alias("max_splits_per_group"),
            F.count_if(F.col("n_splits") > 1).alias("leaking_groups"),
        )
    )


def balance_error(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Sum over splits of |share - wanted share| per metric and strategy; 0 without data."""
    overall = summary.where(F.col("day") == "ALL")
    sums = overall.groupBy("summary_label").agg(
        *[F.sum(m).alias(f"{m}_all") for m in metrics],
        *[
            F.coalesce(F.sum(F.when(F.col("split") == s, F.col(m))), F.lit(0)).alias(f"{m}_{s}")
            for m in metrics
            for s in RATIOS
        ],
    )
    errors = []
    for m in metrics:
        error = F.lit(0.0)
        for s, ratio in RATIOS.items():
            error = error + F.abs(F.try_divide(F.col(f"{m}_{s}"), F.col(f"{m}_all")) - ratio)
        errors.append(F.when(F.col(f"{m}_all") > 0, error).otherwise(0.0).alias(m))
    return sums.select("summary_label", *errors)


def class_coverage(summary: DataFrame) -> DataFrame:
    """Whether each split has attack and benign sequences, and events where counted."""
    out = summary.where(F.col("day") == "ALL").withColumn(
        "n_benign_sequences", F.col("n_sequences") - F.col("n_attack_sequences")
    )
    columns = ["split", "n_sequences", "n_attack_sequences", "n_benign_sequences"]
    out = out.withColumn(
        "sequence_has_both_classes",
        (F.col("n_attack_sequences") > 0) & (F.col("n_benign_sequences") > 0),
    )
    columns.append("sequence_has_both_classes")
    if "n_events" in summary.columns:
        out = out.withColumn(
            "n_benign_events", F.col("n_events") - F.col("n_attack_events")
        ).withColumn(
            "event_has_both_classes",
            (F.col("n_attack_events") > 0) & (F.col("n_benign_events") > 0),
        )
        columns += ["n_events", "n_attack_events", "n_benign_events", "event_has_both_classes"]
    return out.select(*columns)


def impossible_summary_rows(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("n_attack_events") > F.col("n_events"))


def trajectory_integrity(sequences: DataFrame) -> DataFrame:
    """Counts of contradictions in stored trajectories; ``passed`` if all are 0."""
    attacks = F.aggregate("y_seq", F.lit(0), lambda a, y: a + y)
    top = F.coalesce(F.array_max("y_seq"), F.lit(0))
    faults = {
        "n_attack_events_gt_n_events": F.col("n_attack_events") > F.col("n_events"),
        "n_events_ne_seq_len": F.col("n_events") != F.col("seq_len"),
        "n_attack_events_ne_sum_y_seq": F.col("n_attack_events") != attacks,
        "seq_y_ne_max_y_seq": F.col("seq_y") != top,
        "full_seq_len_lt_seq_len": F.col("full_seq_len") < F.col("seq_len"),
        "full_n_attack_events_lt_n_attack_events": F.col("full_n_attack_events")
        < F.col("n_attack_events"),
    }
    report = sequences.agg(
        F.count(F.lit(1)).alias("n_sequences_checked"),
        *[F.count_if(fault).alias(name) for name, fault in faults.items()],
    )
    total = sum((F.col(name) for name in faults), F.lit(0))
    return report.withColumn("passed", (F.col("n_sequences_checked") > 0) & (total == 0))


def require_both_classes(coverage: DataFrame, unit: str = "sequence") -> DataFrame:
    """Raise unless every split has attack and benign rows of the unit."""
    flag = f"{unit}_has_both_classes"
    covered = coverage.where(F.col("split").isin(*RATIOS)).agg(
        *[F.max(F.when(F.col("split") == s, F.col(flag))).alias(s) for s in RATIOS]
    ).first()
    missing = [s for s in RATIOS if not covered[s]]
    if missing:
        raise ValueError(f"not both {unit} classes in {', '.join(missing)}")
    return coverage


def require_splits(counts: DataFrame) -> DataFrame:
    """Raise unless training has benign rows and validation and test have any."""
    need = {"train": "n_benign", "val": "n_total", "test": "n_total"}
    found = counts.agg(
        *[F.sum(F.when(F.col("split") == s, F.col(c))).alias(s) for s, c in need.items()]
    ).first()
    missing = [s for s in need if not found[s]]
    if missing:
        raise ValueError(f"no usable sequences in {', '.join(missing)}")
    return counts
