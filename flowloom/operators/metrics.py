"""Evaluation of score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.plans.lookups import attach_row
from flowloom.plans.ordered import running_totals
from flowloom.plans.staging import stage

# The two threshold grids and the guard in rates.
GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]
SEQUENCE_GRID = [round(0.01 * i, 2) for i in range(1, 100)]
EPS = 1e-12


def ranking_metrics(
    scores: DataFrame, score: str, target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision; null with one class.

    Rows are first reduced to (score, positives, negatives). The running sums over those
    come from ``running_totals``, so a day or table with very many distinct scores is
    not sorted in one task.
    """
    y = F.col(target)
    tallied = stage(
        scores.groupBy(*keys, score).agg(
            F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")
        )
    )
    ranked = running_totals(
        tallied, keys, [F.col(score).desc()], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}
    )
    pos, neg, tp, fp = (F.col(c) for c in ("_pos", "_neg", "_tp", "_fp"))
    sums = ranked.groupBy(*keys).agg(
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        F.sum(neg.cast("double") * (tp - pos / F.lit(2))).alias("_pairs"),
        F.sum(pos * tp / F.greatest(tp + fp, F.lit(1))).alias("_precision"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("_pairs") / (F.col("_p").cast("double") * F.col("_n"))).alias(
            "roc_auc"
        ),
        F.when(both, F.col("_precision") / F.col("_p")).alias("pr_auc"),
    )


def confusion_metrics() -> dict[str, Column]:
    """Rates from the columns tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    tpr, tnr = F.try_divide(tp, pos), F.try_divide(tn, neg)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": F.try_divide(tp + tn, pos + neg),
        # Mean recall of the classes that occur.
        "balanced_accuracy": F.coalesce((tpr + tnr) / 2, tpr, tnr),
        "specificity": tn / (neg + EPS),
        "fpr": fp / (neg + EPS),
        "fnr": fn / (pos + EPS),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(tpr, F.lit(0.0)),
        "support_pos": F.col("tp") + F.col("fn"),
        "support_neg": F.col("tn") + F.col("fp"),
    }


def prediction_metrics(
    df: DataFrame, prediction: Column, target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates of a 0/1 prediction."""
    hit, y = prediction, F.col(target)
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(hit & (y == 1)).alias("tp"),
            F.count_if(hit & (y == 0)).alias("fp"),
            F.count_if(~hit & (y == 0)).alias("tn"),
            F.count_if(~hit & (y == 1)).alias("fn"),
        )
        .withColumns(confusion_metrics())
    )


def metrics_at(
    df: DataFrame, score: str, target: str, threshold: Column | float, keys: Sequence[str] = ()
) -> DataFrame:
    """Metrics of ``score >= threshold``."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return prediction_metrics(df, F.col(score) >= limit, target, keys)


def grid_index(score: Column, grid: Sequence[float]) -> Column:
    """Number of grid values not above ``score``.

    The position is computed and then corrected by comparing with the neighbouring grid
    values, because the division alone is off by one for some of them. NaN is above every
    number, as in Spark's comparisons and so in ``metrics_at``.
    """
    values = F.array(*[F.lit(g) for g in grid])
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    # Within a step of the grid, so that no score, infinite or huge, leaves the integers.
    held = F.greatest(F.least(score, F.lit(grid[-1] + step)), F.lit(grid[0] - step))
    near = F.floor((held - F.lit(grid[0])) / F.lit(step)).cast("int")
    base = F.greatest(F.lit(0), F.least(near - 1, F.lit(len(grid))))
    above = [
        F.coalesce((held >= F.get(values, base + i)).cast("int"), F.lit(0)) for i in range(4)
    ]
    return base + above[0] + above[1] + above[2] + above[3]


def threshold_sweep(
    df: DataFrame,
    score: str,
    target: str,
    grid: Sequence[float] = GRID,
    keys: Sequence[str] = (),
    strict: bool = False,
    always: Column | None = None,
) -> DataFrame:
    """Metrics at every threshold of the grid, from one pass over the scores.

    Rows are counted by the number of thresholds they reach; running sums from the top
    give the predicted positives. ``strict`` predicts on ``score > threshold``. Rows for
    which ``always`` holds are predicted positive at every threshold.
    """
    reached = grid_index(F.col(score), grid)
    if strict:
        at_value = F.array_contains(F.array(*[F.lit(g) for g in grid]), F.col(score))
        reached = reached - at_value.cast("int")
    if always is not None:
        reached = F.when(always, F.lit(len(grid))).otherwise(reached)
    y = F.col(target)
    counted = (
        df.groupBy(*keys, reached.alias("_i"))
        .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    )
    marks = counted.select(
        *keys, "_i", F.struct("_pos", "_neg").alias("_c")
    ).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_c"))).alias("_m"))
    # At most len(grid) + 1 counters per key.
    spine = marks.select(
        *keys,
        "_m",
        F.posexplode(F.array(F.lit(None).cast("double"), *[F.lit(g) for g in grid])).alias(
            "_i", "threshold"
        ),
    ).select(
        *keys,
        "_i",
        "threshold",
        *[
            F.coalesce(F.try_element_at("_m", F.col("_i"))[c], F.lit(0)).alias(c)
            for c in ("_pos", "_neg")
        ],
    )
    whole = Window.partitionBy(*keys)
    from_here = whole.orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    summed = spine.select(
        *keys,
        "threshold",
        F.sum("_pos").over(from_here).alias("tp"),
        F.sum("_neg").over(from_here).alias("fp"),
        F.sum("_pos").over(whole).alias("_p"),
        F.sum("_neg").over(whole).alias("_n"),
    ).where(F.col("threshold").isNotNull())
    return summed.select(
        *keys,
        "threshold",
        "tp",
        "fp",
        (F.col("_n") - F.col("fp")).alias("tn"),
        (F.col("_p") - F.col("tp")).alias("fn"),
    ).withColumns(confusion_metrics())


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row with the best F1, then recall, then precision, then the lowest threshold."""
    merit = F.struct(
        F.round("f1", 12),
        F.round("recall", 12),
        F.round("precision", 12),
        -F.col("threshold"),
    )
    others = [c for c in sweep.columns if c not in set(keys)]
    best = sweep.groupBy(*keys).agg(F.max_by(F.struct(*others), merit).alias("_b"))
    return best.select(*keys, "_b.*")


def positive_weight(df: DataFrame, target: str, one_class: float | None = None) -> DataFrame:
    """Negatives per positive. ``one_class`` replaces it if a class is empty."""
    counts = df.agg(
        F.count_if(F.col(target) == 1).alias("n_pos"),
        F.count_if(F.col(target) == 0).alias("n_neg"),
    )
    weight = F.col("n_neg") / F.greatest("n_pos", F.lit(1))
    if one_class is not None:
        weight = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), weight).otherwise(one_class)
    return counts.withColumn("pos_weight", weight)


def log_loss(
    df: DataFrame, probability: str, target: str, weight: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean log-loss with positives weighted; probabilities kept off 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(target)
    loss = -(weight * y * F.ln(p) + (F.lit(1) - y) * F.ln(F.lit(1) - p))
    return df.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def metric_bundle(
    df: DataFrame,
    score: str,
    target: str,
    tuned: DataFrame,
    loss: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Threshold-free metrics and the metrics at 0.5 and at the tuned threshold.

    Two rows, or two per group such as per day. ``tuned`` is a one-row table with a
    ``threshold``, ``loss`` a one-row table.
    """
    limits = F.array(
        F.struct(F.lit("threshold_0_5").alias("mode"), F.lit(0.5).alias("threshold")),
        F.struct(F.lit("threshold_tuned").alias("mode"), F.col("threshold").alias("threshold")),
    )
    both = tuned.select(F.array_sort(limits).alias("_modes"))
    scored = attach_row(df.select(*keys, score, target), both).select(
        *keys, score, target, F.explode("_modes").alias("_m")
    )
    rows = scored.select(*keys, score, target, "_m.mode", "_m.threshold")
    at = metrics_at(rows, score, target, F.col("threshold"), [*keys, "mode", "threshold"])
    free = ranking_metrics(df, score, target, keys)
    out = at.join(free, list(keys)) if keys else attach_row(at, free)
    return out if loss is None else attach_row(out, loss)


def holdout_report(
    scores: DataFrame, score: str, target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Tune the threshold on validation rows and report on test rows."""
    table = stage(scores.select("split", *keys, score, target))
    tuned = best_threshold(threshold_sweep(table.where(F.col("split") == "val"), score, target))
    test = table.where(F.col("split") == "test")
    weight = positive_weight(table.where(F.col("split") == "train"), target, one_class=1.0)
    weighted = attach_row(test, weight.select("pos_weight"))
    loss = log_loss(weighted, score, target, F.col("pos_weight"))
    return metric_bundle(test, score, target, stage(tuned), loss, keys)


def metrics_by(
    df: DataFrame, keys: Sequence[str], score: str, target: str, prediction: Column
) -> DataFrame:
    """Counts, threshold-free metrics and prediction metrics per group, such as per day."""
    free = ranking_metrics(df, score, target, keys)
    return prediction_metrics(df, prediction, target, keys).join(free, list(keys))
