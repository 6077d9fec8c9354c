"""Anomaly scores of sequences and flow classifiers as Spark jobs.

These take the place of networks trained on one machine. They read the same inputs and
splits and answer the same question, but their scores are their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.operators.encoding import event_rows, pool_sequences
from flowloom.operators.metrics import positive_weight
from flowloom.plans.lookups import attach_row, fits_in_memory, lookup_join
from flowloom.plans.ordered import first_rows, percentiles
from flowloom.plans.staging import stage, stage_measured

START = "[CLS]"
CANDIDATES = 9
BENIGN_FRACTION = 0.99
SCORE_COLUMNS = ["error_ratio", "mean_loss", "distance", "composite_score"]


def transitions(sequences: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(token before, token) pairs; the first token follows the start mark."""
    items = sequences.withColumn("_before", F.concat(F.array(F.lit(START)), F.col("tokens")))
    return items.select(
        "seq_id", *keep, "_before", F.posexplode("tokens").alias("pos", "token")
    ).select("seq_id", *keep, "pos", F.get("_before", F.col("pos")).alias("prev"), "token")


def transition_counts(train_benign: DataFrame) -> DataFrame:
    return (
        transitions(train_benign)
        .groupBy("prev", "token")
        .agg(F.count(F.lit(1)).alias("n_pair"))
    )


def benign_candidates(counts: DataFrame, g: int = CANDIDATES) -> DataFrame:
    """The ``g`` most frequent next tokens of every token; equal counts by token."""
    return first_rows(counts, ["prev"], [F.desc("n_pair"), F.col("token")], g)


def next_token_scores(
    sequences: DataFrame, train_benign: DataFrame, g: int = CANDIDATES, keep: Sequence[str] = ()
) -> DataFrame:
    """Share of tokens that are no benign candidate, and mean add-one log-loss."""
    counts, found = stage_measured(transition_counts(train_benign))
    words = counts.select(F.count_distinct("token").alias("n_words"))
    steps = transitions(sequences, keep)
    if fits_in_memory(counts, found["rows"]):
        # Both lookups come from one window and have at most the rows measured.
        prev = Window.partitionBy("prev")
        rank = F.row_number().over(prev.orderBy(F.desc("n_pair"), "token"))
        pairs = counts.withColumn("is_candidate", rank <= g)
        before = counts.groupBy("prev").agg(F.sum("n_pair").alias("n_prev"))
        known = steps.join(F.broadcast(pairs), ["prev", "token"], "left")
        known = known.join(F.broadcast(before), "prev", "left")
    else:
        candidates = benign_candidates(counts, g).select(
            "prev", "token", F.lit(True).alias("is_candidate")
        )
        pairs = counts.join(candidates, ["prev", "token"], "left")
        before = counts.groupBy("prev").agg(F.sum("n_pair").alias("n_prev"))
        known = lookup_join(steps, pairs, ["prev", "token"], spread=["seq_id", "pos"], how="left")
        known = lookup_join(
            known, before, ["prev"], spread=["seq_id", "pos"], how="left", staged=True
        )
    known = attach_row(known, words)
    seen = F.coalesce("n_pair", F.lit(0)) + 1
    loss = -F.ln(seen / (F.coalesce("n_prev", F.lit(0)) + F.col("n_words") + 1))
    return known.groupBy("seq_id", *keep).agg(
        F.avg(F.when(F.col("is_candidate"), 0.0).otherwise(1.0)).alias("error_ratio"),
        F.avg(loss).alias("mean_loss"),
    )


def centroid(vectors: DataFrame, columns: Sequence[str], tiny: float = 1e-6) -> DataFrame:
    """Mean vector in one row; components near zero are moved to ``tiny``."""
    means = vectors.agg(*[F.avg(c).alias(f"{c}_center") for c in columns])
    return means.withColumns(
        {
            f"{c}_center": F.when(F.abs(F.col(f"{c}_center")) < tiny, tiny).otherwise(
                F.col(f"{c}_center")
            )
            for c in columns
        }
    )


def array_centroid(vectors: DataFrame, column: str, tiny: float = 1e-6) -> DataFrame:
    """Mean per dimension of an array column, one row per dimension."""
    return (
        vectors.select(F.posexplode(column).alias("dim", "v"))
        .groupBy("dim")
        .agg(F.avg(F.col("v").cast("double")).alias("center"))
        .withColumn("center", F.when(F.abs("center") < tiny, tiny).otherwise(F.col("center")))
    )


def centroid_distance(
    pooled: DataFrame, train_benign: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Euclidean distance of every sequence vector from the benign training centre."""
    center = centroid(train_benign, columns)
    squares = [F.pow(F.col(c) - F.col(f"{c}_center"), F.lit(2)) for c in columns]
    total = sum(squares[1:], squares[0])
    return attach_row(pooled, center).withColumn("distance", F.sqrt(total)).drop(*center.columns)


def distance_score(stats_mean: Column, stats_std: Column) -> Column:
    z = (F.col("distance") - stats_mean) / F.greatest(stats_std, F.lit(1e-12))
    return F.greatest(z, F.lit(0.0))


def benign_score_stats(benign: DataFrame, fraction: float = BENIGN_FRACTION) -> DataFrame:
    """Thresholds from benign training scores, and mean and spread of the distance."""
    mean, spread = benign.agg(F.avg("distance"), F.stddev_pop("distance")).first()
    moments = {
        "distance_mean": F.lit(mean).cast("double"),
        "distance_std": F.lit(spread if spread and spread > 0 else 1e-12),
    }
    scored = _composite(benign, *moments.values())
    # One pass for the three columns: long form keyed by score name.
    names = ["error_ratio", "distance", "composite_score"]
    long = scored.select(F.explode(_named(names)).alias("s")).select("s.name", "s.value")
    found = percentiles(long, ["name"], "value", {"at": fraction})
    limits = found.agg(
        *[
            F.max(F.when(F.col("name") == n, F.col("at"))).alias(f"{n}_threshold")
            for n in names
        ]
    )
    return limits.withColumns(moments)


def _named(names: Sequence[str]) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]
    )


def _composite(scores: DataFrame, mean: Column, std: Column) -> DataFrame:
    return scores.withColumn("distance_z", distance_score(mean, std)).withColumn(
        "composite_score", F.col("error_ratio") + F.col("distance_z")
    )


def with_composite(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Error ratio plus the positive part of the standardised distance."""
    moments = stats.select("distance_mean", "distance_std")
    both = attach_row(scores, moments)
    return _composite(both, F.col("distance_mean"), F.col("distance_std")).drop(*moments.columns)


def either_rule(ratio_limit: Column, distance_limit: Column, use_distance: bool = True) -> Column:
    """Error ratio or distance above its limit."""
    flagged = F.col("error_ratio") > ratio_limit
    return flagged | (F.col("distance") > distance_limit) if use_distance else flagged


def flag_anomalies(scores: DataFrame, stats: DataFrame, use_distance: bool = True) -> DataFrame:
    """Composite score and the 0/1 verdict of the percentile rule."""
    limits = stats.select("error_ratio_threshold", "distance_threshold")
    rule = either_rule(
        F.col("error_ratio_threshold"), F.col("distance_threshold"), use_distance
    )
    return (
        attach_row(with_composite(scores, stats), limits)
        .withColumn("prediction", rule.cast("int"))
        .drop(*limits.columns)
    )


def score_summary(scores: DataFrame, columns: Sequence[str] = tuple(SCORE_COLUMNS)) -> DataFrame:
    """Moments and percentiles of every score column, overall and by class."""
    rows = scores.select("seq_y", F.explode(_named(columns)).alias("s")).select(
        "seq_y", "s.name", "s.value"
    )
    table = stage(rows)
    y = F.col("seq_y")
    moments = table.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.count_if(y == 1).alias("n_attack"),
        F.count_if(y == 0).alias("n_benign"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.avg(F.when(y == 0, F.col("value"))).alias("benign_mean"),
        F.avg(F.when(y == 1, F.col("value"))).alias("attack_mean"),
    )
    # Every score counts overall and in its class; all percentiles come from one pass.
    classes = F.array(F.lit("all"), F.when(y == 0, "benign").when(y == 1, "attack"))
    each = table.select("name", F.explode(classes).alias("part"), "value")
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = percentiles(each, ["name", "part"], "value", wanted, staged=True)
    shown = [("all", p, p) for p in wanted]
    shown += [(part, "p95", f"{part}_p95") for part in ("benign", "attack")]
    limits = found.groupBy("name").agg(
        *[F.max(F.when(F.col("part") == part, F.col(p))).alias(n) for part, p, n in shown]
    )
    return moments.join(limits, "name")


#: Fading beyond exp(-40), below the precision of a double, restarts the running sums.
FADE_SPAN = 40.0


def decayed_state(events: DataFrame, features: Sequence[str], rate: float) -> DataFrame:
    """Running sum of features that fades by ``exp(-rate * gap)`` between events.

    Closed form of the fold over events, for any rate. Time is measured in units of the
    decay and cut into spans of ``FADE_SPAN``. Sums run inside a span, with exponents that
    start again at its begin, and the sum of the span before is added, faded. What is older
    has faded below the precision of a double.
    """
    whole = Window.partitionBy("seq_id")
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    span = Window.partitionBy("seq_id", "_span").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = whole.orderBy("_span").rangeBetween(-1, -1)
    timed = events.withColumn(
        "_age", (F.col("t") - F.first(F.col("t")).over(upto)) * F.lit(float(rate))
    ).withColumn("_span", F.floor(F.col("_age") / FADE_SPAN))
    start = F.col("_span") * FADE_SPAN
    grow, fade = F.exp(F.col("_age") - start), F.exp(start - F.col("_age"))
    faded = F.exp(F.col("_age") - start - FADE_SPAN)

    def state(d: int) -> Column:
        value = F.col("x")[d]
        carried = F.coalesce(F.sum(value * faded).over(before), F.lit(0.0))
        return fade * (F.sum(value * grow).over(span) + carried)

    states = [state(d).alias(f"{name}_state") for d, name in enumerate(features)]
    return timed.select("*", *states).drop("_age", "_span")


def sequence_state_features(
    sequences: DataFrame, features: Sequence[str], rate: float
) -> DataFrame:
    """Mean, maximum and last decayed state of every sequence."""
    states = decayed_state(event_rows(sequences), features, rate)
    pooled = []
    for name in features:
        state = f"{name}_state"
        pooled += [
            F.avg(state).alias(f"{state}_mean"),
            F.max(state).alias(f"{state}_max"),
            F.max_by(state, "pos").alias(f"{state}_last"),
        ]
    keys = sequences.select("seq_id", "day", "split", "seq_y")
    return keys.join(states.groupBy("seq_id").agg(*pooled), "seq_id")


def classify(
    rows: DataFrame, features: Sequence[str], target: str, train: Column, max_iter: int = 25
) -> DataFrame:
    """Probability of the attack class from a weighted logistic regression.

    Scaling and weights come from the training rows only. Missing features count as 0.
    """
    table = stage(rows.fillna(0.0, list(features)))
    weight = positive_weight(table.where(train), target, one_class=1.0)
    weighted = attach_row(table, weight.select("pos_weight")).withColumn(
        "_w", F.when(F.col(target) == 1, F.col("pos_weight")).otherwise(1.0)
    )
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(
            featuresCol="_scaled",
            labelCol=target,
            weightCol="_w",
            maxIter=max_iter,
            regParam=1e-4,
            probabilityCol="_p",
            predictionCol="_label",
            rawPredictionCol="_margin",
        ),
    ]
    model = Pipeline(stages=stages).fit(weighted.where(train))
    scored = model.transform(weighted)
    return scored.select(*rows.columns, vector_to_array("_p")[1].alias("probability"))


def pooled_vectors(sequences: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Sequences with their mean vector, and the names of its columns."""
    return pool_sequences(sequences, features), [f"{c}_mean" for c in features]
