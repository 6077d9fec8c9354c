"""Metrics against pair counting and loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import metrics


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "score double, y int")


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(pairs):
    n_pos = sum(y for _, y in pairs)
    total = before = 0.0
    for limit in sorted({s for s, _ in pairs}, reverse=True):
        kept = [y for s, y in pairs if s >= limit]
        recall = sum(kept) / n_pos
        total += (recall - before) * sum(kept) / len(kept)
        before = recall
    return total


@pytest.mark.parametrize("limit", [None, "7"])
def test_auc_and_average_precision(spark, limit):
    draw = random.Random(3)
    pairs = [(round(draw.random(), 2), int(draw.random() < 0.3)) for _ in range(200)]
    if limit:
        spark.conf.set("flowloom.taskRows", limit)
    try:
        row = metrics.ranking_metrics(frame(spark, pairs), "score", "y").first()
        keyed = frame(spark, pairs).withColumn("day", F.lit("Mon")).repartition(3)
        by_day = metrics.ranking_metrics(keyed, "score", "y", ["day"]).first()
    finally:
        spark.conf.unset("flowloom.taskRows")
    for r in (row, by_day):
        assert r["roc_auc"] == pytest.approx(brute_auc(pairs))
        assert r["pr_auc"] == pytest.approx(brute_ap(pairs))


def test_one_class_and_ties(spark):
    row = metrics.ranking_metrics(frame(spark, [(0.1, 1), (0.9, 1)]), "score", "y").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    row = metrics.ranking_metrics(frame(spark, [(0.5, 1), (0.5, 0)]), "score", "y").first()
    assert (row["roc_auc"], row["pr_auc"]) == (0.5, 0.5)


def brute(pairs, hit):
    tp = sum(hit(s) and y == 1 for s, y in pairs)
    fp = sum(hit(s) and y == 0 for s, y in pairs)
    fn = sum(not hit(s) and y == 1 for s, y in pairs)
    tn = sum(not hit(s) and y == 0 for s, y in pairs)
    return tp, fp, tn, fn


@pytest.mark.parametrize("grid", [metrics.GRID, metrics.SEQUENCE_GRID])
@pytest.mark.parametrize("strict", [False, True])
def test_sweep_on_the_grid_itself(spark, grid, strict):
    """Scores equal to grid values are where rounding would show."""
    draw = random.Random(5)
    pairs = [(g, draw.randrange(2)) for g in grid] + [(-1.0, 0), (0.0, 1), (1.0, 1), (7.5, 0)]
    rows = metrics.threshold_sweep(frame(spark, pairs), "score", "y", grid, strict=strict)
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in rows.collect()}
    assert list(sorted(got)) == grid
    for g in grid:
        assert got[g] == brute(pairs, lambda s, g=g: s > g if strict else s >= g), g


def test_rates(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 1), (0.1, 0), (0.0, 0)]
    row = metrics.metrics_at(frame(spark, pairs), "score", "y", 0.5).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 1, 2, 1)
    assert row["accuracy"] == pytest.approx(4 / 6)
    assert row["balanced_accuracy"] == pytest.approx(2 / 3)
    assert row["mcc"] == pytest.approx(3 / math.sqrt(3 * 3 * 3 * 3))
    assert row["f1"] == pytest.approx(2 / 3)
    assert (row["support_pos"], row["support_neg"]) == (3, 3)
    only = metrics.metrics_at(frame(spark, [(0.1, 0)]), "score", "y", 0.5).first()
    assert (only["f1"], only["recall"], only["precision"], only["mcc"]) == (0, 0, 0, 0)
    assert only["balanced_accuracy"] == 1.0


def test_best_threshold_prefers_the_lowest(spark):
    sweep = metrics.threshold_sweep(frame(spark, [(0.9, 1), (0.1, 0)]), "score", "y")
    best = metrics.best_threshold(sweep).first()
    assert best["f1"] == 1.0 and best["threshold"] == 0.11


def test_holdout_report(spark):
    rows = [("train", 0.4, 1), ("train", 0.1, 0), ("train", 0.2, 0), ("val", 0.72, 1)]
    rows += [("val", 0.7, 0), ("test", 0.715, 1), ("test", 0.69, 0), ("test", 0.6, 0)]
    df = spark.createDataFrame(rows, "split string, score double, y int")
    out = {r["mode"]: r for r in metrics.holdout_report(df, "score", "y").collect()}
    tuned, half = out["threshold_tuned"], out["threshold_0_5"]
    assert tuned["threshold"] == 0.71
    assert (tuned["tp"], tuned["fp"], half["fp"], half["roc_auc"]) == (1, 0, 2, 1.0)
    losses = [-2 * math.log(0.715), -math.log(1 - 0.69), -math.log(1 - 0.6)]
    assert tuned["loss"] == pytest.approx(sum(losses) / 3)


def test_weight_and_loss(spark):
    df = frame(spark, [(0.5, 1), (0.0, 0), (1.0, 0)])
    weight = metrics.positive_weight(df, "y").first()
    assert (weight["n_pos"], weight["n_neg"], weight["pos_weight"]) == (1, 2, 2.0)
    loss = metrics.log_loss(df, "score", "y", F.lit(2.0)).first()["loss"]
    want = (-2 * math.log(0.5) - math.log(1 - 1e-12) - math.log(1 - (1 - 1e-12))) / 3
    assert loss == pytest.approx(want, rel=1e-4)
    empty = metrics.positive_weight(df.where("y = 0"), "y", one_class=1.0).first()
    assert empty["pos_weight"] == 1.0
    assert metrics.positive_weight(df.where("y = 0"), "y").first()["pos_weight"] == 2.0
