"""Split assignment against straightforward loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import splits, validation
from flowloom.operators.splits import EVENT_RULE, GRAPH_RULE, RATIOS, SPLITS, TOKEN_RULE


def gain(target, filled, size):
    scale = max(target, 1.0)
    return max(target - filled, 0.0) / scale - max(filled + size - target, 0.0) / scale


def greedy(units, rule, seed=42):
    """One unit after the other, as the rule is defined."""
    out = {}
    for day in sorted({u["day"] for u in units}):
        mine = [u for u in units if u["day"] == day]

        def tie(u):
            text = f"{seed}|{u[rule.unit]}".encode()
            return hashlib.md5(text).hexdigest() if rule.hashed_ties else ""

        mine.sort(
            key=lambda u: (-u[rule.target], *[-u[c] for c in rule.visit], tie(u), u[rule.unit])
        )
        n_class = {c: sum(u[rule.target] == c for u in mine) for c in (0, 1)}
        total = {m: sum(u[m] for u in mine) for m in rule.measures}
        state = {s: dict.fromkeys(["n", 0, 1, *rule.measures], 0.0) for s in SPLITS}
        for u in mine:
            best = None
            for rank, s in enumerate(SPLITS):
                ratio, now, c = RATIOS[s], state[s], u[rule.target]
                by_class = gain(n_class[c] * ratio, now[c], 1.0)
                score = 4.0 * by_class + 2.5 * gain(len(mine) * ratio, now["n"], 1.0)
                gains = {m: gain(total[m] * ratio, now[m], u[m]) for m in rule.measures}
                for m, weight in rule.measures.items():
                    score += weight * gains[m]
                key = (
                    round(score, 12), round(by_class, 12),
                    *[round(gains[m], 12) for m in rule.ties],
                    -now[rule.load], -now["n"], -rank,
                )
                if best is None or key > best[0]:
                    best = (key, s)
            state[best[1]]["n"] += 1
            state[best[1]][u[rule.target]] += 1
            for m in rule.measures:
                state[best[1]][m] += u[m]
            out[u["day"], u[rule.unit]] = best[1]
    return out


def random_units(rule, n, spread, seed):
    """Small ``spread`` makes many equal units, so runs are long."""
    draw = random.Random(seed)
    units = []
    for i in range(n):
        unit = {
            "day": draw.choice(["Mon", "Mon", "Tue", "Wed"]),
            rule.unit: f"g{i:04d}",
            rule.target: int(draw.random() < 0.3),
        }
        for m in rule.measures:
            unit[m] = draw.randrange(0 if "attack" in m or "pos" in m else 1, spread + 1)
        units.append(unit)
    return units


def frame(spark, units, rule):
    counts = ", ".join(f"{m} long" for m in rule.measures)
    return spark.createDataFrame(units, f"day string, {rule.unit} string, {rule.target} int, {counts}")


@pytest.mark.parametrize("rule", [GRAPH_RULE, TOKEN_RULE, EVENT_RULE])
@pytest.mark.parametrize("n, spread", [(1, 3), (150, 1), (150, 40)])
def test_balanced_equals_unit_by_unit(spark, rule, n, spread):
    units = random_units(rule, n, spread, seed=n + spread)
    out = splits.balanced_split(frame(spark, units, rule), rule).collect()
    assert len(out) == n
    assert {(r["day"], r[rule.unit]): r["split"] for r in out} == greedy(units, rule)


def test_balanced_in_small_blocks_and_chunks(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(splits, "PICK_BLOCK", 5)
    units = random_units(TOKEN_RULE, 200, 1, seed=9)
    df = frame(spark, units, TOKEN_RULE)
    out = splits.balanced_split(df, TOKEN_RULE).collect()
    assert {(r["day"], r["split_group_id"]): r["split"] for r in out} == greedy(units, TOKEN_RULE)


def test_balanced_in_stored_segments(spark):
    """A day walked in segments of five runs, each from the totals of the one before."""
    units = random_units(TOKEN_RULE, 90, 9, 4)
    spark.conf.set("flowloom.segmentRuns", "5")
    try:
        out = splits.balanced_split(frame(spark, units, TOKEN_RULE), TOKEN_RULE).collect()
    finally:
        spark.conf.unset("flowloom.segmentRuns")
    assert {(r["day"], r[TOKEN_RULE.unit]): r["split"] for r in out} == greedy(units, TOKEN_RULE)


def test_many_different_sizes_in_one_day(spark):
    """A walk of 50,000 runs, one unit each, takes seconds."""
    import time

    rule = GRAPH_RULE
    sizes = [F.floor(F.xxhash64("id", F.lit(i)) % 50_000 + 60_000).cast("long").alias(m) for i, m in enumerate(rule.measures)]
    df = spark.range(50_000).select(
        F.col("id").cast("string").alias(rule.unit), F.lit("Monday").alias("day"),
        (F.col("id") % 2).cast("int").alias(rule.target), *sizes,
    )
    start = time.time()
    counts = {r["split"]: r["count"] for r in splits.balanced_split(df, rule).groupBy("split").count().collect()}
    assert time.time() - start < 60
    assert abs(counts["train"] - 35_000) < 100 and abs(counts["val"] - 7_500) < 100


def test_balanced_does_not_depend_on_partitions(spark):
    units = random_units(EVENT_RULE, 120, 3, seed=4)
    results = []
    for partitions in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = frame(spark, units, EVENT_RULE).repartition(int(partitions))
        out = splits.balanced_split(df, EVENT_RULE).collect()
        results.append({(r["day"], r["split_group_id"]): r["split"] for r in out})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_large_group_of_equal_units_keeps_shares(spark):
    df = spark.range(20_000).select(
        F.lit("Mon").alias("day"),
        F.col("id").cast("string").alias("graph_id"),
        F.lit(0).alias("graph_y"),
        F.lit(10).cast("long").alias("n_nodes"),
        F.lit(0).cast("long").alias("n_pos_nodes"),
    )
    counts = splits.balanced_split(df, GRAPH_RULE).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {
        "train": 14_000, "val": 3_000, "test": 3_000,
    }


def test_temporal_split(spark, small_tasks):
    data = [(f"2024-01-{i:02d}", "d", f"g{i}") for i in range(1, 21)]
    df = spark.createDataFrame(data, "group_start_ts string, day string, split_group_id string")
    out = {r["split_group_id"]: r["split"] for r in splits.temporal_split(df).collect()}
    ranks = [i / 19 for i in range(20)]
    want = ["train" if p < 0.7 else "val" if p < 0.85 else "test" for p in ranks]
    assert [out[f"g{i}"] for i in range(1, 21)] == want


def test_single_group_trains(spark):
    df = spark.createDataFrame(
        [("2024", "d", "g", 1)], "group_start_ts string, day string, split_group_id string, y int"
    )
    assert splits.temporal_split(df).first()["split"] == "train"
    assert splits.stratified_split(df, "split_group_id", "y").first()["legacy_split"] == "train"


def test_stratified_split(spark):
    data = [("d", f"u{i}", i % 2) for i in range(101)]
    df = spark.createDataFrame(data, "day string, unit string, y int")
    out = {r["unit"]: r["legacy_split"] for r in splits.stratified_split(df, "unit", "y").collect()}
    for y in (0, 1):
        mine = sorted(
            (u for _, u, c in data if c == y),
            key=lambda u: (hashlib.md5(f"42|{u}".encode()).hexdigest(), u),
        )
        for i, u in enumerate(mine):
            p = i / (len(mine) - 1)
            assert out[u] == ("train" if p < 0.7 else "val" if p < 0.85 else "test")


def test_leakage_and_empty_totals(spark):
    df = spark.createDataFrame(
        [("a", "train"), ("a", "val"), ("b", "test")], "g string, split string"
    )
    row = validation.leakage_check(df, "g").first()
    assert (row["groups_total"], row["max_splits_per_group"], row["leaking_groups"]) == (2, 2, 1)
    summary = spark.createDataFrame(
        [("s", "train", "ALL", 7, 0), ("s", "val", "ALL", 3, 0)],
        "summary_label string, split string, day string, n_groups long, n_pos long",
    )
    row = validation.balance_error(summary, ["n_groups", "n_pos"]).first()
    assert row["n_groups"] == pytest.approx(0.0 + 0.15 + 0.15)
    assert row["n_pos"] == 0.0


def test_require_both_classes(spark):
    rows = [("train", "ALL", 5, 2, 9, 3), ("val", "ALL", 2, 0, 4, 1), ("test", "ALL", 2, 1, 4, 4)]
    summary = spark.createDataFrame(
        rows,
        "split string, day string, n_sequences long, n_attack_sequences long, n_events long,"
        "n_attack_events long",
    )
    coverage = validation.class_coverage(summary)
    with pytest.raises(ValueError, match="sequence classes in val"):
        validation.require_both_classes(coverage)
    with pytest.raises(ValueError, match="event classes in test"):
        validation.require_both_classes(coverage, "event")
    assert validation.impossible_summary_rows(summary).count() == 0


def test_require_splits(spark):
    df = spark.createDataFrame(
        [("train", 5, 0), ("val", 1, 1)], "split string, n_total long, n_benign long"
    )
    with pytest.raises(ValueError, match="train, test"):
        validation.require_splits(df)


def test_units_without_a_day_are_kept(spark):
    rows = [(None if i % 3 == 0 else "Mon", f"g{i}", i % 2, 10 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "day string, graph_id string, graph_y int, n_nodes long")
    out = splits.stratified_split(df, "graph_id", "graph_y", 42, "split").collect()
    assert len(out) == 60 and all(r["split"] for r in out)
    more = df.withColumn("n_pos_nodes", F.col("graph_y").cast("long"))
    out = splits.balanced_split(more, splits.GRAPH_RULE).collect()
    assert len(out) == 60
    unnamed = [r["split"] for r in out if r["day"] is None]
    assert len(unnamed) == 20 and set(unnamed) == {"train", "val", "test"}
