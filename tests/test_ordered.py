"""The chunked plans must equal the plain windows and a brute-force loop."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.plans import ordered
from flowloom.plans.lookups import SALTS, lookup_join, spread_lookup
from flowloom.plans.staging import stage_measured


def rows(seed=1, n=300):
    """A third of all rows share one key; times tie often; one key is null."""
    draw = random.Random(seed)
    keys = ["hot"] * (n // 3) + [draw.choice(["a", "b", None, "c"]) for _ in range(n - n // 3)]
    return [(k, draw.randrange(20), i, draw.randrange(5)) for i, k in enumerate(keys)]


@pytest.fixture
def table(spark):
    data = rows()
    return data, spark.createDataFrame(data, "k string, t int, id int, v int").repartition(5)


def groups(data, order):
    found = defaultdict(list)
    for row in data:
        found[row[0]].append(row)
    return {k: sorted(v, key=order) for k, v in found.items()}


def expected_sums(data):
    out = {}
    for part in groups(data, lambda r: (r[1], r[2])).values():
        total = 0
        for row in part:
            total += row[3]
            out[row[2]] = total
    return out


def check_sums(data, df):
    out = ordered.running_totals(df, ["k"], [F.col("t"), F.col("id")], {"s": F.col("v")})
    assert {r["id"]: r["s"] for r in out.collect()} == expected_sums(data)


def test_running_totals(table):
    check_sums(*table)


def test_running_totals_in_chunks(table, small_tasks):
    check_sums(*table)


def test_only_large_groups_are_cut(spark, table):
    """With one hot group all others keep the plain window, and chunks hold the hot rows only."""
    data, df = table
    order, totals = [F.col("t"), F.col("id")], {"s": F.col("v")}
    seen = []
    inner = ordered._chunked_totals
    spark.conf.set("flowloom.taskRows", "90")
    try:
        ordered._chunked_totals = lambda rows, *rest: seen.append((rows, rest[-1])) or inner(rows, *rest)
        out = ordered.running_totals(df, ["k"], order, totals)
        assert {r["id"]: r["s"] for r in out.collect()} == expected_sums(data)
        few = ordered.running_totals(df.where("k <> 'hot'"), ["k"], order, totals)
        known = ordered.running_totals(df.where("k <> 'hot'"), ["k"], order, totals, largest=80)
        assert sorted(map(str, few.collect())) == sorted(map(str, known.collect()))
    finally:
        ordered._chunked_totals = inner
        spark.conf.unset("flowloom.taskRows")
    [(rows, size)] = seen
    assert size == rows.count() == 100 and rows.where("k <> 'hot'").count() == 0


def test_chunks_are_bounded(table, small_tasks, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_CHUNKS", 3)
    check_sums(*table)


def test_running_totals_without_keys(table, small_tasks):
    data, df = table
    out = ordered.positions(df, [], [F.col("v").desc(), F.col("id")], "pos")
    want = sorted(data, key=lambda r: (-r[3], r[2]))
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["pos"])] == [
        r[2] for r in want
    ]


@pytest.mark.parametrize("k", [1, 3, 9])
def test_following(table, small_tasks, k):
    data, df = table
    out = ordered.following(df, ["k"], [F.col("t"), F.col("id")], "id", k, "next")
    want = {}
    for part in groups(data, lambda r: (r[1], r[2])).values():
        ids = [r[2] for r in part]
        for i, own in enumerate(ids):
            want[own] = (ids[i + 1 : i + 1 + k] + [None] * k)[:k]
    assert {r["id"]: r["next"] for r in out.collect()} == want


def test_first_rows_in_slices(table, small_tasks):
    data, df = table
    out = ordered.first_rows(df, ["k"], [F.col("t").desc(), F.col("id").desc()], 4)
    want = [
        r for part in groups(data, lambda r: (-r[1], -r[2])).values() for r in part[:4]
    ]
    assert Counter(r["id"] for r in out.collect()) == Counter(r[2] for r in want)


@pytest.mark.parametrize("limit", [None, "7"])
def test_percentiles(spark, table, limit):
    data, df = table
    if limit:
        spark.conf.set("flowloom.taskRows", limit)
    try:
        out = ordered.percentiles(df, ["k"], "t", {"p50": 0.5, "p99": 0.99}).collect()
        whole = ordered.percentiles(df, [], "t", {"p95": 0.95}).first()
    finally:
        spark.conf.unset("flowloom.taskRows")
    for key, part in groups(data, lambda r: r[1]).items():
        if key is None:
            continue
        row = next(r for r in out if r["k"] == key)
        values = [r[1] for r in part]
        assert row["p50"] == pytest.approx(np.percentile(values, 50))
        assert row["p99"] == pytest.approx(np.percentile(values, 99))
    assert whole["p95"] == pytest.approx(np.percentile([r[1] for r in data], 95))


def wide_values(draw, n):
    """Values of many magnitudes and signs, ties, zeros, a narrow heap, and two infinities."""
    makers = [
        lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300),
        lambda: float(draw.randrange(-3, 4)),
        lambda: 0.75 + draw.random() * 1e-9,
        lambda: 0.75,
        lambda: draw.choice([0.0, -0.0, 5e-324, -5e-324]),
    ]
    return [float("inf"), float("-inf"), *[draw.choice(makers)() for _ in range(n)]]


@pytest.mark.parametrize("limit", ["5", "40", None])
def test_percentiles_of_wide_values(spark, limit):
    """Refined histograms, the values left over in order, and the plain window agree with a sort."""
    draw = random.Random(3)
    data = {"hot": wide_values(draw, 900), "few": [2.5], "same": [0.1] * 60, "odd": wide_values(draw, 301)}
    pairs = [(k, v) for k, values in data.items() for v in values] + [("few", None), (None, 1.0)]
    df = spark.createDataFrame(pairs, "k string, v double").repartition(7)
    wanted = {f"p{k}": k / 100 for k in (1, 25, 50, 60, 90, 99)}
    if limit:
        spark.conf.set("flowloom.taskRows", limit)
    try:
        got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "v", wanted).collect()}
    finally:
        spark.conf.unset("flowloom.taskRows")
    assert set(got) == set(data)
    for key, values in data.items():
        ranked = sorted(values)
        for name, share in wanted.items():
            rank = (len(ranked) - 1) * share
            low, high = ranked[int(rank)], ranked[-int(-rank // 1)]
            assert got[key][name] == low + (high - low) * (rank - int(rank)), (key, name)


def test_bins_follow_the_order(spark):
    """A larger value never has a smaller bin, also next to powers of two and at the ends."""
    near = [np.nextafter(2.0**e, d) for e in range(-60, 60, 7) for d in (0, 1e300)]
    ends = [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    values = sorted([*near, *ends, 0.0, *[-v for v in near], *[-v for v in ends]]) + [float("nan")]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    bins = [r["b"] for r in df.select("i", ordered.log_bin(F.col("v")).alias("b")).sort("i").collect()]
    assert bins == sorted(bins) and bins[-1] > bins[-2] > bins[-3]


def test_large_tables_order_few_values(spark):
    """Beyond the limit only values of the intervals with the ranks are put in order."""
    df = spark.range(20_000).select((F.col("id") * 0.37 % 100).alias("v"), F.lit("k").alias("k"))
    spark.conf.set("flowloom.taskRows", "1000")
    try:
        found, largest = ordered._narrowed(df, ["k"], "v", {"p95": 0.95, "p99": 0.99})
        rows = found.collect()
    finally:
        spark.conf.unset("flowloom.taskRows")
    assert largest <= 1000 and len(rows) <= 4 and sum(r["_n"] for r in rows) < 1000


def test_stage_measured(spark):
    table, found = stage_measured(spark.range(100).where("id % 3 = 0"), most=F.max("id"))
    assert found == {"rows": 34, "most": 99} and table.count() == 34
    _, empty = stage_measured(spark.range(100).where("id < 0").groupBy("id").count())
    assert empty == {"rows": 0}


def test_salted_lookup_equals_broadcast(spark, table, no_broadcast):
    data, df = table
    lookup = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, w int")
    for how in ("inner", "left"):
        got = lookup_join(df, lookup, ["k"], spread=["id"], how=how)
        want = df.join(F.broadcast(lookup), "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(
            map(str, want.collect())
        )


def test_only_heavy_keys_are_copied(spark, no_broadcast):
    facts = spark.range(9000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    lookup = spark.range(-1, 9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("flowloom.heavyRows", "100")
    try:
        salted, copies = spread_lookup(facts, lookup, ["k"], ["id"])
        assert copies.count() == 9001 + SALTS - 1
        assert salted.select("_salt").distinct().count() == SALTS
        got = lookup_join(facts, lookup, ["k"], spread=["id"])
        assert got.count() == 9000 and got.where("v <> k * 2").count() == 0
    finally:
        spark.conf.unset("flowloom.heavyRows")
