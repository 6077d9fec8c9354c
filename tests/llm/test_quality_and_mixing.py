"""Cascade against plain rules, order of rules, mixing totals and chances."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from flowloom.llm.mixing import mix, mix_table, source_targets
from flowloom.llm.quality import RULES, judge, keep_clean, order_rules, quality_table


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts(odd_docs, odd_rows):
    rows = quality_table(odd_docs).collect()
    got = sorted((r["doc_id"] or -1, tuple(r)[1:6]) for r in rows)
    want = sorted((i or -1, base(t)) for i, t, *_ in odd_rows)
    assert got == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert not (r["kept"] and failed)


def test_order_changes_no_verdict(odd_docs, make_docs):
    noisy = make_docs([(i, "word# " * i + "plain text " * (60 - i)) for i in range(60)])
    for docs in (odd_docs, noisy):
        ordered = order_rules(docs)
        assert sorted(r.name for r in ordered) == sorted(r.name for r in RULES)
        few = RULES[:3]
        kept = [
            sorted(str(r["doc_id"]) for r in keep_clean(docs, rules=rules).select("doc_id").collect())
            for rules in (few, few[::-1])
        ]
        assert kept[0] == kept[1]
        assert keep_clean(docs).columns == docs.columns


def test_cheap_and_selective_rule_first(make_docs):
    docs = make_docs([(i, "x# " * 60) for i in range(50)])
    assert order_rules(docs)[0].name in ("symbols", "few_kinds")
    assert {r["rejected_by"] for r in judge(docs).collect()} == {order_rules(docs)[0].name}


def test_empty_table(no_docs):
    assert quality_table(no_docs).count() == 0
    assert keep_clean(no_docs).count() == 0
    assert mix_table(no_docs).count() == 0
    assert mix(no_docs).count() == 0


def water(sizes, weights=(5, 2, 1)):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]} if total else set()
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over


def test_targets(spark):
    sizes = {"a": 10, "b": 300, "c": 500, "d": 7, None: 90, "e": 1200}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = water(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_meets_targets(make_docs):
    rows = [(i, "w " * (1 + i * 7919 % 90), f"s{i % 4}" if i % 11 else None) for i in range(1500)]
    docs = make_docs(rows)
    table = mix_table(docs).collect()
    assert table == mix_table(docs.repartition(7)).orderBy("doc_id").collect() or sorted(table) == sorted(
        mix_table(docs.repartition(7)).collect()
    )
    taken, target, largest = defaultdict(int), {}, 90
    source = {i: s for i, _, s in rows}
    for r in table:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest / 2 + 1e-6
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in table if r["taken"]}


def test_unequal_chances(make_docs):
    """Documents of larger relative weight are taken more often, in proportion."""
    docs = make_docs([(i, "w w w w", "s") for i in range(4000)])
    rows = mix_table(docs, relative=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    even = sum(r["taken"] for r in rows if r["doc_id"] % 2 == 0)
    odd = sum(r["taken"] for r in rows if r["doc_id"] % 2)
    # 150 % of 16,000 words. Even ones stop at two copies each; what they leave, 8,000 words, gives
    # every odd one a certain copy.
    assert (even, odd) == (16_000, 8_000)


def test_odd_rows_mix(odd_docs, odd_rows):
    rows = mix_table(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mix(odd_docs).columns == odd_docs.columns
