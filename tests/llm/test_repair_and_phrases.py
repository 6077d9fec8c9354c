"""Conversation repair, collocations and exact duplicates, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowloom.llm import collocations as phrases
from flowloom.llm.collocation_queries import SQL as PHRASE_SQL
from flowloom.llm.collocations import collocations, count_phrases
from flowloom.llm.live_digests import CuckooFilter, LiveDigests, digests, exact_groups, partial_index
from flowloom.llm.turn_repair import (
    REPAIR_SIGNS,
    SIGNS,
    SuffixAutomaton,
    audited,
    damaged,
    keyed,
    repair_report,
    repair_rows,
)

# ---------------------------------------------------------------- conversations

GRAMMAR = re.compile("(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, sign string, conv string, hash string"


def plain_audit(sign):
    """(cost, audit) over all edit sequences with at most two inserts a gap, for short signatures."""
    best = None

    def go(i, initials, cost, audit, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(sign) and GRAMMAR.fullmatch(initials):
            best = min(best or (cost, audit), (cost, audit))
        if run < 2:
            for x in "ua":
                go(i, initials + x, cost + 5, audit + "I", run + 1)
        if i == len(sign):
            return
        initial, fault = "suao"[SIGNS.index(sign[i]) // 4], SIGNS.index(sign[i]) % 4
        go(i + 1, initials, cost + 2, audit + "D", 0)
        if fault in (0, 3):
            more = 5 if fault == 3 else 0
            go(i + 1, initials + initial, cost + more, audit + "K", 0)
            for x in "ua":
                go(i + 1, initials + x, cost + more + 1, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def reduced(sign):
    return sign[::-1].translate(str.maketrans(SIGNS, REPAIR_SIGNS))


def test_audits_equal_all_edits():
    automaton = SuffixAutomaton()
    signs = ["".join(x) for n in range(3) for x in itertools.product(SIGNS, repeat=n)]
    rng = random.Random(3)
    signs += ["".join(rng.choices("AEIEIEIHLBM", k=rng.randint(3, 4))) for _ in range(80)]
    for sign in sorted(signs, key=reduced):
        assert automaton.best(reduced(sign)) == plain_audit(sign), sign


def test_nodes_are_shared_and_long_signatures_work():
    automaton = SuffixAutomaton()
    tail = "ua" * 500
    first = automaton.best(reduced("EI" * 500))
    made = automaton.made
    assert first == (0, "K" * 1000) and made == len(tail)
    assert automaton.best(reduced("A" + "EI" * 500)) == (0, "K" * 1001)
    assert automaton.made == made + 1
    assert automaton.best("") == (0, "")


def plain_report(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, held in found.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, sign = set(), ""
        for _, role, text in held:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            sign += SIGNS[4 * max(0, "suao".find(role[:1] or "o") if role[:1] in ("s", "u", "a") else 3) + fault]
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(sum(SIGNS.index(x) % 4 == f for x in sign) for f in (1, 2, 3)), illegal, sign)
    return out


def test_report_of_odd_rows(spark):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "What?", "cut off", " \t", "", None, "Yes.", "é 漢字。", "x" * 20_000 + "."]
    rows = [
        (rng.choice([None, 1, 2, 3, 40, 41]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts))
        for _ in range(60)
    ]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for c in range(50, 90) for t in range(4)]
    rows += rows[:5] + [(None, None, None, None)] * 3
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS).repartition(5)
    got = {r["conv_id"]: r for r in repair_report(damaged(table), table).collect()}
    want = plain_report(rows)
    assert set(got) == set(want)
    automaton = SuffixAutomaton()
    for conv, (*counts, sign) in want.items():
        r = got[conv]
        assert [r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]] == counts, conv
        assert (r["cost"], r["audit"]) == automaton.best(reduced(sign))
    # The repaired rows are those of the hash, and follow the grammar.
    lines = {}
    for r in repair_rows(damaged(table)).collect():
        lines.setdefault(r["conv_id"], []).append((r["line"], r["role"], r["text"]))
    for conv, r in got.items():
        own = sorted(lines.get(" " if conv is None else str(conv), []))
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in own).encode()).hexdigest()
        assert GRAMMAR.fullmatch("".join(x[1][:1] for x in own))


def test_one_large_conversation_spans_tasks(spark):
    """Its signature is put together from the parts of several tasks."""
    rows = spark.range(0, 20_000, numPartitions=7).select(
        F.lit(1).cast("long").alias("conv_id"),
        (F.col("id") + 10).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(".")).alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = audited(keyed(rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r["sign"], r["cost"], r["audit"]) for r in found] == [("EI" * 10_000, 0, "K" * 20_000)]


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair_report(damaged(none), none).count() == 0
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = spark.createDataFrame([(*r, "", "", "") for r in gone], TURNS)
    for r in repair_report(damaged(rows), rows).collect():
        assert (r["cost"], r["audit"], r["gaps"]) == (0, "", 0)
        assert r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- collocations


def plain_counts(rows, least):
    counts, totals = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i : i + n]))
                    counts[key] = counts.get(key, 0) + 1
    return {k: c for k, c in counts.items() if c >= least}, totals


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows, least)
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2:
            continue
        inside = any(
            len(w) > len(words) and c >= a and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (other, w), c in counts.items()
            if other == lang
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank): (phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, held in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(held)[:top], 1)
    }


def phrase_rows(seed, texts):
    rng = random.Random(seed)
    fixed = ["new york city", "a b a b a b", "École Élan vital", "x"]
    out = []
    for _ in range(texts):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice("abcdefgh") * rng.randint(1, 2))
            words.append(rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\u0085 "]))
        out.append(("".join(words), rng.choice(["en", "en", None, "de"])))
    return out


@pytest.mark.parametrize("least,top", [(3, 10_000), (12, 7)])
def test_collocations_equal_plain_counts(spark, least, top):
    rows = phrase_rows(least, 120) + [(None, "en"), ("", None), ("word " * 3000, "xx"), ("A b", "de")] * 2
    table = spark.createDataFrame(
        [(i, t, lang, "x", "x", "x") for i, (t, lang) in enumerate(rows)],
        "doc_id long, text string, lang string, print string, size string, phrase string",
    ).repartition(4)
    got = {
        (r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score"))
        for r in collocations(table, least, top).collect()
    }
    assert got == plain_collocations(rows, least, top)


def test_colliding_fingerprints_change_nothing(spark):
    """With fingerprints of a few bits nearly all collide; they are taken apart by the text."""
    rows = phrase_rows(6, 60)
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want, totals = plain_counts(rows, 4)
    for bits in (4, 9, 64):
        found = {(r["lang"], r["phrase"]): r["f"] for r in count_phrases(table, 4, bits).collect()}
        assert found == {(lang, " ".join(w)): c for (lang, w), c in want.items()} | {(lang, ""): c for lang, c in totals.items()}


def test_words_of_equal_hashes_are_compared():
    rows = phrase_rows(5, 40)
    batch = phrases.pa.array([t for t, _ in rows])
    words = phrases.words_of(batch)
    words.hashes = words.hashes % np.uint64(5)
    numbers = phrases.word_numbers(words)
    texts = [words.raw.tobytes()[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
    assert len(set(zip(texts, numbers.tolist(), strict=True))) == len(set(texts)) == len(set(numbers.tolist()))
    starts = np.arange(len(numbers) - 1)
    firsts, counts = phrases.verified_groups(numbers, 2, starts, np.zeros(len(starts), np.uint64))
    want = {}
    for pair in itertools.pairwise(texts):
        want[pair] = want.get(pair, 0) + 1
    assert {(texts[s], texts[s + 1]): c for s, c in zip(firsts.tolist(), counts.tolist(), strict=True)} == want


def test_scores_beyond_64_bits(spark):
    """1000 * a * n of large counts: exact in the same expression."""
    whole = "decimal(19,0)"
    a = n = 9_000_000_000_000_000
    got = spark.range(1).select(
        F.expr(f"(CAST(1000 * {a}L AS {whole}) * CAST({n}L AS {whole})) div (CAST({a - 7}L AS {whole}) * CAST({a - 9}L AS {whole}))")
    ).first()[0]
    assert got == 1000 * a * n // ((a - 7) * (a - 9))


def test_phrases_of_odd_docs(odd_docs, no_docs):
    assert collocations(no_docs).count() == 0
    found = {(r["lang"], r["size"], r["phrase"]): r["f"] for r in count_phrases(odd_docs, 50).collect()}
    assert found["en", 1, "ha"] == 120 and found["en", 2, "ha ha"] == 119
    assert "BIGINT" in PHRASE_SQL


# ---------------------------------------------------------------- exact duplicates


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3000))
def test_cuckoo_filter_loses_nothing(seed, count):
    keys = np.random.default_rng(seed).integers(0, 2**63, count).astype(np.uint64)
    index = CuckooFilter(10)
    assert index.insert(keys)
    assert index.has(keys).all()
    index.delete(keys[: count // 2])
    assert index.has(keys[count // 2 :]).all()
    index.delete(keys[count // 2 :])
    assert not index.table.any()


def digest_of(text):
    return hashlib.sha256(text.encode()).digest()


def test_live_digests_resize_insert_and_delete():
    index = LiveDigests(buckets=4)
    rows = [(digest_of(f"t{i % 5000}"), 5, 1, (-i, i, i)) for i in range(9000)]
    for a in range(0, 9000, 700):
        index.insert(rows[a : a + 700])
    assert index.filter.bits > 8 and index.live == 5000
    assert index.find(digest_of("t7"), 5) == (2, (-5007, 5007, 5007))
    assert index.find(digest_of("t7"), 6) is None and index.find(digest_of("other"), 5) is None
    gone = index.delete([(digest_of("t7"), 5), (digest_of("none"), 5)])
    assert [g[2] for g in gone] == [2] and index.find(digest_of("t7"), 5) is None
    index.insert([(digest_of("t7"), 5, 1, (-1, 1, 1))])
    assert index.find(digest_of("t7"), 5) == (1, (-1, 1, 1))
    assert len(index.names()) == 5000 and len(index.names(once=True)) == 1001


def test_false_hits_are_verified():
    """Two digests with the same leading bits have one tag, and stay two."""
    a, b = digest_of("a"), digest_of("a")[:8] + digest_of("b")[8:]
    index = LiveDigests()
    index.insert([(a, 1, 1, (-1, 1, 1))])
    index.insert([(b, 1, 1, (-1, 2, 2)), (b, 1, 1, (-1, 3, 3))])
    assert index.find(a, 1)[0] == 1 and index.find(b, 1)[0] == 2
    index.delete([(a, 1)])
    assert index.find(a, 1) is None and index.find(b, 1)[0] == 2


def plain_groups(rows):
    groups = {}
    for i, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(key, []).append((-len(text or ""), i is None, i or 0))
    out = []
    for key, held in groups.items():
        _, none, best = min(held)
        for place, (_, no_id, i) in enumerate(sorted(held)):
            out.append((None if no_id else i, None if none else best, len(held), place == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_plain_groups(odd_docs, odd_rows, make_docs, no_docs):
    assert exact_groups(no_docs).count() == 0
    assert sorted(map(tuple, exact_groups(odd_docs).collect()), key=str) == plain_groups([r[:2] for r in odd_rows])
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["a b", "ab", " a\tb ", "é", "", None, f"t {rng.randint(0, 90)}"])) for _ in range(900)]
    got = exact_groups(make_docs(rows).repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)


def test_a_small_index_gives_the_same_groups(make_docs):
    """Digests that leave a full index early are put together again; common ones stay."""
    rows = [(i, f"text {i % 997}" if i % 3 else "the hot text") for i in range(6000)]
    parts = partial_index(digests(make_docs(rows).coalesce(1)), live=50).groupBy("digest").agg(F.sum("rows").alias("rows"), F.count("*").alias("parts"))
    found = {bytes(r["digest"]): r for r in parts.collect()}
    assert found[digest_of("thehottext")]["rows"] == 2000
    assert sum(r["rows"] for r in found.values()) == 6000
