"""Fingerprints, repeated passages, near copies, quality model and pipeline, against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import corpus_pipeline
from flowloom.llm import bpe, jaccard
from flowloom.llm.additive_model import fit, quality_scores, training_rows, tree
from flowloom.llm.batches import PIECE_BYTES, map_batches
from flowloom.llm.components import connected
from flowloom.llm.fingerprint import edited, fingerprint_table, fingerprints, likeness
from flowloom.llm.jaccard import Likeness, keep_one, near_components
from flowloom.llm.substrings import without_repeats

# ---------------------------------------------------------------- fingerprints


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(words))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_fingerprints_do_not_depend_on_neighbours(texts):
    assert fingerprints(texts) == [fingerprints([t])[0] for t in texts]
    for t in fingerprints(texts):
        assert likeness(t, t) == 1.0


def test_shared_substrings_share_names():
    middle = prose(1, 300)
    a, b, c = fingerprints([middle + prose(2, 60), prose(3, 61) + middle, prose(4, 400)])
    assert likeness(a, b) > 0.4 > 0.25 > likeness(a, c)
    runs = fingerprints(["a" * 5000, "a" * 5000 + "b", ""])
    assert len(set(runs)) == 3 and likeness(runs[0], "") == 0.0


def test_fingerprint_table(odd_docs, odd_rows, make_docs, no_docs):
    assert fingerprint_table(no_docs).count() == 0
    assert fingerprint_table(odd_docs).count() == len(odd_rows)
    texts = {i: prose(i, 5 + i % 90) for i in range(90)}
    rows = fingerprint_table(make_docs(list(texts.items())).repartition(5)).collect()
    for r in rows:
        i = r["doc_id"]
        changed = edited(texts[i], texts[(i + 1) % 90])
        assert r["n_chars"] == len(texts[i])
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints([texts[i], changed])
        assert r["near_next"] == likeness(r["fingerprint"], fingerprints([texts[(i + 1) % 90]])[0])
    alone = fingerprint_table(make_docs([(1, "x y z")])).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 5)]


# ---------------------------------------------------------------- passages


def plain_removal(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = text.encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


def planted(seed, docs, alphabet):
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randint(8, 60))] for _ in range(4)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                words += p[a : a + rng.randint(1, len(p))]
            else:
                words += [rng.choice(alphabet) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words)))
    return rows + [(docs + k, rows[k][1]) for k in range(0, docs, 3)]


@pytest.mark.parametrize("alphabet", [["a", "b"], [f"w{i}" for i in range(300)]])
def test_passages_equal_plain_removal(make_docs, alphabet):
    rows = planted(5, 60, alphabet)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in without_repeats(make_docs(rows)).collect()}
    assert got == plain_removal(rows, 20)


def test_passages_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = without_repeats(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["n_removed"] == by_id[6]["n_words"] == 120 and by_id[6]["kept"] == ""
    # Repeated rows are one document.
    assert by_id[1]["n_removed"] == 0 and by_id[2]["n_words"] == 0
    # Two first windows, "Ha ha ..." and "ha Ha ...": their first words are in no later window.
    assert by_id[10]["n_removed"] == 118 and by_id[7]["n_removed"] == 120
    assert without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("key", [None, 5])
def test_passages_of_texts_that_share_an_id(make_docs, key):
    def words(letter, count):
        return [f"{letter}{i}" for i in range(count)]

    passage = words("p", 30)
    texts = [words(c, 25) + passage + words(c + "z", 25) for c in "uv"] + [words("x", 90)]
    rows = [(key, " ".join(t)) for t in texts] + [(9, " ".join(passage))]
    got = without_repeats(make_docs(rows)).collect()
    kept = [r["kept"].split() for r in got if r["doc_id"] == key]
    # One of the two keeps the passage, and nothing else is lost from any text.
    assert sorted(map(len, kept)) == [50, 80, 90]
    for t in texts:
        assert [w for w in t if w not in passage] in [[w for w in k if w not in passage] for k in kept]
    assert [(r["n_removed"], r["kept"]) for r in got if r["doc_id"] == 9] == [(30, "")]


# ---------------------------------------------------------------- near copies


def plain_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(seed, count, words):
    rng = random.Random(seed)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(words)] = f"n{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_components(make_docs):
    texts = family(1, 60, 100) + family(2, 25, 30) + family(3, 20, 7) + family(4, 15, 4)
    texts += [f"common line of all documents here {prose(i, 12)}" for i in range(25)]
    texts += [texts[0].upper(), "", "   ", None, "a", "A", "a b c", "b"]
    random.Random(9).shuffle(texts)
    rows = list(enumerate(texts))
    for width, percent in ((4, 85), (5, 80)):
        got = near_components(make_docs(rows), Likeness(width, percent)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, width, percent)


def test_near_odd_rows(odd_docs, odd_rows, no_docs):
    rows = near_components(odd_docs, Likeness(4, 85)).collect()
    assert len(rows) == len(odd_rows)
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[6] == got[1] == got[7] == 1 and got[2] == 2 and got[3] == 3 and got[5] == 5
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["1", "2", "3", "4", "5", "8", "9", "10", "None", "None"]
    )
    assert near_components(no_docs, Likeness()).count() == 0


def test_sets_are_made_of_compared_nodes_only(make_docs, monkeypatch):
    sizes, shared = [], prose(1, 10)
    plain = jaccard.sets_of

    def spy(*args):
        made = plain(*args)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "sets_of", spy)
    # All texts share a passage, so all are in lists; only the two near copies can be alike enough.
    rows = [(i, f"{prose(10 + i, 80)} {shared} {prose(100 + i, 80)}") for i in range(20)]
    rows.append((20, rows[0][1] + " more"))
    got = near_components(make_docs(rows), Likeness(4, 85)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 4, 85)
    assert sizes[0] == 2 and sum(sizes[1:]) == 0


def test_near_copies_meet_few_pivots(make_docs, monkeypatch):
    compared, plain = [], jaccard.plausible

    def spy(*args):
        made = plain(*args)
        compared.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "plausible", spy)
    rng = random.Random(11)
    base, texts = [f"v{rng.randint(0, 10**6)}" for _ in range(120)], []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = near_components(make_docs(rows), Likeness(4, 85)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 4, 85)
    assert sum(compared) <= 2 * len(rows)


def test_odd_sketches_reject_no_true_pair():
    rng = np.random.default_rng(7)
    left, right, apart, sizes = [], [], [], []
    for n, m, common in [(1, 1, 1), (1, 1, 0), (64, 65, 60), (300, 330, 290), (1000, 1030, 700), (5000, 4200, 3900), (90_000, 80_000, 79_000)]:
        pool = np.unique(rng.integers(0, 2**63, 2 * (n + m)).astype(np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        left.append(jaccard.odd_sketch(a))
        right.append(jaccard.odd_sketch(b))
        apart.append(n + m - 2 * common)
        sizes.append(n + m)
    found = jaccard.sketch_distance(left, right)
    assert (found <= apart).all() and (found == jaccard.sketch_distance(right, left)).all()
    assert found[0] == 0 and jaccard.sketch_distance([], []).tolist() == []
    # Long sets that share two thirds are told apart, too.
    assert found[4] > sizes[4] - 2 * Likeness(4, 85).overlap(1000, 1030)
    assert max(len(x) for x in left) == 2**jaccard.SKETCH_MOST // 8


def test_table_of_wanted_nodes(spark):
    rng = random.Random(3)
    nodes = [-(2**63), -(2**40), -1, 0, 1, 2**40, 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(500))]
    table = jaccard.wanted_bits(spark.createDataFrame([(n,) for n in nodes], "node long"))
    places = set(jaccard.node_place(np.array(nodes, dtype=np.int64)).tolist())
    assert set(np.flatnonzero(np.unpackbits(table, bitorder="little")).tolist()) == places
    assert not jaccard.wanted_bits(spark.createDataFrame([], "node long")).any()


def test_batches_of_stored_tables_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    wide = spark.range(9000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("s"))
    rows = jaccard.stage(wide.mapInArrow(sizes, "n long")).collect()
    assert max(r["n"] for r in rows) * 10_000 <= 1.1 * jaccard.BATCH_BYTES
    assert spark.conf.get(name) == before


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_kept(rows, width, percent):
    """Kept (id, text) rows: one of each group, by smallest id, rows without one last."""
    near = plain_components(list(enumerate(t for _, t in rows)), width, percent)
    groups = {}
    for at, (i, text) in enumerate(rows):
        groups.setdefault(near[at][1] if near[at][0] else ("none", i, text), []).append((i is None, i or 0))
    return sorted(min(ids) for ids in groups.values())


def test_keep_one_of_null_and_repeated_ids(make_docs):
    a, b, c, d = (prose(i, 60) for i in range(4))
    rows = [(1, a), (None, a + " word"), (None, b), (5, b + " word"), (5, "word " + c), (3, c), (None, d)]
    got = keep_one(make_docs(rows).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", a), ("3", c), ("5", b + " word"), ("None", d)]
    rng = random.Random(4)
    texts = family(5, 30, 60) + family(6, 20, 40) + [prose(i, 30) for i in range(20)] + [None, "", " ", "one"]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts)) for _ in range(150)]
    got = keep_one(make_docs(rows).repartition(5)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == plain_kept(rows, 5, 80)


# ---------------------------------------------------------------- quality model


def test_tree_finds_the_steps():
    grad = np.array([-5.0, -5, 4, 4, 4, -3, -3])
    out = tree(grad * 100, np.full(7, 100.0), np.full(7, 100))
    assert len(set(out.round(6))) == 3 and (np.sign(out) == np.sign(grad)).all()


def test_fit_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (fit(x[:5], np.ones(5)).score(x) > 0.5).all()


def test_quality_scores(spark, odd_docs, odd_rows, make_docs, no_docs):
    good = [(i, prose(i, 80)) for i in range(300)]
    bad = [(i, "spam! " * (20 + i % 50)) for i in range(300, 400)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = quality_scores(make_docs(good + bad), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] < 300) for r in tested) / len(tested) > 0.97
    again = quality_scores(make_docs(bad + good).repartition(5), labels).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in again}
    odd = quality_scores(odd_docs, labels.limit(0)).collect()
    assert len(odd) == len(odd_rows) and {r["score"] for r in odd} == {0.5}
    assert quality_scores(no_docs, labels).count() == 0


def test_fit_rows_are_bounded_under_one_id(spark, make_docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0)] * 500 + [(1, 0)], "doc_id long, quality int")
    texts = [(0, prose(i, 12)) for i in range(2000)] + [(0, prose(0, 12))] * 500 + [(1, prose(1, 9))] * 40
    docs = make_docs(texts).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows, y = training_rows(docs, labels, "quality", most=100)
    assert 50 < len(rows) == len(y) < 200
    everything, y = training_rows(docs, labels, "quality")
    assert len(everything) == 2001 and y.sum() == 2000


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_bound_their_batches(spark, no_docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scans, corpus_pipeline.encoding):
        spark.conf.set(name, str(1 << 30))
        stage(spark, no_docs, "")
        assert int(spark.conf.get(name)) == jaccard.BATCH_BYTES
    spark.conf.set(name, before)


class Task:
    """In place of a frame: gives the function that a task would run."""

    def mapInArrow(self, run, schema):
        return run


def held_mb():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"\nAnonymous:\s+(\d+)", file.read())[1]) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_workers_give_memory_back_after_a_task():
    kept = []

    def function(batch):
        made = [b"%01000d" % i for i in range(100_000)]
        # What lives on lies between what is freed.
        kept.extend(made[::1000])
        return {"n": [len(made)] * batch.num_rows}

    run = map_batches(Task(), "text", function, StructType([StructField("n", LongType())]))
    before = held_mb()
    rows = [r for b in run(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])) for r in b.to_pylist()]
    assert rows == [{"n": 100_000}]
    assert held_mb() - before < 30


def test_pipeline_encodes_smaller_pieces(spark, odd_docs, monkeypatch):
    limits = []

    def spied(*args):
        limits.append(args[-1])
        return map_batches(*args)

    whole = bpe.encode_documents(odd_docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "map_batches", spied)
    monkeypatch.setattr(corpus_pipeline, "ENCODED_BYTES", 100)
    made = corpus_pipeline.encoding(spark, odd_docs, "")
    assert limits == [100] and PIECE_BYTES > 1 << 20
    assert sorted(made.collect(), key=str) == sorted(whole.collect(), key=str)


def test_pipeline_stages(spark, make_docs, no_docs, odd_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "secret_scans", "source_mixing", "bpe_encoding"]
    clean = [(i, prose(i, 120), f"s{i % 3}") for i in range(40)]
    copies = [(100 + i, clean[i][1] + " more", "s1") for i in range(10)]
    junk = [(200 + i, "buy now!!! " * 40, "s2") for i in range(5)]
    secret = [(300, prose(300, 90) + " password = hunter2hunter2", "s0")]
    docs, kept = make_docs(clean + copies + junk + secret), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = {n: [r["doc_id"] for r in rows] for n, rows in kept.items()}
    assert sorted(ids["quality_rules"]) == sorted([*range(40), *range(100, 110), 300])
    assert sorted(ids["ngram_jaccard_join"]) == [*range(40), 300]
    assert sorted(ids["secret_scans"]) == [*range(40), 300]
    assert not any("hunter2" in r["text"] for r in kept["secret_scans"])
    assert max(ids["source_mixing"].count(i) for i in ids["source_mixing"]) <= 2
    assert sorted(ids["bpe_encoding"]) == sorted(ids["source_mixing"])
    for start in (no_docs, odd_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
