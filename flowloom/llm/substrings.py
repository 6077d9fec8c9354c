"""Removal of repeated passages by seed and extend on winnowed anchors.

A passage counts as repeated when ``WINDOW`` consecutive words have occurred before: in a document
before it in the order of (id, text hash), or earlier in the same one. Every word in such a window is
removed.

Seeds: a document's anchors are the least hashes of ``GRAM`` words in each window (winnowing). Equal
windows choose the same anchor at the same place, so windows can only be equal where anchors are.
Windows next to each other that choose the same anchor are one run. Only anchors that occur more
than once go on.

Extending: a run is compared with the other runs of its anchor as a whole, to both sides of the
anchor as far as its windows reach. Runs that agree in full form a class; all but the first run of
a class are repeated as they stand. That settles the inside of copied passages with one row for
each run instead of pairs of occurrences. Where the classes of an anchor differ, at the ends of
copied passages, the first run of each class is opened into its windows, and a window that occurs
in an earlier first run is repeated. Runs join to maximal repeats when their words are removed.

Firsts are found by aggregates that are reduced before the shuffle, so a passage in a third of all
documents costs one row per task and class. Ranges of one document are gathered with that document
only.

Defined results: a null text has no words. Different texts under one id, or without an id, are
documents of their own. Rows of the same id and text are one document and get equal answers. A null
id comes before all others. A text of fewer than ``WINDOW`` words is kept whole. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import pieces
from flowloom.llm.hashing import mix, sequence_hashes, word_hashes
from flowloom.plans.staging import stage

WINDOW = 20
GRAM = 6
#: A place is start * STEP + number of windows of the run.
STEP = 64
BEFORE_ALL = -(2**63)
#: A document: its id and the hash of its text.
KEY = ["key", "mark"]


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    return sequence_hashes(hashes, window)


def runs(
    hashes: np.ndarray, firsts: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, class, text number, start in the text, windows) of every run of a piece."""
    none = np.zeros(0, dtype=np.uint64)
    count = len(hashes) - window + 1
    if count <= 0:
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    grams = sequence_hashes(hashes, gram)
    width = window - gram + 1
    least = grams[:count].copy()
    for o in range(1, width):
        np.minimum(least, grams[o : o + count], out=least)
    chosen = np.zeros(count, dtype=np.int64)
    for o in range(width - 1, -1, -1):
        chosen[grams[o : o + count] == least] = o
    chosen += np.arange(count)
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    valid = text_of[:count] == text_of[window - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
    begin = np.flatnonzero(new)
    # A run ends before the next begins, or where windows stop being valid.
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    end = np.flatnonzero(stop)
    whole = window_hashes(hashes, window)
    offset = (chosen[begin] - begin).astype(np.uint64)
    length = (end - begin + 1).astype(np.uint64)
    # The first and the last window overlap, so together they hold every word of the run.
    kind = mix(
        whole[begin] * np.uint64(0x9FB21C651E98DF25) + mix(whole[end] + length + offset * np.uint64(STEP))
    )
    text = text_of[begin]
    return mix(grams[chosen[begin]]), kind, text, begin - firsts[text], end - begin + 1


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, "text", 1 << 20)


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, class, key, mark, place) of every run of every document."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "class", *KEY, "place")])

    def run(batches):
        for batch in text_batches(batches):
            hashes, firsts = word_hashes(batch.column("text"))
            anchor, kind, text, start, length = runs(hashes, firsts, window, gram)
            keys = [batch.column(c).to_numpy()[text] for c in KEY]
            columns = [anchor.view(np.int64), kind.view(np.int64), *keys, start * STEP + length]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return docs.mapInArrow(run, "anchor long, class long, key long, mark long, place long")


def opened(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(sequence, key, mark, start) of every window of the given runs."""
    schema = pa.schema([(n, pa.int64()) for n in ("sequence", *KEY, "start")])

    def run(batches):
        for batch in text_batches(batches):
            batch = batch.filter(batch.column("places").is_valid())
            if not batch.num_rows:
                continue
            hashes, firsts = word_hashes(batch.column("text"))
            whole = window_hashes(hashes, window).view(np.int64)
            keys = zip(*[batch.column(c).to_pylist() for c in KEY], strict=True)
            for i, (key, wanted) in enumerate(zip(keys, batch.column("places"), strict=True)):
                place = wanted.values.to_numpy()
                start, length = place // STEP, place % STEP
                at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
                at = at[at + window <= firsts[i + 1] - firsts[i]]
                columns = [whole[at + firsts[i]], *[np.full(len(at), k) for k in key], at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    # A left join here and below: both then share one shuffle of the texts.
    joined = docs.join(places, KEY, "left").select(*KEY, "text", "places")
    return joined.mapInArrow(run, "sequence long, key long, mark long, start long")


def repeated_places(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, mark, place) of the repeated runs and windows of (key, mark, text).

    Equal rows find the same places, so places are gathered as sets.
    """
    found = anchors(docs, window, gram)
    common = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    seeds = stage(found.join(common, "anchor", "left_semi"))
    firsts = seeds.groupBy("anchor", "class").agg(F.min(F.struct(*KEY, "place")).alias("first"))
    copies = seeds.join(firsts, ["anchor", "class"]).where(F.struct(*KEY, "place") > F.col("first"))
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    edges = firsts.join(several, "anchor", "left_semi").select("first.*")
    places = edges.groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    windows = opened(docs, places, window)
    earliest = (
        windows.groupBy("sequence")
        .agg(F.min(F.struct(*KEY, "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sequence", "first")
    )
    later = windows.join(earliest, "sequence").where(F.struct(*KEY, "start") > F.col("first"))
    opened_places = later.select(*KEY, (F.col("start") * STEP + 1).alias("place"))
    return copies.select(*KEY, "place").union(opened_places)


def removed_mask(count: int, places: np.ndarray, window: int) -> np.ndarray:
    """True for the words of a text that lie in the given runs."""
    steps = np.zeros(count + 1, dtype=np.int64)
    start = np.minimum(places // STEP, count)
    end = np.minimum(start + places % STEP + window - 1, count)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def without_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept words joined by one blank."""
    words = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(BEFORE_ALL)).alias("key"),
        F.xxhash64(words).alias("mark"),
        words.alias("text"),
    )
    ranges = (
        repeated_places(keyed, window, gram).groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    )
    schema = pa.schema(
        [("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    )

    def run(batches):
        for batch in text_batches(batches):
            counts, removed, kept = [], [], []
            for value, wanted in zip(batch.column("text").to_pylist(), batch.column("places"), strict=True):
                found = value.split()
                counts.append(len(found))
                if wanted.is_valid:
                    gone = removed_mask(len(found), wanted.values.to_numpy(), window)
                    removed.append(int(gone.sum()))
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(found))
            columns = [batch.column("key"), counts, removed, pa.array(kept, pa.binary()).cast(pa.string())]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    joined = keyed.join(ranges, KEY, "left").select(*KEY, "text", "places")
    done = joined.mapInArrow(run, "key long, n_words long, n_removed long, kept string")
    return done.select(
        F.when(F.col("key") != BEFORE_ALL, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept"
    )
