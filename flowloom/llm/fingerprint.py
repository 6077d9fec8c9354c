"""Document fingerprints by locally consistent parsing.

A text is a string of symbols. Each level cuts the string into phrases and names every phrase; the
names are the symbols of the next level. Cuts depend on a few neighbouring symbols only, so equal
substrings are cut alike inside, wherever they stand, and give the same names at every level.

Cutting, deterministic coin tossing: runs of one symbol are first joined to one symbol. Then each
symbol takes a label from itself and its left neighbour, twice the lowest bit where they differ
plus that bit. Neighbours keep different labels, and labels shrink from 64 bits to less than 6
values in four rounds. Phrases begin where the label is larger than both neighbours'. That happens at
least every few symbols and at most every second.

A name is a hash of what the phrase holds, so tasks agree on names without talking to each other.

The fingerprint keeps, for each of the levels 1 to ``LEVELS``, the ``KEPT`` smallest names of the
text: a sample that two texts choose alike. The likeness of two fingerprints is the mean, over the
levels that either has, of the estimated share of common names.

Defined results: a null text is an empty text, whose fingerprint has no names and is equal (likeness
1) to that of other empty texts and unlike (0) all others. Documents are ordered by id, nulls
first, rows with equal ids by their text's hash; the next of the last is the first, and a single
document is next to itself. Repeated rows have equal fingerprints. An empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flowloom.llm.batches import pieces
from flowloom.llm.hashing import mix, powers
from flowloom.plans.staging import new_path

LEVELS = 4
KEPT = 16
ROUNDS = 4
#: Hex digits of a kept name.
DIGITS = 6


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def join_runs(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols of one text become one symbol that knows the length."""
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(symbols)))
    joined = symbols[starts]
    long = lengths > 1
    joined[long] = mix(joined[long] ^ mix(lengths[long].astype(np.uint64)))
    return joined, text[starts]


#: Lowest set bit of a number below 256, and of 0 as of a text's first symbol.
LOW_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)


def lowest_bit(values: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of 64-bit numbers."""
    single = values & (~values + np.uint64(1))
    _, exponent = np.frexp(single.astype(np.float64))
    return (exponent - 1).astype(np.uint8)


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours of one text differ. ``first`` marks the first symbol of a text.

    A text's first symbol counts as differing from its left neighbour in the lowest bit.
    """
    begin = np.flatnonzero(first)
    differ = np.ones_like(symbols)
    np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
    differ[begin] = 1
    place = lowest_bit(differ)
    current = 2 * place + ((symbols >> place) & np.uint64(1)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        small = np.ones_like(current)
        np.bitwise_xor(current[1:], current[:-1], out=small[1:])
        small[begin] = 1
        place = LOW_BIT[small]
        current = 2 * place + ((current >> place) & 1)
    return current


def phrases(symbols: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, text) of the phrases of one level."""
    symbols, text = join_runs(symbols, text)
    first = np.ones(len(symbols), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    label = labels(symbols, first)
    above_left = np.zeros(len(symbols), dtype=bool)
    above_left[1:] = label[1:] > label[:-1]
    above_right = np.zeros(len(symbols), dtype=bool)
    above_right[:-1] = (label[:-1] > label[1:]) & ~first[1:]
    begin = first | (above_left & above_right)
    starts = np.flatnonzero(begin)
    lengths = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    table = powers(int(lengths.max()) + 1)[1:]
    sums = segment_sums(symbols * table[place], starts)
    return mix(sums + mix(lengths.astype(np.uint64) + np.uint64(level << 32))), text[starts]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text number) of texts one after another."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
    return mix(points + np.uint64(1)), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints: levels separated by ``/``, names of ``DIGITS`` hex digits in rising order."""
    symbols, text = code_points(texts)
    kept: list[list[str]] = [[] for _ in texts]
    for level in range(1, LEVELS + 1):
        if not len(symbols):
            break
        symbols, text = phrases(symbols, text, level)
        short = mix(symbols) >> np.uint64(64 - 4 * DIGITS)
        order = np.lexsort((short, text))
        names, owner = short[order], text[order]
        fresh = np.ones(len(names), dtype=bool)
        fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        names, owner = names[fresh], owner[fresh]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            a, b = bounds[i], min(bounds[i + 1], bounds[i] + KEPT)
            if a < b:
                kept[i].append("".join(f"{x:0{DIGITS}x}" for x in names[a:b].tolist()))
        # A text that is one phrase has no higher level.
        single = bounds[1:] - bounds[:-1] == 1
        if level < LEVELS:
            counts = np.bincount(text, minlength=len(texts))
            more = ~(single & (counts == 1))[text]
            symbols, text = symbols[more], text[more]
    return ["/".join(k) for k in kept]


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    left, right = a.split("/") if a else [], b.split("/") if b else []
    total = 0.0
    for i in range(max(len(left), len(right))):
        if i < len(left) and i < len(right):
            x = {left[i][j : j + DIGITS] for j in range(0, len(left[i]), DIGITS)}
            y = {right[i][j : j + DIGITS] for j in range(0, len(right[i]), DIGITS)}
            # The least names of both are a sample of all names, cut where either list is full.
            union = x | y
            limit = min(max(s) if len(s) == KEPT else "g" for s in (x, y))
            seen = [n for n in union if n <= limit]
            total += sum(n in x and n in y for n in seen) / len(seen)
    return total / max(len(left), len(right))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many characters of the next text, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


OUTPUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part int, edge int, text string"
)
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        *[(n, pa.float64()) for n in ("near_edited", "near_next")],
        ("part", pa.int32()),
        ("edge", pa.int32()),
        ("text", pa.string()),
    ]
)


def described(ids: list, texts: list[str], following: list[str]) -> list[list]:
    """Result columns of documents, given each one's text and the next text.

    Mostly the documents follow each other, so each text is parsed once for itself and the one
    before it.
    """
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    apart = [n for n, t in zip(following, [*texts[1:], None], strict=True) if n is not t]
    made = fingerprints([*texts, *changed, *apart])
    own, new, rest = made[: len(texts)], made[len(texts) : 2 * len(texts)], iter(made[2 * len(texts) :])
    later = [
        own[i + 1] if i + 1 < len(texts) and following[i] is texts[i + 1] else next(rest)
        for i in range(len(texts))
    ]
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        own,
        new,
        [likeness(a, b) for a, b in zip(own, new, strict=True)],
        [likeness(a, b) for a, b in zip(own, later, strict=True)],
    ]


def fingerprint_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are range partitioned by id and sorted, and each task pairs a document with the one
    after it. The last document of a task waits: it is stored with its text, and so is the first
    one. These two rows per task are then paired over the task numbers.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = source.withColumn("tie", F.xxhash64("text"))
    ranged = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def batch_of(columns: list[list], part, edge, kept) -> pa.RecordBatch:
        rows = len(columns[0])
        tail = [[part] * rows, [edge] * rows, kept if kept is not None else [None] * rows]
        arrays = [pa.array(c, f.type) for c, f in zip([*columns, *tail], SCHEMA, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        blank = [[None] for _ in range(5)]
        held: tuple | None = None
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                if held is None:
                    yield batch_of([[ids[0]], [len(texts[0])], *blank], part, 0, [texts[0]])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                if len(texts) > 1:
                    yield batch_of(described(ids[:-1], texts[:-1], texts[1:]), part, None, None)
                held = ids[-1], texts[-1]
        if held is not None:
            yield batch_of([[held[0]], [len(held[1])], *blank], part, 1, [held[1]])

    # Fingerprints are hex digits, which zstd packs to half.
    path = new_path(docs.sparkSession)
    ranged.mapInArrow(run, OUTPUT).write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.schema(OUTPUT).parquet(path)
    edges = stored.where("edge IS NOT NULL").select("doc_id", "part", "edge", "text")
    # Two rows per task; the text after a task's last is that of the next task's first.
    by_part = W.orderBy("part", "edge")
    whole = by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    waiting = edges.select(
        "doc_id",
        "edge",
        "text",
        F.coalesce(F.lead("text").over(by_part), F.first("text").over(whole)).alias("following"),
    ).where("edge = 1")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                columns = [piece.column(n).to_pylist() for n in ("doc_id", "text", "following")]
                yield batch_of(described(*columns), None, None, None)

    names = [f.name for f in SCHEMA][:7]
    last = waiting.select("doc_id", "text", "following").mapInArrow(finish, OUTPUT).select(*names)
    return stored.where("edge IS NULL").select(*names).union(last)
