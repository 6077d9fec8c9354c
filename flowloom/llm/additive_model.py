"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. The model is one lookup table per feature, and one per chosen
pair of features; a text's score is the logistic of the sum of its table entries. Tables are learned
by cyclic boosting: features take turns, each adds a shallow tree on its own bins, fitted to what
the others leave, at a small rate. Then the pairs whose four-leaf trees would still explain most take
turns in the same way. A table is the sum of its trees, so scoring adds bin entries only.

The model is fitted on at most about ``FIT_ROWS`` labelled texts, chosen by a hash of the id and, where
ids have several texts, of id and text, so the fit has the same cost for any corpus. Their ids are a
table of that many rows, small enough to be sent to every task; features are then computed where the
texts are. Scoring covers every row.

Labels are used from rows outside the held-out third only. Scores are made from the text alone.

Defined results: a null text is an empty text, and has a score. A null id is not held out. Without
labels of both kinds the score is the smoothed share of label 1, 0.5 without any. Repeated rows
have equal scores and count once in the fit. An id with several labels has the most frequent one, 1 if
both are as frequent. An empty table gives an empty table.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from flowloom.llm.batches import map_batches, pieces

FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 40
PAIRS = 10
RATE = 0.15
LEAST_LEAF = 10
#: Pull of every leaf towards zero, in rows.
PRIOR = 5.0

FEATURES = (
    "words",
    "word_length",
    "symbols",
    "upper",
    "marks",
    "digits",
    "stops",
    "bars",
    "distinct",
    "same_as_before",
    "bigrams",
    "lines",
    "repeated_lines",
    "beyond_ascii",
    "worst_line",
    "commonest",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def features(data: bytes) -> list[float]:
    """Numbers that describe a text; a scale-free ratio each, but for the first."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = len(words) or 1
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) or 1
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    worst = max((1 - len(set(ws)) / len(ws) for ws in map(bytes.split, lines) if len(ws) >= 5), default=0.0)
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        counts[SYMBOLS].sum() / n,
        counts[65:91].sum() / letters,
        (counts[33] + counts[63]) / n,
        counts[48:58].sum() / letters,
        (counts[46] + counts[44]) / n,
        counts[124] / n,
        len(tally) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        counts[128:].sum() / letters,
        worst,
        max(tally.values()) / n if tally else 0.0,
    ]


def best_cut(gain_of: np.ndarray, allowed: np.ndarray) -> int:
    """Index of the largest allowed gain, or -1."""
    if not allowed.any():
        return -1
    at = int(np.where(allowed, gain_of, -np.inf).argmax())
    return at if gain_of[at] > 1e-12 else -1


def tree(grad: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf value of every bin: a tree of up to three leaves on sums by bin."""
    edges = [0, len(grad)]

    def cut(a: int, b: int) -> tuple[float, int]:
        g, w, n = (np.cumsum(x[a:b]) for x in (grad, weight, rows))
        if b - a < 2:
            return 0.0, -1
        left = g[:-1] ** 2 / (w[:-1] + PRIOR)
        right = (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + PRIOR)
        gains = left + right - g[-1] ** 2 / (w[-1] + PRIOR)
        at = best_cut(gains, (n[:-1] >= LEAST_LEAF) & (n[-1] - n[:-1] >= LEAST_LEAF))
        return (float(gains[at]), a + at + 1) if at >= 0 else (0.0, -1)

    for _ in range(2):
        options = [cut(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        gain, at = max(options)
        if at < 0 or gain <= 0:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(grad))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = grad[a:b].sum() / (weight[a:b].sum() + PRIOR)
    return out


def quadrants(grad: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut in each of two features."""
    size_a, size_b = grad.shape
    g, w = (np.cumsum(np.cumsum(x, 0), 1) for x in (grad, weight))
    best, at = 0.0, None
    for i in range(size_a - 1):
        for j in range(size_b - 1):
            gs = (g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j])
            ws = (w[i, j], w[i, -1] - w[i, j], w[-1, j] - w[i, j])
            gs, ws = (*gs, g[-1, -1] - sum(gs)), (*ws, w[-1, -1] - sum(ws))
            gain = sum(x * x / (y + PRIOR) for x, y in zip(gs, ws, strict=True))
            if gain > best:
                best, at = gain, (i + 1, j + 1)
    values = np.zeros_like(grad)
    if at:
        for rows in (slice(0, at[0]), slice(at[0], None)):
            for columns in (slice(0, at[1]), slice(at[1], None)):
                values[rows, columns] = grad[rows, columns].sum() / (weight[rows, columns].sum() + PRIOR)
    return best, values


@dataclass
class Model:
    """Bin edges, an intercept, a table per feature and a table per pair."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (i, j), table in self.pairs.items():
            a = np.searchsorted(self.pair_edges[i], x[:, i], "right")
            b = np.searchsorted(self.pair_edges[j], x[:, j], "right")
            total += table[a, b]
        return 1 / (1 + np.exp(-total))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Rising edges between about equally filled bins."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows of features and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    count = x.shape[1]
    model.edges = [cuts(x[:, j], BINS) for j in range(count)]
    bins = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(count):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            step = RATE * tree(
                np.bincount(bins[j], y - p, size),
                np.bincount(bins[j], p * (1 - p), size),
                np.bincount(bins[j], minlength=size),
            )
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(count)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], "right") for j in range(count)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell, size = coarse[i] * shape[j] + coarse[j], shape[i] * shape[j]
        form = (shape[i], shape[j])
        return np.bincount(cell, y - p, size).reshape(form), np.bincount(cell, p * (1 - p), size).reshape(form)

    gains = {(i, j): quadrants(*sums(i, j))[0] for i in range(count) for j in range(i)}
    for pair in sorted(gains, key=gains.get)[-PAIRS:]:
        model.pairs[pair] = np.zeros((shape[pair[0]], shape[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * quadrants(*sums(i, j))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(key: Column) -> Column:
    """Rows never learned from: every third by checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about ``most`` labelled texts that are not held out.

    The labels' ids are thinned by hash to the wanted number, then sent to the tasks; so are their
    texts, by hash of id and text, if they are more.
    """

    def thinned(rows: DataFrame, *by: str) -> DataFrame:
        """Rows in the places of the hash range that give the wanted number on average."""
        found = rows.select(*by).distinct().count()
        part = 1.0 if found <= most else most / found
        return rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(part * (1 << 30)))

    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = F.broadcast(thinned(usable, "doc_id"))
    texts = docs.join(chosen, "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "text", "y")
    texts = thinned(texts, "doc_id", "mark")
    schema = pa.schema([("y", pa.float64()), *[(n, pa.float64()) for n in FEATURES]])
    keyed = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = [features(t) for t in piece.column("text").to_pylist()]
                named = [piece.column(n) for n in ("doc_id", "mark", "y")]
                columns = [*named, *[pa.array(c) for c in zip(*rows, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, schema=keyed)

    kinds = ", ".join(["doc_id long", "mark long", *[f"{n} double" for n in schema.names]])
    # Rows come back in no fixed order; sorted, the fit is the same on every run.
    once = texts.mapInArrow(run, kinds).dropDuplicates(["doc_id", "mark"]).select(*schema.names)
    made = once.toPandas().sort_values(schema.names, ignore_index=True)
    return made[list(FEATURES)].to_numpy(dtype=float).reshape(-1, len(FEATURES)), made["y"].to_numpy(dtype=float)


SCORED = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, text), texts as bytes."""

    def run(batch: pa.RecordBatch) -> dict[str, Sequence]:
        rows = np.array([features(t) for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "score": pa.array(model.score(rows))}

    return map_batches(docs, "text", run, SCORED)


def quality_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    source = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    model = fit(*training_rows(source, labels, label))
    return score_documents(source, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
