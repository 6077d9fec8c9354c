"""Exact duplicates by an index of live digests: a cuckoo filter in front of bucketed content.

Texts are equal when they are the same without white space. A task streams its rows through a
``LiveDigests`` index:

* A **cuckoo filter** holds a 16-bit tag of every live digest in one of two buckets of four. It can
  say no for certain, and it can delete, which other filters can't.
* A **hit is verified** against the bucketed content: the full SHA-256 and the length of the
  normalised text, kept in the bucket its leading bits name. A false hit is a new digest.
* **Overflow**, a tag that finds no place after ``KICKS`` moves, resizes the filter: twice the
  buckets, filled again from the stored keys.

First each scan task does so on its own rows, whatever their order. It may hold ``LIVE`` digests;
beyond that those seen once are passed on and deleted from the index, while digests seen again stay,
so a text that makes up a third of all rows leaves a task in few rows. What tasks pass on (digest,
number of rows, best row) is shuffled by digest and goes through an index per bucket of about
``BUCKET_ROWS`` rows, one bucket after the other. Both sizes are independent of the corpus.

Defined results: a null text is an empty text, and texts of white space alone equal it. Of equal texts
the one with the most code points stays, then the smallest id, an id before none, then any one of
rows alike in both. An empty table gives an empty table. Very long texts are normalised in their own
piece of a batch. Only the columns ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import pieces
from flowloom.llm.hashing import SPACE, joined_bytes, mix
from flowloom.plans.lookups import lookup_join
from flowloom.plans.staging import stage

SLOTS = 4
KICKS = 64
#: Digests a scan task holds.
LIVE = 200_000
#: Rows of partial results in one bucket, on average.
BUCKET_ROWS = 50_000
NO_ID = 2**63 - 1


class CuckooFilter:
    """Tags of 64-bit keys in buckets of four; a key lies in one of two buckets."""

    def __init__(self, bits: int = 8):
        self.bits = bits
        self.table = np.zeros((1 << bits, SLOTS), dtype=np.uint16)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tag, first bucket) of each key."""
        tags = (keys >> np.uint64(48)).astype(np.uint16)
        return np.maximum(tags, np.uint16(1)), (mix(keys) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def other(self, tags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The second bucket; the other of the second is the first."""
        jump = mix(tags.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        return buckets ^ jump.astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        tags, at = self.places(keys)
        found = (self.table[at] == tags[:, None]).any(axis=1)
        return found | (self.table[self.other(tags, at)] == tags[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether every tag found a place; if not, the filter must be made anew."""
        tags, at = self.places(keys)
        for kick in range(KICKS):
            if not len(tags):
                return True
            # One tag a bucket and round; the others wait.
            _, first = np.unique(at, return_index=True)
            waits = np.ones(len(tags), dtype=bool)
            waits[first] = False
            own, bucket = tags[first], at[first]
            room = self.table[bucket] == 0
            free = room.any(axis=1)
            self.table[bucket[free], room[free].argmax(axis=1)] = own[free]
            own, bucket = own[~free], bucket[~free]
            if kick:
                # Full: the tag takes a slot, and the one that was there goes to its other bucket.
                slot = (own.astype(np.int64) + kick) % SLOTS
                own_before = self.table[bucket, slot].copy()
                self.table[bucket, slot] = own
                own = own_before
            moved = self.other(own, bucket)
            tags = np.concatenate([tags[waits], own])
            at = np.concatenate([at[waits], moved])
        return not len(tags)

    def delete(self, keys: np.ndarray) -> None:
        """Remove one tag for each key; every key must be in the filter."""
        for tag, bucket in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            row = self.table[bucket]
            if not (row == tag).any():
                row = self.table[int(self.other(np.array([tag], np.uint16), np.array([bucket]))[0])]
            row[int(np.flatnonzero(row == tag)[0])] = 0


def leading(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


class LiveDigests:
    """(rows, best row) of live digests; a row's rank is (-code points, id, row), the least is best."""

    def __init__(self, buckets: int = 256):
        self.filter = CuckooFilter()
        self.content: list[dict[tuple[bytes, int], list]] = [{} for _ in range(buckets)]
        self.live = 0

    def bucket(self, key: int) -> dict[tuple[bytes, int], list]:
        return self.content[key % len(self.content)]

    def insert(self, rows: list[tuple[bytes, int, int, tuple]]) -> None:
        """Rows of (digest, length, number of rows, rank of the best)."""
        if not rows:
            return
        keys = [leading(r[0]) for r in rows]
        hit = self.filter.has(np.array(keys, dtype=np.uint64)).tolist()
        new: set[int] = set()
        fresh = []
        for (digest, length, count, rank), key, seen in zip(rows, keys, hit, strict=True):
            bucket, name = self.bucket(key), (digest, length)
            # What came with these same rows is not in the filter yet.
            held = bucket.get(name) if seen or key in new else None
            if held is None:
                bucket[name] = [count, rank]
                new.add(key)
                fresh.append(key)
            else:
                held[0] += count
                held[1] = min(held[1], rank)
        self.live += len(fresh)
        if not self.filter.insert(np.array(fresh, dtype=np.uint64)):
            self.resize()

    def resize(self) -> None:
        """A larger filter of all live digests, from the stored keys."""
        keys = np.array([leading(d) for b in self.content for d, _ in b], dtype=np.uint64)
        bits = self.filter.bits
        while True:
            bits += 1
            self.filter = CuckooFilter(bits)
            if len(keys) <= 0.9 * self.filter.table.size and self.filter.insert(keys):
                return

    def find(self, digest: bytes, length: int) -> tuple[int, tuple] | None:
        """(rows, rank of the best) of a live digest."""
        if not self.filter.has(np.array([leading(digest)], dtype=np.uint64))[0]:
            return None
        held = self.bucket(leading(digest)).get((digest, length))
        return None if held is None else (held[0], held[1])

    def delete(self, names: list[tuple[bytes, int]]) -> list[tuple[bytes, int, int, tuple]]:
        """Take live digests out; they are returned with their rows and best row."""
        gone = []
        for name in names:
            held = self.bucket(leading(name[0])).pop(name, None)
            if held is not None:
                gone.append((*name, held[0], held[1]))
        self.filter.delete(np.array([leading(g[0]) for g in gone], dtype=np.uint64))
        self.live -= len(gone)
        return gone

    def names(self, once: bool = False) -> list[tuple[bytes, int]]:
        """Live digests, or those seen once."""
        return [name for b in self.content for name, held in b.items() if not once or held[0] == 1]


FIELDS = [
    ("digest", pa.binary()),
    ("length", pa.int64()),
    ("rows", pa.int64()),
    ("chars", pa.int64()),
    ("best", pa.int64()),
    ("row", pa.int64()),
]
KINDS = "digest binary, length long, rows long, chars long, best long, row long"


def as_batches(rows: list[tuple[bytes, int, int, tuple]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        columns = [
            [r[0] for r in part],
            [r[1] for r in part],
            [r[2] for r in part],
            [-r[3][0] for r in part],
            [None if r[3][1] == NO_ID else r[3][1] for r in part],
            [r[3][2] for r in part],
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)],
            names=[name for name, _ in FIELDS],
        )


def digests(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, chars, digest, length): code points of each text, and the SHA-256 and length
    in bytes of its normalised form."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = joined_bytes(piece.column("text"))
                keep = ~SPACE[raw]
                kept = np.zeros(len(raw) + 1, dtype=np.int64)
                np.cumsum(keep, out=kept[1:])
                points = np.zeros(len(raw) + 1, dtype=np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
                data, at = memoryview(raw[keep]), kept[offsets].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(points[offsets])),
                        pa.array(
                            [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)],
                            pa.binary(),
                        ),
                        pa.array(np.diff(kept[offsets])),
                    ],
                    names=["doc_id", "chars", "digest", "length"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, chars long, digest binary, length long")
    # A number for each row; it is fixed from here on, as the table is stored.
    return stage(found.withColumn("row", F.monotonically_increasing_id()))


def partial_index(rows: DataFrame, live: int = LIVE) -> DataFrame:
    """(digest, length, rows, chars, best) of each scan task; a digest may come several times."""

    def run(batches):
        index = LiveDigests()
        for batch in batches:
            ids = [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
            chars = (-x for x in batch.column("chars").to_pylist())
            ranks = zip(chars, ids, batch.column("row").to_pylist(), strict=True)
            columns = (batch.column("digest").to_pylist(), batch.column("length").to_pylist())
            index.insert([(d, n, 1, rank) for d, n, rank in zip(*columns, ranks, strict=True)])
            if index.live > live:
                yield from as_batches(index.delete(index.names(once=True)))
            if index.live > live:
                yield from as_batches(index.delete(index.names()))
        yield from as_batches(index.delete(index.names()))

    return rows.mapInArrow(run, KINDS)


def merged_index(parts: DataFrame, buckets: int) -> DataFrame:
    """(digest, length, rows, chars, best) of every digest, bucket by bucket."""
    number = F.pmod(F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("long"), F.lit(buckets))
    # A bucket's digests share one index, and its rows lie together in one task.
    dealt = parts.withColumn("bucket", number).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        index, current = LiveDigests(), None
        for batch in batches:
            numbers = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if current is not None and numbers[a] != current:
                    yield from as_batches(index.delete(index.names()))
                    index = LiveDigests()
                current = numbers[a]
                part = batch.slice(a, b - a)
                got = [part.column(name).to_pylist() for name, _ in FIELDS]
                index.insert(
                    [
                        (d, n, c, (-chars, NO_ID if best is None else best, row))
                        for d, n, c, chars, best, row in zip(*got, strict=True)
                    ]
                )
        yield from as_batches(index.delete(index.names()))

    return dealt.mapInArrow(run, KINDS)


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    rows = digests(docs)
    parts = stage(partial_index(rows))
    buckets = max(1, parts.count() // BUCKET_ROWS)
    groups = stage(merged_index(parts, buckets).where("rows > 1").drop("length"))
    names = groups.select("digest", "rows", "best", F.col("row").alias("best_row"))
    found = lookup_join(rows, names, ["digest"], ["row"], how="left", staged=True)
    alone = F.col("rows").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
