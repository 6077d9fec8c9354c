"""Phrases of two to five words that occur together more often than their parts suggest.

Rabin-Karp fingerprints: prefix polynomials modulo 2**64 over the bytes give the hash of every word,
and prefix polynomials over the word hashes the hash of every n-gram, each by one subtraction and one
multiplication, all in numpy. Passes over the texts, each with sums made before its shuffle:

1. Fingerprints of words are counted, then of pairs of frequent words, then of three to five words
   where every pair inside is frequent. What is frequent is known by a bit table of fixed size
   (``FILTER_BITS``): false hits cost work, not results. With its count a fingerprint carries the
   least and the greatest mark of its occurrences: a check of 16 bits, from a polynomial of its own
   over the bytes, and 16 bits of the occurrence's text and word number. So the least mark points to
   an occurrence, and checks that differ show in the two.
2. The occurrences pointed at are read from the texts, and only they become phrases.

A fingerprint whose check values differ belongs to several phrases. Those are taken apart by the text:
a further pass, made only if there are any, compares all their occurrences byte by byte and counts the
phrases themselves. What a check does not tell apart has 80 equal bits.

Scores are products of 19-digit decimals, which are exact, and whole divisions.

Defined results: a null text is empty, a null language is ``und``. Repeated rows count each time.
Equal scores are ordered by count, then phrase. An empty table gives an empty table. Very long texts
are one array of words; only columns ``text`` and ``lang`` are read, so other columns may have any
names, and ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.batches import pieces
from flowloom.llm.hashing import joined_bytes, mix, powers
from flowloom.plans.lookups import lookup_join
from flowloom.plans.staging import stage

LONGEST = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
CHECK_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a fingerprint. Fewer of them make collisions, for tests.
PRINT_BITS = 64
#: Bits of the table of frequent fingerprints, and the parts it is made in.
FILTER_BITS = 26
PARTS = 64
#: Different fingerprints a task holds before it passes their counts on.
HELD = 1_000_000
#: Bytes of text hashed at once.
PIECE = 1 << 20
#: Tasks that rank one language before its best are ranked together.
RANK_SALTS = 64

GAP = np.zeros(256, dtype=bool)
GAP[[0x20, 0x09]] = True
CUT = np.zeros(256, dtype=bool)
CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of the texts of a batch, in order."""

    raw: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray  # number of the piece each word lies in
    row: np.ndarray  # text of each word
    hashes: np.ndarray
    checks: np.ndarray
    places: np.ndarray  # hash of the text and the word's number in it


class Prefixes:
    """Prefix polynomials of an array: sums of ``values[j] * base**j`` before each place."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(len(values), base), out=self.sums[1:])
        self.unpowers = powers(len(values) + 1, np.uint64(pow(int(base), -1, 1 << 64)))

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomial of each slice, whatever its place."""
        return (self.sums[ends] - self.sums[starts]) * self.unpowers[starts]


def words_of(texts: pa.Array) -> Words:
    raw, offsets = joined_bytes(texts)
    raw = LOWER[raw]
    cut = CUT[raw]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~(cut | GAP[raw])
    # A text's end ends its last word.
    bounds = np.zeros(len(raw) + 1, dtype=bool)
    bounds[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | bounds))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | bounds))
    row = np.searchsorted(offsets, starts, side="right") - 1
    passed = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(cut, out=passed[1:])
    values, lengths = raw.astype(np.uint64) + np.uint64(1), mix((ends - starts).astype(np.uint64))
    prefixes = Prefixes(values)
    hashes = mix(prefixes.between(starts, ends) + lengths)
    checks = mix(Prefixes(values, CHECK_BASE).between(starts, ends) ^ lengths)
    texts_at = mix(prefixes.between(offsets[:-1], offsets[1:]) + mix(np.diff(offsets).astype(np.uint64)))
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets)[row] if len(row) else row
    places = mix(texts_at[row] + number.astype(np.uint64))
    return Words(raw, starts, ends, passed[starts] + row, row, hashes, checks, places)


def language_salts(langs: pa.Array) -> np.ndarray:
    """A number for each row's language, the same in every task."""
    raw, offsets = joined_bytes(langs)
    prefixes = Prefixes(raw.astype(np.uint64) + np.uint64(1))
    return mix(prefixes.between(offsets[:-1], offsets[1:]) + mix(np.diff(offsets).astype(np.uint64)))


class Grams:
    """Fingerprints and check values of the n-grams of a batch."""

    def __init__(self, words: Words, salts: np.ndarray, bits: int = 64):
        self.words = words
        self.prefixes = Prefixes(words.hashes)
        self.checked = Prefixes(words.checks, CHECK_BASE)
        self.salt = salts[words.row] if len(words.row) else np.zeros(0, np.uint64)
        self.drop = np.uint64(64 - bits)

    def whole(self, n: int) -> np.ndarray:
        """For each start, whether n words from there lie in one piece."""
        piece = self.words.piece
        count = max(0, len(piece) - n + 1)
        return piece[:count] == piece[n - 1 :][:count]

    def fingerprints(self, n: int, starts: np.ndarray) -> np.ndarray:
        value = self.prefixes.between(starts, starts + n)
        return mix(mix(value + np.uint64(n)) ^ self.salt[starts]) >> self.drop << self.drop

    def marks(self, n: int, starts: np.ndarray) -> np.ndarray:
        """Check and pointer of each occurrence, the check above."""
        check = mix(self.checked.between(starts, starts + n) ^ self.salt[starts]) >> np.uint64(48)
        place = self.words.places[starts] >> np.uint64(48)
        return (check << np.uint64(16) | place).astype(np.uint32).view(np.int32)


class Frequent:
    """Bit table of hashes; has() may say yes to others, never no to one of them."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def places(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - FILTER_BITS)
        return prints >> shift, (prints * np.uint64(0xD6E8FEB86659FD93)) >> shift

    def has(self, prints: np.ndarray) -> np.ndarray:
        found = np.ones(len(prints), dtype=bool)
        for place in self.places(prints):
            found &= (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def frequent_table(counted: DataFrame, column: str = "print") -> Frequent:
    """The bit table of a stored column. 2**FILTER_BITS bits come to the driver, no more."""
    each = (1 << FILTER_BITS) // PARTS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            for place in Frequent.places(batch.column(column).to_numpy().view(np.uint64)):
                table[place] = True
        for part, piece in enumerate(np.split(table, PARTS)):
            if piece.any():
                data = np.packbits(piece, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "bits"]
                )

    def joined(parts: pa.Table) -> pa.Table:
        total = np.zeros(each // 8, dtype=np.uint8)
        for part in parts.column("bits"):
            total |= np.frombuffer(part.as_buffer(), dtype=np.uint8)
        return pa.table({"part": parts.column("part").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    made = counted.mapInArrow(bits, "part int, bits binary").groupBy("part").applyInArrow(joined, "part int, bits binary")
    table = np.zeros((PARTS, each // 8), dtype=np.uint8)
    for row in made.collect():
        table[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Frequent(table.reshape(-1))


def text_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            yield piece, Grams(words_of(piece.column("text")), language_salts(piece.column("lang")), bits)


#: Columns of counted fingerprints, and how those of one fingerprint are put together.
COUNTED = {"c": np.add, "lo": np.minimum, "hi": np.maximum}


def combined(prints: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each fingerprint, sorted."""
    order = np.argsort(prints)
    prints = prints[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else order
    if not len(prints):
        return [prints, *columns]
    return [
        prints[first],
        *(put.reduceat(c[order], first) for put, c in zip(COUNTED.values(), columns, strict=True)),
    ]


def count_prints(docs: DataFrame, sizes: tuple[int, ...], inner=None, bits: int = 64) -> DataFrame:
    """(print, c, lo, hi): parts of the counts of the fingerprints of n-grams of these sizes.

    ``inner`` is (k, broadcast table of frequent k-grams): n-grams made of such k-grams alone count.
    """

    def starts_of(grams: Grams) -> Iterator[tuple[int, np.ndarray]]:
        good, k = np.ones(len(grams.words.piece), dtype=bool), 1
        if inner is not None:
            k, table = inner
            at = np.flatnonzero(grams.whole(k))
            good[:] = False
            good[at[table.value.has(grams.fingerprints(k, at))]] = True
        for n in sizes:
            inside = grams.whole(n)
            for j in range(n - k + 1):
                inside = inside & good[j : j + len(inside)]
            yield n, np.flatnonzero(inside)

    def run(batches):
        parts: list[list[np.ndarray]] = []
        held = 0
        for _, grams in text_batches(batches, bits):
            for n, starts in starts_of(grams):
                marks = grams.marks(n, starts)
                columns = [np.ones(len(starts), dtype=np.int64), marks, marks]
                parts.append(combined(grams.fingerprints(n, starts), columns))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from rows(parts[0])
                    parts, held = [], 0
        if parts:
            yield from rows(merged(parts))

    def merged(parts):
        whole = [np.concatenate(columns) for columns in zip(*parts, strict=True)]
        return combined(whole[0], whole[1:])

    def rows(columns):
        arrays = [pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])]
        whole = pa.RecordBatch.from_arrays(arrays, names=["print", *COUNTED])
        for a in range(0, whole.num_rows, 100_000):
            yield whole.slice(a, 100_000)

    return docs.mapInArrow(run, "print long, c long, lo int, hi int")


def pointer_hash(prints: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return mix(prints ^ mix(marks.view(np.uint32).astype(np.uint64) + np.uint64(1)))


def frequent_prints(parts: DataFrame, least: int) -> DataFrame:
    """Stored (print, c, at, mixed, pointer) of fingerprints that occur often enough."""
    counted = (
        parts.groupBy("print")
        .agg(F.sum("c").alias("c"), F.min("lo").alias("at"), F.max("hi").alias("hi"))
        .select("print", "c", "at", (F.shiftright("at", 16) != F.shiftright("hi", 16)).alias("mixed"))
    )

    def point(batches):
        for batch in batches:
            prints, at = batch.column("print").to_numpy().view(np.uint64), batch.column("at").to_numpy()
            yield batch.append_column("pointer", pa.array(pointer_hash(prints, at).view(np.int64)))

    kinds = "print long, c long, at int, mixed boolean, pointer long"
    return stage(counted.where(F.col("c") >= least).mapInArrow(point, kinds))


def materialised(docs: DataFrame, pointers, bits: int) -> DataFrame:
    """(lang, size, phrase, c, print, at): phrases at the occurrences pointed at; size 0: the words of
    a language in one task. ``pointers`` broadcasts the bit table of pointers."""
    names = ["lang", "size", "phrase", "c", "print", "at"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names
        )

    def run(batches):
        totals: dict[str, int] = {}
        for batch, grams in text_batches(batches, bits):
            words = grams.words
            langs = batch.column("lang").to_pylist()
            for lang, count in zip(langs, np.bincount(words.row, minlength=len(langs)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + count
            data, out = words.raw.tobytes(), []
            for n in range(1, LONGEST + 1):
                starts = np.flatnonzero(grams.whole(n))
                prints, at = grams.fingerprints(n, starts), grams.marks(n, starts)
                wanted = np.flatnonzero(pointers.value.has(pointer_hash(prints, at)))
                for i in wanted.tolist():
                    s = int(starts[i])
                    ends = zip(words.starts[s : s + n].tolist(), words.ends[s : s + n].tolist(), strict=True)
                    phrase = b" ".join(data[a:b] for a, b in ends).decode("utf-8")
                    name = prints[i].view(np.int64).item()
                    out.append((langs[int(words.row[s])], n, phrase, 0, name, int(at[i])))
            yield batch_of(out)
        yield batch_of([(lang, 0, "", count, None, None) for lang, count in totals.items()])

    return docs.mapInArrow(run, "lang string, size int, phrase string, c long, print long, at int")


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word of a batch; equal numbers mean equal bytes, as compared here."""
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    lengths = words.ends - words.starts
    same = lengths == lengths[first][number]
    if same.all() and len(number):
        begin = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        own = words.raw[np.repeat(words.starts, lengths) + within]
        other = words.raw[np.repeat(words.starts[first][number], lengths) + within]
        same = np.add.reduceat(own != other, begin) == 0
    if not same.all():
        known: dict[bytes, int] = {}
        data = words.raw.tobytes()
        number = np.array(
            [known.setdefault(data[a:b], len(known)) for a, b in zip(words.starts, words.ends, strict=True)]
        )
    return number


def verified_groups(numbers: np.ndarray, n: int, starts: np.ndarray, prints: np.ndarray):
    """(first start, occurrences) of each different phrase among the starts.

    Starts of one fingerprint are compared word by word with the first of them.
    """
    _, first, group = np.unique(prints, return_index=True, return_inverse=True)
    same = np.ones(len(starts), dtype=bool)
    for k in range(n):
        same &= numbers[starts + k] == numbers[starts[first][group] + k]
    if not same.all():
        table = np.stack([numbers[starts + k] for k in range(n)], axis=1)
        _, first, group = np.unique(table, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
    return starts[first], np.bincount(group, minlength=len(first))


def phrases_of_prints(docs: DataFrame, prints, bits: int) -> DataFrame:
    """(lang, size, phrase, c): parts of the counts of all phrases of some fingerprints, by text.

    ``prints`` broadcasts the bit table of those fingerprints.
    """
    names = ["lang", "size", "phrase", "c"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(batches):
        for batch, grams in text_batches(batches, bits):
            words = grams.words
            langs = batch.column("lang").to_pylist()
            tongue = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            tongues = np.array([tongue[lang] for lang in langs], dtype=np.int64)
            numbers = word_numbers(words)
            numbers = numbers * max(1, len(tongue)) + tongues[words.row] if len(numbers) else numbers
            data, out = words.raw.tobytes(), []
            for n in range(1, LONGEST + 1):
                starts = np.flatnonzero(grams.whole(n))
                values = grams.fingerprints(n, starts)
                keep = prints.value.has(values)
                firsts, counts = verified_groups(numbers, n, starts[keep], values[keep])
                for s, c in zip(firsts.tolist(), counts.tolist(), strict=True):
                    phrase = b" ".join(data[words.starts[k] : words.ends[k]] for k in range(s, s + n))
                    out.append((langs[int(words.row[s])], n, phrase.decode("utf-8"), c))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names
            )

    return docs.mapInArrow(run, "lang string, size int, phrase string, c long")


def count_phrases(docs: DataFrame, least: int = 100, bits: int = PRINT_BITS) -> DataFrame:
    """Stored (lang, size, phrase, f): exact counts of all phrases of one to five words that occur
    ``least`` times in their language, and under size 0 the number of its words."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.coalesce("lang", F.lit("und")).alias("lang"),
    )
    inner, both = None, None
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        frequent = frequent_prints(count_prints(texts, sizes, inner, bits), least)
        both = frequent if both is None else both.union(frequent)
        if len(sizes) == 1:
            inner = (sizes[0], send(frequent_table(frequent)))
    both = stage(both)
    found = stage(materialised(texts, send(frequent_table(both, "pointer")), bits))
    totals = found.where("size = 0").groupBy("lang").agg(F.sum("c").alias("f"))
    # Copies of a text give a pointer's phrase several times.
    clear = (
        found.where("size > 0")
        .join(both.where("NOT mixed").select("print", "at", F.col("c").alias("f")), ["print", "at"])
        .groupBy("print")
        .agg(*[F.min(c).alias(c) for c in ("lang", "size", "phrase", "f")])
        .select("lang", "size", "phrase", "f")
    )
    counted = totals.select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "f").union(clear)
    mixed = both.where("mixed")
    if not mixed.isEmpty():
        table = frequent_table(mixed)
        parts = phrases_of_prints(texts, send(table), bits)
        exact = parts.groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        # The table may let other fingerprints through; their phrases are known already.
        known = clear.select("lang", "phrase")
        counted = counted.union(exact.join(known, ["lang", "phrase"], "left_anti").select(counted.columns))
    return stage(counted)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``top`` phrases of each language."""
    counts = count_phrases(docs, least)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(f"size BETWEEN 1 AND {LONGEST - 1}").select("lang", "phrase", "f")
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    # A phrase as frequent as one a word longer says nothing of its own. Longer ones than that need
    # no look: what lies between is then as frequent.
    words = F.split("phrase", " ")
    inner = (
        candidates.where("size >= 3")
        .select(
            "lang",
            "a",
            F.explode(
                F.array(
                    F.array_join(F.slice(words, 1, F.col("size") - 1), " "),
                    F.array_join(F.slice(words, 2, F.col("size") - 1), " "),
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("within"))
    )
    kept = candidates.join(inner, ["lang", "phrase"], "left").where("within IS NULL OR within < a")
    cuts = kept.select(
        "lang",
        "phrase",
        "a",
        F.posexplode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_", "k"),
        "size",
        words.alias("w"),
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = lookup_join(cuts, left, ["lang", "first"], ["phrase", "k"], staged=True)
    cuts = lookup_join(cuts, right, ["lang", "rest"], ["phrase", "k"], staged=True)
    cuts = lookup_join(cuts, totals, ["lang"], ["phrase", "k"], staged=True)
    whole = "decimal(19,0)"
    score = F.expr(
        f"(CAST(1000 * a AS {whole}) * CAST(n AS {whole})) div (CAST(l AS {whole}) * CAST(r AS {whole}))"
    )
    best = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(
            F.first("a").alias("a"),
            F.first("n").alias("n"),
            F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        )
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    some = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    some = some.where(F.col("_n") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
