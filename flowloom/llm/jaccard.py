"""Self-join of shingle sets by Jaccard similarity, size-aware: light sets and heavy sets.

Two sets of n and m shingles reach the similarity only if they share c(n, m) of them. All shingles
have one order, rare ones first. Then two such sets share one of their first n - c + 1 and
m - c + 1 shingles (and two of their first n - c + 2 and m - c + 2):

* Light sets (up to a boundary size) enumerate the 2-subsets of that start. A subset is a key that
  unrelated sets hardly share.
* Heavy sets would enumerate too many; they enter each shingle of the start into an inverted
  list. Light sets near the boundary, which may meet heavy partners, enter theirs too.
* The boundary is the size with the least cost by a formula of the set size, summed over the
  histogram of sizes. It reads no list lengths, and comes to at most 6 shingles at 85% and 4 at 80%:
  but for such very short texts the method is a prefix filter over inverted lists.

Rarity comes from a table of counts over all documents, by hash of the shingle. Its size is fixed
(``SKETCH_BITS``), so it can be broadcast whatever the corpus; only the order depends on it, and
the result is the same for any order.

Equal sets are one node. Lists and subsets are not turned into all their pairs: a group of
thousands of near copies would give millions. First the members of every list are compared with one
of them, the list's pivot, and what links is one component from then on. Then, in long lists, those
that are not in the list's largest component are compared with ``PIVOTS`` members. Pivots are the
members that have the list's shingle first in their order: an edit puts its rare shingles in front, so
those are the least edited, which link with most others and lead many lists at once. The rest is
exact: in lists that still hold several components, members outside the largest meet all members of
other components. Pairs inside a component need no test, so no link between components is lost, and
components are exact.

A pair goes through filters that never reject a true pair (sizes, position in the order, the odd
sketch) and is then compared shingle by shingle, as sorted 64-bit hashes. Only
the sets of such pairs are made and shuffled, anew from the texts for each of the three steps: a bit
table of fixed size (``WANTED_BITS``) tells the tasks which nodes those are. It may let others
through, which a join drops.

The odd sketch of a set has about a bit for each shingle: whether an odd number of them falls there. Bits in
which two sketches differ are never more than the shingles that only one of the sets has.

Sets travel by node, not by document id, so rows that share an id, or have none, meet nothing but
their own node. The entries are shuffled once, by token: there lists are counted, and those of one
node dropped. What is stored for a step is deleted when the next has what it needs.

Defined results: a null or empty text has an empty set and is linked with nothing. Repeated rows
are equal sets. A null id stays null and never names a component with other ids. An empty table gives an empty
table. Very long texts are hashed in blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from flowloom.llm.batches import pieces, tidied
from flowloom.llm.components import connected
from flowloom.llm.hashing import mix, sequence_hashes, word_hashes
from flowloom.plans.staging import discard, stage as stage_plainly

SKETCH_BITS = 22
SLOTS = 256
#: Bits of the shortest and the longest odd sketch, as powers of two.
SKETCH_LEAST, SKETCH_MOST = 6, 16
#: Bits of the table of nodes whose sets are compared, a power of two of at least 15.
WANTED_BITS = 25
#: Bytes of an Arrow batch; a row of a comparison holds two sets.
BATCH_BYTES = 4 << 20
#: Lists up to this length take no part in the second round.
SHORT_LIST = 8
#: Members of a longer list that those outside its largest component are compared with then.
PIVOTS = 8
#: Cost of a row met in a list, in rows written.
MEETING_COST = 0.2
#: Stands for a missing id.
NO_ID = -(2**63)


def stage(df: DataFrame) -> DataFrame:
    return stage_plainly(df, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})


@dataclass(frozen=True)
class Likeness:
    """Shingle width, and a threshold of ``percent`` / 100."""

    width: int = 5
    percent: int = 80

    def overlap(self, n: int, m: int) -> int:
        """Least number of shared shingles of sets of n and m that are similar enough."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def start(self, n: int) -> int:
        """Shingles of a set's start, for the smallest partner it can have."""
        return n - self.overlap(n, self.least_partner(n)) + 1

    def may_link(self, n, m, i, j):
        """Column or number test: sizes allow a link, and so do positions i and j of a shared one."""
        need = (self.percent * (n + m) + 100 + self.percent - 1) / (100 + self.percent)
        return (i <= n - F.floor(need)) & (j <= m - F.floor(need)) & (
            F.least(n, m) * 100 >= F.greatest(n, m) * self.percent
        )


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, firsts = word_hashes(texts, lower=True)
    grams = sequence_hashes(hashes, width)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield sequence_hashes(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def node_of(shingles: np.ndarray) -> int:
    total = mix(shingles * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))])).view(np.int64)[0])


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit, by the low bits of their hash."""
    size = 1 << min(max((len(shingles) - 1).bit_length(), SKETCH_LEAST), SKETCH_MOST)
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distance(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Bits in which two lists of odd sketches differ, row by row; the longer one is folded."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), dtype=np.int64)
    for x, y in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == x) & (sizes[:, 1] == y))
        folded = []
        for sketches, size in ((left, x), (right, y)):
            parts = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8)
            folded.append(np.bitwise_xor.reduce(parts.reshape(len(at), size // min(x, y), min(x, y)), axis=1))
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, "text", 1 << 20)


def survey(docs: DataFrame, like: Likeness) -> DataFrame:
    """Stored: (doc_id, n, node, odd) of every document, and the parts of the count table."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("odd", pa.binary())]
    schema = pa.schema([*fields, ("slot", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        seen = False
        for batch in text_batches(batches):
            sets = list(shingle_sets(batch.column("text"), like.width))
            if sets:
                seen = True
                places = np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)
                at, found = np.unique(places, return_counts=True)
                counts[at.astype(np.int64)] += found.astype(np.uint32)
            rows = [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([odd_sketch(s) if len(s) else None for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)
        if seen:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLOTS)]
            empty = [pa.nulls(SLOTS, kind) for _, kind in fields]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array(range(SLOTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema
            )

    kinds = "doc_id long, n long, node long, odd binary, slot int, counts binary"
    return stage(docs.mapInArrow(tidied(run), kinds))


def rarity(surveyed: DataFrame) -> np.ndarray:
    """Level of each place of the count table: 0 for rare, one more for each doubling.

    A fixed number of bytes comes to the driver, 2**SKETCH_BITS, whatever the corpus.
    """

    def total(parts: pa.Table) -> pa.Table:
        size = (1 << SKETCH_BITS) // SLOTS
        counts = np.zeros(size, dtype=np.uint64)
        for part in parts.column("counts"):
            counts += np.frombuffer(zlib.decompress(part.as_buffer()), dtype=np.uint32)
        mean = max(1.0, float(counts.mean()))
        level = np.floor(np.log2(np.maximum(counts / (2 * mean), 0.5))) + 1
        slot = parts.column("slot")[0].as_py()
        return pa.table(
            {"slot": pa.array([slot], pa.int32()), "levels": [level.astype(np.uint8).tobytes()]}
        )

    slots = surveyed.where("slot IS NOT NULL").select("slot", "counts")
    rows = slots.groupBy("slot").applyInArrow(total, "slot int, levels binary").collect()
    table = np.zeros((SLOTS, (1 << SKETCH_BITS) // SLOTS), dtype=np.uint8)
    for row in rows:
        table[row["slot"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return table.reshape(-1)


def light_boundary(nodes: DataFrame, like: Likeness) -> int:
    """Size up to which sets enumerate 2-subsets, by cost over the histogram of sizes.

    Cost of a light set is its subsets, of a heavy one its list entries and whom it meets there.
    Sizes beyond 256 are never light (their subsets exceed any gain), so the histogram has at most
    256 rows.
    """
    sizes = nodes.where("n BETWEEN 1 AND 256").groupBy("n").agg(F.count("*").alias("sets")).collect()
    best, least = 0, 0.0
    saved = 0.0
    for row in sorted(sizes, key=lambda r: r["n"]):
        start = like.start(row["n"])
        light = math.comb(start + 1, 2)
        heavy = start * (1 + MEETING_COST * start)
        saved += row["sets"] * (light - heavy)
        if saved < least:
            best, least = row["n"], saved
    return best


def entries(docs: DataFrame, like: Likeness, levels, boundary: int) -> DataFrame:
    """(token, node, n, pos): list entries of heavy sets and subsets of light ones, once a task."""
    schema = pa.schema(
        [("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]
    )
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def of_set(shingles: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(shingles)
        level = table[(shingles & mask).astype(np.int64)]
        start = like.start(n)
        most = min(n, start + 1)
        ordered = shingles[np.lexsort((mix(shingles), level))[:most]]
        tokens, places = [], []
        if n <= boundary:
            if n == 1:
                tokens.append(mix(ordered + np.uint64(2)))
                places.append(np.zeros(1, dtype=np.int32))
            else:
                a, b = np.triu_indices(most, 1)
                low, high = np.minimum(ordered[a], ordered[b]), np.maximum(ordered[a], ordered[b])
                tokens.append(mix(mix(low) + np.uint64(3) * high))
                places.append(np.zeros(len(a), dtype=np.int32))
        if n > boundary or 100 * n >= like.percent * boundary:
            tokens.append(mix(ordered[:start]))
            places.append(np.arange(min(n, start), dtype=np.int32))
        return np.concatenate(tokens), np.concatenate(places)

    def run(batches):
        table = levels.value
        done: set[int] = set()
        for batch in text_batches(batches):
            tokens, nodes, sizes, places = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), like.width):
                node = node_of(shingles) if len(shingles) else None
                if node is None or node in done:
                    continue
                done.add(node)
                t, p = of_set(shingles, table)
                tokens.append(t)
                places.append(p)
                nodes.append(np.full(len(t), node, dtype=np.int64))
                sizes.append(np.full(len(t), len(shingles), dtype=np.int32))
            if tokens:
                columns = [
                    np.concatenate(tokens).view(np.int64),
                    np.concatenate(nodes),
                    np.concatenate(sizes),
                    np.concatenate(places),
                ]
                whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

    return docs.mapInArrow(tidied(run), "token long, node long, n int, pos int")


def inverted_lists(found: DataFrame) -> DataFrame:
    """Stored (token, node, n, pos, members) of the lists with several nodes, from one shuffle."""
    once = found.repartition("token").groupBy("token", "node").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    members = F.count("*").over(W.partitionBy("token"))
    return stage(once.withColumn("members", members).where("members > 1"))


def node_place(node):
    """Place of a node (numbers or column) in the bit table; its upper bits are hashed already."""
    if isinstance(node, np.ndarray):
        return node.view(np.uint64) >> np.uint64(64 - WANTED_BITS)
    return F.shiftrightunsigned(node, 64 - WANTED_BITS)


def wanted_bits(wanted: DataFrame) -> np.ndarray:
    """Bit table of nodes, the lowest bit of a byte first. 2**WANTED_BITS bits come to the driver."""
    place = node_place(F.col("node")) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    rows = parts.collect()
    # Parts are numbered from 1 and have a size that Spark fixes.
    size = len(rows[0]["bits"]) if rows else 1
    table = np.zeros(((1 << WANTED_BITS) // 8 // size, size), dtype=np.uint8)
    for row in rows:
        table[row["part"] - 1] = np.frombuffer(row["bits"], dtype=np.uint8)
    return table.reshape(-1)


def sets_of(docs: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """Stored (node, shingles) of the wanted nodes: sorted 64-bit hashes, eight bytes each."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast(wanted_bits(wanted))

    def run(batches):
        done: set[int] = set()
        table = sent.value
        for batch in text_batches(batches):
            made = [s for s in shingle_sets(batch.column("text"), like.width) if len(s)]
            named = np.fromiter((node_of(s) for s in made), np.int64, len(made))
            place = node_place(named)
            maybe = table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            nodes, sets = [], []
            for i in np.flatnonzero(maybe).tolist():
                node = int(named[i])
                if node not in done:
                    done.add(node)
                    nodes.append(node)
                    sets.append(made[i].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=schema
            )

    made = docs.mapInArrow(tidied(run), "node long, shingles binary").repartition("node")
    stored = stage(made.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    sent.unpersist()
    return stored


def plausible(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """Stored pairs whose odd sketches allow enough shared shingles."""

    def run(batches):
        for batch in batches:
            apart = sketch_distance(batch.column("oa").to_pylist(), batch.column("ob").to_pylist())
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = n - 2 * -(-like.percent * n // (100 + like.percent))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "oa", "ob")
    return stage(rows.mapInArrow(tidied(run), "a long, b long"))


def linked(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs whose sets reach the similarity, stored."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= like.percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return stage(rows.mapInArrow(tidied(run), "a long, b long"))


def pivot_pairs(lists: DataFrame, like: Likeness) -> DataFrame:
    """Members of each list against one of them, its pivot."""
    order = F.struct("pos", F.xxhash64("node").alias("h"), "node", "n")
    pivot = lists.groupBy("token").agg(F.min(order).alias("p"))
    rows = lists.join(pivot, "token").where("node <> p.node")
    ok = like.may_link(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"))
    return rows.where(ok).select(
        F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")
    )


def list_pairs(lists: DataFrame, like: Likeness, pivots: int | None) -> DataFrame:
    """Members outside their list's largest component, against members of other components.

    With ``pivots``, against that many members of the list at most; without, against all of them.
    """
    counted = lists.groupBy("token", "comp").agg(F.count("*").alias("c"))
    largest = (
        counted.groupBy("token")
        .agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k"))
        .where("k > 1")
        .select("token", F.col("top.comp").alias("major"))
    )
    several = lists.join(largest, "token")
    minor = several.where("comp <> major").select(
        "token",
        F.col("node").alias("x"),
        F.col("n").alias("xn"),
        F.col("pos").alias("xp"),
        F.col("comp").alias("xc"),
    )
    if pivots is not None:
        order = W.partitionBy("token").orderBy("pos", F.xxhash64("node"), "node")
        several = several.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= pivots)
    rows = minor.join(several, "token").where(F.col("comp") != F.col("xc"))
    ok = like.may_link(F.col("n"), F.col("xn"), F.col("pos"), F.col("xp"))
    return rows.where(ok).select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))


def components(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, text) rows: stored (doc_id, n, node) of each, and (node, rep, comp) of each node.

    ``rep`` is the smallest id of a node, ``comp`` names the node's component.
    """
    spark = docs.sparkSession
    surveyed = survey(docs, like)
    ids = surveyed.where("slot IS NULL").select("doc_id", "n", "node", "odd")
    nodes = stage(
        ids.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("odd").alias("odd"))
    )
    levels = spark.sparkContext.broadcast(rarity(surveyed))
    lists = inverted_lists(entries(docs, like, levels, light_boundary(nodes, like)))
    rows = stage(ids.drop("odd"))
    discard(surveyed)

    links, comps = None, None
    for step in range(3):
        if step == 0:
            pairs = pivot_pairs(lists, like)
        else:
            members = lists.where(F.col("members") > SHORT_LIST) if step == 1 else lists
            named = comps.withColumnRenamed("comp", "_comp")
            labels = members.join(named, "node", "left")
            labels = labels.withColumn("comp", F.coalesce("_comp", "node")).drop("_comp")
            pairs = list_pairs(labels, like, PIVOTS if step == 1 else None)
        # What links is known from its component; a pair compared once is not met again.
        close = plausible(pairs.distinct(), nodes, like)
        compared = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets_of(docs, compared, like)
        new = linked(close, sets, like)
        discard(close, sets)
        before = comps
        known = None if before is None else before.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        links = new if known is None else known.union(new)
        comps = stage(connected(links))
        discard(new, *([] if before is None else [before]))
    discard(lists)
    named = nodes.join(comps, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    return rows, named


def texts_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def near_components(docs: DataFrame, like: Likeness, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component's smallest document id."""
    rows, named = components(texts_of(docs, text, key), like)
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    answer = named.join(smallest, "comp").select("node", "component_id")
    return rows.join(answer, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each group of near copies: that with the group's smallest id.

    Rows without an id come last; among those, the node decides. Rows of the same id and shingles
    are one document and stay once, whichever it is. Rows without shingles are in no group: all
    stay, those that repeat an id and text once.
    """
    rows, named = components(texts_of(docs), like)
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    kept = named.groupBy("comp").agg(best.alias("b")).select(F.col("b.node").alias("_node"), F.col("b.rep").alias("_rep"))
    kept = stage(kept.withColumn("_rep", F.coalesce("_rep", F.lit(NO_ID))))

    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column("row"), "text")
            at = 0
            for piece in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text", 1 << 20):
                nodes = [node_of(s) if len(s) else None for s in shingle_sets(piece.column("text"), like.width)]
                part = batch.slice(at, piece.num_rows)
                at += piece.num_rows
                yield part.append_column("_node", pa.array(nodes, pa.int64()))

    # The row is carried as one value, so its columns may have any names.
    packed_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*packed_rows.schema.fields, T.StructField("_node", T.LongType())])
    marked = packed_rows.mapInArrow(tidied(run), schema).withColumn(
        "_rep", F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(NO_ID))
    )
    grouped = marked.join(kept, ["_node", "_rep"], "left_semi").dropDuplicates(["_node", "_rep"])
    alone = marked.where("_node IS NULL").withColumn("_text", F.xxhash64(F.col("row")["text"]))
    alone = alone.dropDuplicates(["_rep", "_text"]).drop("_text")
    return grouped.select("row.*").union(alone.select("row.*"))
