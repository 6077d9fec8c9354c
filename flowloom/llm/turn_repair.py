"""Least-cost repair of conversations over a suffix-shared automaton of their signatures.

A conversation's signature has one letter a row: the initial of its role, and its first fault. For
repair a blank or duplicate row is one letter whatever its role, as it must go. Signatures of all
conversations are reduced to the different ones and laid out by their reversed text, so those with a
common end lie together. They form an automaton minimised from the end: a node is a suffix, made once
for all that share it. For each node and state of the grammar ``(s?(ua)+)?`` the cost-to-go and the
first edit of the best audit are computed once, from the node that follows; of equally cheap edits
the ASCII-least letter is taken, and as the letters of one place differ, that gives the least audit.
Audit suffixes of the last ``KEPT_SUFFIX`` rows are kept as text, longer ones are read off the edits.

No conversation is gathered with its texts. Rows are ordered by range over (conversation, turn, role,
text hash), so a large conversation spans tasks, which write parts of its signature. The repaired
text is streamed in order and hashed line by line; as SHA-256 runs over the whole text, one
conversation's lines pass through one task, which holds one line and the audit.

Defined results: a null role or text is one space, a null ``conv_id`` is a conversation of its own.
Rows of one turn are ordered by role, then by the text's SHA-256; repeated rows are duplicates. A
role whose initial is none of s, u, a fits nowhere. An empty table gives an empty table. Only the
four columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.words import SPACES
from flowloom.plans.lookups import lookup_join
from flowloom.plans.staging import stage

INITIALS = "suao"
#: Letters by fault: none, blank, duplicate, truncated; four for each initial.
SIGNS = "ABCDEFGHIJKLMNOP"
#: The same for repair: kept as it is, must go, must go, truncated.
REPAIR_SIGNS = "sxxSuxxUaxxAoxxO"
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: start, after s, after u, after a. Where an initial leads, and what u or a leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITES = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
FINAL = (0, 3)
FAR = 1 << 60
KEPT_SUFFIX = 64


class Node:
    """A suffix of signatures: cost-to-go and first edit of each state, and the edits as text."""

    __slots__ = ("costs", "edits", "texts")

    def __init__(self, costs: tuple[int, ...], edits: str, texts: tuple[str, ...] | None):
        self.costs, self.edits, self.texts = costs, edits, texts


def with_inserts(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The best of each state when rows may be inserted before what was found."""
    best = found
    for _ in range(3):
        best = [
            min(own, (best[NEXT[s][WRITES[s]]][0] + INSERT, "I")) for s, own in enumerate(found)
        ]
    return best


def end_node() -> Node:
    best = with_inserts([(0, "") if s in FINAL else (FAR, "") for s in range(4)])
    return Node(tuple(c for c, _ in best), "".join(e or "." for _, e in best), ("", "II", "I", ""))


def node_before(sign: str, after: Node, depth: int) -> Node:
    """The node of ``sign`` followed by ``after``; it stands ``depth`` rows before the end."""
    initial, fine = sign.lower(), sign != "x"
    more = TRUNCATED if sign.isupper() else 0
    found = []
    for s in range(4):
        options = [(DELETE + after.costs[s], "D")]
        if fine:
            if initial in NEXT[s]:
                options.append((more + after.costs[NEXT[s][initial]], "K"))
            options.append((more + RENAME + after.costs[NEXT[s][WRITES[s]]], "R"))
        found.append(min(options))
    best = with_inserts(found)
    node = Node(tuple(c for c, _ in best), "".join(e for _, e in best), None)
    if depth <= KEPT_SUFFIX:
        node.texts = tuple(suffix_text(node, after, initial, s) for s in range(4))
    return node


def suffix_text(node: Node, after: Node, initial: str, state: int) -> str:
    out = ""
    while node.edits[state] == "I":
        out, state = out + "I", NEXT[state][WRITES[state]]
    edit = node.edits[state]
    return out + edit + after.texts[after_edit(edit, state, initial)]


def after_edit(edit: str, state: int, initial: str) -> int:
    if edit == "D":
        return state
    return NEXT[state][initial if edit == "K" else WRITES[state]]


class SuffixAutomaton:
    """Nodes of the suffixes of the signature met last; shared ones are kept for the next."""

    def __init__(self):
        self.path = [end_node()]
        self.before = ""
        self.made = 0

    def best(self, back: str) -> tuple[int, str]:
        """(cost, audit) of a reversed signature. Sorted ones share the most nodes."""
        shared, limit = 0, min(len(back), len(self.before))
        while shared < limit and back[shared] == self.before[shared]:
            shared += 1
        del self.path[shared + 1 :]
        for depth in range(shared, len(back)):
            self.path.append(node_before(back[depth], self.path[-1], depth + 1))
        self.made += len(back) - shared
        self.before = back
        depth, state, out = len(back), 0, []
        while self.path[depth].texts is None:
            edit = self.path[depth].edits[state]
            out.append(edit)
            if edit == "I":
                state = NEXT[state][WRITES[state]]
            else:
                state = after_edit(edit, state, back[depth - 1].lower())
                depth -= 1
        return self.path[-1].costs[0], "".join(out) + self.path[depth].texts[state]


def conversation(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the checksum of ``conv_id:turn``."""
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    name = F.concat(conversation(F.col("conv_id")), F.lit(":"), turn)
    kind = (F.crc32(name.cast("binary")) % 20).alias("kind")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).where("kind <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, hash) with nulls filled."""
    return rows.select(
        conversation(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def signatures(rows: DataFrame) -> DataFrame:
    """Stored (conv, sign): a letter for each row of a conversation, in order."""
    text = F.rtrim(F.col("text"), F.lit(SPACES))
    same = ["conv", "role", "hash"]
    narrow = stage(
        rows.select(
            *same,
            "turn",
            (text == "").alias("blank"),
            (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        )
        .groupBy(*same, "turn", "blank", "truncated")
        .agg(F.count("*").alias("times"))
    )
    # Rows equal in role and text over several turns, and the first of these turns.
    again = (
        narrow.groupBy(*same)
        .agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.count("turn").alias("known"))
        .where("turns > 1")
        .select(*same, F.when(F.col("known") == F.col("turns"), F.col("first")).alias("first"), F.lit(True).alias("many"))
    )
    marked = lookup_join(narrow, again, same, ["turn"], how="left")
    later = F.col("many").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(later, 2).when(F.col("truncated"), 3).otherwise(0)
    order = ["conv", F.asc_nulls_first("turn"), "role", "hash"]
    lines = (
        marked.select(
            *same, "turn", "times", (4 * number + fault).alias("sign"),
            (4 * number + F.when(F.col("blank"), 1).otherwise(2)).alias("copy"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "times", "sign", "copy")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        letters = np.frombuffer(SIGNS.encode(), dtype=np.uint8)
        for batch in batches:
            times = batch.column("times").to_numpy()
            signs = np.repeat(batch.column("copy").to_numpy(), times)
            ends = np.cumsum(times)
            signs[ends - times] = batch.column("sign").to_numpy()
            data = letters[signs].tobytes().decode()
            convs = batch.column("conv").to_pylist()
            starts = [i for i, c in enumerate(convs) if i == 0 or c != convs[i - 1]]
            cuts = [0, *ends.tolist()]
            bounds = [*starts, len(convs)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([convs[a] for a in starts], pa.string()),
                    pa.array([place + k for k in range(len(starts))], pa.int64()),
                    pa.array([data[cuts[a] : cuts[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                ],
                names=["conv", "place", "sign"],
            )
            place += len(starts)

    parts = lines.mapInArrow(run, "conv string, place long, sign string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sign"))), lambda x: x["sign"]), "")
    return stage(parts.groupBy("conv").agg(joined.alias("sign")))


def best_audits(signed: DataFrame) -> DataFrame:
    """Stored (back, cost, audit) of every different reversed repair signature."""
    # Signatures are counted away before they are dealt, so a common one is one row.
    shapes = signed.select("back").distinct().repartitionByRange("back").sortWithinPartitions("back")

    def run(batches):
        automaton = SuffixAutomaton()
        for batch in batches:
            backs = batch.column("back").to_pylist()
            found = [automaton.best(b) for b in backs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(backs, pa.string()),
                    pa.array([c for c, _ in found], pa.int64()),
                    pa.array([a for _, a in found], pa.string()),
                ],
                names=["back", "cost", "audit"],
            )

    return stage(shapes.mapInArrow(run, "back string, cost long, audit string"))


class Lines:
    """Applies an audit to the rows of one conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = WRITES[self.state]
            self.at, self.state = self.at + 1, NEXT[self.state][initial]
            yield NAMES[initial], ""

    def add(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, initial = self.audit[self.at], WRITES[self.state]
        self.at += 1
        if edit == "R":
            yield NAMES[initial], text
        elif edit == "K":
            initial = role[:1]
            yield role, text
        if edit != "D":
            self.state = NEXT[self.state][initial]


def streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, tag, turn, role, text): each conversation's audit as text, then its rows in order."""
    tagged = audits.select(
        "conv", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("hash"), F.col("audit").alias("text"),
    ).unionByName(rows.withColumn("tag", F.lit(1)))
    order = ["conv", "tag", F.asc_nulls_first("turn"), "role", "hash"]
    return tagged.repartition("conv").sortWithinPartitions(*order).drop("hash")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, line, role, text): the rows of the repaired conversations, lines from 1."""

    def run(batches):
        lines, count, held = None, 0, ""
        for batch in batches:
            out = []
            for conv, tag, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tag == 0:
                    if lines is not None:
                        out += [(held, *x) for x in lines.inserted()]
                    lines, held = Lines(text), conv
                else:
                    out += [(held, *x) for x in lines.add(role, text)]
            yield from numbered(out)
        if lines is not None:
            yield from numbered([(held, *x) for x in lines.inserted()])

    last = ["", 0]

    def numbered(out):
        places = []
        for conv, _, _ in out:
            last[:] = [conv, last[1] + 1 if conv == last[0] else 1]
            places.append(last[1])
        columns = [[x[0] for x in out], places, [x[1] for x in out], [x[2] for x in out]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "line", "role", "text"]
        )

    return streamed(rows, audits).mapInArrow(run, "conv string, line long, role string, text string")


def digests_and_gaps(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, gaps, repaired_sha256) of every conversation with rows."""

    def run(batches):
        held = None  # conv, lines, hash, whether a line was written, lowest and last turn, different turns

        def write(made):
            for role, text in made:
                held[2].update((b"\n" if held[3] else b"") + f"{role}:{text}".encode())
                held[3] = True

        def closed():
            write(held[1].inserted())
            gaps = 0 if held[4] is None else held[5] - held[4] + 1 - held[6]
            return held[0], gaps, held[2].hexdigest()

        for batch in batches:
            out = []
            for conv, tag, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tag == 0:
                    if held is not None:
                        out.append(closed())
                    held = [conv, Lines(text), hashlib.sha256(), False, None, None, 0]
                    continue
                if turn is not None and turn != held[5]:
                    held[4] = turn if held[4] is None else held[4]
                    held[5], held[6] = turn, held[6] + 1
                write(held[1].add(role, text))
            yield rows_of(out)
        if held is not None:
            yield rows_of([closed()])

    def rows_of(out):
        kinds = [pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
            names=["conv", "gaps", "repaired_sha256"],
        )

    return streamed(rows, audits).mapInArrow(run, "conv string, gaps long, repaired_sha256 string")


def audited(rows: DataFrame) -> DataFrame:
    """Stored (conv, sign, cost, audit) of every conversation of ``keyed`` rows."""
    back = F.translate(F.reverse("sign"), SIGNS, REPAIR_SIGNS)
    signed = signatures(rows).withColumn("back", back)
    return stage(lookup_join(signed, best_audits(signed), ["back"], ["conv"], staged=True).drop("back"))


def repair_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, line, role, text) of all conversations, repaired; ids as text, a null one a space."""
    rows = keyed(conversations)
    return repaired(rows, audited(rows).select("conv", "audit")).withColumnRenamed("conv", "conv_id")


def repair_report(conversations: DataFrame, original: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired text, for every ``conv_id`` of ``original``."""
    rows = keyed(conversations)
    found = audited(rows)
    made = digests_and_gaps(rows, found.select("conv", "audit"))
    ids = original.select("conv_id").distinct().withColumn("conv", conversation(F.col("conv_id")))
    whole = ids.join(found, "conv", "left").join(made, "conv", "left")
    sign = F.coalesce("sign", F.lit(""))

    def having(fault: int) -> Column:
        return F.length(sign) - F.length(F.translate(sign, SIGNS[fault::4], ""))

    initials = F.translate(sign, SIGNS, "".join(i * 4 for i in INITIALS))
    pairs = F.greatest(F.length(sign) - 1, F.lit(0))
    illegal = pairs - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    return whole.select(
        "conv_id",
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        having(1).cast("long").alias("blank"),
        having(2).cast("long").alias("duplicate"),
        having(3).cast("long").alias("truncated"),
        illegal.cast("long").alias("illegal"),
        F.coalesce("cost", F.lit(0)).cast("long").alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
