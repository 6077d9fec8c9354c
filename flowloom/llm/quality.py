"""Quality rules as a short-circuit cascade.

A rule rejects a text by looking at measured features (words, lines, windows, ...). A sample
gives each rule's rejection rate and the work its features take. The rules are then tried in
order of rejection per cost, and the expression stops at the first rule that rejects: later
features are not computed for that row. The order changes the work, never the verdict.

Everything is column expressions; nothing here runs Python on the executors.

Defined results: a null text is an empty text, which has no words and fails ``few_words``.
Repeated rows are judged one by one. An empty table gives an empty table. Columns of the input
may have any names: rules see only the text column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.words import SPACES, let, text_or_empty, words

Env = Mapping[str, Column]

SYMBOLS = "[#*$%&|<>]"


def repeated_positions(grams: Column) -> Column:
    """Ascending positions of the entries of an array that occur in it more than once."""

    def neighbours(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda x, i: F.coalesce(F.get(ordered, i - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["g"] == x["g"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return let(ordered, neighbours)


def covered_words(grams: Column, width: int) -> Column:
    """Words that lie in windows of ``width`` words occurring twice or more."""

    def total(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
        let(repeated_positions(grams), total)
    )


def windows_of(found: Column, width: int) -> Column:
    """Hash of every window of ``width`` words, in order."""
    at = F.sequence(F.lit(0), F.greatest(F.size(found) - width, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(width)]))
    return F.when(F.size(found) < width, F.array().cast("array<bigint>")).otherwise(hashes)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def count_of(text: Column, pattern: str) -> Column:
    """Characters matching a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


#: feature -> (features it is made from, expression). ``text`` is given.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[Env], Column]]] = {
    "words": (("text",), lambda e: words(e["text"])),
    "n_words": (("words",), lambda e: F.size(e["words"]).cast("long")),
    "word_chars": (("words",), lambda e: F.length(F.array_join(e["words"], "")).cast("long")),
    "n_symbols": (("text",), lambda e: count_of(e["text"], SYMBOLS)),
    "lines": (("text",), lambda e: lines_with_words(e["text"])),
    "n_lines": (("lines",), lambda e: F.size(e["lines"]).cast("long")),
    "n_dup_lines": (
        ("lines",),
        lambda e: (F.size(e["lines"]) - F.size(F.array_distinct(e["lines"]))).cast("long"),
    ),
    "windows": (("words",), lambda e: windows_of(e["words"], 3)),
    "n_repeat_words": (("windows",), lambda e: covered_words(e["windows"], 3)),
    "n_upper": (("text",), lambda e: count_of(e["text"], r"\p{Lu}")),
    "n_distinct": (("words",), lambda e: F.size(F.array_distinct(e["words"])).cast("long")),
}

#: What a feature costs per character of the text; relative, a scan of the text being 1.
UNIT_COST = {
    "words": 4.0,
    "n_words": 0.01,
    "word_chars": 1.0,
    "n_symbols": 3.0,
    "lines": 2.0,
    "n_lines": 0.01,
    "n_dup_lines": 0.5,
    "windows": 8.0,
    "n_repeat_words": 4.0,
    "n_upper": 4.0,
    "n_distinct": 2.0,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``rejects`` holds for the features in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Env], Column]


FEW_WORDS = Rule("few_words", ("n_words",), lambda e: e["n_words"] < 50)
REPEATS = Rule(
    "repeats",
    ("n_words", "n_repeat_words"),
    lambda e: 100 * e["n_repeat_words"] > 50 * e["n_words"],
)
RULES = (
    FEW_WORDS,
    REPEATS,
    Rule("symbols", ("n_words", "n_symbols"), lambda e: 10 * e["n_symbols"] > e["n_words"]),
    # A short text may open and close with the same line, so only a majority counts.
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda e: 2 * e["n_dup_lines"] > e["n_lines"]),
    Rule("upper_case", ("word_chars", "n_upper"), lambda e: 10 * e["n_upper"] > 3 * e["word_chars"]),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda e: (e["word_chars"] < 2 * e["n_words"]) | (e["word_chars"] > 12 * e["n_words"]),
    ),
    Rule("few_kinds", ("n_words", "n_distinct"), lambda e: 10 * e["n_distinct"] < e["n_words"]),
)
#: Rows looked at to order the rules.
SAMPLE_ROWS = 2000


def required(needs: Sequence[str], known: Sequence[str] = ("text",)) -> list[str]:
    """Features to compute for ``needs``, in order, without those already known."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in known or name in out:
            return
        for part in FEATURES[name][0]:
            add(part)
        out.append(name)

    for name in needs:
        add(name)
    return out


def with_features(docs: DataFrame, needs: Sequence[str], text: str = "text") -> DataFrame:
    """One column ``_f_<feature>`` for each feature, next to those of ``docs``."""
    out = docs.withColumn("_f_text", text_or_empty(F.col(text)))
    for name in required(needs):
        env = {part: F.col(f"_f_{part}") for part in FEATURES[name][0]}
        out = out.withColumn(f"_f_{name}", FEATURES[name][1](env))
    return out


def verdict(rules: Sequence[Rule], env: Env) -> Column:
    """Name of the first rule that rejects, else null; features not in ``env`` are made on the way."""
    if not rules:
        return F.lit(None).cast("string")
    missing = required(rules[0].needs, tuple(env))
    if missing:
        name = missing[0]
        return let(FEATURES[name][1](env), lambda v: verdict(rules, {**env, name: v}))
    rejects = F.coalesce(rules[0].rejects(env), F.lit(False))
    return F.when(rejects, F.lit(rules[0].name)).otherwise(verdict(rules[1:], env))


def order_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> list[Rule]:
    """The rules by falling rejection per cost, each judged on what the earlier ones leave.

    One aggregate over the sample: rows are grouped by which rules reject them, so at most
    ``2 ** len(rules)`` small rows (and never more than the sample has) come back.
    """
    rows = docs.count()
    sample = docs.select(text)
    if rows > sample_rows:
        sample = sample.sample(fraction=sample_rows / rows, seed=seed)
    needs = [n for r in rules for n in r.needs]
    measured = with_features(sample, needs, text)
    env = {n: F.col(f"_f_{n}") for n in required(needs)} | {"text": F.col("_f_text")}
    bits = [F.coalesce(r.rejects(env), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    seen = (
        measured.select(*bits, F.length("_f_text").alias("chars"))
        .groupBy(*[f"r{i}" for i in range(len(rules))])
        .agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        .collect()
    )
    left, known, out = list(range(len(rules))), {"text"}, []
    while left:
        alive = [s for s in seen if not any(s[f"r{i}"] for i in out)]
        chars = sum(s["chars"] for s in alive)

        def gain(i: int) -> tuple[float, int]:
            work = sum(UNIT_COST[f] for f in required(rules[i].needs, tuple(known))) + 0.01
            rejected = sum(s["n"] for s in alive if s[f"r{i}"])
            return (rejected / (work * chars) if chars else 0.0, -i)

        best = max(left, key=gain)
        left.remove(best)
        out.append(best)
        known.update(required(rules[best].needs, tuple(known)))
    return [rules[i] for i in out]


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``rejected_by``, the rule that rejects the row, or null."""
    env = {"text": text_or_empty(F.col(text))}
    return docs.withColumn("rejected_by", verdict(order_rules(docs, rules, text), env))


def keep_clean(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their columns."""
    env = {"text": text_or_empty(F.col(text))}
    return docs.where(verdict(order_rules(docs, rules, text), env).isNull())


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_table(
    docs: DataFrame, text: str = "text", key: str = "doc_id", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Per row: the base counts, whether they fail, and the verdict of the cascade.

    The base counts are needed for every row, so the cascade starts with them known.
    """
    ordered = order_rules(docs, rules, text)
    table = with_features(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), BASE)
    env = {n: F.col(f"_f_{n}") for n in required(BASE)} | {"text": F.col("_f_text")}
    failed = FEW_WORDS.rejects(env) | REPEATS.rejects(env)
    return (
        table.withColumn("base_failed", failed)
        .withColumn("rejected_by", verdict(ordered, env))
        .select(
            "doc_id",
            *[F.col(f"_f_{n}").alias(n) for n in BASE],
            "base_failed",
            (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
        )
    )
