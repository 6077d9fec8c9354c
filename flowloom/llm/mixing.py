"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document whose expected number of copies is e is
taken floor(e) times for certain; the fraction left is its inclusion chance p in a fixed-size
sample. Documents of a source are ranked by (odds of a random number) / (odds of p), and the
sample is the start of that order whose words come nearest to what the certain copies leave of
the target.

Nothing sorts a whole source. Ranks are first counted in ``BINS`` bins per source, which shows the
bin the cut falls into; only the rows of that bin are put in order. What remains is one small
table with a row per source (its cut), and each row of the corpus is compared with its cut. That
table is stored, so the planner sees its size: it is broadcast below the session's threshold, and
joined by a shuffle (split by adaptive execution where a source is large) beyond it.

Everything is column expressions; nothing here runs Python on the executors.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its
own, last in order; null document ids draw one common number and are ordered first. Rows equal in
id, size and source share rank and fate, so at a cut all of them or none are taken. An empty table
gives an empty table. Other columns of the input are kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowloom.llm.words import words
from flowloom.plans.staging import stage

BINS = 1024
MAX_COPIES = 2
WEIGHTS = (5, 2, 1)
SHARE = 1.5


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (draw + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES
) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` sizes.

    Sources that stop at their limit are those whose limit per weight lies below the common
    level; in rising order of limit per weight, the level is where that ends.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.get(cycle, place)).withColumn(
        "limit", F.col("source_size") * most
    )
    ratio = F.col("limit") / F.col("weight")
    rising = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    leveled = (
        weighed.withColumn("ratio", ratio)
        .withColumn("stopped", F.coalesce(F.sum("limit").over(rising), F.lit(0)))
        .withColumn("weights_done", F.coalesce(F.sum("weight").over(rising), F.lit(0)))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) * share - F.col("stopped"))
            / (F.sum("weight").over(everything) - F.col("weights_done")),
        )
    )
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))
    return leveled.withColumn("common", found.over(everything)["level"]).select(
        "source",
        "source_size",
        F.least(
            F.col("limit").cast("double"), F.coalesce("common", F.lit(float("inf"))) * F.col("weight")
        ).alias("target"),
    )


def same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["_source"])


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Certain copies and rank of each row, from its draw, relative weight and source figures.

    Needs ``draw``, ``relative``, ``target`` and ``weighted_size`` (words times relative weight).
    """
    expected = F.least(
        F.lit(float(most)),
        F.coalesce(F.try_divide(F.col("target") * F.col("relative"), F.col("weighted_size")), F.lit(0.0)),
    )
    odds = F.col("chance") / (1 - F.col("chance"))
    return (
        rows.withColumn("expected", expected)
        .withColumn("copies", F.floor("expected").cast("long"))
        .withColumn("chance", F.col("expected") - F.col("copies"))
        .withColumn(
            "rank",
            F.coalesce(
                F.try_divide(F.col("draw") / (1 - F.col("draw")), odds), F.lit(float("inf"))
            ),
        )
    )


ROW_ORDER = ("rank", "doc_id", "size")


def cuts(sizes: DataFrame, targets: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Per source: figures of ``targets``, and the last row (``ROW_ORDER``) of its sample."""
    right = targets.withColumnRenamed("source", "_source")
    rows = ranked(sizes.join(right, same_source(sizes, right)).drop("_source"), most)
    # rank / (1 + rank) lies in [0, 1) and rises with the rank.
    share = F.when(F.col("rank") < float("inf"), F.col("rank") / (1 + F.col("rank"))).otherwise(1.0)
    rows = rows.withColumn("bin", F.floor(share * BINS).cast("int"))
    counted = rows.groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("copies")).alias("sure")
    )
    per_source = W.partitionBy("source")
    upto = per_source.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        counted.withColumn("upto", F.sum("words").over(upto))
        .withColumn("sure", F.sum("sure").over(per_source))
        .join(right, counted["source"].eqNullSafe(F.col("_source")))
        .withColumn("rest", F.col("target") - F.col("sure"))
        .where(F.col("upto") >= F.col("rest"))
        .groupBy("_source")
        .agg(
            F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("at")
        )
        .select("_source", "at.*")
    )
    at = placed.withColumnRenamed("bin", "cut_bin")
    inside = rows.join(at, same_source(rows, at) & (F.col("bin") == F.col("cut_bin"))).drop("_source")
    running = per_source.orderBy(*ROW_ORDER).rangeBetween(W.unboundedPreceding, W.currentRow)
    # Rows alike in every respect are one step of the order.
    middle = F.col("before") + F.sum("size").over(running) - F.col("size") / 2
    chosen = (
        inside.withColumn("middle", middle)
        .where(F.col("middle") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct(*ROW_ORDER)).alias("last"))
    )
    lower = placed.select("_source", F.col("bin").alias("cut_bin"))
    last = chosen.withColumnRenamed("source", "_last_source")
    return (
        targets.join(lower, targets["source"].eqNullSafe(lower["_source"]), "left")
        .drop("_source")
        .join(last, F.col("source").eqNullSafe(F.col("_last_source")), "left")
        .drop("_last_source")
    )


def decide(sizes: DataFrame, cut: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """``sizes`` with ``source_size``, ``target`` and ``copies``, certain and sampled together."""
    right = cut.withColumnRenamed("source", "_source")
    rows = ranked(sizes.join(right, same_source(sizes, right)).drop("_source"), most)
    share = F.when(F.col("rank") < float("inf"), F.col("rank") / (1 + F.col("rank"))).otherwise(1.0)
    bin_of = F.floor(share * BINS).cast("int")
    # A source without a cut needs every fraction it has.
    in_sample = (
        F.col("cut_bin").isNull()
        | (bin_of < F.col("cut_bin"))
        | F.coalesce(
            (bin_of == F.col("cut_bin")) & (F.struct(*ROW_ORDER) <= F.col("last")), F.lit(False)
        )
    )
    sampled = F.when(in_sample & (F.col("chance") > 0), 1).otherwise(0)
    return rows.withColumn("copies", (F.col("copies") + sampled).cast("long")).drop(
        "weighted_size", "draw", "relative", "expected", "chance", "rank", "cut_bin", "last"
    )


def sized(docs: DataFrame, seed: int, relative: Column | None = None) -> DataFrame:
    """(doc_id, source, size, draw, relative) of every row."""
    weight = F.lit(1.0) if relative is None else F.coalesce(relative.cast("double"), F.lit(1.0))
    return docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), seed).alias("draw"),
        weight.alias("relative"),
    )


def level_chances(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with ``weighted_size`` lowered until expected words add up to the target.

    Documents whose expected copies reach ``most`` stop there, and what they leave is shared by the
    others of their source, until no further one stops. Each round sums over the different relative
    weights of a source.
    """
    levels = stage(sizes.groupBy("source", "relative").agg(F.sum("size").alias("words")))
    stopped = -1
    while True:
        right = targets.withColumnRenamed("source", "_source")
        over = F.col("target") * F.col("relative") >= most * F.col("weighted_size")
        summed = (
            levels.join(right, same_source(levels, right))
            .groupBy("source", "source_size", "target", "weighted_size")
            .agg(
                F.sum(F.when(over, F.col("words")).otherwise(0)).alias("sure"),
                F.sum(F.when(over, 0.0).otherwise(F.col("words") * F.col("relative"))).alias("rest"),
                F.count_if(over).alias("over"),
            )
        )
        left = F.col("target") - most * F.col("sure")
        lower = F.when((F.col("rest") > 0) & (left > 0), F.col("target") * F.col("rest") / left)
        weighted = F.coalesce(lower, F.col("weighted_size")).alias("weighted_size")
        leveled = stage(summed.select("source", "source_size", "target", weighted, "over"))
        now = leveled.agg(F.sum("over")).first()[0] or 0
        targets = leveled.drop("over")
        if now == stopped:
            return targets
        stopped = now


def plan_mix(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MAX_COPIES,
    uneven: bool = False,
) -> DataFrame:
    """The stored table of cuts for stored ``sizes``; ``uneven``: their relative weights differ."""
    weighted = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("relative")).alias("weighted_size"))
    other = weighted.withColumnRenamed("source", "_source")
    targets = source_targets(sizes, weights, share, most)
    targets = stage(targets.join(other, same_source(targets, other)).drop("_source"))
    if uneven:
        targets = level_chances(sizes, targets, most)
    return stage(cuts(sizes, targets, most))


def mix_table(docs: DataFrame, seed: int = 11, relative: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sizes = stage(sized(docs, seed, relative))
    rows = decide(sizes, plan_mix(sizes, uneven=relative is not None))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with the columns of ``docs``."""
    cut = plan_mix(stage(sized(docs, seed)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select(
        "row",
        F.col("row")["doc_id"].alias("doc_id"),
        F.col("row")["source"].alias("source"),
        n_words(F.col("row")["text"]).alias("size"),
        uniform(F.col("row")["doc_id"], seed).alias("draw"),
        F.lit(1.0).alias("relative"),
    )
    decided = decide(rows, cut).where(F.col("copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return decided.select("row", copies.alias("copy")).select("row.*")
