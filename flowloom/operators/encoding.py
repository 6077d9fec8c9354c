"""Encoding of sequences: vocabulary, padding, masking, scaling and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions.keys import unit_interval
from flowloom.functions.tokens import tail
from flowloom.plans.lookups import attach_row, lookup_join
from flowloom.plans.ordered import percentiles, positions
from flowloom.plans.staging import stage

# Special tokens in id order, the label of positions to ignore.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[MASK]", "[CLS]"]
PAD, UNK, MASK, CLS = range(len(SPECIAL_TOKENS))
IGNORE = -100


def token_counts(sequences: DataFrame) -> DataFrame:
    return (
        sequences.select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def top_tokens(sequences: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens; equal counts by token."""
    return token_counts(sequences).orderBy(F.desc("freq"), "token").limit(k)


def vocabulary(train_benign: DataFrame, min_freq: int = 2) -> DataFrame:
    """Token ids after the specials, by falling count and then by token."""
    counted = stage(token_counts(train_benign).where(F.col("freq") >= min_freq))
    numbered = positions(counted, [], [F.desc("freq"), F.col("token")], "_rank")
    tokens = numbered.select(
        "token", (F.col("_rank") + len(SPECIAL_TOKENS)).cast("int").alias("id"), "freq"
    )
    specials = F.array(
        *[
            F.struct(
                F.lit(token).alias("token"),
                F.lit(number).alias("id"),
                F.lit(None).cast("bigint").alias("freq"),
            )
            for number, token in enumerate(SPECIAL_TOKENS)
        ]
    )
    one = train_benign.sparkSession.range(1)
    return one.select(F.explode(specials).alias("s")).select("s.*").unionByName(tokens)


def inferred_length(
    sequences: DataFrame, fraction: float = 0.95, reserve: int = 1, floor: int = 8, cap: int = 512
) -> DataFrame:
    """Padded length from a percentile of sequence lengths, within [floor, cap].

    ``reserve`` leaves room for [CLS] in token sequences; trajectories use 0.
    """
    lengths = percentiles(sequences, [], "seq_len", {"length": fraction})
    wanted = F.col("length").cast("int") + F.lit(reserve)
    return lengths.select(
        F.least(F.greatest(wanted, F.lit(floor)), F.lit(cap)).cast("int").alias("max_len")
    )


def encode_tokens(
    sequences: DataFrame, vocab: DataFrame, max_len: int, keep: Sequence[str] = ()
) -> DataFrame:
    """[CLS] and the ids of the last ``max_len - 1`` tokens, padded, with attention mask.

    ``vocab`` is a stored table.
    """
    if max_len < 2:
        raise ValueError("max_len must leave room for [CLS] and one token")
    columns = ["seq_id", *keep]
    items = sequences.select(*columns, tail("tokens", max_len - 1).alias("_tail")).select(
        *columns, F.posexplode_outer("_tail").alias("pos", "token")
    )
    known = lookup_join(
        items,
        vocab.select("token", "id"),
        ["token"],
        spread=["seq_id", "pos"],
        how="left",
        staged=True,
    )
    ids = known.groupBy(*columns).agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("pos").isNotNull(),
                    F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")),
                )
            )
        ).alias("_ids")
    )
    room = F.lit(max_len - 1) - F.size("_ids")
    return ids.select(
        *columns,
        F.concat(F.array(F.lit(CLS)), F.col("_ids.id"), F.array_repeat(F.lit(PAD), room)).alias(
            "input_ids"
        ),
        F.concat(
            F.array_repeat(F.lit(1), F.size("_ids") + 1), F.array_repeat(F.lit(0), room)
        ).alias("attention_mask"),
    )


def mask_tokens(
    encoded: DataFrame, vocab_size: int, probability: float = 0.15, seed: int = 42
) -> DataFrame:
    """Hide tokens for masked-token scoring, reproducibly.

    Every token is chosen with ``probability``, and at least one per row (the one with
    the smallest draw). Of the chosen, 80 % become [MASK], 10 % a random token, 10 % stay.
    Draws come from a digest of seed, sequence and position. No shuffle: rows are arrays.
    """

    def draws(token: Column, pos: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seq_id"), pos.cast("string")))
        return F.struct(
            token.alias("id"),
            ((token != PAD) & (token != CLS)).alias("eligible"),
            unit_interval(digest, 1).alias("pick"),
            unit_interval(digest, 9).alias("kind"),
            unit_interval(digest, 17).alias("other"),
        )

    first_word = len(SPECIAL_TOKENS)
    words = vocab_size - first_word

    def hide(item: Column) -> Column:
        random_id = (
            (F.lit(first_word) + F.floor(item["other"] * words)).cast("int")
            if words > 0
            else F.lit(MASK)
        )
        return (
            F.when(~chosen(item), item["id"])
            .when(item["kind"] < 0.8, F.lit(MASK))
            .when(item["kind"] < 0.9, random_id)
            .otherwise(item["id"])
        )

    def chosen(item: Column) -> Column:
        return item["eligible"] & (item["pick"] < F.col("_limit"))

    smallest = F.array_min(
        F.transform(F.filter("_items", lambda i: i["eligible"]), lambda i: i["pick"])
    )
    drawn = encoded.withColumn("_items", F.transform("input_ids", draws)).withColumn(
        # Above the smallest draw, so that one token is always chosen.
        "_limit",
        F.when(smallest < probability, F.lit(probability)).otherwise(smallest + F.lit(1e-12)),
    )
    return drawn.select(
        *encoded.columns,
        F.transform("_items", hide).alias("masked_ids"),
        F.transform(
            "_items", lambda i: F.when(chosen(i), i["id"]).otherwise(F.lit(IGNORE))
        ).alias("mask_labels"),
    )


def unknown_rate(encoded: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Positions, tokens and unknown tokens of whole splits."""
    counts = encoded.select(
        *keys,
        F.size("input_ids").alias("n"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("nonpad"),
        F.size(F.filter("input_ids", lambda i: i == UNK)).alias("unk"),
    )
    return (
        counts.groupBy(*keys)
        .agg(
            F.sum("n").alias("n_tokens"),
            F.sum("nonpad").alias("n_nonpad_tokens"),
            F.sum("unk").alias("n_unk_tokens"),
        )
        .withColumn("unk_rate_all", F.col("n_unk_tokens") / F.greatest("n_tokens", F.lit(1)))
        .withColumn(
            "unk_rate_nonpad", F.col("n_unk_tokens") / F.greatest("n_nonpad_tokens", F.lit(1))
        )
    )


def finite_or_zero(value: Column) -> Column:
    """NaN and infinities as 0; null stays null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def feature_stats(df: DataFrame, features: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation of every feature, in one row; non-finite input counts as 0."""
    stats = []
    for c in features:
        value = finite_or_zero(F.col(c).cast("double"))
        stats.append(F.avg(value).alias(f"{c}_mean"))
        stats.append(F.greatest(F.stddev_pop(value), F.lit(floor)).alias(f"{c}_std"))
    return df.agg(*stats)


def standardise(
    df: DataFrame, features: Sequence[str], stats: DataFrame, clip: float | None = None
) -> DataFrame:
    """Scale features with the statistics of the training rows; non-finite input counts as 0."""
    scaled = {}
    for c in features:
        z = (finite_or_zero(F.col(c).cast("double")) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        if clip is not None:
            z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
        scaled[f"{c}_z"] = z
    return attach_row(df, stats).withColumns(scaled).drop(*stats.columns)


def finite_vectors(vectors: Column) -> Column:
    """Arrays of vectors with NaN, infinite and null components as 0."""

    def clean(value: Column) -> Column:
        return F.coalesce(finite_or_zero(value), F.lit(0.0))

    return F.transform(vectors, lambda v: F.transform(v, clean))


def vector_stats(sequences: DataFrame, features: int, floor: float = 1e-6) -> DataFrame:
    """Mean and deviation per dimension of the vectors in ``x``, in one row of arrays.

    Non-finite components count as 0, null ones too.
    """
    vectors = sequences.select(F.explode(finite_vectors(F.col("x"))).alias("v"))
    dims = range(features)
    return vectors.agg(
        F.array(*[F.avg(F.col("v")[d]) for d in dims]).alias("x_mean"),
        F.array(*[F.greatest(F.stddev_pop(F.col("v")[d]), F.lit(floor)) for d in dims]).alias(
            "x_std"
        ),
    )


def standardise_vectors(sequences: DataFrame, stats: DataFrame, clip: float = 5.0) -> DataFrame:
    """Scale every vector of ``x`` and clip it to ``[-clip, clip]``; non-finite input counts as 0."""

    def scale(vector: Column) -> Column:
        return F.transform(
            vector,
            lambda v, d: F.greatest(
                F.least((v - F.get("x_mean", d)) / F.get("x_std", d), F.lit(clip)), F.lit(-clip)
            ),
        )

    return attach_row(sequences, stats).withColumn(
        "x", F.transform(finite_vectors(F.col("x")), scale)
    ).drop(
        *stats.columns
    )


def event_rows(sequences: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event of the capped sequences."""
    return sequences.select(
        "seq_id", *keep, F.posexplode(F.arrays_zip("t", "x", "y_seq")).alias("pos", "_e")
    ).select("seq_id", *keep, "pos", "_e.t", "_e.x", F.col("_e.y_seq").alias("y"))


def event_gaps(events: DataFrame) -> DataFrame:
    """Time since the start, never falling, and gap to the event before.

    The window holds one capped sequence, so its size is bounded by the cap.
    """
    upto = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    by_pos = Window.partitionBy("seq_id").orderBy("pos")
    started = events.withColumn(
        "t_rel", F.max(F.col("t")).over(upto) - F.first(F.col("t")).over(upto)
    )
    return started.withColumn(
        "dt", F.col("t_rel") - F.coalesce(F.lag("t_rel").over(by_pos), F.col("t_rel"))
    )


def gap_clip(gaps: DataFrame, seconds: int, fraction: float = 0.99) -> DataFrame:
    """Largest gap kept: a percentile of the positive gaps, at least 1 s.

    Falls back to the window length when there is no positive gap.
    """
    found = percentiles(gaps.where(F.col("dt") > 0), [], "dt", {"gap": fraction})
    return found.agg(
        F.greatest(
            F.coalesce(F.max("gap"), F.lit(float(seconds))), F.lit(1.0)
        ).alias("dt_clip")
    )


def time_encode(sequences: DataFrame, clip: DataFrame, max_len: int) -> DataFrame:
    """Scaled gaps and scaled time since the start, as arrays beside the events.

    Event times ascend inside a sequence, so no running maximum is needed here.
    """
    cropped = attach_row(sequences, clip).withColumn("t", tail("t", max_len))
    limit = F.col("dt_clip")

    def gap(t: Column, pos: Column) -> Column:
        before = F.get("t", F.greatest(pos - 1, F.lit(0)))
        return F.least(F.greatest(t - before, F.lit(0)).cast("double"), limit) / limit

    def since(t: Column) -> Column:
        passed = F.greatest(t - F.get("t", F.lit(0)), F.lit(0)).cast("double")
        return F.least(passed, limit * max_len) / limit

    return cropped.withColumns(
        {"dt_norm": F.transform("t", gap), "t_norm": F.transform("t", since)}
    ).drop("dt_clip")


def pad_sequences(encoded: DataFrame, max_len: int, features: int) -> DataFrame:
    """Crop to the tail and pad vectors, times and labels to ``max_len``, with a mask."""
    cropped = encoded.withColumns({c: tail(c, max_len) for c in ("x", "y_seq")})
    n = F.size("y_seq")
    room = F.lit(max_len) - n
    zeros = F.array_repeat(F.lit(0.0), features)
    return cropped.withColumns(
        {
            "mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), room)),
            "x": F.concat("x", F.array_repeat(zeros, room)),
            "dt_norm": F.concat("dt_norm", F.array_repeat(F.lit(0.0), room)),
            "t_norm": F.concat("t_norm", F.array_repeat(F.lit(0.0), room)),
            "y_seq": F.concat("y_seq", F.array_repeat(F.lit(IGNORE), room)),
        }
    )


def gap_statistics(
    encoded: DataFrame, keys: Sequence[str] = ("split",), max_len: int | None = None
) -> DataFrame:
    """Valid positions, positive scaled gaps and their upper percentiles per split."""
    gaps = encoded.select(*keys, F.explode("dt_norm").alias("dt"))
    counts = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid_positions"),
        F.count_if(F.col("dt") > 0).alias("n_positive_gaps"),
    )
    if max_len is not None:
        padded = encoded.groupBy(*keys).agg((F.count(F.lit(1)) * max_len).alias("n_positions"))
        counts = padded.join(counts, list(keys))
    upper = percentiles(
        gaps.where(F.col("dt") > 0), keys, "dt", {"dt_p95": 0.95, "dt_p99": 0.99}
    )
    return counts.join(upper, list(keys), "left").fillna(0.0, ["dt_p95", "dt_p99"])


def pool_sequences(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, maximum and last value per feature of every sequence."""

    def component(d: int) -> Column:
        return F.transform("x", lambda v: v[d])

    pooled = {}
    for d, name in enumerate(features):
        values = component(d)
        pooled[f"{name}_mean"] = (
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size("x")
        )
        pooled[f"{name}_max"] = F.array_max(values)
        pooled[f"{name}_last"] = F.element_at(values, -1)
    return sequences.withColumns(pooled)


def event_targets(padded: DataFrame, keep: Sequence[str] = ("seq_id", "day")) -> DataFrame:
    """One row per real event with its label; padding is left out."""
    return (
        padded.select(*keep, F.posexplode("y_seq").alias("pos", "y"))
        .where(F.col("y") != IGNORE)
    )
