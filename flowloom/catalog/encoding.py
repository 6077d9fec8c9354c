"""Queries on vocabularies, encoded sequences and feature statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import sequences as sequence_queries
from flowloom.catalog.base import (
    DAY_SECONDS, EVENT_GROUPS, EVENT_SPLIT, FLOWS, SEED, TOKEN_GROUPS, TOKEN_SPLIT, TOKENS,
    TRAJECTORIES, query, tidy, tidy_sql, with_ctes,
)
from flowloom.operators import encoding
from flowloom.operators.metrics import positive_weight
from flowloom.plans.staging import stage
from flowloom.sources.adapters import read_flows
from flowloom.functions.keys import attack_label

FEATURES = ["value", "k"]
# Length of a query whose crop cuts; other queries use the inferred length.
SHORT_LEN = 3
TOKEN_FLOOR = 3
TRAJECTORY_FLOOR = 8
LENGTH_CAP = 512
MIN_FREQ = 2

TRAIN_BENIGN = "split = 'train' AND seq_y = 0"
VOCAB = f"""
vocab AS (
  SELECT '[PAD]' AS token, 0 AS id, NULL AS freq UNION ALL SELECT '[UNK]', 1, NULL
  UNION ALL SELECT '[MASK]', 2, NULL UNION ALL SELECT '[CLS]', 3, NULL
  UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 3 AS INTEGER), freq
  FROM (SELECT token, count(*) AS freq FROM (
      SELECT unnest(tokens) AS token FROM split_seqs WHERE {TRAIN_BENIGN})
    GROUP BY token HAVING count(*) >= {MIN_FREQ})
)"""
# Padded lengths: within the bounds, by the 95th percentile of the training sequences.
TOKEN_LENGTH = f"""
token_length AS (
  SELECT CAST(least(greatest(floor(quantile_cont(seq_len, 0.95)) + 1, {TOKEN_FLOOR}),
    {LENGTH_CAP}) AS INTEGER) AS max_len FROM split_seqs WHERE {TRAIN_BENIGN}
)"""
TRAJECTORY_LENGTH = f"""
traj_length AS (
  SELECT CAST(least(greatest(floor(quantile_cont(seq_len, 0.95)), {TRAJECTORY_FLOOR}),
    {LENGTH_CAP}) AS INTEGER) AS max_len FROM split_trajs WHERE split = 'train'
)"""


def encoded_sql(length: str) -> str:
    return f"""
items AS (
  SELECT seq_id, split, max_len, unnest(tail) AS token, generate_subscripts(tail, 1) AS pos
  FROM (SELECT *, list_slice(tokens, 1 - max_len, -1) AS tail FROM split_seqs, {length})
),
encoded AS (
  SELECT seq_id, split,
    [3] || list(coalesce(v.id, 1) ORDER BY pos) || list_resize([]::INTEGER[],
      CAST(max_len - 1 - count(*) AS BIGINT), 0) AS input_ids,
    list_resize(list_resize([]::INTEGER[], CAST(count(*) + 1 AS BIGINT), 1), max_len, 0)
      AS attention_mask
  FROM items LEFT JOIN vocab v USING (token) GROUP BY seq_id, split, max_len
)"""


ENCODED = TOKEN_LENGTH + "," + encoded_sql("token_length")
SHORT_ENCODED = encoded_sql(f"(SELECT {SHORT_LEN} AS max_len)")
TOKEN_PARTS = [FLOWS, TOKENS, TOKEN_GROUPS, TOKEN_SPLIT]
EVENT_PARTS = [FLOWS, TRAJECTORIES, EVENT_GROUPS, EVENT_SPLIT]


def staged_tokens(spark, sf_dir):
    return stage(sequence_queries.split_token_sequences(spark, sf_dir))


def train_benign(sequences):
    return sequences.where((F.col("split") == "train") & (F.col("seq_y") == 0))


def staged_trajectories(spark, sf_dir):
    return stage(sequence_queries.split_trajectories(spark, sf_dir))


def train(sequences):
    return sequences.where(F.col("split") == "train")


def token_length(sequences):
    return encoding.inferred_length(train_benign(sequences), floor=TOKEN_FLOOR, cap=LENGTH_CAP)


def trajectory_length(sequences):
    lengths = encoding.inferred_length(
        train(sequences), reserve=0, floor=TRAJECTORY_FLOOR, cap=LENGTH_CAP
    )
    return lengths.first()["max_len"]


def encoded(spark, sf_dir, max_len=None):
    sequences = staged_tokens(spark, sf_dir)
    vocab = stage(encoding.vocabulary(train_benign(sequences), MIN_FREQ))
    if max_len is None:
        max_len = token_length(sequences).first()["max_len"]
    return vocab, encoding.encode_tokens(sequences, vocab, max_len, keep=["split"])


def joined(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("top_tokens", f"""{with_ctes(FLOWS, TOKENS)}
SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM token_seqs)
GROUP BY token ORDER BY freq DESC, token LIMIT 20""")
def top_tokens(spark, sf_dir):
    return encoding.top_tokens(sequence_queries.token_sequences_(spark, sf_dir), 20)


@query("vocab", f"{with_ctes(*TOKEN_PARTS, VOCAB)} SELECT token, id, freq FROM vocab")
def vocab(spark, sf_dir):
    return encoding.vocabulary(train_benign(staged_tokens(spark, sf_dir)), MIN_FREQ)


@query("infer_max_len", f"""{with_ctes(*TOKEN_PARTS, TOKEN_LENGTH)}
SELECT max_len FROM token_length""")
def infer_max_len(spark, sf_dir):
    return token_length(staged_tokens(spark, sf_dir))


@query("encode_tokens", f"""{with_ctes(*TOKEN_PARTS, VOCAB, ENCODED)}
SELECT seq_id, split, array_to_string(input_ids, ',') AS input_ids,
  array_to_string(attention_mask, ',') AS attention_mask FROM encoded""")
def encode_tokens(spark, sf_dir):
    _, rows = encoded(spark, sf_dir)
    return rows.select("seq_id", "split", joined("input_ids"), joined("attention_mask"))


@query("encode_tokens_cropped", f"""{with_ctes(*TOKEN_PARTS, VOCAB, SHORT_ENCODED)}
SELECT seq_id, split, array_to_string(input_ids, ',') AS input_ids,
  array_to_string(attention_mask, ',') AS attention_mask FROM encoded""")
def encode_tokens_cropped(spark, sf_dir):
    """As ``encode_tokens``, with a length that most sequences exceed."""
    _, rows = encoded(spark, sf_dir, SHORT_LEN)
    return rows.select("seq_id", "split", joined("input_ids"), joined("attention_mask"))


def _draw(start):
    return (
        f"CAST('0x' || substr(md5('{SEED}|' || seq_id || '|' || pos), {start}, 8) AS BIGINT)"
        " / 4294967296.0::DOUBLE"
    )


@query("mask_tokens", f"""{with_ctes(*TOKEN_PARTS, VOCAB, ENCODED)},
positions AS (SELECT seq_id, split, unnest(input_ids) AS id,
    generate_subscripts(input_ids, 1) - 1 AS pos FROM encoded),
draws AS (SELECT *, id NOT IN (0, 3) AS eligible, {_draw(1)} AS pick, {_draw(9)} AS kind,
    {_draw(17)} AS other, (SELECT count(*) - 4 FROM vocab) AS n_words FROM positions),
limits AS (SELECT *, min(pick) FILTER (WHERE eligible) OVER (PARTITION BY seq_id) AS smallest
  FROM draws),
chosen AS (SELECT *, eligible AND (pick < 0.15::DOUBLE
    OR (smallest >= 0.15::DOUBLE AND pick = smallest)) AS hit FROM limits)
SELECT seq_id, split,
  string_agg(CASE WHEN NOT hit THEN id WHEN kind < 0.8::DOUBLE THEN 2
    WHEN kind < 0.9::DOUBLE THEN CAST(4 + floor(other * n_words) AS INTEGER) ELSE id END,
    ',' ORDER BY pos) AS masked_ids,
  string_agg(CASE WHEN hit THEN id ELSE -100 END, ',' ORDER BY pos) AS mask_labels
FROM chosen GROUP BY seq_id, split""")
def mask_tokens(spark, sf_dir):
    words, rows = encoded(spark, sf_dir)
    hidden = encoding.mask_tokens(rows, words.count(), 0.15, SEED)
    return hidden.select("seq_id", "split", joined("masked_ids"), joined("mask_labels"))


@query("unk_rate", f"""{with_ctes(*TOKEN_PARTS, VOCAB, ENCODED)},
counts AS (SELECT split, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens,
  CAST(sum(list_sum(attention_mask)) AS BIGINT) AS n_nonpad_tokens,
  CAST(sum(len(list_filter(input_ids, lambda i: i = 1))) AS BIGINT) AS n_unk_tokens
  FROM encoded GROUP BY split)
SELECT *, {tidy_sql('n_unk_tokens / greatest(n_tokens, 1)::DOUBLE')} AS unk_rate_all,
  {tidy_sql('n_unk_tokens / greatest(n_nonpad_tokens, 1)::DOUBLE')} AS unk_rate_nonpad
FROM counts""")
def unk_rate(spark, sf_dir):
    _, rows = encoded(spark, sf_dir)
    rates = encoding.unknown_rate(rows)
    counts = ["n_tokens", "n_nonpad_tokens", "n_unk_tokens"]
    return rates.select("split", *counts, tidy("unk_rate_all"), tidy("unk_rate_nonpad"))


@query("feature_stats", f"""{with_ctes(FLOWS)}
SELECT {', '.join(f"{tidy_sql(f'avg({c})')} AS {c}_mean, "
                  f"{tidy_sql(f'greatest(stddev_pop({c}), 1e-6)')} AS {c}_std"
                  for c in FEATURES)}
FROM flows WHERE k < 70""")
def feature_stats(spark, sf_dir):
    rows = read_flows(spark, sf_dir).where(F.col("k") < 70)
    stats = encoding.feature_stats(rows, FEATURES)
    return stats.select(*[tidy(c) for c in stats.columns])


@query("standardise", f"""{with_ctes(FLOWS)},
stats AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk
  FROM flows WHERE k < 70)
SELECT event_id, {tidy_sql('greatest(least((value - mv) / sv, 2.0::DOUBLE), -2.0::DOUBLE)')}
    AS value_z,
  {tidy_sql('greatest(least((k - mk) / sk, 2.0::DOUBLE), -2.0::DOUBLE)')} AS k_z
FROM flows, stats""")
def standardise(spark, sf_dir):
    flows = read_flows(spark, sf_dir).select("event_id", *FEATURES)
    stats = encoding.feature_stats(flows.where(F.col("k") < 70), FEATURES)
    scaled = encoding.standardise(flows, FEATURES, stats, clip=2.0)
    return scaled.select("event_id", tidy("value_z"), tidy("k_z"))


@query("pos_weight", f"""{with_ctes(FLOWS)}
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
  {tidy_sql('sum(1 - y) / greatest(sum(y), 1)::DOUBLE')} AS pos_weight FROM flows""")
def pos_weight(spark, sf_dir):
    flows = read_flows(spark, sf_dir).select(attack_label().alias("y"))
    return positive_weight(flows, "y").select("n_pos", "n_neg", tidy("pos_weight"))


GAPS = """
started AS (SELECT *, max(t) OVER (PARTITION BY seq_id ORDER BY pos)
    - first(t) OVER (PARTITION BY seq_id ORDER BY pos) AS t_rel FROM traj_rows),
gaps AS (SELECT *, t_rel - coalesce(lag(t_rel) OVER (PARTITION BY seq_id ORDER BY pos), t_rel)
    AS dt FROM started),
clip AS (SELECT greatest(coalesce(quantile_cont(dt, 0.99), 86400.0), 1.0)::DOUBLE AS dt_clip
  FROM gaps WHERE dt > 0 AND split = 'train')"""


def train_clip(sequences):
    gaps = encoding.event_gaps(encoding.event_rows(train(sequences)))
    return encoding.gap_clip(gaps, DAY_SECONDS)


@query("event_gaps", f"""{with_ctes(*EVENT_PARTS, GAPS)}
SELECT seq_id, CAST(pos AS INTEGER) AS pos, t, t_rel, dt FROM gaps""")
def event_gaps(spark, sf_dir):
    rows = encoding.event_rows(sequence_queries.split_trajectories(spark, sf_dir))
    return encoding.event_gaps(rows).select("seq_id", "pos", "t", "t_rel", "dt")


@query("dt_clip", f"""{with_ctes(*EVENT_PARTS, GAPS)}
SELECT {tidy_sql('dt_clip')} AS dt_clip FROM clip""")
def dt_clip(spark, sf_dir):
    return train_clip(staged_trajectories(spark, sf_dir)).select(tidy("dt_clip"))


TAIL = TRAJECTORY_LENGTH + """,
tails AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos DESC) AS back
  FROM traj_rows),
cropped AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY back DESC) - 1 AS i,
    first(t) OVER (PARTITION BY seq_id ORDER BY back DESC) AS t0,
    coalesce(t - lag(t) OVER (PARTITION BY seq_id ORDER BY back DESC), 0) AS gap
  FROM tails, traj_length WHERE back <= max_len),
timed AS (SELECT c.*, least(gap::DOUBLE, dt_clip) / dt_clip AS dt_norm,
    least((t - t0)::DOUBLE, dt_clip * max_len) / dt_clip AS t_norm
  FROM cropped c, clip)"""


@query("time_encode", f"""{with_ctes(*EVENT_PARTS, GAPS, TAIL)}
SELECT seq_id, CAST(i AS INTEGER) AS pos, {tidy_sql('dt_norm')} AS dt_norm,
  {tidy_sql('t_norm')} AS t_norm FROM timed""")
def time_encode(spark, sf_dir):
    sequences = staged_trajectories(spark, sf_dir)
    timed = encoding.time_encode(
        sequences, train_clip(sequences), trajectory_length(sequences)
    )
    rows = timed.select("seq_id", F.posexplode(F.arrays_zip("dt_norm", "t_norm")))
    return rows.select("seq_id", "pos", "col.*").select(
        "seq_id", "pos", tidy("dt_norm"), tidy("t_norm")
    )


def padded(spark, sf_dir):
    sequences = staged_trajectories(spark, sf_dir)
    stats = encoding.vector_stats(train(sequences), len(FEATURES))
    scaled = encoding.standardise_vectors(sequences, stats)
    max_len = trajectory_length(sequences)
    timed = encoding.time_encode(scaled, train_clip(sequences), max_len)
    return encoding.pad_sequences(timed, max_len, len(FEATURES))


@query("pad_sequences", f"""{with_ctes(*EVENT_PARTS, GAPS, TAIL)},
scale AS (SELECT avg(value) AS mv, greatest(stddev_pop(value), 1e-6) AS sv, avg(k) AS mk,
  greatest(stddev_pop(k), 1e-6) AS sk FROM traj_rows WHERE split = 'train')
SELECT seq_id, CAST(count(*) AS INTEGER) AS n_valid, max(max_len) AS n_positions,
  string_agg(y, ',' ORDER BY i) || repeat(',-100', max(max_len) - CAST(count(*) AS INTEGER))
    AS y_seq,
  {tidy_sql('sum(greatest(least((value - mv) / sv, 5.0::DOUBLE), -5.0::DOUBLE))', 4)}
    AS value_sum,
  {tidy_sql('sum(greatest(least((k - mk) / sk, 5.0::DOUBLE), -5.0::DOUBLE))', 4)} AS k_sum,
  {tidy_sql('sum(dt_norm)', 4)} AS dt_sum, {tidy_sql('sum(t_norm)', 4)} AS t_sum
FROM timed, scale GROUP BY seq_id""")
def pad_sequences(spark, sf_dir):
    rows = padded(spark, sf_dir)

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)

    out = rows.select(
        "seq_id",
        F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n_valid"),
        F.size("x").alias("n_positions"),
        joined("y_seq"),
        total(F.transform("x", lambda v: v[0])).alias("value_sum"),
        total(F.transform("x", lambda v: v[1])).alias("k_sum"),
        total(F.col("dt_norm")).alias("dt_sum"),
        total(F.col("t_norm")).alias("t_sum"),
    )
    sums = ["value_sum", "k_sum", "dt_sum", "t_sum"]
    return out.select(
        "seq_id", "n_valid", "n_positions", "y_seq", *[tidy(c, 4) for c in sums]
    )


@query("gap_stats", f"""{with_ctes(*EVENT_PARTS, GAPS, TAIL)}
SELECT split, count(DISTINCT seq_id) * max(max_len) AS n_positions,
  count(*) AS n_valid_positions, count(*) FILTER (WHERE dt_norm > 0) AS n_positive_gaps,
  {tidy_sql('quantile_cont(dt_norm, 0.95) FILTER (WHERE dt_norm > 0)')} AS dt_p95,
  {tidy_sql('quantile_cont(dt_norm, 0.99) FILTER (WHERE dt_norm > 0)')} AS dt_p99
FROM timed GROUP BY split""")
def gap_stats(spark, sf_dir):
    sequences = staged_trajectories(spark, sf_dir)
    max_len = trajectory_length(sequences)
    timed = encoding.time_encode(sequences, train_clip(sequences), max_len)
    stats = encoding.gap_statistics(timed, ["split"], max_len)
    counts = ["n_positions", "n_valid_positions", "n_positive_gaps"]
    return stats.select("split", *counts, tidy("dt_p95"), tidy("dt_p99"))


@query("seq_pool", f"""{with_ctes(FLOWS, TRAJECTORIES)}
SELECT seq_id, {tidy_sql('list_avg(xv)')} AS value_mean, {tidy_sql('list_max(xv)')} AS value_max,
  {tidy_sql('xv[-1]')} AS value_last, {tidy_sql('list_avg(xk)')} AS k_mean,
  {tidy_sql('list_max(xk)')} AS k_max, {tidy_sql('xk[-1]')} AS k_last FROM traj_seqs""")
def seq_pool(spark, sf_dir):
    pooled = encoding.pool_sequences(sequence_queries.trajectories_(spark, sf_dir), FEATURES)
    names = [f"{c}_{how}" for c in FEATURES for how in ("mean", "max", "last")]
    return pooled.select("seq_id", *[tidy(c) for c in names])


@query("event_targets", f"""{with_ctes(*EVENT_PARTS, GAPS, TAIL)}
SELECT seq_id, day, CAST(i AS INTEGER) AS pos, y FROM timed""")
def event_targets(spark, sf_dir):
    return encoding.event_targets(padded(spark, sf_dir))


@query("dataset_counts_events", f"""{with_ctes(*EVENT_PARTS)}
SELECT split, count(*) AS n_total, count(*) FILTER (WHERE seq_y = 0) AS n_benign,
  count(*) FILTER (WHERE seq_y = 1) AS n_attack, CAST(sum(n_events) AS BIGINT) AS n_events,
  CAST(sum(n_attack_events) AS BIGINT) AS n_attack_events FROM split_trajs GROUP BY split""")
def dataset_counts_events(spark, sf_dir):
    from flowloom.operators.sequences import dataset_counts

    return dataset_counts(sequence_queries.split_trajectories(spark, sf_dir))
