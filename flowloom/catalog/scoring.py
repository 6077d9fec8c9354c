"""Queries on anomaly scores and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import encoding as encoding_queries
from flowloom.catalog import graphs as graph_queries
from flowloom.catalog import sequences as sequence_queries
from flowloom.catalog.base import (
    DAY_SECONDS, EVENT_GROUPS, EVENT_SPLIT, FLOWS, GRAPH_SPLIT, GRAPHS, TOKEN_GROUPS, TOKEN_SPLIT,
    TOKENS, TRAJECTORIES, query, tidy, tidy_sql, with_ctes,
)
from flowloom.catalog.evaluation import (
    COUNTS, RATES, SUPPORT, confusion_sql, grid_sql, rates_sql, tidy_metrics,
)
from flowloom.operators import encoding, graphs, metrics, scoring
from flowloom.plans.lookups import attach_row
from flowloom.plans.staging import stage
from flowloom.sources.adapters import read_flows, read_table

FEATURES = ["value", "k"]
CANDIDATES = 3
FRACTION = 0.9
DECAY = 1e-4
TOKEN_PARTS = [FLOWS, TOKENS, TOKEN_GROUPS, TOKEN_SPLIT]

STEPS = f"""
steps AS (
  SELECT seq_id, day, split, seq_y, unnest(tokens) AS token,
    unnest(list_prepend('[CLS]', tokens[1:-2])) AS prev FROM split_seqs
),
pair_counts AS (
  SELECT prev, token, count(*) AS n_pair FROM steps WHERE split = 'train' AND seq_y = 0
  GROUP BY ALL
),
pairs AS (
  SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n_pair DESC, token) <= {CANDIDATES}
    AS is_candidate FROM pair_counts
),
prevs AS (SELECT prev, sum(n_pair) AS n_prev FROM pair_counts GROUP BY prev),
words AS (SELECT count(DISTINCT token) AS n_words FROM pair_counts),
token_scores AS (
  SELECT seq_id, day, split, seq_y,
    avg(CASE WHEN coalesce(is_candidate, FALSE) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)
      AS error_ratio,
    avg(-ln((coalesce(n_pair, 0) + 1)
      / (coalesce(n_prev, 0) + n_words + 1)::DOUBLE)) AS mean_loss
  FROM steps LEFT JOIN pairs USING (prev, token) LEFT JOIN prevs USING (prev), words
  GROUP BY seq_id, day, split, seq_y
)"""

KEEP = ["day", "split", "seq_y"]


def token_scores(spark, sf_dir):
    sequences = encoding_queries.staged_tokens(spark, sf_dir)
    benign = encoding_queries.train_benign(sequences)
    return sequences, scoring.next_token_scores(sequences, benign, CANDIDATES, KEEP)


@query("benign_candidates", f"""{with_ctes(*TOKEN_PARTS, STEPS)}
SELECT prev, token, n_pair FROM pairs WHERE is_candidate""")
def benign_candidates(spark, sf_dir):
    benign = encoding_queries.train_benign(sequence_queries.split_token_sequences(spark, sf_dir))
    counts = stage(scoring.transition_counts(benign))
    return scoring.benign_candidates(counts, CANDIDATES)


@query("candidate_miss_ratio", f"""{with_ctes(*TOKEN_PARTS, STEPS)}
SELECT seq_id, day, split, seq_y, {tidy_sql('error_ratio')} AS error_ratio,
  {tidy_sql('mean_loss')} AS mean_loss FROM token_scores""")
def candidate_miss_ratio(spark, sf_dir):
    _, scores = token_scores(spark, sf_dir)
    return scores.select("seq_id", *KEEP, tidy("error_ratio"), tidy("mean_loss"))


@query("benign_centroid", """
SELECT CAST(dim AS INTEGER) AS dim,
  round(CASE WHEN abs(center) < 1e-6 THEN 1e-6 ELSE center END, 6) AS center
FROM (SELECT dim, avg(v) AS center FROM (
    SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
    FROM embeddings WHERE label = 0)
  GROUP BY dim)""")
def benign_centroid(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").where(F.col("label") == 0)
    center = scoring.array_centroid(vectors, "embedding")
    return center.select("dim", F.round("center", 6).alias("center"))


# Distance of a sequence: mean value and k of its flows from the benign training centre.
DISTANCES = """
flow_vectors AS (
  SELECT day || '_' || CAST(ts_unix // 86400 AS VARCHAR) || '_' || source_ip AS seq_id,
    avg(value) AS mv, avg(k) AS mk
  FROM flows GROUP BY ALL
),
vectors AS (SELECT s.*, v.mv, v.mk FROM split_seqs s JOIN flow_vectors v USING (seq_id)),
center AS (SELECT avg(mv) AS cv, avg(mk) AS ck FROM vectors
  WHERE split = 'train' AND seq_y = 0),
distances AS (SELECT seq_id, sqrt((mv - cv) * (mv - cv) + (mk - ck) * (mk - ck)) AS distance
  FROM vectors, center)"""


def distances(spark, sf_dir, sequences):
    """Distance per sequence, from the mean features of its flows."""
    from flowloom.operators.sequences import keyed_events

    events = keyed_events(read_flows(spark, sf_dir), ["source_ip"], DAY_SECONDS)
    means = events.groupBy("seq_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in FEATURES])
    vectors = stage(sequences.select("seq_id", "split", "seq_y").join(means, "seq_id"))
    columns = [f"{c}_mean" for c in FEATURES]
    benign = encoding_queries.train_benign(vectors)
    return scoring.centroid_distance(vectors, benign, columns).select("seq_id", "distance")


@query("centroid_distance", f"""{with_ctes(*TOKEN_PARTS, DISTANCES)}
SELECT seq_id, {tidy_sql('distance')} AS distance FROM distances""")
def centroid_distance(spark, sf_dir):
    sequences = encoding_queries.staged_tokens(spark, sf_dir)
    return distances(spark, sf_dir, sequences).select("seq_id", tidy("distance"))


STATS = f"""
joined AS (SELECT * FROM token_scores JOIN distances USING (seq_id)),
moments AS (SELECT avg(distance) AS distance_mean, stddev_pop(distance) AS distance_std
  FROM joined WHERE split = 'train' AND seq_y = 0),
scored AS (SELECT j.*, greatest((distance - distance_mean) / distance_std, 0) AS distance_z,
    error_ratio + greatest((distance - distance_mean) / distance_std, 0) AS composite_score
  FROM joined j, moments),
stats AS (SELECT quantile_cont(error_ratio, {FRACTION}) AS error_ratio_threshold,
    quantile_cont(distance, {FRACTION}) AS distance_threshold,
    quantile_cont(composite_score, {FRACTION}) AS composite_score_threshold
  FROM scored WHERE split = 'train' AND seq_y = 0),
flagged AS (SELECT s.*, CASE WHEN error_ratio > error_ratio_threshold
    OR distance > distance_threshold THEN 1 ELSE 0 END AS prediction FROM scored s, stats)"""
SCORED_SQL = with_ctes(*TOKEN_PARTS, STEPS, DISTANCES, STATS)


def scored(spark, sf_dir):
    """Staged scores of all sequences, and the thresholds from benign training ones."""
    sequences, ratios = token_scores(spark, sf_dir)
    both = stage(ratios.join(distances(spark, sf_dir, sequences), "seq_id"))
    stats = stage(
        scoring.benign_score_stats(encoding_queries.train_benign(both), FRACTION)
    )
    return both, stats


@query("score_stats", f"""{SCORED_SQL}
SELECT {tidy_sql('error_ratio_threshold')} AS error_ratio_threshold,
  {tidy_sql('distance_threshold')} AS distance_threshold,
  {tidy_sql('composite_score_threshold')} AS composite_score_threshold,
  {tidy_sql('distance_mean')} AS distance_mean, {tidy_sql('distance_std')} AS distance_std
FROM stats, moments""")
def score_stats(spark, sf_dir):
    _, stats = scored(spark, sf_dir)
    return stats.select(*[tidy(c) for c in stats.columns])


@query("composite_score", f"""{SCORED_SQL}
SELECT seq_id, {tidy_sql('distance_z')} AS distance_z,
  {tidy_sql('composite_score')} AS composite_score FROM scored""")
def composite_score(spark, sf_dir):
    both, stats = scored(spark, sf_dir)
    out = scoring.with_composite(both, stats)
    return out.select("seq_id", tidy("distance_z"), tidy("composite_score"))


@query("anomaly_flags", f"""{SCORED_SQL}
SELECT seq_id, day, split, seq_y, prediction, {tidy_sql('composite_score')} AS composite_score
FROM flagged""")
def anomaly_flags(spark, sf_dir):
    both, stats = scored(spark, sf_dir)
    flags = scoring.flag_anomalies(both, stats)
    return flags.select("seq_id", *KEEP, "prediction", tidy("composite_score"))


@query("or_rule", f"""{SCORED_SQL},
labelled AS (SELECT split, prediction, seq_y AS y FROM flagged),
c AS ({confusion_sql('labelled', 'prediction = 1', 'split')})
{rates_sql('c', 'split')}""")
def or_rule(spark, sf_dir):
    both, stats = scored(spark, sf_dir)
    flags = scoring.flag_anomalies(both, stats)
    hit = F.col("prediction") == 1
    return tidy_metrics(metrics.prediction_metrics(flags, hit, "seq_y", ["split"]), ["split"])


@query("tuned_or_rule", f"""{SCORED_SQL},
validation AS (SELECT error_ratio, distance > distance_threshold AS far, seq_y AS y
  FROM scored, stats WHERE split = 'val'),
c AS ({confusion_sql(f'validation, {grid_sql(metrics.SEQUENCE_GRID)}',
                     '(error_ratio > threshold OR far)', 'threshold')}),
m AS ({rates_sql('c', 'threshold')})
SELECT * FROM m ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1""")
def tuned_or_rule(spark, sf_dir):
    from flowloom.plans.lookups import attach_row

    both, stats = scored(spark, sf_dir)
    limit = stats.select("distance_threshold")
    validation = attach_row(both.where(F.col("split") == "val"), limit)
    sweep = metrics.threshold_sweep(
        validation,
        "error_ratio",
        "seq_y",
        grid=metrics.SEQUENCE_GRID,
        strict=True,
        always=F.col("distance") > F.col("distance_threshold"),
    )
    return tidy_metrics(metrics.best_threshold(sweep), ["threshold"])


@query("flags_by_day", f"""{SCORED_SQL},
labelled AS (SELECT day, prediction, seq_y AS y FROM flagged),
c AS ({confusion_sql('labelled', 'prediction = 1', 'day')}) {rates_sql('c', 'day')}""")
def flags_by_day(spark, sf_dir):
    both, stats = scored(spark, sf_dir)
    flags = scoring.flag_anomalies(both, stats)
    by_day = metrics.metrics_by(
        flags, ["day"], "composite_score", "seq_y", F.col("prediction") == 1
    )
    return by_day.select("day", *COUNTS, *[tidy(c) for c in RATES], *SUPPORT)


def _summary_sql(name):
    return f"""SELECT '{name}' AS name, count(*) AS n_sequences,
  CAST(sum(seq_y) AS BIGINT) AS n_attack, CAST(sum(1 - seq_y) AS BIGINT) AS n_benign,
  {tidy_sql(f'avg({name})')} AS mean, {tidy_sql(f'stddev_pop({name})')} AS std,
  {tidy_sql(f'quantile_cont({name}, 0.5)')} AS p50,
  {tidy_sql(f'quantile_cont({name}, 0.9)')} AS p90,
  {tidy_sql(f'quantile_cont({name}, 0.95)')} AS p95,
  {tidy_sql(f'quantile_cont({name}, 0.99)')} AS p99,
  {tidy_sql(f'avg({name}) FILTER (WHERE seq_y = 0)')} AS benign_mean,
  {tidy_sql(f'avg({name}) FILTER (WHERE seq_y = 1)')} AS attack_mean,
  {tidy_sql(f'quantile_cont({name}, 0.95) FILTER (WHERE seq_y = 0)')} AS benign_p95,
  {tidy_sql(f'quantile_cont({name}, 0.95) FILTER (WHERE seq_y = 1)')} AS attack_p95
FROM scored"""


@query("score_summary", f"""{SCORED_SQL}
{' UNION ALL '.join(_summary_sql(c) for c in scoring.SCORE_COLUMNS)}""")
def score_summary(spark, sf_dir):
    both, stats = scored(spark, sf_dir)
    summary = scoring.score_summary(scoring.with_composite(both, stats))
    counts = ["n_sequences", "n_attack", "n_benign"]
    values = [c for c in summary.columns if c not in ("name", *counts)]
    return summary.select("name", *counts, *[tidy(c) for c in values])


@query("decayed_state", f"""{with_ctes(FLOWS, TRAJECTORIES, EVENT_GROUPS, EVENT_SPLIT)}
SELECT a.seq_id, CAST(a.pos AS INTEGER) AS pos,
  {tidy_sql(f'sum(b.value * exp(-{DECAY}::DOUBLE * (a.t - b.t)))', 4)} AS value_state,
  {tidy_sql(f'sum(b.k * exp(-{DECAY}::DOUBLE * (a.t - b.t)))', 4)} AS k_state
FROM traj_rows a JOIN traj_rows b ON a.seq_id = b.seq_id AND b.pos <= a.pos
GROUP BY a.seq_id, a.pos""")
def decayed_state(spark, sf_dir):
    events = encoding.event_rows(sequence_queries.trajectories_(spark, sf_dir))
    states = scoring.decayed_state(events, FEATURES, DECAY)
    return states.select("seq_id", "pos", tidy("value_state", 4), tidy("k_state", 4))


FAST_DECAY = 0.01


@query("decayed_state_fast", f"""{with_ctes(FLOWS, TRAJECTORIES, EVENT_GROUPS, EVENT_SPLIT)}
SELECT a.seq_id, CAST(a.pos AS INTEGER) AS pos,
  {tidy_sql(f'sum(b.value * exp(-{FAST_DECAY}::DOUBLE * (a.t - b.t)))', 4)} AS value_state,
  {tidy_sql(f'sum(b.k * exp(-{FAST_DECAY}::DOUBLE * (a.t - b.t)))', 4)} AS k_state
FROM traj_rows a JOIN traj_rows b ON a.seq_id = b.seq_id AND b.pos <= a.pos
GROUP BY a.seq_id, a.pos""")
def decayed_state_fast(spark, sf_dir):
    """A rate that fades to nothing many times within a sequence."""
    events = encoding.event_rows(sequence_queries.trajectories_(spark, sf_dir))
    states = scoring.decayed_state(events, FEATURES, FAST_DECAY)
    return states.select("seq_id", "pos", tidy("value_state", 4), tidy("k_state", 4))


def split_nodes(spark, sf_dir):
    numbered, _ = graph_queries.stored_nodes(spark, sf_dir)
    return graphs.node_table(numbered, graph_queries.graphs_split(spark, sf_dir), FEATURES)


NODE_KEYS = ["graph_id", "node_id", "split", "y"]
NODE_PARTS = [FLOWS, GRAPHS, GRAPH_SPLIT]
EVENT_PARTS = [FLOWS, TRAJECTORIES, EVENT_GROUPS, EVENT_SPLIT]


def determined(scores, keys, target):
    """What is certain about fitted probabilities, whatever the optimiser: rows, labels, the
    weight of attacks, that all lie in [0, 1], and that weighted residuals of the training rows
    add up to nothing, which holds at the optimum only."""
    table = stage(scores)
    train = table.where(F.col("split") == "train")
    y, p = F.col(target), F.col("probability")
    weight = metrics.positive_weight(train, target, one_class=1.0).select("pos_weight")
    w = F.when(y == 1, F.col("pos_weight")).otherwise(1.0)
    rest = attach_row(train, weight).agg(
        (F.round(F.sum(w * (y - p)) / F.sum(w), 3) + 0.0).alias("residual")
    )
    return attach_row(attach_row(table, weight), rest).select(
        *keys, F.round("pos_weight", 6).alias("pos_weight"), "residual",
        p.between(0, 1).alias("is_probability"),
    )


def determined_sql(parts, table, keys, target):
    return f"""{with_ctes(*parts, table)},
classes AS (SELECT sum({target}) AS n_pos, sum(1 - {target}) AS n_neg FROM scored_rows
  WHERE split = 'train')
SELECT {', '.join(keys)},
  round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN n_neg / n_pos::DOUBLE ELSE 1.0::DOUBLE END, 6)
    AS pos_weight,
  0.0::DOUBLE AS residual, TRUE AS is_probability
FROM scored_rows, classes"""


SCORED_NODES = """
scored_rows AS (SELECT n.graph_id, n.node_id, g.split, n.y
  FROM nodes n JOIN graph_split g USING (graph_id))"""
SCORED_SEQS = """
scored_rows AS (SELECT seq_id, day, split, seq_y FROM split_trajs)"""


@query("score_node_lr", determined_sql(NODE_PARTS, SCORED_NODES, NODE_KEYS, "y"))
def score_node_lr(spark, sf_dir):
    rows = split_nodes(spark, sf_dir)
    scores = scoring.classify(rows, FEATURES, "y", F.col("split") == "train")
    return determined(scores, NODE_KEYS, "y")


def graph_context_scores(spark, sf_dir):
    numbered, sizes = graph_queries.stored_nodes(spark, sf_dir)
    columns = [*FEATURES, *[f"{hop}_{c}" for hop in ("nb1", "nb2") for c in FEATURES]]
    means = graphs.context_means(numbered, FEATURES, sizes, k=graph_queries.EDGE_K)
    context = graphs.node_table(means, graph_queries.graphs_split(spark, sf_dir), columns)
    return scoring.classify(context, columns, "y", F.col("split") == "train")


@query("score_graph_lr", determined_sql(NODE_PARTS, SCORED_NODES, NODE_KEYS, "y"))
def score_graph_lr(spark, sf_dir):
    return determined(graph_context_scores(spark, sf_dir), NODE_KEYS, "y")


def sound_report(report, keys=()):
    """Supports of a report, and whether its counts and rates fit together."""
    counts = (F.col("tp") + F.col("fn") == F.col("support_pos")) & (
        F.col("tn") + F.col("fp") == F.col("support_neg")
    )
    shares = ["accuracy", "specificity", "fpr", "fnr", "f1", "precision", "recall", "threshold"]
    for c in shares:
        counts = counts & F.col(c).between(0, 1)
    for c in ("roc_auc", "pr_auc", "balanced_accuracy"):
        counts = counts & F.coalesce(F.col(c), F.lit(0.5)).between(0, 1 + 1e-9)
    sound = counts & F.col("mcc").between(-1 - 1e-9, 1 + 1e-9) & (F.col("loss") >= 0)
    return report.select(*keys, "mode", *SUPPORT, sound.alias("is_sound"))


def report_sql(parts, rows, keys=""):
    return f"""{with_ctes(*parts, rows)}
SELECT {keys} mode, CAST(sum(y) AS BIGINT) AS support_pos,
  CAST(sum(1 - y) AS BIGINT) AS support_neg, TRUE AS is_sound
FROM scored_rows, (SELECT unnest(['threshold_0_5', 'threshold_tuned']) AS mode)
WHERE split = 'test' GROUP BY {keys} mode"""


@query("report_graph_lr", report_sql(NODE_PARTS, SCORED_NODES))
def report_graph_lr(spark, sf_dir):
    scores = graph_context_scores(spark, sf_dir)
    return sound_report(metrics.holdout_report(scores, "probability", "y"))


@query("score_seq_lr", determined_sql(
    EVENT_PARTS, SCORED_SEQS, ["seq_id", "day", "split", "seq_y"], "seq_y"))
def score_seq_lr(spark, sf_dir):
    sequences = encoding_queries.staged_trajectories(spark, sf_dir)
    rows = scoring.sequence_state_features(sequences, FEATURES, DECAY)
    columns = [c for c in rows.columns if "_state_" in c]
    scores = scoring.classify(rows, columns, "seq_y", F.col("split") == "train")
    return determined(scores, ["seq_id", "day", "split", "seq_y"], "seq_y")


SCORED_EVENTS = "scored_rows AS (SELECT day, split, y FROM traj_rows)"


@query("report_event_lr", report_sql(EVENT_PARTS, SCORED_EVENTS, "day,"))
def report_event_lr(spark, sf_dir):
    sequences = encoding_queries.staged_trajectories(spark, sf_dir)
    events = encoding.event_rows(sequences, ["day", "split"])
    states = scoring.decayed_state(events, FEATURES, DECAY)
    columns = [f"{c}_state" for c in FEATURES]
    rows = states.select("seq_id", "pos", "day", "split", "y", *columns)
    scores = scoring.classify(rows, columns, "y", F.col("split") == "train")
    return sound_report(metrics.holdout_report(scores, "probability", "y", ["day"]), ["day"])
