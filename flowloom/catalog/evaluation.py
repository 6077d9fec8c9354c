"""Queries on score tables and saved runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, SCORES, query, tidy, tidy_sql, with_ctes
from flowloom.operators import metrics
from flowloom.plans.lookups import attach_row
from flowloom.plans.staging import stage
from flowloom.sources import runs
from flowloom.sources.adapters import read_flows, score_table

SCORE_SQL = with_ctes(FLOWS, SCORES)
RATES = [
    "accuracy", "balanced_accuracy", "specificity", "fpr", "fnr", "mcc", "f1", "precision",
    "recall",
]
COUNTS = ["tp", "fp", "tn", "fn"]
SUPPORT = ["support_pos", "support_neg"]


def rates_sql(table: str, keys: str) -> str:
    """Metrics from the confusion counts in ``table``."""
    select = {
        "accuracy": "(tp + tn) / n",
        "balanced_accuracy": """CASE WHEN p = 0 THEN tn / q WHEN q = 0 THEN tp / p
          ELSE (tp / p + tn / q) / 2 END""",
        "specificity": "tn / (q + 1e-12::DOUBLE)",
        "fpr": "fp / (q + 1e-12::DOUBLE)",
        "fnr": "fn / (p + 1e-12::DOUBLE)",
        "mcc": """CASE WHEN (tp + fp) * p * q * (tn + fn) = 0 THEN 0 ELSE
          (tp * tn - fp * fn) / sqrt((tp + fp) * p * q * (tn + fn)) END""",
        "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END",
        "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END",
        "recall": "CASE WHEN p = 0 THEN 0 ELSE tp / p END",
    }
    rates = ", ".join(f"{tidy_sql(e)} AS {n}" for n, e in select.items())
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
      CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {rates},
      CAST(p AS BIGINT) AS support_pos, CAST(q AS BIGINT) AS support_neg
    FROM (SELECT *, tp + fn AS p, tn + fp AS q, tp + fp + tn + fn AS n FROM {table})"""


def confusion_sql(source: str, hit: str, keys: str = "") -> str:
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}
      count(*) FILTER (WHERE {hit} AND y = 1)::DOUBLE AS tp,
      count(*) FILTER (WHERE {hit} AND y = 0)::DOUBLE AS fp,
      count(*) FILTER (WHERE NOT ({hit}) AND y = 0)::DOUBLE AS tn,
      count(*) FILTER (WHERE NOT ({hit}) AND y = 1)::DOUBLE AS fn
    FROM {source} {tail}"""


def ranking_sql(source: str, keys: str = "") -> str:
    """AUC and average precision from running counts over falling scores."""
    head = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}
      CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
        sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE END AS roc_auc,
      CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
        sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE END AS pr_auc
    FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
      FROM (SELECT {head}score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
        FROM {source} GROUP BY ALL)
      WINDOW w AS ({part} ORDER BY score DESC)) {tail}"""


def scores(spark, sf_dir):
    return score_table(read_flows(spark, sf_dir))


def tidy_metrics(df, keys=()):
    return df.select(*keys, *COUNTS, *[tidy(c) for c in RATES], *SUPPORT)


@query("roc_auc", f"""{SCORE_SQL}
SELECT {tidy_sql('roc_auc')} AS roc_auc FROM ({ranking_sql('scores')})""")
def roc_auc(spark, sf_dir):
    return metrics.ranking_metrics(scores(spark, sf_dir), "score", "y").select(tidy("roc_auc"))


@query("pr_auc", f"""{SCORE_SQL}
SELECT {tidy_sql('pr_auc')} AS pr_auc FROM ({ranking_sql('scores')})""")
def pr_auc(spark, sf_dir):
    return metrics.ranking_metrics(scores(spark, sf_dir), "score", "y").select(tidy("pr_auc"))


@query("confusion_at", f"""{SCORE_SQL},
c AS ({confusion_sql('scores', 'score >= 0.5')}) {rates_sql('c', '')}""")
def confusion_at(spark, sf_dir):
    return tidy_metrics(metrics.metrics_at(scores(spark, sf_dir), "score", "y", 0.5))


def grid_sql(grid):
    return "(VALUES " + ", ".join(f"({g}::DOUBLE)" for g in grid) + ") AS g(threshold)"


def sweep_sql(source, grid, hit="score >= threshold"):
    """Brute force: every score against every threshold."""
    return confusion_sql(f"{source}, {grid_sql(grid)}", hit, "threshold")


@query("threshold_sweep", f"""{SCORE_SQL},
c AS ({sweep_sql('scores', metrics.GRID)}) {rates_sql('c', 'threshold')}""")
def threshold_sweep(spark, sf_dir):
    sweep = metrics.threshold_sweep(scores(spark, sf_dir), "score", "y")
    return tidy_metrics(sweep, ["threshold"])


BEST = "ORDER BY round(f1, 12) DESC, round(recall, 12) DESC, round(precision, 12) DESC, threshold"


@query("best_threshold", f"""{SCORE_SQL},
c AS ({sweep_sql('scores', metrics.GRID)}), m AS ({rates_sql('c', 'threshold')})
SELECT * FROM m {BEST} LIMIT 1""")
def best_threshold(spark, sf_dir):
    sweep = metrics.threshold_sweep(scores(spark, sf_dir), "score", "y")
    return tidy_metrics(metrics.best_threshold(sweep), ["threshold"])


@query("metrics_by_day", f"""{SCORE_SQL},
c AS ({confusion_sql('scores', 'score >= 0.5', 'day')}), m AS ({rates_sql('c', 'day')}),
r AS ({ranking_sql('scores', 'day')})
SELECT m.*, {tidy_sql('r.roc_auc')} AS roc_auc, {tidy_sql('r.pr_auc')} AS pr_auc
FROM m JOIN r USING (day)""")
def metrics_by_day(spark, sf_dir):
    table = scores(spark, sf_dir)
    by_day = metrics.metrics_by(table, ["day"], "score", "y", F.col("score") >= 0.5)
    return by_day.select(
        "day", *COUNTS, *[tidy(c) for c in RATES], *SUPPORT, tidy("roc_auc"), tidy("pr_auc")
    )


LOSS_SQL = """
weight AS (SELECT sum(1 - y) / greatest(sum(y), 1)::DOUBLE AS w FROM scores),
loss AS (SELECT avg(-(w * y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM (
  SELECT y, w, least(greatest(score, 1e-12), 1 - 1e-12) AS p FROM scores, weight))"""


def weighted_loss(table):
    weight = metrics.positive_weight(table, "y").select("pos_weight")
    return metrics.log_loss(attach_row(table, weight), "score", "y", F.col("pos_weight"))


@query("log_loss", f"""{with_ctes(FLOWS, SCORES, LOSS_SQL)}
SELECT {tidy_sql('loss')} AS loss FROM loss""")
def log_loss(spark, sf_dir):
    return weighted_loss(scores(spark, sf_dir)).select(tidy("loss"))


@query("metric_bundle", f"""{with_ctes(FLOWS, SCORES, LOSS_SQL)},
c AS ({sweep_sql('scores', metrics.GRID)}), swept AS ({rates_sql('c', 'threshold')}),
best AS (SELECT threshold FROM swept {BEST} LIMIT 1),
modes AS (SELECT 'threshold_0_5' AS mode, 0.5::DOUBLE AS threshold
  UNION ALL SELECT 'threshold_tuned', threshold FROM best),
d AS ({confusion_sql('scores, modes', 'score >= threshold', 'mode, threshold')}),
m AS ({rates_sql('d', 'mode, threshold')}), r AS ({ranking_sql('scores')})
SELECT m.*, {tidy_sql('r.roc_auc')} AS roc_auc, {tidy_sql('r.pr_auc')} AS pr_auc,
  {tidy_sql('loss.loss')} AS loss FROM m, r, loss""")
def metric_bundle(spark, sf_dir):
    table = stage(scores(spark, sf_dir))
    tuned = metrics.best_threshold(metrics.threshold_sweep(table, "score", "y"))
    bundle = metrics.metric_bundle(table, "score", "y", tuned, weighted_loss(table))
    return bundle.select(
        "mode", "threshold", *COUNTS, *[tidy(c) for c in RATES], *SUPPORT,
        tidy("roc_auc"), tidy("pr_auc"), tidy("loss"),
    )


@query("metric_bundle_by_day", f"""{SCORE_SQL},
c AS ({sweep_sql('scores', metrics.GRID)}), swept AS ({rates_sql('c', 'threshold')}),
best AS (SELECT threshold FROM swept {BEST} LIMIT 1),
modes AS (SELECT 'threshold_0_5' AS mode, 0.5::DOUBLE AS threshold
  UNION ALL SELECT 'threshold_tuned', threshold FROM best),
d AS ({confusion_sql('scores, modes', 'score >= threshold', 'day, mode, threshold')}),
m AS ({rates_sql('d', 'day, mode, threshold')}), r AS ({ranking_sql('scores', 'day')})
SELECT m.*, {tidy_sql('r.roc_auc')} AS roc_auc, {tidy_sql('r.pr_auc')} AS pr_auc
FROM m JOIN r USING (day)""")
def metric_bundle_by_day(spark, sf_dir):
    table = stage(scores(spark, sf_dir))
    tuned = metrics.best_threshold(metrics.threshold_sweep(table, "score", "y"))
    bundle = metrics.metric_bundle(table, "score", "y", tuned, keys=["day"])
    return bundle.select(
        "day", "mode", "threshold", *COUNTS, *[tidy(c) for c in RATES], *SUPPORT,
        tidy("roc_auc"), tidy("pr_auc"),
    )


# Saved runs: one per user and hour of day, with metrics taken from the events.
RUNS_SQL = """
run_base AS (
  SELECT user_id, hour(ts) AS hour, event_type, count(*) AS n, avg(value) AS mean_value,
    min(value) AS low, max(value) AS high
  FROM events GROUP BY ALL
),
run_rows AS (
  SELECT 'gnn' AS model_name, '20240101_' || lpad(CAST(hour AS VARCHAR), 2, '0') || '_u'
      || user_id || '_' || event_type AS run_name,
    CAST(user_id % 5 AS VARCHAR) AS seed, 'data/' || event_type AS data_root,
    event_type || '_k' || (user_id % 3) AS variant_id, event_type AS edge_family,
    CAST(user_id % 3 AS VARCHAR) AS chain_k, mode AS evaluation_mode,
    1 / (1 + low) AS roc_auc, 1 / (1 + mean_value) AS pr_auc, f1, f1 / 2 AS "precision",
    f1 / 4 AS recall, threshold AS selected_threshold, CAST(n AS INTEGER) AS best_epoch
  FROM (SELECT *, 'threshold_0_5' AS mode, 0.5::DOUBLE AS threshold, 1 / (1 + high) AS f1
      FROM run_base
    UNION ALL SELECT *, 'threshold_tuned', 0.25::DOUBLE, 1 / (2 + high) FROM run_base)
  WHERE n > 1
)"""


def run_document_columns(seed, family, variant, chain):
    """The three documents of a run from the columns low, high, mean_value and n."""

    def block(limit, f1):
        return F.struct(
            F.lit(limit).alias("threshold"),
            f1.alias("f1"),
            (f1 / 2).alias("precision"),
            (f1 / 4).alias("recall"),
        )

    build = F.struct(
        variant.alias("variant_id"), family.alias("edge_family"), chain.alias("chain_k")
    )
    config = F.struct(
        seed.alias("seed"),
        F.concat(F.lit("data/"), family).alias("data_root"),
        build.alias("graph_build_config"),
    )
    free = F.struct(
        (1 / (1 + F.col("low"))).alias("roc_auc"), (1 / (1 + F.col("mean_value"))).alias("pr_auc")
    )
    test = F.struct(
        free.alias("threshold_free"),
        block(0.5, 1 / (1 + F.col("high"))).alias("at_threshold_0.5"),
        block(0.25, 1 / (2 + F.col("high"))).alias("at_threshold_tuned"),
    )
    return [
        F.to_json(config).alias("config"),
        F.when(F.col("n") > 1, F.to_json(test)).otherwise(F.to_json(free)).alias("metrics"),
        F.to_json(F.struct(F.col("n").alias("best_epoch"))).alias("summary"),
    ]


def run_documents(spark, sf_dir):
    """Run folders as JSON texts. Runs of a single event keep the older metric layout."""
    from flowloom.sources.adapters import read_table

    base = (
        read_table(spark, sf_dir, "events")
        .groupBy("user_id", F.hour("ts").alias("hour"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean_value"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )
    chain = F.col("user_id") % 3
    variant = F.concat(F.col("event_type"), F.lit("_k"), chain.cast("string"))
    name = F.concat(
        F.lit("20240101_"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit("_u"),
        F.col("user_id").cast("string"), F.lit("_"), F.col("event_type"),
    )
    documents = run_document_columns(F.col("user_id") % 5, F.col("event_type"), variant, chain)
    return base.select(name.alias("run_name"), *documents)


def run_rows(spark, sf_dir):
    return runs.flatten_runs(run_documents(spark, sf_dir), "gnn", runs.GRAPH_RUNS)


TIDY_RUN = ["roc_auc", "pr_auc", "f1", "precision", "recall", "selected_threshold"]
RUN_KEYS = ["model_name", "run_name", "seed", "data_root", "variant_id", "edge_family", "chain_k",
            "evaluation_mode", "best_epoch"]
TIDY_RUN_SQL = ", ".join(f"{tidy_sql(c, 6)} AS {c}" for c in TIDY_RUN)
RUN_SELECT = f"{', '.join(RUN_KEYS)}, {TIDY_RUN_SQL}"


@query("runs_flatten", f"{with_ctes(RUNS_SQL)} SELECT {RUN_SELECT} FROM run_rows")
def runs_flatten(spark, sf_dir):
    return run_rows(spark, sf_dir).select(*RUN_KEYS, *[tidy(c, 6) for c in TIDY_RUN])


LATEST_SQL = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY model_name, variant_id, seed, evaluation_mode ORDER BY run_name DESC) AS rn
  FROM run_rows) WHERE rn = 1)"""


@query("runs_latest", f"{with_ctes(RUNS_SQL, LATEST_SQL)} SELECT {RUN_SELECT} FROM latest")
def runs_latest(spark, sf_dir):
    latest = runs.latest_runs(run_rows(spark, sf_dir), runs.GRAPH_RUNS.latest_keys)
    return latest.select(*RUN_KEYS, *[tidy(c, 6) for c in TIDY_RUN])


def _aggregates(name):
    return f"""{tidy_sql(f'avg({name})', 6)} AS {name}_mean,
      {tidy_sql(f'CASE WHEN count({name}) > 1 THEN stddev_samp({name}) ELSE 0 END', 6)}
        AS {name}_std,
      {tidy_sql(f'min({name})', 6)} AS {name}_min, {tidy_sql(f'max({name})', 6)} AS {name}_max"""


@query("runs_aggregate", f"""{with_ctes(RUNS_SQL, LATEST_SQL)}
SELECT model_name, variant_id, edge_family, chain_k, data_root, evaluation_mode,
  count(*) AS n_runs, {_aggregates('roc_auc')}, {_aggregates('f1')}
FROM latest GROUP BY ALL""")
def runs_aggregate(spark, sf_dir):
    latest = runs.latest_runs(run_rows(spark, sf_dir), runs.GRAPH_RUNS.latest_keys)
    table = runs.aggregate_runs(latest, runs.GRAPH_RUNS.group_keys, ["roc_auc", "f1"])
    values = [f"{m}_{s}" for m in ("roc_auc", "f1") for s in ("mean", "std", "min", "max")]
    return table.select(
        *runs.GRAPH_RUNS.group_keys, "n_runs", *[tidy(c, 6) for c in values]
    )
