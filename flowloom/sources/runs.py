"""Saved experiment runs: one folder per run with three JSON files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CONFIG, METRICS, SUMMARY = "run_config.json", "test_metrics.json", "summary.json"


@dataclass(frozen=True)
class RunLayout:
    """Where the fields of a run are found.

    ``build`` names the build settings inside the run settings. ``modes`` maps an
    evaluation mode to its block of metrics. ``thresholds`` maps output names to the
    names used inside that block.
    """

    build: str
    build_fields: Sequence[str]
    run_fields: Sequence[str]
    modes: Mapping[str, str]
    required_mode: str
    metrics: Sequence[str]
    thresholds: Mapping[str, str]
    latest_by: Sequence[str]

    @property
    def latest_keys(self) -> list[str]:
        """Runs that agree on these are repeats of each other."""
        return ["model_name", "variant_id", *self.latest_by, "evaluation_mode"]

    @property
    def group_keys(self) -> list[str]:
        """Runs that agree on these differ in their seed only."""
        settings = [c for c in self.run_fields if c != "seed"]
        return ["model_name", "variant_id", *self.build_fields, *settings, "evaluation_mode"]

    @property
    def metric_columns(self) -> list[str]:
        return ["roc_auc", "pr_auc", *self.metrics, *self.thresholds]


# Field names of the three kinds of run.
COMMON_METRICS = ["f1", "precision", "recall", "balanced_accuracy", "specificity", "fpr"]
ALL_METRICS = ["accuracy", *COMMON_METRICS, "fnr", "mcc"]
TOKEN_SETTINGS = [
    "seed", "data_root", "max_len", "d_model", "n_heads", "n_layers", "dropout", "lr",
    "weight_decay", "mask_prob_train", "mask_prob_score", "score_passes", "num_candidates",
    "benign_percentile", "vhm_weight",
]
TRAJECTORY_SETTINGS = [
    "seed", "data_root", "prediction_level", "pooling", "solver", "time_conditioning",
    "x_embed_dim", "hidden_dim", "ode_hidden", "ode_layers", "ode_steps", "dropout", "lr",
    "weight_decay", "dt_clip", "max_len",
]
TRAJECTORY_VERSIONS = ["sequence_build_version", "event_counting_policy"]
GRAPH_RUNS = RunLayout(
    build="graph_build_config",
    build_fields=["edge_family", "chain_k"],
    run_fields=["seed", "data_root"],
    modes={"threshold_0_5": "at_threshold_0.5", "threshold_tuned": "at_threshold_tuned"},
    required_mode="at_threshold_tuned",
    metrics=COMMON_METRICS,
    thresholds={"selected_threshold": "threshold"},
    latest_by=["seed"],
)
TOKEN_RUNS = RunLayout(
    build="sequence_build_config",
    build_fields=["entity_mode", "split_strategy", "window_seconds", "min_len", "max_len_build"],
    run_fields=TOKEN_SETTINGS,
    modes={
        "train_benign_percentile": "at_threshold_train_benign_percentile",
        "validation_tuned": "at_threshold_val_tuned",
    },
    required_mode="at_threshold_val_tuned",
    metrics=ALL_METRICS,
    thresholds={
        "selected_sequence_threshold": "sequence_threshold",
        "selected_distance_threshold": "distance_threshold",
    },
    latest_by=TOKEN_SETTINGS,
)
TRAJECTORY_RUNS = RunLayout(
    build="sequence_build_config",
    build_fields=[
        *TRAJECTORY_VERSIONS, "entity_mode", "split_strategy", "window_seconds", "min_len",
        "max_len_build",
    ],
    run_fields=TRAJECTORY_SETTINGS,
    modes={"threshold_0_5": "at_threshold_0.5", "threshold_tuned": "at_threshold_tuned"},
    required_mode="at_threshold_tuned",
    metrics=ALL_METRICS,
    thresholds={"selected_threshold": "threshold"},
    latest_by=[*TRAJECTORY_VERSIONS, *TRAJECTORY_SETTINGS],
)
DEFAULTS = {
    "sequence_build_version": "pre_versioned",
    "event_counting_policy": "pre_versioned",
}


#: Folder and name of a file; a table written by Spark is a folder of part files.
FILE_PATH = r"^(.*)/(?:[^/=]*=)?([^/=]+\.json)(?:/part-[^/]*)?$"


def read_run_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder below ``root`` that has all three files, as JSON text.

    Runs are told apart by their whole folder, so equal names in two places are two runs.
    """
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .where(F.col("_metadata.file_path").rlike(FILE_PATH))
        .select(finite_json(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("path"))
        .select(
            "value",
            F.regexp_extract("path", FILE_PATH, 2).alias("file"),
            F.regexp_extract("path", FILE_PATH, 1).alias("folder"),
        )
    )
    parts = {"config": CONFIG, "metrics": METRICS, "summary": SUMMARY}
    rows = files.groupBy("folder").agg(
        *[F.max(F.when(F.col("file") == f, F.col("value"))).alias(n) for n, f in parts.items()]
    )
    named = rows.withColumn("run_name", F.regexp_extract("folder", "([^/=]+)$", 1))
    return named.dropna(subset=list(parts)).select("run_name", *parts)


def finite_json(document: Column) -> Column:
    """Bare NaN and infinities, which JSON does not allow, as null."""
    return F.regexp_replace(document, r"(?<=[:\[,])(\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])", "$1null")


def _field(document: str, *path: str) -> Column:
    steps = "".join(f"['{step}']" for step in path)
    return F.get_json_object(F.col(document), f"${steps}")


def flatten_runs(runs: DataFrame, model_name: str, layout: RunLayout) -> DataFrame:
    """Two rows per run, one per evaluation mode; runs of an older layout are left out."""
    usable = runs.where(
        _field("metrics", "threshold_free").isNotNull()
        & _field("metrics", layout.required_mode).isNotNull()
    )
    blocks = F.array(
        *[
            F.struct(
                F.lit(mode).alias("evaluation_mode"), _field("metrics", block).alias("block")
            )
            for mode, block in layout.modes.items()
        ]
    )
    folder = F.element_at(F.split(_field("config", "data_root"), "/"), -1)
    build = [
        F.coalesce(_field("config", layout.build, c), F.lit(DEFAULTS.get(c))).alias(c)
        for c in layout.build_fields
    ]
    return usable.withColumn("_m", F.explode(blocks)).select(
        F.lit(model_name).alias("model_name"),
        "run_name",
        *[_field("config", c).alias(c) for c in layout.run_fields],
        F.coalesce(
            _field("config", layout.build, "variant_id"), folder, F.col("run_name")
        ).alias("variant_id"),
        *build,
        "_m.evaluation_mode",
        *[
            _field("metrics", "threshold_free", c).cast("double").alias(c)
            for c in ("roc_auc", "pr_auc")
        ],
        *[
            F.get_json_object("_m.block", f"$.{c}").cast("double").alias(c)
            for c in layout.metrics
        ],
        *[
            F.get_json_object("_m.block", f"$.{inner}").cast("double").alias(c)
            for c, inner in layout.thresholds.items()
        ],
        _field("summary", "best_epoch").cast("int").alias("best_epoch"),
        _field("summary", "best_val_pr_auc").cast("double").alias("best_val_pr_auc"),
    )


def latest_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last run by name of every key; names begin with date and time."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("run_name"))
    return (
        rows.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def aggregate_runs(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Runs per group, and mean, sample deviation, minimum and maximum of every metric.

    Nulls and NaN are left out; one value has deviation 0, none has null.
    """
    stats = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        value = F.nanvl(F.col(m), F.lit(None).cast("double"))
        stats += [
            F.avg(value).alias(f"{m}_mean"),
            F.when(F.count(value) > 1, F.stddev_samp(value))
            .when(F.count(value) == 1, F.lit(0.0))
            .alias(f"{m}_std"),
            F.min(value).alias(f"{m}_min"),
            F.max(value).alias(f"{m}_max"),
        ]
    return rows.groupBy(*keys).agg(*stats)
