"""Intermediate tables in the shared checkpoint folder.

A staged table cuts lineage (a lost executor re-reads files instead of
recomputing the plan), gives its row count for free from the parquet footers,
and freezes values that would otherwise depend on one execution of the plan,
such as the number of the range partition a row landed in.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return context.getCheckpointDir()


def staging_folder(spark: SparkSession) -> str:
    """Folder of this application below the checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/flowloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of an execution when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def stage(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as parquet below the checkpoint folder and read it back.

    What was shuffled for it is deleted at once, as only the table is read from then on.
    ``settings`` of the session hold while it is written.
    """
    spark = df.sparkSession
    path = new_path(spark)
    wanted = {SHUFFLE_CLEANUP: "true"} | (settings or {})
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_at = path
    return stored


def stage_measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """The staged table, and its ``rows`` and other aggregates.

    All figures come from one job over the stored files; rows alone are read from their footers.
    A single aggregate row has nothing to adapt at run time, so it is not cut into several jobs.
    """
    spark = df.sparkSession
    table = stage(df)
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false")
    try:
        found = table.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
        return table, found.first().asDict()
    finally:
        spark.conf.set(ADAPTIVE, before)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stage``, once all that was derived from them is stored."""
    for table in tables:
        remove(table.sparkSession, table._staged_at)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged, once nothing reads it any more."""
    remove(spark, staging_folder(spark))
