"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.plans.staging import discard, stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``edges``; comp is the smallest node it is linked with.

    Alternates two steps until nothing changes: every node's larger neighbours are hung below its
    smallest neighbour, then the same for its smaller ones. The number of rounds grows with the
    logarithm of the longest path. Each round is stored and the one before deleted; nothing is collected. A node with many
    neighbours is reduced by partial aggregates and joined back, never gathered in one row.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = stage(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        # Large step: neighbours above u go to the smallest node around u.
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        before, links = links, stage(large.where("u <> v").distinct())
        discard(before)
        # Small step: u and its neighbours below go to the smallest of them.
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, stage(low.select("u", F.col("m").alias("v")).union(moved).distinct())
        discard(before)
        mark = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if last == mark:
            break
        last = mark
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
