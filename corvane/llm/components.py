"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize_at, shared_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects each node's larger neighbours to its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b); component: the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; no edges: empty result. Each
    round is written to the shared folder in place of the one before; rounds end when the edges
    no longer change."""
    last = shared_path(edges.sparkSession, "edges")
    now = materialize_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), last)
    mark = None
    for _ in range(most_rounds):
        path = shared_path(edges.sparkSession, "edges")
        now, last = materialize_at(_small_star(_large_star(now)), path, last), path
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
