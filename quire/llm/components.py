"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is a few shuffles keyed by node; edges shrink towards stars around the
smallest node of each component. Only a count and a hash of the edges reach the
driver, which ends the loop when a round changes nothing. Each round is cut with
``checkpoint()`` into the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import scratch

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Join the larger neighbours of a node to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label (smallest node of its component) for every node of ``edges`` (u, v); self-edges and null ends are ignored.

    ``rows`` is about the number of edges, where known.
    """
    scratch.shared_dir(edges.sparkSession)
    edges = scratch.fewer(edges.select("u", "v").where("u <> v").distinct(), rows).checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        now = _state(edges)
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = now
        edges = scratch.fewer(_small_star(_large_star(edges)), now[0]).checkpoint()
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
