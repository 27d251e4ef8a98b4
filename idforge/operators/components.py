"""Connected components by alternating large-star and small-star rounds.

Both rounds are a ``min`` per node (combined before the shuffle) and one
equi-join back to the edges, so a node with a third of all edges costs no task
more than its share: adaptive execution splits the joined partition and no
group is ever collected. Every round is written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.operators.lineage import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: ``node``, ``component`` (its smallest node).

    ``edges`` has two bigint columns ``u`` and ``v``; rows with a null or with
    ``u = v`` are left out, repeated and reversed edges count once. No edge
    gives an empty result. Raises if ``max_rounds`` don't suffice (each round
    at least halves the depth, so 60 rounds cover any graph in practice).
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v"), "cc")
    for _ in range(max_rounds):
        after = cut(_small_star(_large_star(now)), "cc")
        release(now)
        now = after
        # Stars, in which no leaf has two centres or is a centre, stay as they are.
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(now.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf > 0 and centre > 0").isEmpty():
            centres = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
