"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.llm.words import clean_id_col, title_key_col
from idforge.operators.components import connected_components
from idforge.operators.lineage import cut


def entity_components(df: DataFrame, row: str = "row_no", id_col: str = "id", title_col: str = "title") -> DataFrame:
    """Component of each record over shared ids and shared titles.

    Returns ``row_no``, ``component`` (a record number of the component),
    ``entity_id`` (the component's smallest cleaned id, null where no member
    has one) and ``members``. A record with neither id nor title words is its
    own component. Nulls, blanks, repeated rows and further columns of any
    name are allowed; an empty table gives an empty result.

    Records with the same (id, title) pair are first folded into one node, the
    smallest record number of the pair, so that the many records of a hot page
    reach the graph as one node.
    """
    rows = df.select(F.col(row).alias("row_no"), clean_id_col(F.col(id_col)).alias("i"), title_key_col(F.col(title_col)).alias("t"))
    alone = F.when(F.col("i").isNull() & F.col("t").isNull(), F.col("row_no"))
    rows = rows.withColumn("a", alone)
    pairs = cut(rows.groupBy("i", "t", "a").agg(F.min("row_no").alias("node"), F.count("*").alias("n")), "pairs")

    def star(key: str) -> DataFrame:
        known = pairs.where(F.col(key).isNotNull())
        centre = known.groupBy(key).agg(F.min("node").alias("v"), F.count("*").alias("k")).where("k > 1")
        return known.join(centre, key).select(F.col("node").alias("u"), "v").where("u <> v")

    comps = connected_components(star("i").union(star("t")))
    placed = cut(pairs.join(comps, "node", "left").select("i", "t", "a", "n", F.coalesce("component", "node").alias("component")), "placed")
    facts = placed.groupBy("component").agg(F.min("i").alias("entity_id"), F.sum("n").alias("members"))
    placed = placed.select("i", "t", "a", "component").join(facts, "component")
    # One joined key without nulls, so that the join stays an equi-join that can be split.
    key = F.struct(F.coalesce("i", F.lit("")).alias("i"), F.coalesce("t", F.lit("")).alias("t"), F.coalesce("a", F.lit(-1)).alias("a"))
    return rows.select("row_no", key.alias("k")).join(placed.select(key.alias("k"), "component", "entity_id", "members"), "k").select("row_no", "component", "entity_id", "members")


def related_splits(df: DataFrame, shares: dict[str, float], row: str = "row_no", id_col: str = "id", title_col: str = "title", seed: int = 7, fine: int = 1 << 20, big: float = 0.0005) -> DataFrame:
    """Give every record a split so that whole components land together.

    The component's hash picks a point in [0, 1), and the points of the split
    ranges are laid out in proportion to ``shares``. A component that holds
    more than ``big`` of all rows would upset the proportions, so these (at
    most ``1 / big`` of them, a proven bound) are placed first, largest first,
    each into the split with the most room left, and the ranges for the hashed
    rest are the room that remains. Returns ``row_no``, ``component``,
    ``split``.
    """
    names = list(shares)
    total_share = sum(shares.values())
    comps = cut(entity_components(df, row, id_col, title_col).select("row_no", "component", "members"), "entities")
    spark = df.sparkSession
    n = comps.count()
    large = comps.where(F.col("members") > big * n).select("component", "members").distinct().orderBy(F.desc("members"), "component").collect()
    room = {s: shares[s] / total_share * n for s in names}
    fixed = []
    for c in large:
        best = max(names, key=lambda s: room[s])
        room[best] -= c["members"]
        fixed.append((c["component"], best))
    room = {s: max(room[s], 0.0) for s in names}
    left = sum(room.values()) or 1.0
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(fine)) / F.lit(float(fine))
    upto, ends = 0.0, {}
    for s in names:
        upto += room[s] / left
        ends[s] = upto
    choice = F.lit(names[-1])
    for s in reversed(names[:-1]):
        choice = F.when(point < ends[s], F.lit(s)).otherwise(choice)
    placed = spark.createDataFrame(fixed, "component bigint, chosen string")
    return comps.join(F.broadcast(placed), "component", "left").select("row_no", "component", F.coalesce("chosen", choice).alias("split"))
