"""Dense numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idforge.operators.lineage import cut


def dense_index(df: DataFrame, order: list, name: str = "i", start: int = 0) -> DataFrame:
    """Numbers rows from ``start`` in the given order.

    Rows are range-partitioned by the order and numbered within each
    partition; the partitions' sizes (one row each) give the offsets. A window
    without a partition would put the whole table into one task.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    at, offsets = start, []
    for p, k in sizes:
        offsets.append((p, at))
        at += k
    table = spark.createDataFrame(offsets, "_p int, _o bigint")
    w = Window.partitionBy("_p").orderBy(*order)
    numbered = placed.join(F.broadcast(table), "_p").withColumn(name, F.row_number().over(w) - 1 + F.col("_o"))
    return numbered.drop("_p", "_o")


def with_unique_suffix(df: DataFrame, docid: str, order: list, modulo: int | None = None) -> DataFrame:
    """Every member of a group of equal ids gets ``-n`` (from 1; modulo ``modulo`` if given, where ids may collide again).

    A member's place is its number in the whole order less that of its group's
    first, so that an id that a third of all rows have isn't one task's window.
    Null ids stay null.
    """
    placed = cut(dense_index(df.where(F.col(docid).isNotNull()), [docid, *order], "_i"), "placed")
    groups = placed.groupBy(docid).agg(F.min("_i").alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    n = F.col("_i") - F.col("_f") + 1
    k = n % modulo if modulo else n
    named = placed.join(groups, docid, "left").withColumn(docid, F.when(F.col("_n") > 1, F.concat_ws("-", docid, k)).otherwise(F.col(docid)))
    return named.select(df.columns).union(df.where(F.col(docid).isNull()))
