"""Problem 1: near-duplicate records with small edits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.near_dup import near_duplicate_groups
from idforge.llm.words import blank_to_null


def groups(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/process_nq_dataset.parquet").select("row_no", "content", "doc_tac")
    text = F.coalesce(blank_to_null(F.col("content")), F.col("doc_tac"))
    return near_duplicate_groups(rows, "row_no", text, width=3, threshold=0.5, min_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every member of a group but its first record."""
    return groups(spark, d).where("row_no <> first_row_no").select("first_row_no", "row_no")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by size: how many there are, and the records in them."""
    size = groups(spark, d).groupBy("first_row_no").agg(F.count("*").alias("size"))
    return size.groupBy("size").agg(F.count("*").alias("groups"), F.sum("size").alias("records"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

SQL = {
    "p1_found": r"""
WITH RECURSIVE w AS (
  SELECT row_no, regexp_extract_all(lower(CASE WHEN regexp_matches(content, '[^\s]') THEN content ELSE doc_tac END), '[\p{L}\p{N}]+') AS w
  FROM process_nq_dataset),
s AS (SELECT DISTINCT row_no, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT row_no, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row_no <> b.row_no GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE c >= 0.5 * (x.n + y.n - c)),
r(node, seen) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT min(seen) AS first_row_no, node AS row_no FROM r GROUP BY node HAVING min(seen) <> node"""
}
_FOUND = SQL["p1_found"]
SQL["p1_groups"] = _FOUND.replace("\nSELECT min(seen)", ", g AS (\nSELECT min(seen)", 1) + ") SELECT size, count(*) AS groups, sum(size) AS records FROM (SELECT first_row_no, count(*) + 1 AS size FROM g GROUP BY 1) GROUP BY 1"
