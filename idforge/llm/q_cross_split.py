"""Problem 5: same or near-same records across splits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.cross_split import cross_split_overlaps
from idforge.llm.words import title_key_col


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/process_nq_dataset.parquet").select("row_no", "query", "title", "split", "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Dev and test records whose title or query is in train."""
    rows = _rows(spark, d)
    keys = rows.select("row_no", title_key_col(F.col("title")).alias("title_key")).where("title_key is not null")
    return cross_split_overlaps(rows, keys)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping records by split, source and field."""
    rows = _rows(spark, d).select("row_no", "split", "source")
    return p5_found(spark, d).join(rows, "row_no").groupBy("split", "source", "field_name").agg(F.count("*").alias("records"))


_FOUND = r"""
WITH k AS (
  SELECT row_no, split, source, nullif(array_to_string(list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')), ' '), '') AS t,
         array_to_string(regexp_extract_all(lower(query), '[\p{L}\p{N}]+'), ' ') AS q
  FROM process_nq_dataset WHERE split IS NOT NULL),
u AS (SELECT q, split = 'train' AS tr, list_distinct(list_transform(range(1, length(q) - 1), lambda i: substring(q, i, 3))) AS g FROM (SELECT DISTINCT q, split FROM k WHERE length(q) >= 3)),
m AS (SELECT DISTINCT a.q FROM u a, u b WHERE NOT a.tr AND b.tr AND len(b.g) >= 0.75 * len(a.g) AND 0.75 * len(b.g) <= len(a.g)
      AND len(list_intersect(a.g, b.g)) >= 0.75 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
f AS (SELECT row_no, split, source, 'title' AS field_name FROM k WHERE split <> 'train' AND t IN (SELECT t FROM k WHERE split = 'train' AND t IS NOT NULL)
      UNION ALL SELECT row_no, split, source, 'query' FROM k WHERE split <> 'train' AND q IN (SELECT q FROM m))
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _FOUND + "SELECT row_no, field_name FROM f",
    "p5_report": _FOUND + "SELECT split, source, field_name, count(*) AS records FROM f GROUP BY ALL",
}
