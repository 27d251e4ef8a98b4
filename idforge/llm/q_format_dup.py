"""Problem 3: duplicates hidden by formatting differences."""

from pyspark.sql import DataFrame, SparkSession

from idforge.llm.format_dup import collapse_formats, format_copies


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/process_nq_dataset.parquet").select("row_no", "title")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose title occurs on two or more."""
    return format_copies(_rows(spark, d), "row_no", "title", least=2).select("title_key", "row_no")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct title with its number of copies."""
    return collapse_formats(_rows(spark, d), "row_no", "title").selectExpr("row_no", "text as title", "title_key", "copies")


_KEYS = r"""
WITH k AS (SELECT row_no, title, array_to_string(list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')), ' ') AS title_key FROM process_nq_dataset),
c AS (SELECT title_key, min(row_no) AS row_no, count(*) AS copies FROM k WHERE title_key <> '' GROUP BY 1)
"""

QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}
SQL = {
    "p3_found": _KEYS + "SELECT title_key, k.row_no FROM k JOIN c USING (title_key) WHERE copies > 1",
    "p3_collapsed": _KEYS + "SELECT c.row_no, k.title, c.title_key, copies FROM c JOIN k ON k.row_no = c.row_no",
}
