"""Problem 4: splitting oversized items at natural boundaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.chunking import cut_long_texts


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of at most 2,000 characters that overlap by 200."""
    rows = spark.read.parquet(f"{d}/process_nq_dataset.parquet").select("row_no", "content", "doc_tac")
    return cut_long_texts(rows, "row_no", ["content", "doc_tac"], 2000, 200)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The boundary each oversized value needs, as the operator found it."""
    return p4_pieces(spark, d).where("piece = 0").select("row_no", "field_name", "cut")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized value: characters that its pieces cover once, where they begin and end, and whether all keep the limit and the overlap."""
    p = p4_pieces(spark, d).groupBy("row_no", "field_name").agg(
        F.sum(F.col("end") - F.col("start")).alias("held"), F.count("*").alias("n"), F.min("start").cast("bigint").alias("first"), F.max("end").cast("bigint").alias("last"),
        F.bool_and((F.length("text") == F.col("end") - F.col("start")) & F.length("text").between(1, 2000)).alias("kept"), F.array_sort(F.collect_list(F.struct("piece", "start", "end"))).alias("all"),
    )
    follows = F.forall(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: (k == F.col("n")) | (F.element_at("all", k)["end"] - 200 == F.element_at("all", F.least(k + 1, F.col("n").cast("int")))["start"]))
    return p.select("row_no", "field_name", (F.col("held") - 200 * (F.col("n") - 1)).alias("covered"), "first", "last", (F.col("kept") & follows).alias("kept"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checks": p4_checks}
SQL = {
    "p4_checks": """SELECT row_no, field_name, length(t) AS covered, 0 AS first, length(t) AS last, true AS kept
FROM (SELECT row_no, 'content' AS field_name, content AS t FROM process_nq_dataset UNION ALL SELECT row_no, 'doc_tac', doc_tac FROM process_nq_dataset) WHERE length(t) > 2000""",
    "p4_found": r"""
WITH v AS (
  SELECT row_no, 'content' AS field_name, content AS t FROM process_nq_dataset WHERE length(content) > 2000
  UNION ALL SELECT row_no, 'doc_tac', doc_tac FROM process_nq_dataset WHERE length(doc_tac) > 2000)
SELECT row_no, field_name, CASE
  WHEN list_max(list_transform(string_split(regexp_replace(t, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x))) <= 2000 THEN 'sentence'
  WHEN list_max(list_transform(string_split(regexp_replace(t, '[ \t\r\n]+', chr(1), 'g'), chr(1)), lambda x: length(x))) <= 2000 THEN 'word'
  ELSE 'char' END AS cut
FROM v"""
}
