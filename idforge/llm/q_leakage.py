"""Problem 6: evaluation texts leaking into training text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.llm.leakage import leaked_items
from idforge.llm.words import words_col


def _leaks(spark: SparkSession, d: str, near: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{d}/eval_passages.parquet").select("item_id", "passage")
    return leaked_items(docs, items, near=near)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold a run of words."""
    return _leaks(spark, d, near=False).where("whole").select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the documents that hold them, exactly or nearly."""
    items = spark.read.parquet(f"{d}/eval_passages.parquet").select("item_id", "split", "source")
    by = _leaks(spark, d).groupBy("item_id").agg(F.count_if("whole").alias("exact_documents"), F.count_if(~F.col("whole")).alias("near_documents"))
    return items.join(by, "item_id")


def p6_planted(spark: SparkSession, d: str) -> DataFrame:
    """Copies of the items of 26 words or more without any run of 13 in common, and whether windows as long as the item find them (runs within a radius don't count here).

    Of every ten words the shortest of the fourth to seventh is another one, so
    that what is replaced are mostly words as common as "of". Each copy stands
    in a document of its own with other text around it.
    """
    items = spark.read.parquet(f"{d}/eval_passages.parquet").select("item_id", "passage")
    w = words_col(F.col("passage"))
    near = F.slice("w", F.expr("cast(i div 10 * 10 + 4 as int)"), F.lit(4))
    sizes = F.transform(near, lambda x: F.length(x))
    at = F.expr("i div 10 * 10 + 3") + F.array_position(sizes, F.array_min(sizes)) - 1
    each = items.select("item_id", w.alias("w")).where(F.size("w") >= 26).select("item_id", "w", F.posexplode("w").alias("i", "x"))
    each = each.select("item_id", "i", F.when(F.col("i") == at, F.concat(F.lit("zzq"), F.col("i").cast("string"))).otherwise(F.col("x")).alias("x"))
    own = each.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]), " ").alias("copy"))
    around = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text").orderBy("doc_id").limit(1).first()
    text = F.concat_ws(" ", F.lit(around["text"] if around else ""), "copy", F.lit("the end"))
    found = leaked_items(own.select(F.col("item_id").alias("doc_id"), text.alias("text")), items, radius=0).where("doc_id = item_id")
    return own.join(found.drop("item_id"), F.col("item_id") == F.col("doc_id"), "left").select("item_id", F.col("similarity").isNotNull().alias("found"), F.coalesce("whole", F.lit(False)).alias("exact"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_planted": p6_planted}
SQL = {
    # Brute force over all windows as long as the item, by weighted single words.
    "p6_planted": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_passages WHERE passage IS NOT NULL),
c AS (SELECT term, count(*) AS c FROM (SELECT item_id, unnest(list_distinct(w)) AS term FROM i) GROUP BY 1), t AS (SELECT sum(c) AS total FROM c),
m AS (SELECT map(list(term), list(ln(1 + total / c))) AS m, any_value(ln(1 + total)) AS unseen FROM c, t),
e AS (SELECT item_id, w, list_distinct(w) AS s, len(w) AS n, list_transform(w, lambda x, k: CASE WHEN k = (k - 1) // 10 * 10 + 3 + list_position(list_transform(w[(k - 1) // 10 * 10 + 4:(k - 1) // 10 * 10 + 7], lambda y: length(y)), list_min(list_transform(w[(k - 1) // 10 * 10 + 4:(k - 1) // 10 * 10 + 7], lambda z: length(z)))) THEN 'zzq' || (k - 1) ELSE x END) AS copy FROM i WHERE len(w) >= 26),
d AS (SELECT item_id, s, n, regexp_extract_all(lower((SELECT arg_min(text, doc_id) FROM documents WHERE text IS NOT NULL)), '[\p{L}\p{N}]+') || copy || ['the', 'end'] AS d FROM e),
x AS (SELECT item_id, s, list_distinct(d[k:k + n - 1]) AS v FROM (SELECT item_id, s, n, d, unnest(range(1, len(d) - n + 2)) AS k FROM d)),
j AS (SELECT item_id, list_sum(list_transform(list_intersect(s, v), lambda q: m[q])) AS held, list_sum(list_transform(s, lambda q: m[q])) + list_sum(list_transform(v, lambda q: coalesce(m[q], unseen))) AS sums FROM x, m)
SELECT item_id, max(coalesce(held, 0) / (sums - coalesce(held, 0))) >= 0.8 AS found, false AS exact FROM j GROUP BY 1""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_passages),
z AS (SELECT DISTINCT item_id, least(13, len(w)) AS z, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS r
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT z FROM z),
x AS (SELECT doc_id, z, array_to_string(w[k:k + z - 1], ' ') AS r FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d, s WHERE len(w) >= z))
SELECT DISTINCT doc_id, item_id FROM x JOIN z USING (z, r)"""
}
