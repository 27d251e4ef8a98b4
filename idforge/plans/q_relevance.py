"""Joins, negatives and triples over the query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.functions.docids import bracketed, unbracketed
from idforge.operators import relevance as r


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def qrels(s, d, least: int = 1):
    t = table(s, d, "nq_qrels")
    return t.where(F.col("rel") >= least).where("docid is not null").select("qid", unbracketed(F.col("docid")).alias("docid"), "rel", "judged_at")


def run(s, d):
    return table(s, d, "bm25_run").select("qid", unbracketed(F.col("docid")).alias("docid"), "rank")


def pages(s, d):
    """One row for each page: its id, and the smallest URL and title it is known by."""
    p = table(s, d, "process_nq_dataset").select(unbracketed(F.col("id")).alias("docid"), "document_url", "title").where("docid is not null and docid <> ''")
    return p.groupBy("docid").agg(F.min("document_url").alias("url"), F.min("title").alias("title"))


def queries(s, d):
    return table(s, d, "nq_queries").select(F.trim("qid").alias("qid"), F.trim(F.regexp_replace("query", "[\\t\\n]", " ")).alias("query"))


BUCKETS = ((1, 3), (4, 8), (9, 13))


def groups(s, d):
    n = r.sampled_negatives(run(s, d), qrels(s, d), 3).groupBy("qid").agg(F.sort_array(F.collect_list("docid")).alias("negatives"))
    return r.hard_negative_groups(r.one_positive(qrels(s, d)).withColumnRenamed("docid", "positive").join(n, "qid"), 6).select("qid", F.array_join("docs", ",").alias("docs"))


def pairs_skipped(s, d):
    """Judged pairs with a query and a page, and how many lack one."""
    j = qrels(s, d).select("qid", "docid").distinct()
    q = queries(s, d).where("query is not null").select("qid").distinct().withColumn("q", F.lit(1))
    p = pages(s, d).select("docid", F.lit(1).alias("p"))
    return j.join(q, "qid", "left").join(p, "docid", "left").agg(F.count_if(F.col("q").isNotNull() & F.col("p").isNotNull()).alias("kept"), F.count_if(F.col("q").isNull() | F.col("p").isNull()).alias("skipped"))


def first_qrel(s, d):
    q = qrels(s, d)
    return r.first_by(q, ["docid"], "judged_at", "qid").select("docid", "qid")


QUERIES = {
    "docid_normalised": lambda s, d: table(s, d, "nq_qrels").select(bracketed(F.col("docid")).alias("docid")).where("docid is not null").distinct(),
    "click_counts": lambda s, d: r.click_counts(pages(s, d), qrels(s, d)),
    "top_clicked_docs": lambda s, d: r.top_clicked(pages(s, d), qrels(s, d), 100),
    "graded_positive_qrels": lambda s, d: qrels(s, d).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("docid")), ",").alias("docids")),
    "last_judgement": lambda s, d: r.last_judgement(qrels(s, d, 0)),
    "unjudged_hits": lambda s, d: r.unjudged(run(s, d), qrels(s, d)).select("qid", "docid", "rank"),
    "rank_buckets": lambda s, d: run(s, d).groupBy(r.rank_bucket(F.col("rank"), BUCKETS).alias("bucket")).agg(F.count("*").alias("hits")),
    "hard_negatives_sampled": lambda s, d: r.sampled_negatives(run(s, d), qrels(s, d), 3),
    "stratified_negatives": lambda s, d: r.stratified_negatives(run(s, d), qrels(s, d), 7, BUCKETS),
    "stratified_topped_up": lambda s, d: r.stratified_negatives(run(s, d), qrels(s, d), 12, BUCKETS, top_up=True),
    "one_positive": lambda s, d: r.one_positive(qrels(s, d)),
    "rank_filter_triples": lambda s, d: r.rank_filter_triples(run(s, d), qrels(s, d), 2),
    "triples_enriched": lambda s, d: r.triples(run(s, d), qrels(s, d), queries(s, d), pages(s, d), 3),
    "sampling_status": lambda s, d: r.sampling_status(run(s, d), qrels(s, d), queries(s, d), 8),
    "hard_negative_groups": groups,
    "judged_pairs_joined": pairs_skipped,
    "first_qrel_per_document": first_qrel,
    "shuffled_alignment": lambda s, d: r.shuffled_alignment(pages(s, d), "docid"),
    "run_page_mismatches": lambda s, d: r.mismatches(run(s, d), pages(s, d), "docid"),
    "docs_with_query": lambda s, d: pages(s, d).join(qrels(s, d), "docid", "left_semi").join(run(s, d), "docid", "left_semi").select("docid"),
    "pages_left_run": lambda s, d: pages(s, d).join(run(s, d).groupBy("docid").agg(F.count("*").alias("hits")), "docid", "left").select("docid", "hits"),
}

_ID = r"lower(regexp_replace(trim({0}), '^[\[\] ]+|[\[\] ]+$', '', 'g'))"
BASE = rf"""WITH qr AS (SELECT qid, {_ID.format('docid')} AS docid, rel, judged_at FROM nq_qrels WHERE rel >= 1 AND docid IS NOT NULL),
qr0 AS (SELECT qid, {_ID.format('docid')} AS docid, rel, judged_at FROM nq_qrels WHERE rel >= 0 AND docid IS NOT NULL),
run AS (SELECT qid, {_ID.format('docid')} AS docid, rank FROM bm25_run),
pages AS (SELECT docid, min(document_url) AS url, min(title) AS title FROM (SELECT {_ID.format('id')} AS docid, document_url, title FROM process_nq_dataset) WHERE docid IS NOT NULL AND docid <> '' GROUP BY 1),
qs AS (SELECT trim(qid) AS qid, trim(regexp_replace(query, '[\t\n]', ' ', 'g')) AS query FROM nq_queries),
un AS (SELECT * FROM run WHERE NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = run.qid AND qr.docid = run.docid)),
ud AS (SELECT DISTINCT qid, docid FROM un),
neg AS (SELECT qid, docid, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || docid), docid) AS r, count(*) OVER (PARTITION BY qid) AS k FROM ud) WHERE k >= 3 AND r <= 3),
pos AS (SELECT qid, docid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || docid), docid) AS r FROM (SELECT DISTINCT qid, docid FROM qr)) WHERE r = 1)
"""
_STRAT = BASE + """, c AS (SELECT qid, docid, CASE WHEN min(rank) BETWEEN 1 AND 3 THEN 0 WHEN min(rank) BETWEEN 4 AND 8 THEN 1 WHEN min(rank) BETWEEN 9 AND 13 THEN 2 END AS bucket FROM un GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY qid, bucket ORDER BY md5('42|' || qid || '|' || docid), docid) AS r FROM c WHERE bucket IS NOT NULL),
o AS (SELECT qid, docid, bucket, r, false AS repeat FROM p WHERE r <= CASE WHEN bucket = 2 THEN {1} ELSE {0} END)
"""
SQL = {
    "docid_normalised": f"SELECT DISTINCT '[' || {_ID.format('docid')} || ']' AS docid FROM nq_qrels WHERE docid IS NOT NULL",
    "click_counts": BASE + "SELECT docid, count(qr.qid) AS clicks FROM pages LEFT JOIN qr USING (docid) GROUP BY 1",
    "top_clicked_docs": BASE + "SELECT docid, count(*) AS clicks FROM qr WHERE docid IN (SELECT docid FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "graded_positive_qrels": BASE + "SELECT qid, array_to_string(list_sort(list(DISTINCT docid)), ',') AS docids FROM qr GROUP BY 1",
    "last_judgement": BASE + "SELECT qid, docid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY judged_at DESC NULLS LAST, docid DESC) AS r FROM qr0) WHERE r = 1",
    "unjudged_hits": BASE + "SELECT qid, docid, rank FROM un",
    "rank_buckets": BASE + "SELECT CASE WHEN rank BETWEEN 1 AND 3 THEN 0 WHEN rank BETWEEN 4 AND 8 THEN 1 WHEN rank BETWEEN 9 AND 13 THEN 2 END AS bucket, count(*) AS hits FROM run GROUP BY 1",
    "hard_negatives_sampled": BASE + "SELECT * FROM neg",
    "stratified_negatives": _STRAT.format(2, 3) + "SELECT * FROM o",
    "stratified_topped_up": _STRAT.format(4, 4) + """, s AS (SELECT qid, count(*) AS k FROM o GROUP BY 1 HAVING count(*) < 12), z AS (SELECT qid, count(*) AS size FROM p WHERE bucket = 0 GROUP BY 1),
e AS (SELECT qid, slot, ('0x' || substring(md5('42|' || qid || '|' || slot), 1, 8))::BIGINT % size + 1 AS pos FROM (SELECT qid, size, unnest(range(k + 1, 13)) AS slot FROM s JOIN z USING (qid)))
SELECT * FROM o UNION ALL SELECT e.qid, p.docid, 0, e.slot, true FROM e JOIN p ON p.qid = e.qid AND p.bucket = 0 AND p.r = e.pos""",
    "one_positive": BASE + "SELECT * FROM pos",
    "rank_filter_triples": BASE + "SELECT pos.qid, pos.docid AS positive, min(un.docid) AS negative FROM pos JOIN un ON un.qid = pos.qid WHERE rank = 2 GROUP BY ALL",
    "triples_enriched": BASE + "SELECT pos.qid, q.query, p.url AS pos_url, pos.docid AS pos_docid, n.url AS neg_url, neg.docid AS neg_docid FROM pos JOIN neg ON neg.qid = pos.qid JOIN (SELECT qid, min(query) AS query FROM qs WHERE query IS NOT NULL GROUP BY 1) q ON q.qid = pos.qid JOIN pages p ON p.docid = pos.docid JOIN pages n ON n.docid = neg.docid",
    "sampling_status": BASE + "SELECT CASE WHEN qid NOT IN (SELECT qid FROM qs WHERE query IS NOT NULL AND qid IS NOT NULL) THEN 'no_query' WHEN coalesce(k, 0) < 8 THEN 'not_enough' ELSE 'kept' END AS status, count(*) AS queries FROM (SELECT DISTINCT qid FROM run) LEFT JOIN (SELECT qid, count(*) AS k FROM ud GROUP BY 1) USING (qid) GROUP BY 1",
    "hard_negative_groups": BASE + "SELECT pos.qid, array_to_string((list_value(pos.docid) || n || n || n)[1:6], ',') AS docs FROM pos JOIN (SELECT qid, list_sort(list(docid)) AS n FROM neg GROUP BY 1) x ON x.qid = pos.qid",
    "judged_pairs_joined": BASE + "SELECT count(*) FILTER (q AND p) AS kept, count(*) FILTER (NOT (q AND p)) AS skipped FROM (SELECT qid IN (SELECT qid FROM qs WHERE query IS NOT NULL) AS q, docid IN (SELECT docid FROM pages) AS p FROM (SELECT DISTINCT qid, docid FROM qr))",
    "first_qrel_per_document": BASE + "SELECT docid, qid FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY judged_at NULLS FIRST, qid) AS r FROM qr) WHERE r = 1",
    "shuffled_alignment": BASE + ", h AS (SELECT docid, md5('42|' || docid) AS h FROM pages), n AS (SELECT docid, coalesce(lead(docid) OVER (ORDER BY h, docid), first_value(docid) OVER (ORDER BY h, docid)) AS negative FROM h) SELECT * FROM n WHERE docid <> negative",
    "run_page_mismatches": BASE + "SELECT coalesce(a.docid, b.docid) AS docid, CASE WHEN a.docid IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT docid FROM run) a FULL JOIN pages b ON a.docid = b.docid WHERE a.docid IS NULL OR b.docid IS NULL",
    "docs_with_query": BASE + "SELECT docid FROM pages WHERE docid IN (SELECT docid FROM qr) AND docid IN (SELECT docid FROM run)",
    "pages_left_run": BASE + "SELECT docid, hits FROM pages LEFT JOIN (SELECT docid, count(*) AS hits FROM run GROUP BY 1) USING (docid)",
}
