"""Nearest vectors, preference rows, and smaller projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions import text as x
from idforge.functions.docids import unbracketed
from idforge.functions.hooks import hashed_embedding
from idforge.operators.analysis import shared_token_similarity
from idforge.operators.nearest import near_duplicate_vectors, nearest
from idforge.operators.relevance import first_by
from idforge.plans.codes_sql import codes_cte
from idforge.plans.q_analysis import _COS, _GRP, docs
from idforge.plans.q_quantize import RQ, vectors
from idforge.plans.q_relevance import QUERIES as RELEVANCE
from idforge.plans.q_relevance import SQL as RELEVANCE_SQL
from idforge.plans.q_relevance import table


def near(s, d):
    v = vectors(s, d)
    return nearest(v, v.where("vec_id % 100 = 0"), 0.3).select("vec_id", "nearest", F.round("cosine", 6).alias("cosine"), "near")


def shared_mean(s, d):
    """Shared-prefix similarity with every document weighing the same: its mean over all others of its group."""
    g = shared_token_similarity(docs(s, d, RQ), {"hierarchical": [[0], [0, 1], [0, 1, 2]]})
    return g.select("k", F.round("by_document", 6).alias("similarity"), "docs")


def text_vectors(s, d):
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"), hashed_embedding(F.col("text"), 64).alias("embedding"))


def near_duplicates(s, d):
    """Texts, near-duplicates among them by the cosine of their vectors, and what is left of them."""
    c = near_duplicate_vectors(text_vectors(s, d), 0.9)
    return c.agg(F.count("*").alias("texts"), F.count_if(F.col("vec_id") != F.col("first")).alias("duplicates"), F.count_if(F.col("vec_id") == F.col("first")).alias("unique_texts"))


def near_duplicate_classes(s, d):
    return near_duplicate_vectors(text_vectors(s, d), 0.9)


def dpo_rows(s, d):
    return RELEVANCE["triples_enriched"](s, d).select(F.col("query").alias("prompt"), F.col("pos_docid").alias("chosen"), F.col("neg_docid").alias("rejected"))


def first_qid(s, d):
    """The first row of each page, train before dev before test."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    r = table(s, d, "process_nq_dataset").select("row_no", unbracketed(F.col("id")).alias("docid"), "split").where("docid <> ''")
    return first_by(r.withColumn("o", order), ["docid"], "o", "row_no").select("docid", "row_no", "split")


def ranker_rows(s, d):
    """The four forms of a ranker's input: with and without the title and the answer."""
    r = table(s, d, "process_nq_dataset").where("query is not null and abstract is not null")
    q, title, text, answer = F.col("query"), F.coalesce("title", F.lit("")), F.col("abstract"), F.coalesce("short_answer", F.lit(""))
    forms = {"text": (title, None), "no_title": (None, None), "answered": (title, answer), "answered_no_title": (None, answer)}
    return r.select("row_no", *(x.ranker_text(q, t, text, answer=a).alias(n) for n, (t, a) in forms.items()), (F.trim("abstract") == "").alias("empty"))


def numbers(s, d):
    return table(s, d, "nq_queries").select("qid", x.padded_number(F.concat(F.lit("  "), "qid", F.lit(" "))).alias("number")).distinct()


def query_pairs(s, d):
    """Rows for fitting a query generator: id, query, page text."""
    return table(s, d, "process_nq_dataset").select("row_no", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("doc_tac", F.lit("")).alias("doc_tac"))


QUERIES = {
    "nearest_vectors": near, "near_duplicates": near_duplicates, "near_duplicate_classes": near_duplicate_classes, "shared_prefix_mean": shared_mean, "dpo_rows": dpo_rows, "first_row_by_split": first_qid, "ranker_texts": ranker_rows,
    "padded_numbers": numbers, "query_document_pairs": query_pairs,
}

SQL = {
    "nearest_vectors": f"WITH p AS (SELECT a.vec_id, b.vec_id AS o, round({_COS.format('a', 'b')}, 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, arg_min(o, (-c, o)) AS nearest, round(max(c), 6) AS cosine, count(*) FILTER (c >= 0.3) AS near FROM p GROUP BY 1",
    "shared_prefix_mean": codes_cte(*RQ) + _GRP + f", e AS (SELECT a.k, a.vec_id, avg({_COS.format('a', 'b')}) AS s FROM g a JOIN g b ON a.k = b.k AND a.p = b.p AND a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT k, round(avg(s), 6) AS similarity, count(*) AS docs FROM e GROUP BY 1",
    "dpo_rows": "SELECT query AS prompt, pos_docid AS chosen, neg_docid AS rejected FROM (" + RELEVANCE_SQL["triples_enriched"] + ")",
    "first_row_by_split": r"SELECT docid, row_no, split FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, row_no) AS k FROM (SELECT row_no, split, lower(regexp_replace(trim(id), '^[\[\] ]+|[\[\] ]+$', '', 'g')) AS docid FROM process_nq_dataset) WHERE docid <> '') WHERE k = 1",
    "ranker_texts": "SELECT row_no, query || ' [SEP] ' || coalesce(title, '') || ' ' || abstract AS text, query || ' [SEP] ' || abstract AS no_title, query || ' [SEP] ' || coalesce(short_answer, '') || ' ' || coalesce(title, '') || ' ' || abstract AS answered, query || ' [SEP] ' || coalesce(short_answer, '') || ' ' || abstract AS answered_no_title, trim(abstract) = '' AS empty FROM process_nq_dataset WHERE query IS NOT NULL AND abstract IS NOT NULL",
    "padded_numbers": "SELECT DISTINCT qid, try_cast(trim(qid) AS DOUBLE) AS number FROM nq_queries",
    "query_document_pairs": "SELECT row_no, coalesce(id, '') AS id, coalesce(query, '') AS query, coalesce(doc_tac, '') AS doc_tac FROM process_nq_dataset",
}

_DUP = r"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: ('0x' || substring(md5(t), 1, 8))::BIGINT % 64) AS p FROM documents WHERE text IS NOT NULL),
v AS (SELECT id, list_transform(range(64), lambda k: len(list_filter(p, lambda x: x = k))::DOUBLE) AS v FROM w WHERE len(p) > 0),
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v),
l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND round(list_dot_product(a.u, b.u), 9) >= 0.9),
r(node, seen) AS (SELECT id, id FROM u UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node AS vec_id, min(seen) AS first FROM r GROUP BY 1) """
SQL["near_duplicate_classes"] = _DUP + "SELECT vec_id, first FROM c"
SQL["near_duplicates"] = _DUP + "SELECT count(*) AS texts, count(*) FILTER (vec_id <> first) AS duplicates, count(*) FILTER (vec_id = first) AS unique_texts FROM c"
