"""Round trips through the text formats, checked against the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions.docids import unbracketed
from idforge.operators.analysis import first_token_samples, level_balance, level_histogram
from idforge.operators.lineage import scratch
from idforge.operators.quantize import code_usage
from idforge.operators.retrieval import trec_run
from idforge.plans.q_quantize import RQ, book, codes, vectors
from idforge.plans.q_relevance import BASE, pages, qrels, queries, run, table
from idforge.plans.q_relevance import QUERIES as RELEVANCE
from idforge.plans.q_relevance import SQL as RELEVANCE_SQL
from idforge.plans.q_retrieval import SQL as RETRIEVAL_SQL
from idforge.plans.q_retrieval import ranked
from idforge.sources import readers, writers


def folder(s, name):
    return scratch(s, name)


def docs_tsv(s, d):
    p = folder(s, "docs")
    r = table(s, d, "process_nq_dataset")
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), "\t\n\r", "   ")
    body = F.regexp_replace(F.coalesce("abstract", F.lit("")), "[\\n\\r]", " ")
    r.select(F.concat_ws("\t", F.col("row_no").cast("string"), clean(F.col("document_url")), clean(F.col("title")), F.regexp_replace(body, " ", "\t")).alias("value")).write.option("compression", "gzip").text(p)
    return readers.docs_tsv(s, p)


def queries_tsv(s, d):
    p = folder(s, "queries")
    table(s, d, "nq_queries").select(F.concat_ws("\t", "qid", "query").alias("value")).write.text(p)
    return readers.queries_tsv(s, p)


def rejected(s, d):
    p = folder(s, "queries")
    table(s, d, "nq_queries").select(F.concat_ws("\t", "qid", "query").alias("value")).write.text(p)
    return readers.rejected_queries(s, p).agg(F.count("*").alias("rejected"))


def qrels_text(s, d):
    p = folder(s, "qrels")
    table(s, d, "nq_qrels").where("docid is not null").select(F.concat_ws(" ", "qid", F.col("zero").cast("string"), unbracketed(F.col("docid")), F.col("rel").cast("string")).alias("value")).write.text(p)
    return readers.qrels(s, p)


def trec(s, d):
    p = folder(s, "run")
    writers.run(trec_run(ranked(s, d)), p)
    return readers.run(s, p)


def run_three(s, d):
    p = folder(s, "run")
    run(s, d).select(F.concat_ws("\t", "qid", "docid", F.col("rank").cast("string")).alias("value")).write.text(p)
    return readers.run(s, p).select("qid", "docid", "rank")


def code_file(s, d):
    p = folder(s, "codes")
    writers.codes(codes(s, d, RQ).select(F.col("vec_id").cast("string").alias("docid"), "codes"), p)
    return readers.encoded_docids(s, p).select("docid", F.array_join("codes", ",").alias("codes"))


def vector_file(s, d):
    p = folder(s, "vectors")
    writers.vectors(vectors(s, d).select(F.col("vec_id").cast("string").alias("docid"), "embedding"), p)
    return readers.vectors(s, p).select("docid", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def nested_json(s, d):
    p = folder(s, "raw")
    writers.jsonl(table(s, d, "nq_raw_dev"), p)
    r = readers.raw_examples(s, p)
    return r.select("example_id", F.size("document_tokens").alias("tokens"), F.size("annotations").alias("annotations"))


def corpus_json(s, d):
    p = folder(s, "corpus")
    r = table(s, d, "process_nq_dataset").select(F.col("row_no").cast("string").alias("id"), "title", "doc_tac")
    writers.jsonl(r, p, ("doc_tac",))
    return readers.titles_texts(s, p)


def triples_file(s, d):
    p = folder(s, "triples")
    writers.triples(RELEVANCE["triples_enriched"](s, d), p)
    return readers.triples(s, p)


def csv_file(s, d):
    p = folder(s, "csv")
    writers.csv(pages(s, d), p)
    return readers.csv(s, p, "docid string, url string, title string", header=True, escape='"', nullValue="\\N", emptyValue="", multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def pseudo(s, d):
    p = folder(s, "pseudo")
    writers.keyed_lines(table(s, d, "pseudo_queries").where("query is not null"), "docid", F.col("query"), p)
    return readers.queries_tsv(s, p).select(F.col("qid").alias("docid"), "query")


def codebook_file(s, d):
    p = folder(s, "codebook")
    writers.parquet(book(s, d, RQ), p)
    return readers.codebook(s, p).select("level", "subspace", "code", F.size("centroid").alias("dim"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def prompts(s, d):
    p = pages(s, d).where("title is not null")
    return readers.generation_prompts(p, F.col("title"), F.coalesce("url", F.lit("")), ("en", "de"), "docid")


def position_metrics(s, d):
    c = codes(s, d, RQ)
    h = level_histogram(c)
    m = writers.position_metrics(h, level_balance(h), code_usage(c, 16))
    return m.select("level", "most", "used", F.round("entropy", 6).alias("entropy"), F.round("gini", 6).alias("gini"))


QUERIES = {
    "source_docs_tsv": docs_tsv, "source_queries_tsv": queries_tsv, "source_queries_rejected": rejected, "source_qrels": qrels_text, "source_trec_run": trec,
    "source_run_three_fields": run_three, "source_encoded_docids": code_file, "source_vectors": vector_file, "source_nested_json": nested_json, "source_corpus_json": corpus_json,
    "source_triples": triples_file, "source_csv": csv_file, "source_pseudo_queries": pseudo, "source_codebook": codebook_file, "source_generation_prompts": prompts,
    "position_metrics": position_metrics, "first_token_samples_json": lambda s, d: writers.samples_json(first_token_samples(codes(s, d, RQ), 5)),
}

from idforge.plans.codes_sql import codes_cte  # noqa: E402
from idforge.plans.q_analysis import _BAL, _H  # noqa: E402

_C = codes_cte(*RQ)
SQL = {
    "source_docs_tsv": r"SELECT row_no::VARCHAR AS docid, translate(coalesce(document_url, ''), E'\t\n\r', '   ') AS url, translate(coalesce(title, ''), E'\t\n\r', '   ') AS title, replace(regexp_replace(coalesce(abstract, ''), '[\n\r]', ' ', 'g'), ' ', E'\t') AS body FROM process_nq_dataset",
    "source_queries_tsv": "SELECT qid, query FROM nq_queries WHERE query IS NOT NULL AND query NOT LIKE E'%\t%' AND query NOT LIKE E'%\n%'",
    "source_queries_rejected": "SELECT count(*) AS rejected FROM nq_queries WHERE query IS NULL OR query LIKE E'%\t%'",
    "source_qrels": BASE + "SELECT qid, docid, rel FROM qr",
    "source_trec_run": RETRIEVAL_SQL["trec_run"].rsplit(" SELECT qid || ", 1)[0] + " SELECT qid, p[i] AS docid, i AS rank, round(1.0 / i, 6) AS score FROM (SELECT qid, p, unnest(range(1, len(p) + 1)) AS i FROM z)",
    "source_run_three_fields": BASE + "SELECT * FROM run",
    "source_encoded_docids": _C + " SELECT '[' || vec_id || ']' AS docid, array_to_string(list_transform(codes, lambda x: x::VARCHAR), ',') AS codes FROM codes",
    "source_vectors": "SELECT '[' || vec_id || ']' AS docid, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings",
    "source_nested_json": "SELECT example_id, len(document_tokens) AS tokens, len(annotations) AS annotations FROM nq_raw_dev",
    "source_corpus_json": r"SELECT row_no::VARCHAR AS docid, coalesce(title, '') AS title, trim(translate(doc_tac, E'\n\t', '  '), ' ') AS text FROM process_nq_dataset WHERE doc_tac IS NOT NULL",
    "source_triples": "SELECT qid, query, coalesce(pos_url, '') AS pos_url, pos_docid, coalesce(neg_url, '') AS neg_url, neg_docid FROM (" + RELEVANCE_SQL["triples_enriched"] + ")",
    "source_csv": BASE + "SELECT docid, url, title FROM pages",
    "source_pseudo_queries": r"SELECT '[' || lower(regexp_replace(trim(docid), '^[\[\] ]+|[\[\] ]+$', '', 'g')) || ']' AS docid, query FROM pseudo_queries WHERE query IS NOT NULL",
    "source_codebook": _C + " " + " UNION ALL ".join(f"SELECT {k} AS level, s AS subspace, code, len(c) AS dim, round(list_sum(c), 5) AS total FROM b{k}" for k in range(3)),
    "source_generation_prompts": BASE + "SELECT docid, l AS lang, 'Generate a ' || l || ' question for this passage: ' || title || ' ' || coalesce(url, '') AS prompt FROM pages, (VALUES ('en'), ('de')) v(l) WHERE title IS NOT NULL",
    "position_metrics": _C + _H.format(3) + _BAL + ", u AS (SELECT level, max(n) AS most, count(*) AS used FROM h GROUP BY 1) SELECT b.level, most, used, round(entropy, 6) AS entropy, round(gini, 6) AS gini FROM b JOIN u ON u.level = b.level",
    "first_token_samples_json": _C + ", s AS (SELECT codes[1] AS token, row_number() OVER (PARTITION BY codes[1] ORDER BY md5('42|' || vec_id), vec_id) AS rank, vec_id FROM codes) SELECT '{\"token\":' || token || ',\"docs\":[' || array_to_string(list(vec_id::VARCHAR ORDER BY rank), ',') || ']}' AS value FROM s WHERE rank <= 5 GROUP BY token",
}
