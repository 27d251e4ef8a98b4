"""Page cleaning, identifiers from URLs and titles, and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions import text as x
from idforge.functions.docids import content_uuid, end_tokens, first_words, unbracketed, url_title_docid
from idforge.functions.hooks import hashed_embedding, initial_embedding, leading_queries, overlap_score, perturb_text, preference_loss
from idforge.operators import instances as t
from idforge.operators import pages as p
from idforge.operators.lineage import spread
from idforge.operators.ordering import dense_index, with_unique_suffix
from idforge.plans.q_relevance import BASE, qrels, queries, table
from idforge.plans.q_relevance import pages as page_table


def rows(s, d):
    return table(s, d, "process_nq_dataset")


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def joined(df, *cols):
    return df.select(*(F.array_join(c, " ").alias(c) if c in cols else F.col(c) for c in df.columns))


def url_docids(s, d):
    text, branch = url_title_docid(F.col("document_url"), F.col("title"))
    return rows(s, d).select("row_no", text.alias("docid"), branch.alias("branch"))


def passages(s, d):
    r = rows(s, d).where("doc_tac is not null").select("row_no", F.coalesce("title", F.lit("")).alias("title"), "doc_tac")
    return joined(t.passage_rows(spread(r), "row_no", F.col("title"), x.dotted_sentences(F.col("doc_tac")), 128, 10), "tokens")


def terms(s, d):
    return joined(t.salient_terms(spread(docs(s, d)), "doc_id", F.col("text"), 128), "tokens")


def term_ids(s, d):
    v = t.vocabulary(docs(s, d), F.col("text"))
    q = table(s, d, "eval_passages").select("item_id", F.concat(x.tokens(F.col("passage")), F.array(F.lit(t.END))).alias("tokens"))
    ids = t.model_inputs(t.to_ids(q, ["item_id"], "tokens", v), 16)
    return ids.select("item_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


def hashed(k, column, modulo):
    """A number below ``modulo`` that DuckDB computes alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(k)), column)), 1, 8), 16, 10).cast("bigint") % modulo


def page_codes(s, d):
    """A short code for each page, by hash."""
    return page_table(s, d).select("docid", F.array(*(hashed(k, "docid", 16).cast("int") for k in range(3))).alias("codes"))


def query_rows(s, d):
    q = queries(s, d).where("query is not null").distinct()
    i = t.paired_instances(q, qrels(s, d).select("qid", "docid").distinct(), page_codes(s, d))
    return i.select("qid", "docid", F.array_join("tokens", " ").alias("tokens"), F.array_join("codes", ",").alias("codes"))


def pseudo_rows(s, d):
    q = table(s, d, "pseudo_queries").where("query is not null").select(unbracketed(F.col("docid")).alias("docid"), "query").distinct()
    i = q.join(page_codes(s, d), "docid")
    return i.select("docid", F.array_join(x.tokens(F.col("query")), " ").alias("tokens"), F.array_join("codes", ",").alias("codes"))


def stage_union(s, d):
    """Counts of the training rows of a whole stage."""
    parts = {"query": query_rows(s, d), "fake_query": pseudo_rows(s, d), "enhanced_docid": page_codes(s, d)}
    out = None
    for k, f in parts.items():
        n = f.select(F.lit(k).alias("kind"))
        out = n if out is None else out.unionByName(n)
    return out.groupBy("kind").agg(F.count("*").alias("rows"))


def dsi(s, d):
    r = rows(s, d).select("row_no", unbracketed(F.col("id")).alias("docid"), "split", "abstract", "query")
    return p.indexing_rows(r)


def splits(s, d):
    return p.position_splits(rows(s, d).select("row_no"), ["row_no"], [("train", 0.72), ("dev", 0.18), ("test", 0.1)]).select("row_no", "i", "part")


def subset(s, d):
    r = rows(s, d).select("row_no", "query", "split").where("query is not null")
    return p.subset_with_overlap(r.where("split = 'train'").select("row_no", "query"), r.where("split = 'test'"), "query", 200).select("row_no")


def init_vectors(s, d):
    tok = page_table(s, d).where("title is not null").select("docid", F.explode(x.tokens(F.col("title"))).alias("token"))
    v = tok.select("token").distinct().select("token", F.array(*(hashed(k, "token", 1000) / 1000.0 for k in range(4))).alias("vector"))
    return initial_embedding(tok, v).select("docid", "i", F.round("x", 6).alias("x"))


def losses(s, d):
    l = table(s, d, "bm25_run")
    f = lambda k: -(hashed(k, "docid", 1000) / 100.0)
    return l.groupBy("qid").agg(F.round(F.avg(preference_loss(f("a"), f("b"), f("c"), f("d"))), 6).alias("loss"))


QUERIES = {
    "html_strip": lambda s, d: rows(s, d).select("row_no", x.strip_tags(F.col("content")).alias("content")),
    "url_docids": url_docids,
    "first_words_docids": lambda s, d: docs(s, d).select("doc_id", first_words(F.col("text"), 5).alias("docid")),
    "content_uuids": lambda s, d: docs(s, d).select("doc_id", content_uuid(F.col("text")).alias("docid")),
    "atomic_docids": lambda s, d: dense_index(page_table(s, d).select("docid"), ["docid"], "atomic", 32128),
    "docid_disambiguation": lambda s, d: with_unique_suffix(docs(s, d).select("doc_id", first_words(F.col("text"), 2).alias("docid")), "docid", ["doc_id"]),
    "docid_suffix_modulo": lambda s, d: with_unique_suffix(docs(s, d).select("doc_id", first_words(F.col("text"), 1).alias("docid")), "docid", ["doc_id"], 4),
    "sequential_qids": lambda s, d: dense_index(rows(s, d).where("split = 'dev'").select("row_no"), ["row_no"], "qid", 1000),
    "summary_docids": lambda s, d: page_table(s, d).where("title is not null").select("docid", F.array_join(end_tokens(F.transform(x.tokens(F.col("title")), lambda w: F.length(w)), 4), ",").alias("ids")),
    "nq_flat_examples": lambda s, d: p.flatten_examples(table(s, d, "nq_raw_dev")),
    "title_survivors": lambda s, d: p.title_survivors(rows(s, d)),
    "mapped_title_ids": lambda s, d: p.mapped_ids(rows(s, d)),
    "train_dev_antijoin": lambda s, d: p.dev_without_train(rows(s, d)),
    "latest_rows": lambda s, d: p.latest_rows(rows(s, d), "id", "loaded_at", "row_no"),
    "position_splits": splits,
    "hash_splits": lambda s, d: p.hash_split(rows(s, d).select("row_no"), "row_no", 0.1),
    "train_subset_with_overlap": subset,
    "dsi_assembly": dsi,
    "idf": lambda s, d: t.inverse_frequency(docs(s, d), F.col("text")).select("term", "df", F.round("idf", 6).alias("idf")),
    "passage_chunks": passages,
    "sampled_terms": terms,
    "token_ids": term_ids,
    "query_instances": query_rows,
    "pseudo_query_instances": pseudo_rows,
    "pretrain_union": stage_union,
    "instance_losses": lambda s, d: t.instance_losses(queries(s, d).where("query is not null"), qrels(s, d).select("qid", "docid").distinct(), page_codes(s, d)),
    "prompts": lambda s, d: rows(s, d).where("abstract is not null").select("row_no", x.question_prompt(F.coalesce("language", F.lit("en")), F.coalesce("title", F.lit("")), F.col("abstract")).alias("prompt"), x.encoder_text(F.col("abstract"), 40).alias("encoder")),
    "prompt_strip": lambda s, d: docs(s, d).select("doc_id", x.without_prompt(F.col("text")).alias("text")),
    "wordpiece_titles": lambda s, d: rows(s, d).select("row_no", x.rough_wordpiece(F.col("title")).alias("title")),
    "sentence_split": lambda s, d: docs(s, d).select("doc_id", F.array_join(x.sentences(F.col("text")), "|").alias("sentences"), F.array_join(x.dotted_sentences(F.col("text")), "|").alias("dotted")),
    "paraphrase_hook": lambda s, d: docs(s, d).select("doc_id", perturb_text(F.col("text")).alias("text")),
    "query_generation_hook": lambda s, d: docs(s, d).select("doc_id", F.posexplode(leading_queries(F.col("text"), 10)).alias("n", "query")),
    "cross_encoder_hook": lambda s, d: rows(s, d).where("query is not null and abstract is not null").select("row_no", F.round(overlap_score(F.col("query"), F.col("abstract")), 6).alias("score")),
    "embedding_hook": lambda s, d: rows(s, d).where("title is not null").select("row_no", F.posexplode(hashed_embedding(F.col("title"), 16)).alias("i", "v")).select("row_no", "i", F.round("v", 6).alias("v")),
    "docid_embedding_init": init_vectors,
    "dpo_loss": losses,
}

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^<]+?>', '', 'g'), '[\n\r]', '', 'g'), ' {{2,}}', ' ', 'g'))"
_WP = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'), '([^\p{{L}}\p{{N}} ])', ' \1 ', 'g'), ' +', ' ', 'g'))"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_CODE = BASE + ", pc AS (SELECT docid, 'x' AS codes FROM pages)"
_SURV = "WITH t AS (SELECT row_no, id, split, " + _WP.format("title") + " AS title, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS o FROM process_nq_dataset WHERE title IS NOT NULL), s AS (SELECT title, row_no, id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY o, row_no) AS k FROM t) WHERE k = 1), m AS (SELECT t.row_no, t.split, s.id FROM t JOIN s USING (title))"
SQL = {
    "html_strip": "SELECT row_no, " + _STRIP.format("content") + " AS content FROM process_nq_dataset",
    "url_docids": r"""WITH u AS (SELECT row_no, coalesce(lower(trim(title)), '') AS t, list_filter(string_split(replace(replace(replace(lower(trim(coalesce(document_url, ''))), 'http://', ''), 'https://', ''), '-', ' '), '/'), lambda s: s <> '') AS g FROM process_nq_dataset),
b AS (SELECT *, CASE WHEN len(g) > 0 AND len(list_filter(g, lambda s: NOT regexp_full_match(s, '\p{N}+') AND s NOT IN ('index', 'page', 'item', 'view', 'default', 'home') AND length(s) > 2)) > len(g) / 2 THEN 'url' WHEN t <> '' AND len(g) > 0 THEN 'title_domain' WHEN t <> '' THEN 'title' WHEN len(g) > 0 THEN 'domain' ELSE 'skipped' END AS branch FROM u)
SELECT row_no, CASE branch WHEN 'url' THEN trim(array_to_string(list_reverse(g[2:]) || [g[1]], ' ')) WHEN 'title_domain' THEN t || ' ' || g[1] WHEN 'title' THEN t WHEN 'domain' THEN g[1] END AS docid, branch FROM b""",
    "first_words_docids": "SELECT doc_id, array_to_string((" + _WORDS.format("text") + ")[1:5], ' ') AS docid FROM documents",
    "content_uuids": "SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS docid FROM (SELECT doc_id, md5(text) AS h FROM documents)",
    "atomic_docids": BASE + "SELECT docid, 32127 + row_number() OVER (ORDER BY docid) AS atomic FROM pages",
    "docid_disambiguation": "WITH f AS (SELECT doc_id, array_to_string((" + _WORDS.format("text") + ")[1:2], ' ') AS f FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY f) > 1 THEN f || '-' || row_number() OVER (PARTITION BY f ORDER BY doc_id) ELSE f END AS docid FROM f",
    "docid_suffix_modulo": "WITH f AS (SELECT doc_id, array_to_string((" + _WORDS.format("text") + ")[1:1], ' ') AS f FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY f) > 1 THEN f || '-' || (row_number() OVER (PARTITION BY f ORDER BY doc_id)) % 4 ELSE f END AS docid FROM f",
    "sequential_qids": "SELECT row_no, 999 + row_number() OVER (ORDER BY row_no) AS qid FROM process_nq_dataset WHERE split = 'dev'",
    "summary_docids": BASE + "SELECT docid, array_to_string((list_transform(" + _TOK.format("title") + ", lambda w: length(w)))[1:4] || [1], ',') AS ids FROM pages WHERE title IS NOT NULL",
    "title_survivors": _SURV + " SELECT * FROM s",
    "mapped_title_ids": _SURV + " SELECT * FROM m",
    "train_dev_antijoin": _SURV + " SELECT id, min(row_no) AS row_no FROM m WHERE split = 'dev' AND id IS NOT NULL AND id NOT IN (SELECT id FROM m WHERE split = 'train' AND id IS NOT NULL) GROUP BY 1",
    "latest_rows": "SELECT id, row_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, row_no DESC) AS k FROM process_nq_dataset WHERE id IS NOT NULL) WHERE k = 1",
    "position_splits": "SELECT row_no, i, CASE WHEN i < floor(0.72 * n) THEN 'train' WHEN i < floor(0.72 * n) + floor(0.18 * n) THEN 'dev' ELSE 'test' END AS part FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS i, count(*) OVER () AS n FROM process_nq_dataset)",
    "hash_splits": "SELECT row_no, ('0x' || substring(md5('42|' || row_no), 1, 8))::BIGINT / 4294967296.0 < 0.1 AS held_out FROM process_nq_dataset",
    "train_subset_with_overlap": "SELECT row_no FROM (SELECT row_no, CASE WHEN query IN (SELECT query FROM process_nq_dataset WHERE split = 'test' AND query IS NOT NULL) THEN 0 ELSE 1 END AS o FROM process_nq_dataset WHERE split = 'train' AND query IS NOT NULL) ORDER BY o, md5('42|' || row_no), row_no LIMIT 200",
    "idf": "WITH t AS (SELECT DISTINCT doc_id, unnest(" + _TOK.format("text") + ") AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)), 6) AS idf FROM t GROUP BY 1",
    "passage_chunks": r"""WITH RECURSIVE z AS (SELECT row_no, """ + _TOK.format("title") + r""" AS h, list_transform(list_filter(string_split(doc_tac, '.'), lambda x: trim(x) <> ''), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS s FROM process_nq_dataset WHERE doc_tac IS NOT NULL),
r AS (SELECT row_no, h, s, 0 AS k, h AS now, 0 AS part, NULL::VARCHAR[] AS out FROM z
UNION ALL SELECT row_no, h, s, k + 1, CASE WHEN f THEN h ELSE n END, part + f::INT, CASE WHEN f THEN n[1:127] END FROM (SELECT *, len(n) >= 127 OR k = len(s) - 1 AS f FROM (SELECT *, now || s[k + 1] AS n FROM r WHERE k < len(s) AND part < 10)))
SELECT row_no, part - 1 AS part, array_to_string(out || ['</s>'], ' ') AS tokens FROM r WHERE out IS NOT NULL""",
    "sampled_terms": "WITH d AS (SELECT doc_id, " + _TOK.format("text") + """[1:1024] AS t, """ + _TOK.format("text") + """ AS a FROM documents),
i AS (SELECT term, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM (SELECT DISTINCT doc_id, unnest(a) AS term FROM d) GROUP BY 1),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
s AS (SELECT doc_id, n, e.term, pos, round(count(*) OVER (PARTITION BY doc_id, e.term) / n * idf, 9) AS s FROM e JOIN i ON i.term = e.term),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM s),
m AS (SELECT doc_id, min(s) AS least FROM k WHERE r <= 127 GROUP BY 1),
o AS (SELECT doc_id, list(term ORDER BY pos) AS t, count(DISTINCT term) AS u FROM s JOIN m USING (doc_id) WHERE s >= least AND n >= 10 GROUP BY 1)
SELECT doc_id, array_to_string(t[1:127] || ['</s>'], ' ') AS tokens FROM o WHERE u >= 2""",
    "token_ids": "WITH v AS (SELECT term, 1 + row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT unnest(" + _TOK.format("text") + ") AS term FROM documents)), e AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT item_id, " + _TOK.format("passage") + " || ['</s>'] AS w FROM eval_passages)), l AS (SELECT item_id, list(coalesce(id, CASE WHEN e.term = '</s>' THEN 1 ELSE -1 END) ORDER BY pos) AS l FROM e LEFT JOIN v ON v.term = e.term GROUP BY 1) SELECT item_id, array_to_string((l || list_transform(range(16), lambda i: 0))[1:16], ',') AS input_ids, array_to_string(list_transform(range(1, 17), lambda i: (i <= len(l))::INT), ',') AS attention_mask FROM l",
    "instance_losses": BASE + "SELECT CASE WHEN qid NOT IN (SELECT qid FROM qs WHERE query IS NOT NULL AND qid IS NOT NULL) THEN 'no_query' WHEN docid NOT IN (SELECT docid FROM pages) THEN 'no_code' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT DISTINCT qid, docid FROM qr) GROUP BY 1",
    "pretrain_union": BASE + "SELECT 'query' AS kind, count(*) AS rows FROM (SELECT DISTINCT qid, docid FROM qr) JOIN (SELECT DISTINCT qid, query FROM qs WHERE query IS NOT NULL) USING (qid) WHERE docid IN (SELECT docid FROM pages) UNION ALL SELECT 'fake_query', count(*) FROM (SELECT DISTINCT lower(regexp_replace(trim(docid), '^[\\[\\] ]+|[\\[\\] ]+$', '', 'g')) AS docid, query FROM pseudo_queries WHERE query IS NOT NULL) WHERE docid IN (SELECT docid FROM pages) UNION ALL SELECT 'enhanced_docid', count(*) FROM pages".replace("\\\\", "\\"),
    "prompts": "SELECT row_no, 'Generate a ' || coalesce(language, 'en') || ' question for this passage: ' || coalesce(title, '') || ' ' || abstract AS prompt, 'Passage: ' || substring(abstract, 1, 40) AS encoder FROM process_nq_dataset WHERE abstract IS NOT NULL",
    "prompt_strip": "SELECT doc_id, regexp_replace(regexp_replace(text, '^Passage: ', ''), '^Question: ', '') AS text FROM documents",
    "wordpiece_titles": "SELECT row_no, " + _WP.format("title") + " AS title FROM process_nq_dataset",
    "sentence_split": "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''), '|') AS sentences, array_to_string(list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda y: y <> ''), lambda z: z || '.'), '|') AS dotted FROM documents",
    "paraphrase_hook": "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 10 <> 0), ' ') AS text FROM documents",
    "cross_encoder_hook": "SELECT row_no, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, p)) / len(q) END, 6) AS score FROM (SELECT row_no, list_distinct(" + _TOK.format("query") + ") AS q, list_distinct(" + _TOK.format("abstract") + ") AS p FROM process_nq_dataset WHERE query IS NOT NULL AND abstract IS NOT NULL)",
    "query_generation_hook": "SELECT doc_id, n, array_to_string(w[n * 8 + 1:n * 8 + 8], ' ') AS query FROM (SELECT doc_id, " + _TOK.format("text") + " AS w FROM documents), range(10) t(n) WHERE n * 8 < len(w)",
}

SQL["embedding_hook"] = "SELECT row_no, i::INT AS i, round(CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE v[i + 1] / sqrt(list_dot_product(v, v)) END, 6) AS v FROM (SELECT row_no, [" + ", ".join(f"len(list_filter(w, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 16 = {k}))::DOUBLE" for k in range(16)) + "] AS v FROM (SELECT row_no, " + _TOK.format("title") + " AS w FROM process_nq_dataset WHERE title IS NOT NULL)), range(16) t(i)"

_SPAN = "CASE WHEN {0} >= 0 AND {1} > {0} THEN array_to_string(w[{0} + 1:{1}], ' ') ELSE '' END"
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^<]+?>', '', 'g'), '\n', '', 'g'))"
_LAST = "CASE WHEN contains({0}, '</Ul>') THEN array_to_string(string_split({0}, '</Ul>')[1:len(string_split({0}, '</Ul>')) - 1], '</Ul>') ELSE {0} END"
SQL |= {
    "nq_flat_examples": f"""WITH w AS (SELECT *, list_transform(document_tokens, lambda t: t.token) AS w FROM nq_raw_dev),
d AS (SELECT *, array_to_string(w, ' ') AS doc, list_filter(list_transform(annotations, lambda a: a.long_answer), lambda a: a.start_token >= 0)[1] AS la FROM w),
t AS (SELECT *, CASE WHEN contains(doc, '<P>') THEN substring(doc, strpos(doc, '<P>')) ELSE '' END AS tail, CASE WHEN contains(doc, '</P>') THEN substring(doc, strpos(doc, '</P>') + 4) ELSE doc END AS rest FROM d),
u AS (SELECT *, CASE WHEN contains(doc, '<P>') THEN substring(string_split(tail, '</P>')[1], 4) ELSE '' END AS abs, {_LAST.format('rest')} AS r1 FROM t),
v AS (SELECT *, {_STRIP.format('(' + _LAST.format('r1') + ')')} AS con FROM u)
SELECT coalesce(question_text, '') AS query, example_id::VARCHAR AS id,
  CASE WHEN annotations[1].long_answer.start_token >= 0 THEN {_CLEAN.format('(' + _SPAN.format('la.start_token', 'la.end_token') + ')')} ELSE '' END AS long_answer,
  CASE WHEN len(annotations[1].short_answers) > 0 THEN {_CLEAN.format("array_to_string(list_transform(annotations[1].short_answers, lambda x: " + _SPAN.format('x.start_token', 'x.end_token') + "), '|')")} ELSE '' END AS short_answer,
  coalesce(document_title, '') AS title, abs AS abstract, con AS content, coalesce(document_url, '') AS document_url, coalesce(document_title, '') || abs || con AS doc_tac, 'en' AS language
FROM v""",
    "dsi_assembly": r"""WITH p AS (SELECT row_no, split, abstract, query, lower(regexp_replace(trim(id), '^[\[\] ]+|[\[\] ]+$', '', 'g')) AS docid FROM process_nq_dataset WHERE id IS NOT NULL),
f AS (SELECT * FROM (SELECT *, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS o, row_number() OVER (PARTITION BY docid, split = 'train' ORDER BY row_no) AS k FROM p) WHERE k = 1)
SELECT docid AS text_id, 'passage' AS kind, 'Passage: ' || coalesce(abstract, '') AS text FROM f WHERE o = 0 OR docid NOT IN (SELECT docid FROM p WHERE split = 'train')
UNION ALL SELECT DISTINCT docid, 'question', 'Question: ' || query FROM p WHERE split = 'train' AND query IS NOT NULL""",
}

_HASH = "(('0x' || substring(md5('{0}|' || {1}), 1, 8))::BIGINT % {2})"
_PC = BASE + ", pc AS (SELECT docid, " + " || ',' || ".join(_HASH.format(k, "docid", 16) for k in range(3)) + " AS codes FROM pages)"
_LP = {k: "(-" + _HASH.format(k, "docid", 1000) + " / 100.0)" for k in "abcd"}
SQL |= {
    "query_instances": _PC + " SELECT qid, docid, array_to_string(" + _TOK.format("query") + ", ' ') AS tokens, codes FROM (SELECT DISTINCT qid, docid FROM qr) JOIN (SELECT DISTINCT qid, query FROM qs WHERE query IS NOT NULL) USING (qid) JOIN pc USING (docid)",
    "pseudo_query_instances": _PC + " SELECT docid, array_to_string(" + _TOK.format("query") + r""", ' ') AS tokens, codes FROM (SELECT DISTINCT lower(regexp_replace(trim(docid), '^[\[\] ]+|[\[\] ]+$', '', 'g')) AS docid, query FROM pseudo_queries WHERE query IS NOT NULL) JOIN pc USING (docid)""",
    "docid_embedding_init": BASE + ", t AS (SELECT DISTINCT docid, unnest(" + _TOK.format("title") + ") AS token FROM pages WHERE title IS NOT NULL) SELECT docid, i, round(sum(v / 1000.0) / (count(*) + 1), 6) AS x FROM (SELECT docid, unnest(range(4)) AS i, unnest([" + ", ".join(_HASH.format(k, "token", 1000) for k in range(4)) + "]) AS v FROM t) GROUP BY 1, 2",
    "dpo_loss": f"SELECT qid, round(avg(greatest(0, -m) + ln(1 + exp(-abs(m)))), 6) AS loss FROM (SELECT qid, 0.4 * (({_LP['a']} - {_LP['c']}) - ({_LP['b']} - {_LP['d']})) AS m FROM bm25_run) GROUP BY 1",
}
