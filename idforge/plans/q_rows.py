"""Training rows of whole stages, assemblies, reports, and the remaining readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions import text as x
from idforge.functions.docids import codes_to_tokens, end_tokens, unbracketed
from idforge.functions.hooks import hashed_embedding
from idforge.functions.metrics import exact_match, evaluate, mean_metrics
from idforge.functions.similarity import cosine
from idforge.functions.tokenizers import piece_ids, piece_round_trip
from idforge.operators import instances as t
from idforge.operators import pages as p
from idforge.operators import relevance as r
from idforge.operators.analysis import level_histogram
from idforge.operators.retrieval import code_key
from idforge.plans.codes_sql import codes_cte
from idforge.plans.q_analysis import _H
from idforge.plans.q_pages import _HASH, _PC, _TOK, docs, hashed, page_codes, rows
from idforge.plans.q_pages import SQL as PAGES_SQL
from idforge.plans.q_quantize import RQ, codes
from idforge.plans.q_relevance import BASE, BUCKETS, pages, qrels, queries, run, table
from idforge.plans.q_retrieval import _RANKED, ranked
from idforge.plans.q_sources import folder
from idforge.sources import readers, writers


def joined(df):
    return df.select(*(F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))


def label_codes(s, d):
    """Other codes for every second page, as labels."""
    return pages(s, d).where(hashed("half", "docid", 2) == 0).select("docid", F.array(*(hashed(k, "docid", 8).cast("int") for k in "xy")).alias("codes"))


def titled(s, d):
    """One text for each page: its title and URL."""
    return pages(s, d).select("docid", F.coalesce("title", F.lit("")).alias("title"), F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))).alias("text"))


def builders(s, d):
    c = page_codes(s, d)
    q = queries(s, d).where("query is not null").distinct()
    fake = table(s, d, "pseudo_queries").where("query is not null").select(unbracketed(F.col("docid")).alias("docid"), x.tokens(F.col("query")).alias("tokens")).distinct()
    return {
        "passage": t.passage_rows(titled(s, d), "docid", F.col("title"), x.dotted_sentences(F.col("text")), 16, 10).join(c, "docid"),
        "sampled_terms": t.salient_terms(titled(s, d), "docid", F.col("text"), 8, fewest=3).join(c, "docid"),
        "enhanced_docid": t.label_rows(c, label_codes(s, d)),
        "fake_query": fake.join(c, "docid"),
        "query": t.paired_instances(q, qrels(s, d).select("qid", "docid").distinct(), c),
    }


def stage(name):
    return lambda s, d: joined(t.stage_rows(name, builders(s, d)))


def eval_rows(s, d):
    q = queries(s, d).where("query is not null").distinct()
    return joined(t.eval_instances(q, qrels(s, d).select("qid", "docid").distinct(), page_codes(s, d), 6))


def label_ids(s, d):
    """Query words as ids under the corpus vocabulary, filled up with the value that a loss ignores."""
    v = t.vocabulary(docs(s, d), F.col("text"))
    q = table(s, d, "eval_passages").select("item_id", x.tokens(F.col("passage")).alias("tokens"))
    return t.to_ids(q, ["item_id"], "tokens", v).select("item_id", F.array_join(x.labels(F.col("ids"), 12), ",").alias("labels"))


def triplets(s, d):
    v = lambda c: hashed_embedding(F.col(c), 8)
    q = queries(s, d).where("query is not null").groupBy("qid").agg(F.min("query").alias("query")).select("qid", v("query").alias("vector"))
    dv = pages(s, d).where("title is not null").select("docid", v("title").alias("vector"))
    j = r.vector_triplets(dv, qrels(s, d), q)
    return j.select("docid", "qid", "negative", F.round(cosine(F.col("q"), F.col("d")), 6).alias("near"), F.round(cosine(F.col("q"), F.col("n")), 6).alias("far"))


def inverse_keys(s, d):
    """Documents by code text: with the end token kept, and with end and padding stripped."""
    c = codes(s, d, RQ).select(F.col("vec_id").cast("string").alias("docid"), F.concat(codes_to_tokens(F.col("codes"), 16), F.array(F.lit(1), F.lit(0), F.lit(0))).alias("codes"))
    kept = F.array_join(F.filter("codes", lambda v: v != 0), ",")
    forms = F.array(F.struct(F.lit("end_kept").alias("form"), kept.alias("code")), F.struct(F.lit("stripped").alias("form"), code_key(F.col("codes")).alias("code")))
    return c.select("docid", F.explode(forms).alias("f")).groupBy("f.form", "f.code").agg(F.array_join(F.array_sort(F.collect_set("docid")), ",").alias("docids"))


def train_shape(s, d):
    """The nested examples in the form of the training files: the page as one text, no title."""
    raw = table(s, d, "nq_raw_dev")
    page = F.concat_ws(" ", F.lit("<H1>"), F.coalesce("document_title", F.lit("")), F.lit("</H1>"), F.array_join(F.transform("document_tokens", lambda w: w["token"]), " "))
    return p.flatten_examples(raw.select("question_text", "example_id", "document_url", "annotations", page.alias("document_text"))).select("id", "query", "title", "abstract", "long_answer", "short_answer", "content")


def assembly_parts(s, d):
    b = rows(s, d).select(unbracketed(F.col("id")).alias("qid"), x.section_title(F.concat(F.lit("title:"), "title", F.lit("_parentSection"))).alias("title"), F.col("abstract").alias("passage"), F.col("query").alias("question"), F.col("language").alias("lang"), "split")
    fill = table(s, d, "documents").select(F.concat(F.lit("fill-"), "doc_id").alias("qid"), F.lit(None).cast("string").alias("title"), F.col("text").alias("passage"))
    ok = b.where("qid <> '' and question is not null and passage is not null and title is not null")
    return ok.where("split = 'train'"), fill.where("passage is not null"), ok.where("split = 'dev'")


def assembly(s, d):
    n = rows(s, d).select("id").distinct().count()
    return p.numbered_assembly(*assembly_parts(s, d), n_train=n + 50, n_eval=n // 20)


def readings(s, d):
    """Pages and queries read in proportion to their numbers, as by two ranks in batches of four."""
    a, b = pages(s, d).select(F.lit("pages").alias("dataset"), F.col("docid").alias("key")), queries(s, d).select(F.lit("queries").alias("dataset"), F.col("qid").alias("key")).distinct()
    return p.proportional_steps(a.unionByName(b), 100, 4, 2)


def exact(s, d):
    q = ranked(s, d).select(exact_match(F.col("pred"), F.col("truth")).alias("m"))
    return q.agg(F.sum("m").cast("bigint").alias("matches"), F.count("*").alias("queries"), F.round(F.avg("m"), 6).alias("accuracy"))


def report(s, d):
    f = folder(s, "report")
    m = mean_metrics(evaluate(ranked(s, d)))
    writers.metric_report(m.select(*(F.round(c, 6).alias(c) for c in ("mrr_10", "ndcg_10", "r_10", "hit_1")), "queries"), f)
    return readers.lines(s, f"{f}/text").withColumnRenamed("value", "line")


def score_order(s, d):
    return r.score_buckets(run(s, d).distinct().withColumn("score", (hashed("score", F.concat_ws(",", "qid", "docid"), 1000) / 1000.0)), BUCKETS)


def strict_queries(s, d):
    """The well-formed query lines under the strict reader, which would raise at any other."""
    f = folder(s, "queries")
    good = table(s, d, "nq_queries").where("query is not null and not contains(query, '\t')")
    good.select(F.concat_ws("\t", "qid", "query").alias("value")).write.text(f)
    return readers.queries_tsv(s, f, strict=True)


def qrels_as(**how):
    def read(s, d):
        f = folder(s, "qrels")
        table(s, d, "nq_qrels").where("docid is not null").select(F.concat_ws(" ", "qid", F.col("zero").cast("string"), unbracketed(F.col("docid")), F.col("rel").cast("string")).alias("value")).write.text(f)
        return readers.qrels(s, f, **how)

    return read


def last_line(s, d):
    """The last line of each query of a judgement file in which the lines stand by document."""
    f = folder(s, "qrels")
    q = table(s, d, "nq_qrels").where("docid is not null").select("qid", unbracketed(F.col("docid")).alias("docid"), "rel").distinct()
    lines = F.concat_ws(" ", "qid", F.lit("0"), "docid", F.col("rel").cast("string"))
    q.repartitionByRange(5, "docid").sortWithinPartitions("docid", "qid", "rel").select(lines.alias("value")).write.text(f)
    return readers.last_qrels(s, f)


def nq_table(s, d):
    f = folder(s, "nq")
    clean = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "\t\n\r", "   ")
    rows(s, d).select(F.concat_ws("\t", *(F.col("row_no").cast("string") if c == "long_answer" else clean(c) for c in readers.NQ)).alias("value")).write.text(f)
    return readers.nq_tsv(s, f).select(F.col("long_answer").alias("row_no"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("language", F.lit("")).alias("language"))


def renamed(s, d):
    return readers.table(s, f"{d}/nq_queries.parquet", {"qid": "query_id", "query": "text"}, ("query_id", "text"))


def json_field(s, d):
    f = folder(s, "field")
    e = table(s, d, "eval_passages").select("item_id", "passage")  # a table of fixed size
    e.agg(F.to_json(F.struct(F.collect_list(F.struct("item_id", "passage")).alias("data"))).alias("value")).write.text(f)
    return readers.json_field(s, f, "data", "item_id bigint, passage string")


def instance_file(s, d):
    f = folder(s, "instances")
    c = page_codes(s, d)
    writers.jsonl(c.select(F.concat(F.lit("["), "docid", F.lit("]")).alias("query_id"), F.array_join("codes", ",").alias("doc_id"), F.concat("codes", F.array(F.lit(1))).alias("input_ids")), f)
    return readers.instances(s, f).select("query_id", "doc_id", F.array_join("input_ids", ",").alias("input_ids"))


def index_file(s, d):
    f = folder(s, "indexing")
    writers.jsonl(p.indexing_rows(rows(s, d).select("row_no", unbracketed(F.col("id")).alias("docid"), "split", "abstract", "query")).select("text_id", "text"), f)
    every, ids = readers.indexing(s, f)
    return every.join(ids, "text_id").groupBy("text_id").agg(F.count("*").alias("rows"), F.min("text").alias("first"))


def dpr_file(s, d):
    f = folder(s, "dpr")
    ctx = lambda a, b: F.array(F.struct(F.col(a).alias("title"), F.col(b).alias("text")))
    tr = r.triples(run(s, d), qrels(s, d), queries(s, d), pages(s, d), 3)
    writers.jsonl(tr.select(F.col("query").alias("question"), F.array("qid").alias("answers"), ctx("pos_docid", "qid").alias("positive_ctxs"), ctx("neg_docid", "qid").alias("hard_negative_ctxs")), f)
    back = readers.dpr(s, f)
    return back.select("question", F.get("answers", F.lit(0)).alias("qid"), F.col("positive_ctxs")[0]["title"].alias("pos_docid"), F.col("hard_negative_ctxs")[0]["title"].alias("neg_docid"))


def page_outputs(s, d):
    f = folder(s, "outputs")
    r_ = rows(s, d).select(*readers.NQ, "split")
    writers.nq_outputs(r_.where("split = 'train'").drop("split"), r_.where("split = 'dev'").drop("split"), r_.drop("split"), f)
    back = readers.jsonl(s, f"{f}/contents", "id string, contents string")
    lines = readers.lines(s, f"{f}/train").agg(F.count("*").alias("n")).first()["n"]
    return back.select("id", "contents", F.lit(lines).alias("train_lines"))


def array_file(s, d):
    f = folder(s, "array")
    writers.json_array(table(s, d, "nq_qrels").select("qid", "docid", "rel"), f)
    return s.read.option("multiLine", True).schema("qid string, docid string, rel int").json(f)


def appended(s, d):
    f = folder(s, "results")
    q = qrels(s, d).groupBy("rel").agg(F.count("*").alias("n"))
    writers.append(q, f)
    writers.append(q.select("rel", F.lit("again").alias("note")), f)
    return s.read.option("mergeSchema", True).parquet(f).select("rel", "n", "note")


def nested(s, d):
    f = folder(s, "raw")
    writers.jsonl(table(s, d, "nq_raw_dev"), f)
    back = readers.raw_examples(s, f)
    starts = F.transform("annotations", lambda a: F.concat_ws(":", a["long_answer"]["start_token"].cast("string"), a["long_answer"]["end_token"].cast("string"), F.size(a["short_answers"]).cast("string"), a["yes_no_answer"]))
    return back.select("example_id", "question_text", F.array_join(F.transform("document_tokens", lambda w: w["token"]), " ").alias("tokens"), F.array_join(starts, "|").alias("annotations"))


def marked_numbers(s, d):
    """Order prices written as 1.234,56 and read back."""
    f = folder(s, "numbers")
    o = table(s, d, "orders").select("o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("price"))
    o.write.option("sep", ";").csv(f)
    return readers.csv(s, f, "o_orderkey bigint, price double", thousands=".", decimal=",", sep=";")


def all_docs(s, d):
    """The pages of train and dev, with repeats, in the corpus form."""
    of = lambda k: rows(s, d).where(F.col("split") == k).select("id", "document_url", "title", F.col("doc_tac").alias("contents"))
    both = of("train").unionByName(of("dev"))
    return both.groupBy("id").agg(F.count("*").alias("copies"), F.count("contents").alias("with_contents"), F.min("title").alias("first_title"))


def summary_pieces(s, d):
    """Identifiers from the pieces of a page's title: at most four ids and the end."""
    return pages(s, d).where("title is not null").select("docid", F.array_join(end_tokens(piece_ids(F.col("title")), 4), ",").alias("ids"))


def round_trips(s, d):
    """Titles as they come back from a lower-casing tokenizer."""
    return rows(s, d).select("row_no", piece_round_trip(F.col("title")).alias("title"))


def bad_json(s, d):
    """Malformed lines of a file in which every eleventh one is cut off."""
    f = folder(s, "bad")
    e = table(s, d, "eval_passages").select("item_id", F.to_json(F.struct("item_id", "split")).alias("j"))
    e.select(F.when(F.col("item_id") % 11 == 0, F.substring("j", 1, 9)).otherwise(F.col("j")).alias("value")).write.text(f)
    return readers.rejected_json(s, f, "item_id bigint, split string").select(F.col("value").alias("line"))


QUERIES = {
    "stage_general_pretrain": stage("general_pretrain"), "stage_search_pretrain": stage("search_pretrain"), "stage_finetune": stage("finetune"),
    "eval_instances": eval_rows, "label_ids": label_ids, "ir_triplets": triplets, "inverse_code_keys": inverse_keys, "nq_train_examples": train_shape,
    "numbered_assembly": assembly, "proportional_steps": readings, "exact_match": exact, "metric_report": report, "score_buckets": score_order,
    "level_summaries_json": lambda s, d: writers.level_summaries(level_histogram(codes(s, d, RQ))),
    "source_queries_strict": strict_queries, "source_qrels_exact": qrels_as(exact=2), "source_qrels_all": qrels_as(least=None), "source_last_line": last_line,
    "source_nq_tsv": nq_table, "source_renamed_table": renamed, "source_json_field": json_field, "source_instances": instance_file, "source_indexing": index_file,
    "source_dpr": dpr_file, "source_page_outputs": page_outputs, "source_json_array": array_file, "results_appended": appended, "source_nested_values": nested,
    "source_json_rejected": bad_json, "source_csv_marks": marked_numbers, "all_documents": all_docs, "summary_piece_docids": summary_pieces, "piece_round_trips": round_trips,
}

_ID = r"lower(regexp_replace(trim({0}), '^[\[\] ]+|[\[\] ]+$', '', 'g'))"
_J = "array_to_string({0}, ' ')"
_SP = _PC.replace("|| ',' ||", "|| ' ' ||") + r""", tx AS (SELECT docid, coalesce(title, '') AS title, coalesce(title, '') || '. ' || coalesce(url, '') AS text FROM pages), """
_STAGE = {
    "passage": r"""z AS (SELECT docid, """ + _TOK.format("title") + r""" AS h, list_transform(list_filter(string_split(text, '.'), lambda x: trim(x) <> ''), lambda x: """ + _TOK.format("x") + r""") AS s FROM tx),
r AS (SELECT docid, h, s, 0 AS k, h AS now, 0 AS part, NULL::VARCHAR[] AS out FROM z
UNION ALL SELECT docid, h, s, k + 1, CASE WHEN f THEN h ELSE n END, part + f::INT, CASE WHEN f THEN n[1:15] END FROM (SELECT *, len(n) >= 15 OR k = len(s) - 1 AS f FROM (SELECT *, now || s[k + 1] AS n FROM r WHERE k < len(s) AND part < 10))),
passage AS (SELECT docid, array_to_string(out || ['</s>'], ' ') AS tokens, codes FROM r JOIN pc USING (docid) WHERE out IS NOT NULL)""",
    "sampled_terms": "d AS (SELECT docid, " + _TOK.format("text") + """[1:1024] AS t FROM tx),
i AS (SELECT term, ln((SELECT count(*) FROM tx) / (count(*) + 1)) AS idf FROM (SELECT DISTINCT docid, unnest(t) AS term FROM d) GROUP BY 1),
e AS (SELECT docid, len(t) AS n, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
y AS (SELECT docid, n, e.term, pos, round(count(*) OVER (PARTITION BY docid, e.term) / n * idf, 9) AS s FROM e JOIN i ON i.term = e.term),
k AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY s DESC) AS r FROM y),
m AS (SELECT docid, min(s) AS least FROM k WHERE r <= 7 GROUP BY 1),
o AS (SELECT docid, list(term ORDER BY pos) AS t, count(DISTINCT term) AS u FROM y JOIN m USING (docid) WHERE s >= least AND n >= 3 GROUP BY 1),
sampled_terms AS (SELECT docid, array_to_string(t[1:7] || ['</s>'], ' ') AS tokens, codes FROM o JOIN pc USING (docid) WHERE u >= 2)""",
    "enhanced_docid": "enhanced_docid AS (SELECT docid, codes AS tokens, " + _HASH.format("x", "docid", 8) + " || ' ' || " + _HASH.format("y", "docid", 8) + " AS codes FROM pc WHERE " + _HASH.format("half", "docid", 2) + " = 0)",
}
_CLEANED = r"translate(coalesce({0}, ''), E'\t\n\r', '   ')"
_V8 = "[" + ", ".join(f"len(list_filter({{0}}, lambda w: ('0x' || substring(md5(w), 1, 8))::BIGINT % 8 = {k}))::DOUBLE" for k in range(8)) + "]"
_C8 = "round(CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) = 0 THEN 0 ELSE list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1})) END, 6)"
SQL = {
    "stage_general_pretrain": _SP.replace("WITH ", "WITH RECURSIVE ", 1) + ", ".join(_STAGE.values()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, docid, tokens, codes FROM {k}" for k in _STAGE),
    "stage_search_pretrain": _PC.replace("|| ',' ||", "|| ' ' ||") + " SELECT 'fake_query' AS kind, docid, tokens, codes FROM (SELECT DISTINCT " + _ID.format("docid") + " AS docid, " + _J.format(_TOK.format("query")) + " AS tokens FROM pseudo_queries WHERE query IS NOT NULL) JOIN pc USING (docid)",
    "stage_finetune": "SELECT 'query' AS kind, docid, tokens, replace(codes, ',', ' ') AS codes FROM (" + PAGES_SQL["query_instances"] + ")",
    "eval_instances": "SELECT qid, docid, array_to_string(string_split(tokens, ' ')[1:5] || ['</s>'], ' ') AS tokens, replace(codes, ',', ' ') AS codes FROM (" + PAGES_SQL["query_instances"] + ")",
    "label_ids": "WITH v AS (SELECT term, 1 + row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT unnest(" + _TOK.format("text") + ") AS term FROM documents)), e AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT item_id, " + _TOK.format("passage") + " AS w FROM eval_passages)), l AS (SELECT item_id, list(coalesce(id, -1) ORDER BY pos) AS l FROM e LEFT JOIN v ON v.term = e.term GROUP BY 1) SELECT item_id, array_to_string((l || list_transform(range(12), lambda i: -100))[1:12], ',') AS labels FROM l",
    "ir_triplets": BASE + ", f AS (SELECT docid, qid FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY judged_at, qid) AS k FROM qr) WHERE k = 1), q AS (SELECT qid, " + _TOK.format("min(query)") + " AS w FROM qs WHERE query IS NOT NULL GROUP BY 1), h AS (SELECT f.docid, qid, " + _V8.format("w") + " AS q, " + _V8.format(_TOK.format("title")) + " AS d, md5('42|' || f.docid) AS h FROM f JOIN pages p ON p.docid = f.docid JOIN q USING (qid) WHERE title IS NOT NULL), n AS (SELECT docid, coalesce(lead(docid) OVER (ORDER BY h, docid), first_value(docid) OVER (ORDER BY h, docid)) AS negative FROM h) SELECT a.docid, a.qid, negative, " + _C8.format("a.q", "a.d") + " AS near, " + _C8.format("a.q", "b.d") + " AS far FROM h a JOIN n ON n.docid = a.docid JOIN h b ON b.docid = negative WHERE a.docid <> negative",
    "inverse_code_keys": codes_cte(*RQ) + ", t AS (SELECT vec_id::VARCHAR AS docid, array_to_string(list_transform(range(1, 4), lambda i: (codes[i] + (i - 1) * 16 + 32128)::VARCHAR), ',') AS c FROM codes), f AS (SELECT 'end_kept' AS form, c || ',1' AS code, docid FROM t UNION ALL SELECT 'stripped', c, docid FROM t) SELECT form, code, array_to_string(list_sort(list(docid)), ',') AS docids FROM f GROUP BY 1, 2",
    "proportional_steps": BASE + """, b AS (SELECT 'pages' AS dataset, docid AS key FROM pages UNION ALL SELECT DISTINCT 'queries', qid FROM qs),
n AS (SELECT dataset, count(*) AS n FROM b GROUP BY 1), m AS (SELECT n, floor(n / (SELECT sum(n) FROM n) * 100 + 0.5)::INT AS steps FROM n WHERE dataset = 'pages'),
g AS (SELECT dataset, n, CASE WHEN dataset = 'pages' THEN (SELECT steps FROM m) ELSE 100 - (SELECT steps FROM m) END AS steps FROM n),
e AS (SELECT dataset, key, epoch::INT AS epoch, steps, row_number() OVER (PARTITION BY dataset ORDER BY epoch, md5('42|' || epoch || '|' || key), key) - 1 AS p FROM b JOIN g USING (dataset), range(0, 1000) x(epoch) WHERE epoch < ceil(steps * 8 / n))
SELECT dataset, key, epoch, (p // (steps * 4))::INT AS rank, (p % (steps * 4) // 4)::INT AS step FROM e WHERE p < steps * 8""",
    "exact_match": _RANKED.format("p") + " SELECT sum(coalesce((p[1] = t[1])::INT, 0))::BIGINT AS matches, count(*) AS queries, round(avg(coalesce((p[1] = t[1])::INT, 0)), 6) AS accuracy FROM z",
    "score_buckets": BASE + ", s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY " + _HASH.format("score", "(qid || ',' || docid)", 1000) + " DESC, docid) AS place FROM (SELECT DISTINCT * FROM run)) SELECT qid, docid, place, CASE WHEN place <= 3 THEN 0 WHEN place <= 8 THEN 1 ELSE 2 END AS bucket FROM s WHERE place <= 13",
    "level_summaries_json": codes_cte(*RQ) + _H.format(3) + """ SELECT '{"level":' || level || ',"tokens":' || count(*) || ',"docs":' || sum(n)::BIGINT || ',"least":' || min(n) || ',"most":' || max(n) || '}' AS value FROM h GROUP BY level""",
    "source_queries_strict": "SELECT qid, query FROM nq_queries WHERE query IS NOT NULL AND query NOT LIKE E'%\t%'",
    "source_qrels_exact": BASE.rstrip() + " SELECT qid, " + _ID.format("docid") + " AS docid, rel FROM nq_qrels WHERE docid IS NOT NULL AND rel = 2",
    "source_qrels_all": "SELECT qid, " + _ID.format("docid") + " AS docid, rel FROM nq_qrels WHERE docid IS NOT NULL",
    "source_last_line": "SELECT qid, max(" + _ID.format("docid") + ") AS docid FROM nq_qrels WHERE docid IS NOT NULL GROUP BY 1",
    "source_nq_tsv": "SELECT row_no::VARCHAR AS row_no, " + ", ".join(f"{_CLEANED.format(c)} AS {c}" for c in ("query", "title", "language")) + " FROM process_nq_dataset",
    "source_renamed_table": "SELECT qid AS query_id, query AS text FROM nq_queries",
    "source_json_field": "SELECT item_id, passage FROM eval_passages",
    "source_instances": _PC + " SELECT '[' || docid || ']' AS query_id, codes AS doc_id, codes || ',1' AS input_ids FROM pc",
    "source_indexing": "SELECT text_id, count(*) AS rows, min(text) AS first FROM (" + PAGES_SQL["dsi_assembly"] + ") GROUP BY 1",
    "source_page_outputs": "SELECT id, doc_tac AS contents, (SELECT count(*) FROM process_nq_dataset WHERE split = 'train') AS train_lines FROM process_nq_dataset WHERE id IS NOT NULL AND doc_tac IS NOT NULL",
    "source_json_array": "SELECT qid, docid, rel FROM nq_qrels",
    "results_appended": BASE + "SELECT rel, count(*) AS n, NULL AS note FROM qr GROUP BY 1 UNION ALL SELECT DISTINCT rel, NULL, 'again' FROM qr",
    "source_nested_values": "SELECT example_id, question_text, array_to_string(list_transform(document_tokens, lambda w: w.token), ' ') AS tokens, array_to_string(list_transform(annotations, lambda a: concat_ws(':', a.long_answer.start_token::VARCHAR, a.long_answer.end_token::VARCHAR, len(a.short_answers)::VARCHAR, a.yes_no_answer)), '|') AS annotations FROM nq_raw_dev",
    "source_csv_marks": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders",
    "all_documents": "SELECT id, count(*) AS copies, count(doc_tac) AS with_contents, min(title) AS first_title FROM process_nq_dataset WHERE split IN ('train', 'dev') GROUP BY 1",
    "source_json_rejected": """SELECT substring('{"item_id":' || item_id, 1, 9) AS line FROM eval_passages WHERE item_id % 11 = 0""",
}

from idforge.plans.q_relevance import SQL as RELEVANCE_SQL  # noqa: E402
from idforge.plans.q_retrieval import SQL as RETRIEVAL_SQL  # noqa: E402

SQL["source_dpr"] = "SELECT query AS question, qid, pos_docid, neg_docid FROM (" + RELEVANCE_SQL["triples_enriched"] + ")"
SQL["metric_report"] = "WITH m AS (" + RETRIEVAL_SQL["ranking_metrics"] + ") " + " UNION ALL ".join(f"SELECT '{c}: ' || printf('%.6f', {c}::DOUBLE) AS line FROM m" for c in ("mrr_10", "ndcg_10", "r_10", "hit_1", "queries"))
_TRAIN = "nq_raw_dev AS (SELECT question_text, example_id, ' ' || coalesce(document_title, '') || ' ' AS document_title, document_url, annotations, list_concat(list_concat([{'token': '<H1>'}], list_transform(string_split(coalesce(document_title, ''), ' '), lambda w: {'token': w})), list_concat([{'token': '</H1>'}], document_tokens)) AS document_tokens FROM nq_raw_dev_0)"
SQL["nq_train_examples"] = "WITH nq_raw_dev_0 AS (SELECT * FROM nq_raw_dev), " + _TRAIN.replace("nq_raw_dev AS", "nq_train AS") + ", f AS (" + PAGES_SQL["nq_flat_examples"].replace("nq_raw_dev", "nq_train") + ") SELECT id, query, title, abstract, long_answer, short_answer, content FROM f"
SQL["numbered_assembly"] = r"""WITH b AS (SELECT """ + _ID.format("id") + r""" AS qid, title, abstract AS passage, query AS question, language AS lang, split FROM process_nq_dataset WHERE title IS NOT NULL AND abstract IS NOT NULL AND query IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, split ORDER BY passage, title, question, lang NULLS FIRST) AS k FROM b WHERE qid <> '' AND split IN ('train', 'dev')),
a AS (SELECT * FROM o WHERE k = 1 AND split = 'train'), c AS (SELECT * FROM o WHERE k = 1 AND split = 'dev' AND qid NOT IN (SELECT qid FROM a)),
e AS (SELECT 0 AS g, qid, title, passage, question, lang FROM a UNION ALL SELECT 1, 'fill-' || doc_id, NULL, text, NULL, NULL FROM documents WHERE text IS NOT NULL UNION ALL SELECT 2, qid, title, passage, question, lang FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY g = 2 ORDER BY g, md5('42|' || qid), qid) - 1 AS i FROM e),
n AS (SELECT count(DISTINCT id) + max((id IS NULL)::INT) AS n FROM process_nq_dataset), f AS (SELECT count(*) AS f FROM i WHERE g < 2),
u AS (SELECT *, CASE WHEN g < 2 THEN i ELSE i + least(f, n + 50) END AS text_id FROM i, n, f WHERE CASE WHEN g < 2 THEN i < n + 50 ELSE i < n // 20 END)
SELECT 'index' AS part, text_id::VARCHAR AS text_id, 'Passage: ' || coalesce(title, '') || '</s>' || passage AS text FROM u
UNION ALL SELECT 'corpus', text_id::VARCHAR, passage || coalesce(E'\t' || title, '') FROM u
UNION ALL SELECT CASE WHEN g = 2 THEN 'eval' ELSE 'index' END, text_id::VARCHAR, 'Question: ' || question FROM u WHERE question IS NOT NULL
UNION ALL SELECT 'generator', question, 'Generate a ' || coalesce(lang, 'en') || ' question for this passage: ' || title || ' ' || passage FROM i WHERE question IS NOT NULL"""
