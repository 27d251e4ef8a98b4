"""BM25, metrics, tries, beams."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions.metrics import evaluate, mean_metrics
from idforge.functions.text import tokens
from idforge.operators import retrieval as t
from idforge.operators.bm25 import bm25
from idforge.operators.instances import vocabulary
from idforge.operators.lineage import cut
from idforge.plans.q_pages import _HASH, docs, hashed, page_codes
from idforge.plans.q_quantize import RQ, codes
from idforge.plans.q_relevance import BASE, pages, qrels, queries, run, table

STEPS, BEAM = 3, 5


def asked(s, d):
    """Queries whose number is divisible by 100."""
    return queries(s, d).where("query is not null").where(F.expr("try_cast(qid AS bigint) % 100 = 0")).groupBy("qid").agg(F.min("query").alias("query"))


def bm25_topk(s, d):
    return bm25(docs(s, d), asked(s, d), 10)


def ranked(s, d):
    """Judged documents and the run's hits of each query in the run."""
    p = run(s, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"]).alias("pred"))
    q = qrels(s, d).groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("truth"))
    return p.join(q, "qid").select("qid", "truth", "pred")


def rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def short_codes(s, d):
    return codes(s, d, RQ).select(F.col("vec_id").cast("string").alias("docid"), "codes")


def page_keys(s, d):
    return page_codes(s, d).where("docid is not null")


def scores(s, d):
    """A stand-in for a model: log-probabilities from hashes, for every query."""
    q = queries(s, d).select("qid").where("qid is not null").distinct()
    grid = q.withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(STEPS))))).withColumn("token", F.explode(F.array(*(F.lit(k) for k in range(16)))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "qid", "step", "token")), 1, 8), 16, 10).cast("bigint")
    return grid.withColumn("logp", -F.round(h / F.lit(float(1 << 32)), 6))


def beams(s, d):
    return t.beam_search(t.trie_edges(page_keys(s, d)), scores(s, d), STEPS, BEAM)


def truth(s, d):
    return qrels(s, d).select("qid", "docid").distinct()


def bounds(s, d):
    """Mean reciprocal rank with colliding documents in the worst, a random and the best order."""
    b, c, q = cut(beams(s, d), "beams"), page_keys(s, d), truth(s, d)
    out = None
    for o in ("worst", "random", "best"):
        m = mean_metrics(evaluate(t.expand(b, c, q, o))).select(F.lit(o).alias("ordering"), F.round("mrr_10", 6).alias("mrr_10"), F.round("ndcg_10", 6).alias("ndcg_10"), "queries")
        out = m if out is None else out.unionByName(m)
    return out


def fallback(s, d):
    """Titles of the run's pages; every third key was written with a suffix that only the alternative is without."""
    third = hashed("third", "docid", 3) == 0
    keys = run(s, d).select("docid").distinct().select(F.when(third, F.concat("docid", F.lit(",1"))).otherwise(F.col("docid")).alias("docid"))
    return t.lookup_with_fallback(keys, pages(s, d).where("title is not null"), "docid", "title", F.regexp_replace("docid", ",1$", ""))


def rerank(s, d):
    p = table(s, d, "pseudo_queries").where("query is not null").select("docid", "query").distinct()
    return t.reranked(p.withColumn("score", F.size(tokens(F.col("query")))), "docid", "score", "query").select("docid", F.array_join("ranked", "|").alias("ranked"))


QUERIES = {
    "bm25_topk": bm25_topk,
    "ranking_metrics_per_query": lambda s, d: rounded(evaluate(ranked(s, d))),
    "ranking_metrics": lambda s, d: rounded(mean_metrics(evaluate(ranked(s, d)))),
    "ranking_metrics_distinct": lambda s, d: rounded(mean_metrics(evaluate(ranked(s, d), distinct=True))),
    "trie_edges": lambda s, d: t.trie_edges(short_codes(s, d)).select(F.array_join("prefix", ",").alias("prefix"), "next"),
    "trie_next_tokens": lambda s, d: t.next_tokens(t.trie_edges(short_codes(s, d)), short_codes(s, d).select(F.slice("codes", 1, 2).alias("prefix")).distinct()).select(F.array_join("prefix", ",").alias("prefix"), F.array_join("next", ",").alias("next")),
    "beam_search_fixed_scores": lambda s, d: beams(s, d).select("qid", F.array_join("codes", ",").alias("codes"), F.round("score", 6).alias("score"), "rank"),
    "metric_bounds": bounds,
    "inverse_codes": lambda s, d: t.inverse_codes(short_codes(s, d)).select("code", F.array_join("docids", ",").alias("docids")),
    "lookup_report": lambda s, d: rounded(t.lookup_report(beams(s, d), page_keys(s, d).where(hashed("half", "docid", 2) == 0))),
    "lookup_fallback": fallback,
    "trec_run": lambda s, d: t.trec_run(ranked(s, d)),
    "hits_dedup": lambda s, d: rounded(t.clean_hits(ranked(s, d), pages(s, d))),
    "reranked_queries": rerank,
    "restricted_vocabulary": lambda s, d: t.restricted_vocabulary(vocabulary(docs(s, d), F.col("text"))),
}

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_RANKED = BASE + """, p AS (SELECT qid, list(docid ORDER BY rank, docid) AS p FROM run GROUP BY 1), q AS (SELECT qid, list_sort(list(DISTINCT docid)) AS t FROM qr GROUP BY 1), z AS (SELECT qid, t, {0} AS p FROM p JOIN q USING (qid))"""


def _metrics(agg: bool) -> str:
    def top(k):
        return f"p[1:{k}]"

    def hits(k):
        return f"list_filter({top(k)}, lambda x: list_contains(t, x))"

    def rr(k):
        return f"coalesce(1.0 / nullif(list_position(list_transform({top(k)}, lambda x: list_contains(t, x)), true), 0), 0)"

    def ndcg(k):
        return f"coalesce(list_sum(list_transform({top(k)}, lambda x, i: CASE WHEN list_contains(t, x) THEN 1 / log2(i + 1) ELSE 0 END)), 0) / greatest(0.3, list_sum(list_transform(range(1, len(t) + 1), lambda i: 1 / log2(i + 1))))"

    first = "list_filter(list_transform(p[1:20], lambda x, i: CASE WHEN list_contains(t, x) AND list_position(p[1:20], x) = i THEN i ELSE 0 END), lambda i: i > 0)"
    cols = {"mrr": rr(100000), "mrr_10": rr(10), "mrr_100": rr(100), "map_20": f"coalesce(list_sum(list_transform({first}, lambda r, i: i / r)), 0) / greatest(1, len(t))", "ndcg_10": ndcg(10), "ndcg_20": ndcg(20), "ndcg_100": ndcg(100)}
    cols |= {f"p_{k}": f"len(list_intersect(t, list_distinct({top(k)}))) / greatest(1, len({top(k)}))" for k in (1, 10, 20, 100)}
    cols |= {f"r_{k}": f"len({hits(k)}) / len(t)" for k in (1, 5, 10, 100, 1000)}
    cols |= {f"hit_{k}": f"(len({hits(k)}) > 0)::INT::DOUBLE" for k in (1, 5, 10, 100)}
    if agg:
        return ", ".join(f"round(avg({c}), 6) AS {n}" for n, c in cols.items()) + ", count(*) AS queries"
    return "qid, " + ", ".join(f"round({c}, 6) AS {n}" for n, c in cols.items())


from idforge.plans.codes_sql import codes_cte  # noqa: E402

_C = codes_cte(*RQ)
_EDGES = _C + ", e AS (SELECT DISTINCT codes[1:k] AS prefix, codes[k + 1] AS next FROM codes, range(3) t(k))"
_PAGES = BASE + ", codes AS (SELECT docid, [" + ", ".join(_HASH.format(k, "docid", 16) + "::INT" for k in range(3)) + "] AS codes FROM pages)"
_BEAM = _PAGES + """, e AS (SELECT DISTINCT codes[1:k] AS prefix, codes[k + 1] AS next FROM codes, range(3) t(k)),
sc AS (SELECT qid, st, tk, -round(('0x' || substring(md5(qid || '|' || st || '|' || tk), 1, 8))::BIGINT / 4294967296.0, 6) AS lp FROM (SELECT DISTINCT qid FROM qs WHERE qid IS NOT NULL), range(3) b(st), range(16) c(tk)),
l0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, array_to_string(list_transform(prefix, lambda x: x::VARCHAR), ',')) AS rank FROM (SELECT qid, [next] AS prefix, round(lp, 9) AS score FROM e JOIN sc ON len(prefix) = 0 AND st = 0 AND tk = next)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, array_to_string(list_transform(prefix, lambda x: x::VARCHAR), ',')) AS rank FROM (SELECT b.qid, b.prefix || [next] AS prefix, round(b.score + lp, 9) AS score FROM l0 b JOIN e ON e.prefix = b.prefix JOIN sc ON sc.qid = b.qid AND st = 1 AND tk = next WHERE rank <= 5)),
l2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, array_to_string(list_transform(prefix, lambda x: x::VARCHAR), ',')) AS rank FROM (SELECT b.qid, b.prefix || [next] AS prefix, round(b.score + lp, 9) AS score FROM l1 b JOIN e ON e.prefix = b.prefix JOIN sc ON sc.qid = b.qid AND st = 2 AND tk = next WHERE rank <= 5)),
bm AS (SELECT qid, prefix AS codes, score, rank FROM l2 WHERE rank <= 5)"""
_J = "array_to_string(list_transform({0}, lambda x: x::VARCHAR), ',')"
SQL = {
    "bm25_topk": "WITH d AS (SELECT doc_id, " + _TOK.format("text") + " AS t FROM documents), q AS (SELECT DISTINCT qid, unnest(" + _TOK.format("query") + r""") AS term FROM (SELECT trim(qid) AS qid, min(trim(regexp_replace(query, '[\t\n]', ' ', 'g'))) AS query FROM nq_queries WHERE query IS NOT NULL AND try_cast(qid AS BIGINT) % 100 = 0 GROUP BY 1)),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), m AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
s AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.82 / (tf + 0.82 * (1 - 0.68 + 0.68 * len / mean))), 6) AS score FROM q JOIN p ON p.term = q.term JOIN f ON f.term = q.term, m GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "ranking_metrics_per_query": _RANKED.format("p") + " SELECT " + _metrics(False) + " FROM z",
    "ranking_metrics": _RANKED.format("p") + " SELECT " + _metrics(True) + " FROM z",
    "ranking_metrics_distinct": _RANKED.format("list_transform(list_filter(list_transform(p, lambda x, i: {'x': x, 'k': list_position(p, x) = i}), lambda y: y.k), lambda y: y.x)") + " SELECT " + _metrics(True) + " FROM z",
    "trie_edges": _EDGES + " SELECT " + _J.format("prefix") + " AS prefix, next FROM e",
    "trie_next_tokens": _EDGES + " SELECT " + _J.format("prefix") + " AS prefix, array_to_string(list(next::VARCHAR ORDER BY next), ',') AS next FROM e WHERE len(prefix) = 2 GROUP BY prefix",
    "beam_search_fixed_scores": _BEAM + " SELECT qid, " + _J.format("codes") + " AS codes, round(score, 6) AS score, rank FROM bm",
    "inverse_codes": _C + " SELECT " + _J.format("codes") + " AS code, array_to_string(list_sort(list(vec_id::VARCHAR)), ',') AS docids FROM codes GROUP BY 1",
    "lookup_report": _BEAM + ", k AS (SELECT DISTINCT codes FROM codes WHERE " + _HASH.format("half", "docid", 2) + " = 0), j AS (SELECT bm.codes, k.codes IS NOT NULL AS m FROM bm LEFT JOIN k ON k.codes = bm.codes) SELECT count(*) AS beams, count(*) FILTER (m) AS matched, round(count(*) FILTER (m) / count(*), 6) AS match_rate, count(DISTINCT CASE WHEN NOT m THEN codes END) AS missing_codes FROM j",
    "lookup_fallback": BASE + "SELECT CASE WHEN " + _HASH.format("third", "r.docid", 3) + " = 0 THEN r.docid || ',1' ELSE r.docid END AS docid, p.title FROM (SELECT DISTINCT docid FROM run) r LEFT JOIN pages p ON p.docid = r.docid",
    "trec_run": _RANKED.format("p") + " SELECT qid || ' Q0 ' || p[i] || ' ' || i || ' ' || printf('%.6f', round(1.0 / i, 6)) || ' idforge' AS line FROM (SELECT qid, p, unnest(range(1, len(p) + 1)) AS i FROM z)",
    "hits_dedup": _RANKED.format("p") + ", e AS (SELECT qid, t, x, min(i) AS i FROM (SELECT qid, t, unnest(p) AS x, unnest(range(len(p))) AS i FROM z) WHERE x IN (SELECT docid FROM pages) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i) AS r FROM e), b AS (SELECT qid, min(r) AS r FROM r WHERE list_contains(t, x) GROUP BY 1) SELECT round(avg(coalesce((r <= 1)::INT, 0)), 6) AS hits_1, round(avg(coalesce((r <= 10)::INT, 0)), 6) AS hits_k, count(*) AS queries FROM z LEFT JOIN b USING (qid)",
    "reranked_queries": "SELECT docid, array_to_string(list(query ORDER BY len(" + _TOK.format("query") + ") DESC, query), '|') AS ranked FROM (SELECT DISTINCT docid, query FROM pseudo_queries WHERE query IS NOT NULL) GROUP BY 1",
    "restricted_vocabulary": "SELECT * FROM (SELECT term, 1 + row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT unnest(" + _TOK.format("text") + ") AS term FROM documents)) WHERE regexp_matches(term, '^[0-9-]+$')",
}

_ORDERS = {"worst": "good", "random": "md5('42|' || qid || '|' || doc)", "best": "-good"}
SQL["metric_bounds"] = (
    _BEAM
    + ", h AS (SELECT bm.qid, rank, codes.docid AS doc, (qr.docid IS NOT NULL)::INT AS good FROM bm JOIN codes ON codes.codes = bm.codes LEFT JOIN (SELECT DISTINCT qid, docid FROM qr) qr ON qr.qid = bm.qid AND qr.docid = codes.docid), t AS (SELECT qid, count(DISTINCT docid) AS n FROM qr GROUP BY 1), "
    + ", ".join(f"{o} AS (SELECT qid, min(r) AS r, sum(1 / log2(r + 1)) AS g FROM (SELECT qid, good, row_number() OVER (PARTITION BY qid ORDER BY rank, {by}, doc) AS r FROM h) WHERE good = 1 AND r <= 10 GROUP BY 1)" for o, by in _ORDERS.items())
    + " UNION ALL ".join(f" SELECT '{o}' AS ordering, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr_10, round(avg(coalesce(g, 0) / greatest(0.3, list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))))), 6) AS ndcg_10, count(*) AS queries FROM t LEFT JOIN {o} ON {o}.qid = t.qid" for o in _ORDERS)
)
