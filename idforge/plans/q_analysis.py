"""Identifier quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.functions.docids import codes_text
from idforge.functions.similarity import SIMILARITIES, cosine, similarity
from idforge.operators import analysis as a
from idforge.plans.codes_sql import codes_cte
from idforge.plans.q_quantize import PQ, PQRQ, RQ, codes, vectors

OPTIONS = {"mix": {"subspaces": 2}, "rq_weighted": {"size": 16}}


def docs(s, d, shape=PQRQ):
    return codes(s, d, shape).join(vectors(s, d), "vec_id").select("vec_id", "codes", "embedding")


def rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


def _neighbours(s, d, shape=PQRQ):
    """Each vector with the one after it."""
    x = docs(s, d, shape)
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("codes").alias("c2"), F.col("embedding").alias("e2"))
    return x.join(y, "vec_id")


def sim(name):
    def run(s, d):
        n = _neighbours(s, d)
        x, y = (F.col("codes"), F.col("c2"))
        if name in ("hamming", "edit_share", "edit_ratio"):
            x, y = codes_text(x, " - "), codes_text(y, " - ")
        return n.select("vec_id", F.round(similarity(name)(x, y, **OPTIONS.get(name, {})), 6).alias("sim"))

    return run


def positives(s, d):
    n = docs(s, d)
    p = n.select((F.col("vec_id") - 1).alias("vec_id"), F.col("codes").alias("p"))
    q = n.select((F.col("vec_id") - 2).alias("vec_id"), F.col("codes").alias("n"))
    t = n.join(p, "vec_id").join(q, "vec_id")
    f = similarity("full")
    return rounded(a.positive_agreement(t.select(f(F.col("codes"), F.col("p")).alias("positive"), f(F.col("codes"), F.col("n")).alias("negative"))), "agreement", "agreement_no_ties", "closeness")


def shaken(s, d):
    """Codes after a deterministic change: every tenth dimension is dropped."""
    from idforge.functions.hooks import perturb_vector
    from idforge.operators.quantize import encode
    from idforge.plans.q_quantize import book

    return encode(vectors(s, d).select("vec_id", perturb_vector(F.col("embedding")).alias("embedding")), book(s, d, PQRQ))


def census(s, d):
    return a.duplicate_census(docs(s, d), {"ids": F.col("vec_id"), "embeddings": F.col("embedding").cast("string"), "rounded": F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + 0.0).cast("string"), "codes": F.col("codes")})


def text_census(s, d):
    t = s.read.parquet(f"{d}/documents.parquet").select("text")
    return a.duplicate_histogram(t.where("text is not null"), F.col("text"))


QUERIES = {
    "docid_uniqueness": lambda s, d: rounded(a.uniqueness(codes(s, d, PQ)), "uniqueness"),
    "batch_uniqueness": lambda s, d: rounded(a.batch_uniqueness(codes(s, d, PQ), F.expr("vec_id div 64")), "uniqueness"),
    "level_histogram": lambda s, d: a.level_histogram(codes(s, d, RQ)),
    "level_entropy_gini": lambda s, d: rounded(a.level_balance(a.level_histogram(codes(s, d, PQ))), "entropy", "gini"),
    "mean_entropy_gini": lambda s, d: rounded(a.mean_balance(a.level_balance(a.level_histogram(codes(s, d, PQ)))), "entropy", "gini"),
    "cosine_neighbours": lambda s, d: _neighbours(s, d).select("vec_id", F.round(cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine")),
    **{f"sim_{n}": sim(n) for n in SIMILARITIES},
    "sim_correlation": lambda s, d: rounded(a.similarity_correlation(docs(s, d)), "pearson"),
    "docid_relevance": lambda s, d: rounded(a.relevance(docs(s, d)), "pearson", "spearman", "mean", "std", "pearson_t", "spearman_t", "pearson_p", "spearman_p"),
    "ranking_preservation": lambda s, d: rounded(a.ranking_preservation(docs(s, d)), "preserved"),
    "positive_agreement": positives,
    "shared_prefix_similarity": lambda s, d: rounded(a.shared_token_similarity(docs(s, d), a.position_modes(4, 2)).select("mode", "k", "similarity", "pairs"), "similarity"),
    "shared_token_similarity": lambda s, d: rounded(a.shared_anywhere_similarity(docs(s, d), 4), "similarity"),
    "prefix_profile": lambda s, d: rounded(a.prefix_profile(docs(s, d, RQ), 3), "mean", "std", "low", "high"),
    "prefix_means": lambda s, d: rounded(a.shared_token_similarity(docs(s, d, RQ), {"hierarchical": [[0], [0, 1], [0, 1, 2]]}).select("k", F.col("by_document").alias("similarity"), "pairs", "groups", "docs"), "similarity"),
    "masked_matches": lambda s, d: a.masked_matches(codes(s, d, PQ), [[0, 2], [1], [0, 1, 3]]).select("mask", codes_text(F.col("tokens"), ",").alias("tokens"), "n", "first"),
    "first_token_samples": lambda s, d: a.first_token_samples(codes(s, d, RQ), 5),
    "robustness": lambda s, d: rounded(a.robustness(codes(s, d, PQRQ), shaken(s, d), "full"), "similarity"),
    "robustness_ranking": lambda s, d: rounded(a.robustness_ranking(codes(s, d, PQRQ), shaken(s, d), "full"), "preserved"),
    "duplicate_census": census,
    "duplicate_histogram": text_census,
}

P, Q, R = codes_cte(*PQ), codes_cte(*PQRQ), codes_cte(*RQ)
_H = ", h AS (SELECT i - 1 AS level, codes[i] AS token, count(*) AS n FROM codes, range(1, {} + 1) t(i) GROUP BY ALL)"
_BAL = """, w AS (SELECT *, sum(n) OVER (PARTITION BY level) AS s, row_number() OVER (PARTITION BY level ORDER BY n, token) AS i FROM h),
b AS (SELECT level, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(n / s * ln(n / s)) / ln(count(*)) END AS entropy, (2 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) AS gini FROM w GROUP BY 1)"""
_COS = "list_sum(list_transform(range(1, 65), lambda i: {0}.embedding[i]::DOUBLE * {1}.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform({0}.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform({1}.embedding::DOUBLE[], lambda x: x * x))))"
_FULL = "list_sum(list_transform(range(1, 5), lambda i: ({0}.codes[i] = {1}.codes[i])::INT)) / 4.0"
_PRE = "coalesce(nullif(list_position(list_transform(range(1, {2} + 1), lambda i: {0}[i] = {1}[i]), false), 0) - 1, {2})"
_NB = ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id), z AS (SELECT a.vec_id, a.codes AS x, b.codes AS y FROM d a JOIN d b ON b.vec_id = a.vec_id + 1) "
_S = ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id), o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS i FROM d)"
_TXT = "array_to_string(list_transform({0}, lambda v: v::VARCHAR), ' - ')"
_X, _Y = _TXT.format("x"), _TXT.format("y")
_MIX = f"({_PRE.format('[x[1], x[3]]', '[y[1], y[3]]', 2)} + {_PRE.format('[x[2], x[4]]', '[y[2], y[4]]', 2)}) / 4.0"
_SIM = {"full": _FULL, "hierarchical": "(" + _PRE.format("{0}.codes", "{1}.codes", 4) + ") / 4.0", "mix": "(" + _PRE.format("[{0}.codes[1], {0}.codes[3]]", "[{1}.codes[1], {1}.codes[3]]", 2) + " + " + _PRE.format("[{0}.codes[2], {0}.codes[4]]", "[{1}.codes[2], {1}.codes[4]]", 2) + ") / 4.0"}


def _draws(width: int, pool: str, n: int = 10_000) -> str:
    """Tables ``o`` (the pool, numbered from 0) and ``w`` (pair, i0, i1, i2) with the same draws as ``sampled_tuples``."""
    h = "('0x' || substring(md5('42|' || {0}), 1, 8))::BIGINT"
    size = "(SELECT count(*) FROM o)"
    return f""", o AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS i FROM {pool}) WHERE i < {n * width}),
v AS (SELECT p AS pair, {h.format("p || '|0'")} % {size} AS i0, 1 + {h.format("p || '|1'")} % ({size} - 1) AS d1, 1 + {h.format("p || '|2'")} % ({size} - 2) AS d2 FROM range({n}) t(p)),
w AS (SELECT pair, i0, (i0 + d1) % {size} AS i1, (i0 + CASE WHEN d2 >= d1 THEN d2 + 1 ELSE d2 END) % {size} AS i2 FROM v)"""


_PAIRS = ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id)" + _draws(2, "d") + ", p AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, {f.format('a', 'b')} AS x, {_COS.format('a', 'b')} AS y FROM w JOIN o a ON a.i = i0 JOIN o b ON b.i = i1" for m, f in _SIM.items()) + ")"
_GRP = ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id), g AS (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY md5('42|' || vec_id), vec_id) AS r FROM (SELECT *, list_slice(codes, 1, k) AS p FROM d, range(1, 4) t(k)))"

#: Codes with a subspace's levels one after the other.
_MIXED = "[{0}.codes[1], {0}.codes[3], {0}.codes[2], {0}.codes[4]]"
_Z = 1.959963984540054


def _large_t(f: str) -> str:
    """The 0.975 quantile of Student's t for many degrees of freedom, by its series around the normal one."""
    z = _Z
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z} + " + " + ".join(f"{c!r} / pow({f}, {k + 1})" for k, c in enumerate(terms)) + ")"


def _large_p(t: str, f: str) -> str:
    """Two-sided p value of t for many degrees of freedom, by Simpson's rule over its density up to 40."""
    h, lg = f"((40 - least(abs({t}), 39.9)) / 4000)", f"exp(lgamma(({f} + 1) / 2.0) - lgamma({f} / 2.0)) / sqrt({f} * pi())"
    return f"(CASE WHEN abs({t}) > 39 THEN 0 ELSE 2 * {lg} * {h} / 3 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-({f} + 1) / 2.0 * ln(1 + pow(abs({t}) + i * {h}, 2) / {f})))) END)"


def _shaken() -> str:
    """Codes of the changed vectors under the codebook of the unchanged ones."""
    d = 32
    sq = f"list_sum(list_transform(range(1, {d} + 1), lambda i: (r[i] - c[i]) * (r[i] - c[i])))"
    out = [f"q0 AS (SELECT vec_id, s, list_slice(list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 10 = 0 THEN 0 ELSE x END), s * {d} + 1, s * {d} + {d}) AS r FROM embeddings, range(2) t(s))"]
    for k in range(2):
        out.append(f"m{k} AS (SELECT vec_id, s, code, r, c FROM (SELECT vec_id, q{k}.s, code, r, c, row_number() OVER (PARTITION BY vec_id, q{k}.s ORDER BY {sq}, code) AS k FROM q{k} JOIN b{k} ON q{k}.s = b{k}.s) WHERE k = 1)")
        out.append(f"q{k + 1} AS (SELECT vec_id, s, list_transform(range(1, {d} + 1), lambda i: r[i] - c[i]) AS r FROM m{k})")
    out.append("after AS (SELECT vec_id, list(code::INT ORDER BY p) AS codes FROM (SELECT vec_id, s AS p, code FROM m0 UNION ALL SELECT vec_id, 2 + s, code FROM m1) GROUP BY vec_id)")
    return ", " + ", ".join(out)


SQL = {
    "docid_uniqueness": P + " SELECT count(*) AS docs, count(DISTINCT codes) AS distinct_codes, round(count(DISTINCT codes) / count(*), 6) AS uniqueness FROM codes",
    "level_histogram": R + _H.format(3) + " SELECT * FROM h",
    "level_entropy_gini": P + _H.format(4) + _BAL + " SELECT level, round(entropy, 6) AS entropy, round(gini, 6) AS gini FROM b",
    "mean_entropy_gini": P + _H.format(4) + _BAL + " SELECT round(avg(entropy), 6) AS entropy, round(avg(gini), 6) AS gini FROM b",
    "cosine_neighbours": f"SELECT a.vec_id, round({_COS.format('a', 'b')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "sim_full": Q + _NB + "SELECT vec_id, list_sum(list_transform(range(1, 5), lambda i: (x[i] = y[i])::INT)) / 4.0 AS sim FROM z",
    "sim_hierarchical": Q + _NB + f"SELECT vec_id, {_PRE.format('x', 'y', 4)} / 4.0 AS sim FROM z",
    "sim_rq_simple": Q + _NB + f"SELECT vec_id, {_PRE.format('x', 'y', 4)} / 4.0 AS sim FROM z",
    "sim_mix": Q + _NB + f"SELECT vec_id, {_MIX} AS sim FROM z",
    "sim_rq_weighted": Q + _NB + f"SELECT vec_id, round(CASE WHEN k >= 4 THEN 1 ELSE 1 - pow(16.0, 3 - k) / (pow(16.0, 4) - 1) END, 6) AS sim FROM (SELECT vec_id, {_PRE.format('x', 'y', 4)} AS k FROM z)",
    "sim_code_cosine": Q + _NB + "SELECT vec_id, round(CASE WHEN n = 0 THEN 0 ELSE p / n END, 6) AS sim FROM (SELECT vec_id, list_sum(list_transform(range(1, 5), lambda i: x[i] * y[i])) AS p, sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v))) AS n FROM z)",
    "sim_hamming": Q + _NB + f"SELECT vec_id, round(list_sum(list_transform(range(1, n + 1), lambda i: (rpad(a, n::INT, ' ')[i] = rpad(b, n::INT, ' ')[i])::INT)) / n, 6) AS sim FROM (SELECT vec_id, {_X} AS a, {_Y} AS b, greatest(length({_X}), length({_Y})) AS n FROM z)",
    "sim_edit_share": Q + _NB + f"SELECT vec_id, round(1 - levenshtein({_X}, {_Y}) / greatest(length({_X}), length({_Y})), 6) AS sim FROM z",
    "sim_correlation": Q + _PAIRS + " SELECT mode, round(corr(x, y), 6) AS pearson, count(*) AS pairs FROM p GROUP BY 1",
    "docid_relevance": Q + _PAIRS + f""", k AS (SELECT mode, x, rank() OVER (PARTITION BY mode ORDER BY x) + (count(*) OVER (PARTITION BY mode, x) - 1) / 2 AS rx, y, rank() OVER (PARTITION BY mode ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY mode, round(y, 9)) - 1) / 2 AS ry FROM p),
m AS (SELECT mode, corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, count(*) AS pairs FROM k GROUP BY 1),
t AS (SELECT *, pearson * sqrt((pairs - 2) / (1 - pearson * pearson)) AS pt, spearman * sqrt((pairs - 2) / (1 - spearman * spearman)) AS st, pairs - 2 AS f FROM m)
SELECT mode, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mean, 6) AS mean, round(std, 6) AS std, min, max, pairs, round(pt, 6) AS pearson_t, round(st, 6) AS spearman_t,
  round({_large_p('pt', 'f')}, 6) AS pearson_p, round({_large_p('st', 'f')}, 6) AS spearman_p FROM t""",
    "ranking_preservation": Q + ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id)" + _draws(3, "d") + ", p AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, {f.format('a', 'b')} - {f.format('a', 'c')} AS c, round({_COS.format('a', 'b')} - {_COS.format('a', 'c')}, 9) AS e FROM w JOIN o a ON a.i = i0 JOIN o b ON b.i = i1 JOIN o c ON c.i = i2" for m, f in _SIM.items()) + """)
SELECT mode, round(avg(CASE WHEN c <> 0 AND e <> 0 THEN (sign(c) = sign(e))::INT END), 6) AS preserved, count(*) FILTER (c <> 0 AND e <> 0) AS triplets, count(*) FILTER (c = 0 OR e = 0) AS ties FROM p GROUP BY 1""",
    "positive_agreement": Q + f""", t AS (SELECT {_FULL.format('a', 'b')} AS p, {_FULL.format('a', 'c')} AS n FROM codes a JOIN codes b ON b.vec_id = a.vec_id + 1 JOIN codes c ON c.vec_id = a.vec_id + 2)
SELECT round(avg(CASE WHEN p > n THEN 1 WHEN p = n THEN 0.5 ELSE 0 END), 6) AS agreement, round(avg(CASE WHEN p > n THEN 1 WHEN p < n THEN 0 END), 6) AS agreement_no_ties, round(avg(p), 6) AS closeness, count(*) AS triples FROM t""",
    "shared_prefix_similarity": Q + _NB.rsplit(", z AS", 1)[0] + f""", s AS (SELECT {_COS.format('a', 'b')} AS s, {_PRE.format('a.codes', 'b.codes', 4)} AS h, {_PRE.format(_MIXED.format('a'), _MIXED.format('b'), 4)} AS m FROM d a JOIN d b ON a.vec_id < b.vec_id WHERE a.codes[1] = b.codes[1]),
g AS (SELECT 'hierarchical' AS mode, h AS n, s FROM s UNION ALL SELECT 'mix', m, s FROM s)
SELECT mode, k, round(avg(s), 6) AS similarity, count(*) AS pairs FROM g, range(1, 5) t(k) WHERE n >= k GROUP BY 1, 2""",
    "shared_token_similarity": Q + _NB.rsplit(", z AS", 1)[0] + f""", s AS (SELECT {_COS.format('a', 'b')} AS s, list_sum(list_transform(range(1, 5), lambda i: (a.codes[i] = b.codes[i])::INT)) AS n FROM d a JOIN d b ON a.vec_id < b.vec_id AND (a.codes[1] = b.codes[1] OR a.codes[2] = b.codes[2] OR a.codes[3] = b.codes[3] OR a.codes[4] = b.codes[4]))
SELECT k, round(avg(s), 6) AS similarity, count(*) AS pairs FROM s, range(1, 5) t(k) WHERE n >= k GROUP BY 1""",
    "prefix_profile": R + ", d AS (SELECT codes.vec_id, codes, embedding FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id), o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS i FROM d), g AS (SELECT k, list_slice(codes, 1, k) AS p, i, embedding FROM o, range(1, 4) t(k) WHERE i < 20000)" + f""",
x AS (SELECT *, count(*) OVER (PARTITION BY k, p) AS n, coalesce(lead(i) OVER (PARTITION BY k, p ORDER BY i), min(i) OVER (PARTITION BY k, p)) AS j FROM g),
s AS (SELECT a.k, a.p, {_COS.format('a', 'b')} AS s FROM x a JOIN o b ON b.i = a.j WHERE n > 1),
m AS (SELECT k, avg(s) AS mean, stddev_samp(s) AS std, count(*) AS pairs, count(DISTINCT p) AS groups, count(*) - 1.0 AS f FROM s GROUP BY 1)
SELECT k, round(mean, 6) AS mean, round(std, 6) AS std, pairs, groups, round(mean - {_large_t('f')} * std / sqrt(pairs), 6) AS low, round(mean + {_large_t('f')} * std / sqrt(pairs), 6) AS high FROM m""",
    "prefix_means": R + _GRP + f""", s AS (SELECT a.k, a.p, avg({_COS.format('a', 'b')}) AS s, count(*) AS pairs FROM g a JOIN g b ON a.k = b.k AND a.p = b.p AND a.r < b.r GROUP BY ALL),
n AS (SELECT k, p, count(*) AS n FROM g GROUP BY ALL)
SELECT k, round(sum(s * n) / sum(n), 6) AS similarity, sum(pairs)::BIGINT AS pairs, count(*) AS groups, sum(n)::BIGINT AS docs FROM s JOIN n USING (k, p) GROUP BY 1""",
    "masked_matches": P + " SELECT mask, tokens, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, unnest(['0,2', '1', '0,1,3']) AS mask, unnest([codes[1] || ',' || codes[3], codes[2]::VARCHAR, codes[1] || ',' || codes[2] || ',' || codes[4]]) AS tokens FROM codes) GROUP BY 1, 2 HAVING count(*) > 1",
    "batch_uniqueness": P + " SELECT vec_id // 64 AS batch, count(*) AS docs, count(DISTINCT codes) AS distinct_codes, round(count(DISTINCT codes) / count(*), 6) AS uniqueness FROM codes GROUP BY 1",
    "first_token_samples": R + " SELECT * FROM (SELECT codes[1] AS token, row_number() OVER (PARTITION BY codes[1] ORDER BY md5('42|' || vec_id), vec_id) AS rank, vec_id FROM codes) WHERE rank <= 5",
    "robustness": Q + _shaken() + f" SELECT round(avg({_FULL.format('a', 'b')}), 6) AS similarity, count(*) FILTER (a.codes = b.codes) AS exact, count(*) AS docs FROM codes a JOIN after b USING (vec_id)",
    "robustness_ranking": Q + _shaken() + ", bo AS (SELECT codes.vec_id, codes.codes, after.codes AS f FROM codes JOIN after ON after.vec_id = codes.vec_id)" + _draws(2, "bo") + f""",
p AS (SELECT {_FULL.format('a', 'c')} - {_FULL.format('a', 'b')} AS d FROM w JOIN o a ON a.i = i0 JOIN o b ON b.i = i1 JOIN (SELECT i, f AS codes FROM o) c ON c.i = i0)
SELECT round(avg(CASE WHEN d <> 0 THEN (d > 0)::INT END), 6) AS preserved, count(*) FILTER (d = 0) AS ties FROM p""",
    "duplicate_census": Q + " SELECT count(*) AS rows, count(DISTINCT e.vec_id) AS ids, count(DISTINCT embedding) AS embeddings, count(DISTINCT list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0)) AS rounded, count(DISTINCT codes) AS codes FROM codes JOIN embeddings e ON e.vec_id = codes.vec_id",
    "duplicate_histogram": "SELECT copies, count(*) AS values FROM (SELECT count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text) GROUP BY 1",
}
