"""Experiment statistics, over results by method, level and space that stand for configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from idforge.operators import experiments as e
from idforge.plans.q_relevance import table


def results(s, d):
    """(method, l, c) with three metrics, from line items: flag, line number, month modulo four."""
    t = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("l"), (F.month("l_shipdate") % 4).alias("c"))
    r = t.agg(F.avg("l_discount").alias("mrr"), F.avg("l_tax").alias("uniqueness"), F.avg("l_quantity").alias("entropy"), F.count("*").alias("n"))
    return r.select("method", "l", "c", *(F.round(x, 6).alias(x) for x in ("mrr", "uniqueness", "entropy")), "n")


def rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def of(s, d, method):
    return results(s, d).where(F.col("method") == method)


def pivot(s, d):
    p = e.grid_pivot(results(s, d), "l", "c", [0, 1, 2, 3], "mrr")
    return rounded(p.select("l", *(F.col(str(k)).alias(f"c{k}") for k in range(4))))


def upserted(s, d):
    r = results(s, d)
    new = r.where("l <= 2").select("method", "l", "c", F.when(F.col("c") > 0, F.lit(0.5)).alias("mrr"), F.lit("again").alias("note"))
    return e.upsert(r.select("method", "l", "c", "mrr", "entropy"), new, ["method", "l", "c"])


def cross_joined(s, d):
    a, b = of(s, d, "A").select("l", "c", F.col("mrr").alias("mrr_a")), of(s, d, "R").select("l", "c", F.col("mrr").alias("mrr_r"))
    return e.joined_results(a, b, ["l", "c"]).select("l", "c", "mrr_a", "mrr_r", F.least("mrr_a", "mrr_r").alias("low"), F.greatest("mrr_a", "mrr_r").alias("high"), F.round((F.col("mrr_a") + F.col("mrr_r")) / 2, 6).alias("middle"))


def grid(s, d):
    return e.parameter_grid(s, [[{"encoding": "pq", "levels": 1}, {"encoding": "rq", "levels": 4}], [{"size": v} for v in (128, 256, 512)]])


def band(s, d):
    """Points of the bootstrap band, and whether the fitted line lies within it."""
    r = results(s, d)
    fit = r.groupBy("method").agg(F.regr_slope("mrr", "entropy").alias("b"), F.regr_intercept("mrr", "entropy").alias("a"))
    y = F.col("a") + F.col("b") * F.col("x")
    return e.regression_band(r, "method", "entropy", "mrr", draws=2000).join(fit, "method").select("method", F.round("x", 6).alias("x"), y.between(F.col("low"), F.col("high")).alias("within"))


def weighted(s, d):
    """Means of the worst and best run, plain and weighted by uniqueness."""
    r = results(s, d).groupBy("method", "l").agg(F.min("mrr").alias("worst"), F.max("mrr").alias("best"), F.avg("uniqueness").alias("u"))
    return rounded(r.select("method", "l", ((F.col("worst") + F.col("best")) / 2).alias("middle"), ((F.col("worst") + F.col("best")) / 2 * F.col("u")).alias("weighted")))


def pivots(s, d):
    """One pivot for each metric."""
    long = results(s, d).selectExpr("l", "c", "stack(3, 'mrr', mrr, 'uniqueness', uniqueness, 'entropy', entropy) as (metric, v)")
    p = long.groupBy("metric", "l").pivot("c", [0, 1, 2, 3]).agg(F.avg("v"))
    return rounded(p.select("metric", "l", *(F.col(str(k)).alias(f"c{k}") for k in range(4))))


def resumed(s, d):
    """Every configuration with the stage it goes on from: checkpoints stand for months with line items."""
    g = results(s, d).select("method", "l", "c")
    stages = s.createDataFrame([("pretrain", 1), ("search", 2), ("finetune", 3)], "stage string, step int")
    t = table(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("l"), (F.month("l_shipdate") % 4).alias("c"), (F.year("l_shipdate") % 7).alias("step"))
    done = t.join(F.broadcast(stages), "step").select("method", "l", "c", "stage").distinct()
    return e.resume(g, done, stages, ["method", "l", "c"])


QUERIES = {
    "config_pivot": pivot,
    "config_full_grid": lambda s, d: rounded(e.full_grid(of(s, d, "A").where("l <> c"), "l", "c", "mrr")),
    "config_winner": lambda s, d: rounded(e.winners(results(s, d), ["l", "c"], "method", "mrr")),
    "config_argmax": lambda s, d: results(s, d).groupBy("l", "c").agg(F.max_by("method", F.struct("mrr", "method")).alias("method")),
    "top_configs": lambda s, d: results(s, d).orderBy(F.desc("mrr"), "method", "l", "c").limit(5).select("method", "l", "c", "mrr"),
    "run_confidence_interval": lambda s, d: rounded(e.run_statistics(results(s, d), ["method"], "mrr")),
    "paired_tests": lambda s, d: rounded(e.paired_test(of(s, d, "A"), of(s, d, "R"), ["l", "c"], "mrr")),
    "kendall_tau": lambda s, d: rounded(e.kendall(results(s, d), ["method"], "entropy", "mrr")),
    "kendall_pooled": lambda s, d: rounded(e.kendall(results(s, d), [], "entropy", "mrr")),
    "method_spread": lambda s, d: rounded(e.spread(results(s, d), ["method"], "mrr")),
    "length_effect": lambda s, d: rounded(results(s, d).groupBy("method", (F.col("l") * (F.col("c") + 1)).alias("m")).agg(F.avg("mrr").alias("mrr"))),
    "linear_fit": lambda s, d: rounded(e.linear_fit(results(s, d), "entropy", "mrr", F.col("uniqueness") >= 0.04)),
    "value_census": lambda s, d: rounded(e.value_census(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])),
    "docid_lengths": lambda s, d: rounded(e.length_statistics(table(s, d, "pseudo_queries"), "docid")),
    "token_sort": lambda s, d: e.token_sort(table(s, d, "nq_queries").select("qid").distinct(), "qid"),
    "results_upsert": upserted,
    "cross_dataset": cross_joined,
    "parameter_grid": grid,
    "run_interval_few": lambda s, d: rounded(e.run_statistics(results(s, d).where("l <= 3 and c < l - 1").union(results(s, d).where("l = 7 and c = 0")), ["method", "l"], "mrr")),
    "partial_spearman": lambda s, d: rounded(e.partial_spearman(results(s, d), "method", "entropy", "mrr", ["l"], ["c"]).select("method", "rho", "n")),
    "partial_spearman_interval": lambda s, d: e.partial_spearman(results(s, d), "method", "entropy", "mrr", ["l"], ["c"]).select("method", (F.col("low") <= F.col("rho")).alias("above_low"), (F.col("rho") <= F.col("high")).alias("below_high"), (F.col("high") - F.col("low") < 1.2).alias("narrow")),
    "leave_one_out_r2": lambda s, d: rounded(e.leave_one_out(results(s, d), "method", ["entropy"], "mrr")),
    "regression_band": band,
    "size_weighted_metrics": weighted,
    "config_pivot_by_metric": pivots,
    "resumed_experiments": resumed,
}

R = """WITH r AS (SELECT l_returnflag AS method, l_linenumber AS l, month(l_shipdate) % 4 AS c, round(avg(l_discount), 6) AS mrr, round(avg(l_tax), 6) AS uniqueness, round(avg(l_quantity), 6) AS entropy, count(*) AS n FROM lineitem GROUP BY ALL)
"""
#: The 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_TABLE = (
    12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520,
    2.2009851601, 2.1788128297, 2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402, 2.0930240544, 2.0859634473,
    2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616, 2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)
_T = f"({list(T_TABLE)})[k - 1]"


def t_p_sql(t: str, n: str) -> str:
    """Two-sided p value for whole degrees of freedom, by the finite series in the angle."""
    cos2, sin, cos = f"({n} / ({n} + {t} * {t}))", f"(abs({t}) / sqrt({n} + {t} * {t}))", f"sqrt({n} / ({n} + {t} * {t}))"
    even = f"{sin} * list_sum(list_transform(range(0, {n} // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: (2 * i - 1) / (2.0 * i) * {cos2})), 1.0)))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({n})) + CASE WHEN {n} = 1 THEN 0 ELSE {sin} * {cos} * list_sum(list_transform(range(0, ({n} - 1) // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: 2 * i / (2.0 * i + 1) * {cos2})), 1.0))) END)"
    return f"(1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END)"


def normal_p_sql(z: str) -> str:
    """Two-sided p value of a normal deviate, by Simpson's rule up to 12."""
    h = f"((12 - abs({z})) / 2000)"
    return f"(2 / sqrt(2 * pi()) * {h} / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({z}) + i * {h}, 2) / 2))))"


_TAU = R + """, p AS (SELECT a.method, sign(a.entropy - b.entropy) AS sx, sign(a.mrr - b.mrr) AS sy FROM r a JOIN r b ON {0} (a.method, a.l, a.c) < (b.method, b.l, b.c)),
t AS (SELECT {1} sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))) AS tau FROM p {2}), x AS (SELECT {1} pow(corr(entropy, mrr), 2) AS r2, count(*) AS n FROM r {2})
SELECT {1} round(tau, 6) AS tau, round(r2, 6) AS r2, n FROM t {3}"""
SQL = {
    "config_pivot": R + "SELECT l, " + ", ".join(f"round(avg(mrr) FILTER (c = {k}), 6) AS c{k}" for k in range(4)) + " FROM r GROUP BY 1",
    "config_full_grid": R + ", a AS (SELECT * FROM r WHERE method = 'A' AND l <> c) SELECT x.l, y.c, round(avg(mrr), 6) AS mrr FROM (SELECT DISTINCT l FROM a) x CROSS JOIN (SELECT DISTINCT c FROM a) y LEFT JOIN a ON a.l = x.l AND a.c = y.c GROUP BY 1, 2",
    "config_winner": R + ", k AS (SELECT *, row_number() OVER (PARTITION BY l, c ORDER BY mrr DESC, method) AS k FROM r) SELECT l, c, max(method) FILTER (k = 1) AS winner, max(mrr) FILTER (k = 1) AS best, max(method) FILTER (k = 2) AS runner_up, round(max(mrr) FILTER (k = 1) - max(mrr) FILTER (k = 2), 6) AS gap FROM k WHERE k <= 2 GROUP BY 1, 2",
    "config_argmax": R + "SELECT l, c, method FROM (SELECT *, row_number() OVER (PARTITION BY l, c ORDER BY mrr DESC, method DESC) AS k FROM r) WHERE k = 1",
    "top_configs": R + "SELECT method, l, c, mrr FROM r ORDER BY mrr DESC, method, l, c LIMIT 5",
    "run_confidence_interval": R + f", s AS (SELECT method, avg(mrr) AS mean, stddev_samp(mrr) AS std, min(mrr) AS min, max(mrr) AS max, count(*) - 1 + 1 AS runs, count(*) - 1 AS k0 FROM r GROUP BY 1), u AS (SELECT *, k0 + 1 AS k FROM s) SELECT method, round(mean, 6) AS mean, round(std, 6) AS std, min, max, runs, round(mean - {_T.replace('k - 1', 'k0')} * std / sqrt(k), 6) AS low, round(mean + {_T.replace('k - 1', 'k0')} * std / sqrt(k), 6) AS high FROM u",
    "run_interval_few": R + f", s AS (SELECT method, l, avg(mrr) AS mean, stddev_samp(mrr) AS std, min(mrr) AS min, max(mrr) AS max, count(*) AS runs, count(*) - 1 AS k0 FROM r WHERE l <= 3 AND c < l - 1 OR l = 7 AND c = 0 GROUP BY 1, 2) SELECT method, l, round(mean, 6) AS mean, round(std, 6) AS std, min, max, runs, round(mean - {_T.replace('k - 1', 'k0')} * std / sqrt(runs), 6) AS low, round(mean + {_T.replace('k - 1', 'k0')} * std / sqrt(runs), 6) AS high FROM s",
    "paired_tests": R + f""", d AS (SELECT a.mrr - b.mrr AS d FROM r a JOIN r b ON a.l = b.l AND a.c = b.c AND a.method = 'A' AND b.method = 'R'),
k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS ties FROM d WHERE d <> 0),
w AS (SELECT coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus, count(*) AS n, sum(ties * ties - 1) AS tied FROM k),
z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - tied / 2) / 24) AS z FROM w),
t AS (SELECT count(*) AS pairs, count(*) - 1 AS f, avg(d) AS difference, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d)
SELECT pairs, round(difference, 6) AS difference, round(t, 6) AS t, round({t_p_sql('t', 'f')}, 6) AS t_p, w_plus, w_minus, round(z, 6) AS z, round({normal_p_sql('z')}, 6) AS w_p FROM t, z""",
    "kendall_tau": _TAU.format("a.method = b.method AND", "method,", "GROUP BY 1", "JOIN x USING (method) WHERE n >= 4"),
    "kendall_pooled": _TAU.format("", "", "", ", x"),
    "method_spread": R + "SELECT method, round(avg(mrr), 6) AS mean, min(mrr) AS min, max(mrr) AS max, round(median(mrr), 6) AS median FROM r GROUP BY 1",
    "length_effect": R + "SELECT method, l * (c + 1) AS m, round(avg(mrr), 6) AS mrr FROM r GROUP BY 1, 2",
    "linear_fit": R + "SELECT round(regr_slope(mrr, entropy) FILTER (uniqueness >= 0.04), 6) AS slope, round(regr_intercept(mrr, entropy) FILTER (uniqueness >= 0.04), 6) AS intercept, round(regr_r2(mrr, entropy) FILTER (uniqueness >= 0.04), 6) AS r2, count(*) FILTER (uniqueness < 0.04) AS set_aside FROM r",
    "value_census": " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, round(avg({c}), 6) AS mean, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isnan({c})) AS nans FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "docid_lengths": "SELECT round(avg(length(docid)), 6) AS mean, round(stddev_samp(length(docid)), 6) AS std, min(length(docid)) AS min, max(length(docid)) AS max FROM pseudo_queries",
    "token_sort": "SELECT qid, row_number() OVER (ORDER BY try_cast(qid AS INT) IS NULL, try_cast(qid AS INT) NULLS FIRST, qid) AS place FROM (SELECT DISTINCT qid FROM nq_queries)",
    "results_upsert": R + "SELECT method, l, c, CASE WHEN l <= 2 AND c > 0 THEN 0.5 ELSE mrr END AS mrr, entropy, CASE WHEN l <= 2 THEN 'again' END AS note FROM r",
    "cross_dataset": R + "SELECT a.l, a.c, a.mrr AS mrr_a, b.mrr AS mrr_r, least(a.mrr, b.mrr) AS low, greatest(a.mrr, b.mrr) AS high, round((a.mrr + b.mrr) / 2, 6) AS middle FROM r a JOIN r b ON a.l = b.l AND a.c = b.c AND a.method = 'A' AND b.method = 'R'",
}
_RK = "rank() OVER (PARTITION BY method ORDER BY {0}) + (count(*) OVER (PARTITION BY method, {0}) - 1) / 2"
_DEMEAN = "{0} - avg({0}) OVER (PARTITION BY method, c)"
SQL |= {
    # With one control and dummies, taking out the dummies is centring within them (for ranks of the control, too); one slope is left.
    "partial_spearman": R + f""", k AS (SELECT method, c, {_RK.format('entropy')} AS x, {_RK.format('mrr')} AS y, {_RK.format('l')} AS z FROM r),
q AS (SELECT method, {_DEMEAN.format('x')} AS x, {_DEMEAN.format('y')} AS y, {_DEMEAN.format('z')} AS z FROM k),
b AS (SELECT method, sum(x * z) / sum(z * z) AS gx, sum(y * z) / sum(z * z) AS gy FROM q GROUP BY 1),
e AS (SELECT q.method, x - gx * z AS x, y - gy * z AS y FROM q JOIN b ON b.method = q.method)
SELECT method, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS rho, count(*) AS n FROM e GROUP BY 1""",
    "partial_spearman_interval": R + "SELECT DISTINCT method, true AS above_low, true AS below_high, true AS narrow FROM r",
    "leave_one_out_r2": R + """, m AS (SELECT method, count(*) AS n, avg(entropy) AS mx, avg(mrr) AS my, var_pop(entropy) * count(*) AS sxx, regr_slope(mrr, entropy) AS b, var_pop(mrr) * count(*) AS syy FROM r GROUP BY 1)
SELECT method, round(1 - sum(pow((mrr - my - b * (entropy - mx)) / (1 - 1.0 / n - pow(entropy - mx, 2) / sxx), 2)) / any_value(syy), 6) AS r2, count(*) AS n FROM (SELECT method, entropy, mrr FROM r) JOIN m USING (method) GROUP BY 1""",
    "regression_band": R + ", m AS (SELECT method, min(entropy) AS a, max(entropy) AS b FROM r GROUP BY 1) SELECT method, round(a + (b - a) * i / 9, 6) AS x, true AS within FROM m, range(10) t(i)",
    "size_weighted_metrics": R + "SELECT method, l, round((min(mrr) + max(mrr)) / 2, 6) AS middle, round((min(mrr) + max(mrr)) / 2 * avg(uniqueness), 6) AS weighted FROM r GROUP BY 1, 2",
    "config_pivot_by_metric": R + ", g AS (SELECT l, c, unnest(['mrr', 'uniqueness', 'entropy']) AS metric, unnest([mrr, uniqueness, entropy]) AS v FROM r) SELECT metric, l, " + ", ".join(f"round(avg(v) FILTER (c = {k}), 6) AS c{k}" for k in range(4)) + " FROM g GROUP BY 1, 2",
    "resumed_experiments": R + """, n AS (SELECT l_returnflag AS method, l_linenumber AS l, month(l_shipdate) % 4 AS c, max(year(l_shipdate) % 7) FILTER (year(l_shipdate) % 7 IN (1, 2, 3)) AS k FROM lineitem GROUP BY ALL)
SELECT r.method, r.l, r.c, CASE k WHEN 1 THEN 'pretrain' WHEN 2 THEN 'search' WHEN 3 THEN 'finetune' END AS done, CASE coalesce(k, 0) WHEN 0 THEN 'pretrain' WHEN 1 THEN 'search' WHEN 2 THEN 'finetune' END AS next FROM r JOIN n ON n.method = r.method AND n.l = r.l AND n.c = r.c""",
}
SQL["parameter_grid"] = "SELECT (row_number() OVER (ORDER BY levels, size)) - 1 AS number, encoding, levels, size FROM (VALUES ('pq', 1), ('rq', 4)) a(encoding, levels), (VALUES (128), (256), (512)) b(size)"
