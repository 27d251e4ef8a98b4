"""Prefix tries, constrained beam search, and expansion of codes to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idforge.operators.lineage import cut


def trie_edges(codes: DataFrame, start: int | None = None) -> DataFrame:
    """``prefix`` (codes so far), ``next``: every step that leads to some identifier."""
    c = F.concat(F.array(F.lit(start)), "codes") if start is not None else F.col("codes")
    s = codes.select(c.alias("c")).distinct()
    e = s.select("c", F.explode(F.sequence(F.lit(0), F.size("c") - 1)).alias("k"))
    return e.select(F.expr("slice(c, 1, k)").alias("prefix"), F.expr("c[k]").alias("next")).distinct()


def next_tokens(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Allowed next codes of each prefix, ascending; prefixes of no identifier are left out."""
    return prefixes.join(edges, "prefix").groupBy("prefix").agg(F.array_sort(F.collect_set("next")).alias("next"))


def beam_search(edges: DataFrame, scores: DataFrame, steps: int, beam: int) -> DataFrame:
    """Constrained beam search under given step scores: ``qid``, ``codes``, ``score``, ``rank``.

    ``scores`` has ``qid``, ``step`` (from 0), ``token``, ``logp``: a model's
    output, or any table. Each step is a join with the trie's edges of that
    depth and a top-``beam`` window per query, and is cut to storage, so the
    plan doesn't grow with the steps.
    """
    now = scores.select("qid").distinct().select("qid", F.array().cast("array<int>").alias("prefix"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.array_join("prefix", ","))
    for k in range(steps):
        level = edges.where(F.size("prefix") == k)
        step = scores.where(F.col("step") == k).select("qid", F.col("token").alias("next"), "logp")
        grown = now.join(level, "prefix").join(step, ["qid", "next"])
        grown = grown.select("qid", F.concat("prefix", F.array("next")).alias("prefix"), F.round(F.col("score") + F.col("logp"), 9).alias("score"))
        now = cut(grown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam), "beam")
        ranked, now = now, now.drop("rank")
    return ranked.select("qid", F.col("prefix").alias("codes"), "score", "rank")


def code_key(codes: Column, drop: tuple[int, ...] = (0,), end: int = 1) -> Column:
    """Codes as text, without the dropped ones, up to the end token."""
    at = F.array_position(codes, end)
    kept = F.when(at > 0, F.slice(codes, F.lit(1), (at - 1).cast("int"))).otherwise(codes)
    return F.array_join(F.filter(kept, lambda x: ~x.isin(*drop)), ",")


def inverse_codes(codes: DataFrame, key: str = "docid") -> DataFrame:
    """``code``, ``docids``: documents of each code, collisions kept, in id order."""
    return codes.groupBy(F.array_join("codes", ",").alias("code")).agg(F.array_sort(F.collect_set(key)).alias("docids"))


def expand(beams: DataFrame, codes: DataFrame, truth: DataFrame, order: str = "id", most: int = 100, key: str = "docid", seed: int = 42) -> DataFrame:
    """Ranked documents of each query: ``qid``, ``truth``, ``pred``.

    A code that several documents share is expanded in place; ``order`` says
    how: ``best`` (relevant first), ``worst`` (relevant last), ``random`` (by
    hash) or ``id``. ``truth`` has ``qid``, ``docid``. Queries without a match
    have an empty prediction.
    """
    c = codes.select(F.array_join("codes", ",").alias("code"), F.col(key).alias("doc"))
    good = truth.select("qid", F.col("docid").alias("doc")).distinct().withColumn("good", F.lit(1))
    hits = beams.select("qid", F.col("rank").alias("beam"), F.array_join("codes", ",").alias("code")).join(c, "code").join(good, ["qid", "doc"], "left")
    target = F.coalesce("good", F.lit(0))
    by = {"best": -target, "worst": target, "random": F.md5(F.concat_ws("|", F.lit(seed), "qid", "doc")), "id": F.lit(0)}[order]
    w = Window.partitionBy("qid").orderBy("beam", by, "doc")
    ranked = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    pred = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc"))), lambda x: x["doc"]).alias("pred"))
    t = truth.groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("truth"))
    return t.join(pred, "qid", "left").select("qid", "truth", F.coalesce("pred", F.array().cast("array<string>")).alias("pred"))


def lookup_report(beams: DataFrame, codes: DataFrame) -> DataFrame:
    """``beams``, ``matched``, ``match_rate``, ``missing_codes``: predictions that are some document's code."""
    c = codes.select(F.array_join("codes", ",").alias("code")).distinct().withColumn("m", F.lit(1))
    s = beams.select(F.array_join("codes", ",").alias("code")).join(c, "code", "left")
    return s.agg(F.count("*").alias("beams"), F.count("m").alias("matched"), (F.count("m") / F.count("*")).alias("match_rate"), F.count_distinct(F.when(F.col("m").isNull(), F.col("code"))).alias("missing_codes"))


def lookup_with_fallback(keys: DataFrame, table: DataFrame, key: str, value: str, alternative: Column) -> DataFrame:
    """Value of a key, or of its alternative where the key has none."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    a, b = t.select(F.col("_k").alias("_a"), F.col("_v").alias("_va")), t.select(F.col("_k").alias("_b"), F.col("_v").alias("_vb"))
    j = keys.withColumn("_alt", alternative).join(a, F.col(key) == F.col("_a"), "left").join(b, F.col("_alt") == F.col("_b"), "left")
    return j.select(*keys.columns, F.coalesce("_va", "_vb").alias(value))


def trec_run(ranked: DataFrame, tag: str = "idforge") -> DataFrame:
    """Run lines with score 1 / rank: ``line``."""
    e = ranked.select("qid", F.posexplode("pred").alias("p", "doc"))
    return e.select(F.format_string(f"%s Q0 %s %d %s {tag}", "qid", "doc", F.col("p") + 1, F.format_number(1 / (F.col("p") + 1), 6)).alias("line"))


def clean_hits(ranked: DataFrame, valid: DataFrame, k: int = 10) -> DataFrame:
    """Hits at 1 and ``k`` after dropping repeated and unknown ids: ``hits_1``, ``hits_k``, ``queries``."""
    e = ranked.select("qid", "truth", F.posexplode_outer("pred").alias("p", "doc"))
    known = e.join(valid.select(F.col("docid").alias("doc")).distinct(), "doc", "left_semi")
    first = known.groupBy("qid", "doc").agg(F.min("p").alias("p"), F.first("truth").alias("truth"))
    r = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("p"))).where(F.array_contains("truth", F.col("doc")))
    best = r.groupBy("qid").agg(F.min("r").alias("r"))
    return ranked.select("qid").join(best, "qid", "left").agg(F.avg(F.coalesce((F.col("r") <= 1).cast("double"), F.lit(0.0))).alias("hits_1"), F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias("hits_k"), F.count("*").alias("queries"))


def reranked(groups: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """Values of each key by score, best first: key, ``ranked``."""
    return groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v")))), lambda x: x["v"]).alias("ranked"))


def restricted_vocabulary(vocab: DataFrame, pattern: str = "^[0-9-]+$") -> DataFrame:
    """Tokens a decoder may use, e.g. digits and dashes."""
    return vocab.where(F.col("term").rlike(pattern))
