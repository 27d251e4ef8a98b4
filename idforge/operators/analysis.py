"""Quality of identifiers: uniqueness, balance, and agreement with embeddings.

Random pairs and triplets come from a pool, the first documents by a seeded
hash, so that a sample is the same on every run and engine, needs no number for
every row, and costs one bounded top-k. Tuples are drawn from the pool with
replacement, as many as asked for however few documents there are; the members
of a tuple differ.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idforge.functions.similarity import cosine, similarity
from idforge.operators.lineage import cut
from idforge.operators.student import t_p_value, t_quantile


def uniqueness(codes: DataFrame) -> DataFrame:
    """``docs``, ``distinct_codes``, ``uniqueness`` (0 without documents)."""
    by = codes.groupBy("codes").agg(F.count("*").alias("n"))
    u = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count("*").alias("distinct_codes"))
    return u.select("docs", "distinct_codes", F.when(F.col("docs") == 0, 0.0).otherwise(F.col("distinct_codes") / F.col("docs")).alias("uniqueness"))


def batch_uniqueness(codes: DataFrame, batch: Column) -> DataFrame:
    """Share of distinct codes within each batch: ``batch``, ``docs``, ``distinct_codes``, ``uniqueness``."""
    by = codes.groupBy(batch.alias("batch"), "codes").agg(F.count("*").alias("n"))
    u = by.groupBy("batch").agg(F.sum("n").alias("docs"), F.count("*").alias("distinct_codes"))
    return u.withColumn("uniqueness", F.col("distinct_codes") / F.col("docs"))


def level_histogram(codes: DataFrame) -> DataFrame:
    """``level``, ``token``, ``n``."""
    return codes.select(F.posexplode("codes").alias("level", "token")).groupBy("level", "token").agg(F.count("*").alias("n"))


def level_balance(histogram: DataFrame) -> DataFrame:
    """``level``, ``entropy`` (normalised, 0 for one token), ``gini`` of the token counts."""
    w = Window.partitionBy("level")
    h = histogram.withColumn("s", F.sum("n").over(w)).withColumn("i", F.row_number().over(w.orderBy("n", "token")))
    p = F.col("n") / F.col("s")
    k = F.count("*")
    entropy = F.when(k <= 1, 0.0).otherwise(-F.sum(p * F.log(p)) / F.log(k))
    gini = (2 * F.sum(F.col("i") * F.col("n")) - (k + 1) * F.sum("n")) / (k * F.sum("n"))
    return h.groupBy("level").agg(entropy.alias("entropy"), gini.alias("gini"))


def mean_balance(balance: DataFrame) -> DataFrame:
    return balance.agg(F.avg("entropy").alias("entropy"), F.avg("gini").alias("gini"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows by seeded hash, with ``i`` from 0."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))
    top = df.withColumn("_h", h).orderBy("_h", key).limit(n)
    return top.withColumn("i", F.row_number().over(Window.orderBy("_h", key)) - 1).drop("_h")


def sampled_tuples(df: DataFrame, key: str, n: int, width: int, seed: int = 42) -> DataFrame:
    """``n`` tuples of ``width`` (2 or 3) distinct members: columns of ``df`` prefixed t0_, t1_, ..., and ``pair`` from 0.

    The pool has ``n * width`` documents at most. None comes from fewer than ``width``.
    """
    pool = cut(hash_sample(df, key, n * width, seed), "pool")
    size = pool.count()
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "pair", F.lit(k))), 1, 8), 16, 10).cast("bigint")
    at = df.sparkSession.range(n if size >= width else 0).select(F.col("id").alias("pair"))
    at = at.withColumn("i0", draw(0) % max(size, 1)).withColumn("d1", 1 + draw(1) % max(size - 1, 1))
    ends = [F.col("i0"), (F.col("i0") + F.col("d1")) % max(size, 1)]
    if width == 3:
        d2 = 1 + draw(2) % max(size - 2, 1)
        ends.append((F.col("i0") + F.when(d2 >= F.col("d1"), d2 + 1).otherwise(d2)) % max(size, 1))
    out = at.select("pair", *(e.alias(f"i{w}") for w, e in enumerate(ends)))
    for w in range(width):
        out = out.join(pool.select(F.col("i").alias(f"i{w}"), *(F.col(c).alias(f"t{w}_{c}") for c in df.columns)), f"i{w}")
    return out.select("pair", *(f"t{w}_{c}" for w in range(width) for c in df.columns))


#: The modes in which codes are compared, with their options for ``similarity``.
MODES = {"full": {}, "hierarchical": {}, "mix": {"subspaces": 2}}


def _each_mode(tuples: DataFrame, modes: dict[str, dict], columns) -> DataFrame:
    """``columns(similarity, options)`` of every tuple under each mode, with ``mode``."""
    found = F.array(*(F.struct(F.lit(m).alias("mode"), *columns(similarity(m), o)) for m, o in modes.items()))
    return tuples.select("pair", F.explode(found).alias("x")).select("pair", "x.*")


def similarity_correlation(docs: DataFrame, n: int = 10_000, modes: dict[str, dict] = MODES, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Pearson correlation of code and embedding similarity on ``n`` sampled pairs: ``mode``, ``pearson``, ``pairs``."""
    p = sampled_tuples(docs, key, n, 2, seed)
    s = _each_mode(p, modes, lambda f, o: (f(F.col("t0_codes"), F.col("t1_codes"), **o).alias("x"), cosine(F.col("t0_embedding"), F.col("t1_embedding")).alias("y")))
    return s.groupBy("mode").agg(F.corr("x", "y").alias("pearson"), F.count("*").alias("pairs"))


def mean_rank(df: DataFrame, by: list[str], column: str, to: str) -> DataFrame:
    """Rank from 1 within ``by``, ties at their mean. For samples, whose size a parameter bounds."""
    return df.withColumn(to, F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2)


def relevance(docs: DataFrame, n: int = 10_000, modes: dict[str, dict] = MODES, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Pearson and Spearman correlation with their t and two-sided p values, and moments of the code similarity, by ``mode``."""
    p = sampled_tuples(docs, key, n, 2, seed)
    s = _each_mode(p, modes, lambda f, o: (f(F.col("t0_codes"), F.col("t1_codes"), **o).alias("x"), F.round(cosine(F.col("t0_embedding"), F.col("t1_embedding")), 9).alias("y")))
    r = mean_rank(mean_rank(s, ["mode"], "x", "rx"), ["mode"], "y", "ry")
    out = r.groupBy("mode").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("*").alias("pairs"))
    t = lambda c: F.col(c) * F.sqrt((F.col("pairs") - 2) / (1 - F.col(c) * F.col(c)))
    out = out.select("*", t("pearson").alias("pearson_t"), t("spearman").alias("spearman_t"))
    return out.select("*", *(t_p_value(F.col(f"{c}_t"), F.col("pairs") - 2).alias(f"{c}_p") for c in ("pearson", "spearman")))


def ranking_preservation(docs: DataFrame, n: int = 10_000, modes: dict[str, dict] = MODES, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Share of sampled triplets whose nearer member is the same by codes and by embedding, by ``mode``; ties of either are left out and counted."""
    p = sampled_tuples(docs, key, n, 3, seed)
    e = cosine(F.col("t0_embedding"), F.col("t1_embedding")) - cosine(F.col("t0_embedding"), F.col("t2_embedding"))
    s = _each_mode(p, modes, lambda f, o: ((f(F.col("t0_codes"), F.col("t1_codes"), **o) - f(F.col("t0_codes"), F.col("t2_codes"), **o)).alias("c"), F.round(e, 9).alias("e")))
    tie = (F.col("c") == 0) | (F.col("e") == 0)
    return s.groupBy("mode").agg(F.avg(F.when(~tie, (F.signum("c") == F.signum("e")).cast("int"))).alias("preserved"), F.count_if(~tie).alias("triplets"), F.count_if(tie).alias("ties"))


def positive_agreement(triples: DataFrame, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """How often the positive is more similar than the negative: ``agreement`` (ties count half), ``agreement_no_ties``, ``triples``."""
    p, n = F.col(positive), F.col(negative)
    score = F.when(p > n, 1.0).when(p == n, 0.5).otherwise(0.0)
    return triples.agg(F.avg(score).alias("agreement"), F.avg(F.when(p != n, score)).alias("agreement_no_ties"), F.avg(p).alias("closeness"), F.count("*").alias("triples"))


def token_groups(docs: DataFrame, modes: dict[str, list[list[int]]]) -> DataFrame:
    """One row per document, mode and number of shared codes: ``mode``, ``k``, ``prefix`` (the codes there), and the document's columns.

    A mode lists the positions that count for each k, e.g. the first k ones.
    """
    at = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(len(p)).alias("k"), F.array(*(F.get("codes", F.lit(i)) for i in p)).alias("prefix")) for m, every in modes.items() for p in every))
    return docs.withColumn("_g", F.explode(at)).select("*", "_g.*").drop("_g")


def position_modes(length: int, subspaces: int = 1) -> dict[str, list[list[int]]]:
    """The first k codes (``hierarchical``), or the first k where a subspace's levels come one after the other (``mix``)."""
    order = [level * subspaces + s for s in range(subspaces) for level in range(length // subspaces)]
    return {"hierarchical": [list(range(k)) for k in range(1, length + 1)], "mix": [order[:k] for k in range(1, length + 1)]}


def _unit_sums(docs: DataFrame, modes: dict[str, list[list[int]]]) -> DataFrame:
    """``mode``, ``k``, ``prefix``, ``q`` (the squared length of the sum of the unit vectors) and ``n`` of every group of two or more.

    Documents alone in their group, most of them for long prefixes, are left
    out before any vector is taken apart.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    units = docs.withColumn("v", v).withColumn("norm", norm).where("norm > 0").select("codes", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    by = ["mode", "k", "prefix"]
    sizes = token_groups(units.select("codes"), modes).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    parts = token_groups(units, modes).join(sizes, by).select(*by, "n", F.posexplode("u").alias("i", "x"))
    sums = parts.groupBy(*by, "i").agg(F.sum("x").alias("x"), F.first("n").alias("n"))
    return sums.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.first("n").alias("n"))


def shared_token_similarity(docs: DataFrame, modes: dict[str, list[list[int]]]) -> DataFrame:
    """Mean embedding cosine over all pairs of documents that share the codes at k positions.

    ``mode``, ``k``, ``similarity`` (every pair weighing the same), ``by_document``
    (every document weighing the same, with its mean over its group), ``pairs``,
    ``groups``, ``docs``. A group's sum over its pairs is had from the sum of
    its unit vectors, (|sum|^2 - n) / 2, so no pair is formed, no document is
    left out, and a group as large as N / V costs what its documents do.
    Groups of one and null or zero vectors count nowhere.
    """
    groups = _unit_sums(docs, modes)
    n, both = F.col("n"), F.col("n") * (F.col("n") - 1)
    return groups.groupBy("mode", "k").agg(
        (F.sum(F.col("q") - n) / F.sum(both)).alias("similarity"), (F.sum((F.col("q") - n) / (n - 1)) / F.sum(n)).alias("by_document"),
        F.sum((both / 2).cast("bigint")).alias("pairs"), F.count("*").alias("groups"), F.sum(n).alias("docs"),
    )


def masked_matches(codes: DataFrame, masks: list[list[int]], key: str = "vec_id") -> DataFrame:
    """Groups of documents with the same codes at the positions of a mask: ``mask``, ``tokens``, ``n``, ``first``."""
    named = {",".join(map(str, m)): [m] for m in masks}
    by = token_groups(codes, named).groupBy(F.col("mode").alias("mask"), F.col("prefix").alias("tokens"))
    return by.agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def first_token_samples(codes: DataFrame, n: int, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Up to ``n`` documents of each first code, by hash: ``token``, ``rank``, key."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))
    r = codes.select(F.get("codes", F.lit(0)).alias("token"), key, h.alias("h"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("h", key))).where(F.col("rank") <= n).select("token", "rank", key)


def robustness(before: DataFrame, after: DataFrame, name: str, key: str = "vec_id", **options) -> DataFrame:
    """Similarity of codes before and after a rewriting: ``similarity``, ``exact``, ``docs``."""
    both = before.select(key, F.col("codes").alias("a")).join(after.select(key, F.col("codes").alias("b")), key)
    return both.agg(F.avg(similarity(name)(F.col("a"), F.col("b"), **options)).alias("similarity"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count("*").alias("docs"))


def robustness_ranking(before: DataFrame, after: DataFrame, name: str, seed: int = 42, key: str = "vec_id", n: int = 10_000, **options) -> DataFrame:
    """Whether a document's own rewriting is nearer to it than another document's: ``preserved``, ``ties``."""
    f = similarity(name)
    both = before.select(key, F.col("codes").alias("a")).join(after.select(key, F.col("codes").alias("b")), key)
    p = sampled_tuples(both, key, n, 2, seed)
    d = p.select((f(F.col("t0_a"), F.col("t0_b"), **options) - f(F.col("t0_a"), F.col("t1_a"), **options)).alias("d"))
    return d.agg(F.avg(F.when(F.col("d") != 0, (F.col("d") > 0).cast("int"))).alias("preserved"), F.count_if(F.col("d") == 0).alias("ties"))


def shared_anywhere_similarity(docs: DataFrame, length: int) -> DataFrame:
    """Mean embedding cosine over all pairs with at least k equal codes, whichever they are: ``k``, ``similarity``, ``pairs``.

    Pairs that agree at given positions are summed over each choice of
    positions as in ``shared_token_similarity``; the inclusion-exclusion formula
    makes these sums those of the pairs with k or more. There are 2**length
    choices, so codes have at most ten positions.
    """
    if length > 10:
        raise ValueError("more than ten positions")
    masks = [list(m) for k in range(1, length + 1) for m in combinations(range(length), k)]
    groups = _unit_sums(docs, {"".join(map(str, m)): [m] for m in masks})
    by = groups.groupBy(F.col("k").alias("j")).agg((F.sum(F.col("q") - F.col("n")) / 2).alias("s"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("c"))
    weights = docs.sparkSession.createDataFrame([(k, j, float((-1) ** (j - k) * math.comb(j - 1, k - 1))) for k in range(1, length + 1) for j in range(k, length + 1)], "k int, j int, w double")
    out = by.join(F.broadcast(weights), "j").groupBy("k").agg(F.sum(F.col("s") * F.col("w")).alias("s"), F.round(F.sum(F.col("c") * F.col("w"))).cast("bigint").alias("pairs"))
    return out.where("pairs > 0").select("k", (F.col("s") / F.col("pairs")).alias("similarity"), "pairs")


def prefix_profile(docs: DataFrame, longest: int, pool: int = 20_000, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Similarity within groups of the same first k codes: ``k``, ``mean``, ``std``, ``pairs``, ``groups``, 95 % t interval ``low`` and ``high``.

    Sampling is the feature: a pool of documents is drawn by hash, so that a
    group is drawn from in proportion to its size, and each is paired with the
    next of its group in hash order (the last with the first).
    ``shared_token_similarity`` has the mean over all pairs.
    """
    s = hash_sample(docs, key, pool, seed)
    g = token_groups(s, {"first": [list(range(k)) for k in range(1, longest + 1)]})
    w = Window.partitionBy("k", "prefix").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("n", F.count("*").over(whole)).withColumn("e", F.coalesce(F.lead("embedding").over(w), F.first("embedding").over(whole))).where("n > 1")
    out = g.withColumn("s", cosine(F.col("embedding"), F.col("e"))).groupBy("k").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.count("*").alias("pairs"), F.count_distinct("prefix").alias("groups"))
    half = t_quantile(F.col("pairs") - 1) * F.col("std") / F.sqrt("pairs")
    return out.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def duplicate_census(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows and distinct values of each named expression.

    A value is counted by 128 bits of hash and each expression by itself: rows
    of (name, hash) are combined before the shuffle, which holds no text.
    """
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(n), c, F.lit(1)).alias("b"))).alias("h")) for n, c in columns.items()))
    each = docs.select(F.explode(named).alias("x")).groupBy("x.name", "x.h").agg(F.count("*").alias("n"))
    by = each.groupBy("name").agg(F.sum("n").alias("rows"), F.count("h").alias("values"))
    return by.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), *(F.coalesce(F.max(F.when(F.col("name") == n, F.col("values"))), F.lit(0)).alias(n) for n in columns))


def duplicate_histogram(docs: DataFrame, value: Column) -> DataFrame:
    """How many values occur how often: ``copies``, ``values``. Values are told apart by 128 bits of hash, so no text is shuffled."""
    by = docs.groupBy(value.isNull().alias("null"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b")).agg(F.count("*").alias("copies"))
    return by.groupBy("copies").agg(F.count("*").alias("values"))
