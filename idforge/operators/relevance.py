"""Queries, judgements and ranked runs: joins, negative sampling and triples.

Random choices are orders by a seeded hash of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idforge.operators.lineage import cut
from idforge.operators.ordering import dense_index

BUCKETS = ((1, 100), (101, 500), (501, 1000))


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *cols))


def click_counts(docs: DataFrame, qrels: DataFrame, key: str = "docid") -> DataFrame:
    """Judgements of every document, 0 for those without."""
    n = qrels.groupBy(key).agg(F.count("*").alias("n"))
    return docs.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("clicks"))


def top_clicked(docs: DataFrame, qrels: DataFrame, n: int, key: str = "docid") -> DataFrame:
    """The ``n`` documents with the most judgements; ties by id; those without any are left out."""
    return qrels.groupBy(key).agg(F.count("*").alias("clicks")).join(docs.select(key).distinct(), key, "left_semi").orderBy(F.desc("clicks"), key).limit(n)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_judgement(qrels: DataFrame) -> DataFrame:
    """The last judged document of each query: ``qid``, ``docid``. Ties in time go to the larger id."""
    return qrels.where("docid is not null").groupBy("qid").agg(F.max_by("docid", F.struct("judged_at", "docid")).alias("docid"))


def unjudged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits of a run that aren't judged for their query."""
    return run.join(qrels.select("qid", "docid").distinct(), ["qid", "docid"], "left_anti")


def rank_bucket(rank: Column, buckets=BUCKETS) -> Column:
    """Number of the bucket a rank is in, null outside all."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(buckets))):
        out = F.when(rank.between(a, b), k).otherwise(out)
    return out


def sampled_negatives(run: DataFrame, qrels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` unjudged hits of each query by hash; queries with fewer are left out."""
    c = unjudged(run, qrels).select("qid", "docid").distinct()
    w = Window.partitionBy("qid")
    r = c.withColumn("r", F.row_number().over(w.orderBy(hash_order(seed, "qid", "docid"), "docid"))).withColumn("k", F.count("*").over(w))
    return r.where((F.col("k") >= n) & (F.col("r") <= n)).select("qid", "docid", "r")


def stratified_negatives(run: DataFrame, qrels: DataFrame, n: int, buckets=BUCKETS, seed: int = 42, top_up: bool = False) -> DataFrame:
    """Unjudged hits by rank bucket: n // buckets from each, the remainder from the last.

    With ``top_up`` the shortfall of a query is filled from its first bucket,
    with replacement, at positions a hash picks.
    """
    share = n // len(buckets)
    c = unjudged(run, qrels).groupBy("qid", "docid").agg(F.min("rank").alias("rank")).withColumn("bucket", rank_bucket(F.col("rank"), buckets)).where("bucket is not null")
    want = F.when(F.col("bucket") == len(buckets) - 1, n - share * (len(buckets) - 1)).otherwise(share)
    w = Window.partitionBy("qid", "bucket").orderBy(hash_order(seed, "qid", "docid"), "docid")
    picked = c.withColumn("r", F.row_number().over(w))
    out = picked.where(F.col("r") <= want).select("qid", "docid", "bucket", F.col("r").cast("int").alias("r"), F.lit(False).alias("repeat"))
    if not top_up:
        return out
    pool = picked.where("bucket = 0").select("qid", "docid", F.col("r").alias("at"))
    short = out.groupBy("qid").agg(F.count("*").alias("k")).where(F.col("k") < n)
    size = pool.groupBy("qid").agg(F.count("*").alias("size"))
    extra = short.join(size, "qid").select("qid", "size", F.explode(F.sequence(F.col("k") + 1, F.lit(n))).alias("slot"))
    extra = extra.withColumn("at", (F.conv(F.substring(hash_order(seed, "qid", "slot"), 1, 8), 16, 10).cast("bigint") % F.col("size")) + 1)
    more = extra.join(pool, ["qid", "at"]).select("qid", "docid", F.lit(0).alias("bucket"), F.col("slot").cast("int").alias("r"), F.lit(True).alias("repeat"))
    return out.unionByName(more)


def one_positive(qrels: DataFrame, seed: int = 42) -> DataFrame:
    """One judged document of each query, by hash."""
    q = qrels.where("docid is not null").select("qid", "docid").distinct()
    return q.groupBy("qid").agg(F.min_by("docid", F.struct(hash_order(seed, "qid", "docid"), "docid")).alias("docid"))


def rank_filter_triples(run: DataFrame, qrels: DataFrame, rank: int, seed: int = 42) -> DataFrame:
    """(qid, positive, negative): the unjudged hit at one rank, one for each query."""
    neg = unjudged(run, qrels).where(F.col("rank") == rank).groupBy("qid").agg(F.min("docid").alias("negative"))
    return one_positive(qrels, seed).withColumnRenamed("docid", "positive").join(neg, "qid").select("qid", "positive", "negative")


def triples(run: DataFrame, qrels: DataFrame, queries: DataFrame, docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(qid, query, pos_url, pos_docid, neg_url, neg_docid); both documents and the query must be there."""
    t = one_positive(qrels, seed).withColumnRenamed("docid", "pos_docid").join(sampled_negatives(run, qrels, n, seed).select("qid", F.col("docid").alias("neg_docid")), "qid")
    q = queries.where("query is not null").groupBy("qid").agg(F.min("query").alias("query"))
    p = docs.select(F.col("docid").alias("pos_docid"), F.col("url").alias("pos_url"))
    m = docs.select(F.col("docid").alias("neg_docid"), F.col("url").alias("neg_url"))
    return t.join(q, "qid").join(p, "pos_docid").join(m, "neg_docid").select("qid", "query", "pos_url", "pos_docid", "neg_url", "neg_docid")


def sampling_status(run: DataFrame, qrels: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Queries by outcome: ``status`` (no_query, not_enough, kept), ``queries``."""
    k = unjudged(run, qrels).select("qid", "docid").distinct().groupBy("qid").agg(F.count("*").alias("k"))
    known = queries.where("query is not null").select("qid").distinct().withColumn("known", F.lit(True))
    s = run.select("qid").distinct().join(k, "qid", "left").join(known, "qid", "left")
    status = F.when(F.col("known").isNull(), "no_query").when(F.coalesce("k", F.lit(0)) < n, "not_enough").otherwise("kept")
    return s.groupBy(status.alias("status")).agg(F.count("*").alias("queries"))


def shuffled_alignment(docs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Each document with another one as its negative: the next in a seeded circle of hashes.

    The circle's places are numbered over range partitions, so its number of
    tasks follows the data. A document that is alone has no negative and gives
    no row; nulls are no documents.
    """
    d = docs.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", hash_order(seed, key))
    placed = cut(dense_index(d, ["h", key], "i"), "circle")
    n = placed.count()
    after = placed.select(((F.col("i") + (n - 1)) % max(n, 1)).alias("i"), F.col(key).alias("negative"))
    return placed.join(after, "i").where(F.col(key) != F.col("negative")).select(key, "negative")


def hard_negative_groups(rows: DataFrame, size: int) -> DataFrame:
    """``docs``: the positive first, then negatives, repeated where there are too few, ``size`` in all."""
    negs = F.col("negatives")
    many = F.array_repeat(negs, size)
    filled = F.slice(F.concat(F.array("positive"), F.flatten(many)), 1, size)
    return rows.where(F.size("negatives") > 0).select("qid", filled.alias("docs"))


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, ``side``."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def score_buckets(run: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Hits by their place in the order of scores, best first (ties by id): ``qid``, ``docid``, ``place`` from 1, ``bucket``; hits behind the last bucket are left out."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    placed = run.withColumn("place", F.row_number().over(w))
    return placed.withColumn("bucket", rank_bucket(F.col("place"), buckets)).where("bucket is not null").select("qid", "docid", "place", "bucket")


def vector_triplets(docs: DataFrame, qrels: DataFrame, queries: DataFrame, seed: int = 42) -> DataFrame:
    """Query, document and negative vectors: ``docid``, ``qid``, ``negative``, ``q``, ``d``, ``n``.

    ``docs`` (``docid``, ``vector``) are paired with their first judged query
    (by time, then id) and with the next document of the seeded circle over the
    documents that have one; ``queries`` has ``qid``, ``vector``.
    """
    first = first_by(qrels, ["docid"], "judged_at", "qid").select("docid", "qid")
    have = cut(docs.join(first, "docid").join(queries.select("qid", F.col("vector").alias("q")), "qid").select("docid", "qid", "q", F.col("vector").alias("d")), "triplets")
    other = have.select(F.col("docid").alias("negative"), F.col("d").alias("n"))
    return have.join(shuffled_alignment(have, "docid", seed), "docid").join(other, "negative").select("docid", "qid", "negative", "q", "d", "n")
