"""Quantisation: codes, tokens, decoding and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.functions.docids import codes_text, codes_to_tokens, scalar_codes, text_codes, tokens_to_codes
from idforge.operators import quantize as q
from idforge.plans.codes_sql import codes_cte

PQ, RQ, PQRQ = (16, 4, 1), (16, 1, 3), (16, 2, 2)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def book(spark: SparkSession, d: str, shape=PQ) -> DataFrame:
    return q.seeded_codebook(vectors(spark, d), *shape)


def codes(spark: SparkSession, d: str, shape=PQ) -> DataFrame:
    return q.encode(vectors(spark, d), book(spark, d, shape))


def _text(df: DataFrame) -> DataFrame:
    return df.select("vec_id", codes_text(F.col("codes"), ",").alias("codes"))


def weights(rows: int, columns: int) -> tuple[list, list]:
    """A layer by rule, in place of a trained one."""
    return [[((7 * i + 13 * j) % 11 - 5) / 10 for i in range(columns)] for j in range(rows)], [(j % 3) / 10 for j in range(rows)]


def behind_layers(shape):
    """Codes of the vectors behind a network of two layers."""

    def run(spark, d):
        v = q.encode_layers(vectors(spark, d), [weights(32, 64), weights(16, 32)])
        return _text(q.encode(v, q.seeded_codebook(v, *shape)))

    return run


def decoded(spark, d):
    out = q.decode(codes(spark, d, RQ), book(spark, d, RQ))
    return out.select("vec_id", F.posexplode("decoded").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def mse(spark, d):
    e = q.reconstruction_error(vectors(spark, d), q.decode(codes(spark, d, PQRQ), book(spark, d, PQRQ)))
    return e.select(F.round("mse", 8).alias("mse"), "vectors")


def tokens(spark, d):
    c = codes(spark, d, PQRQ)
    t = codes_to_tokens(F.col("codes"), 16)
    return c.select("vec_id", codes_text(t, ",").alias("tokens"), (tokens_to_codes(t, 16) == F.col("codes")).alias("same"))


def code_strings(spark, d):
    c = codes(spark, d, PQ)
    s = codes_text(F.col("codes"))
    return c.select("vec_id", s.alias("docid"), F.size(text_codes(s)).alias("positions"))


def usage(spark, d):
    return q.code_usage(codes(spark, d, RQ), 16).select("level", "used", "unused", F.round("usage_rate", 6).alias("usage_rate"))


def residual_norm(spark, d):
    return codes(spark, d, RQ).agg(F.round(F.avg("residual_norm"), 6).alias("avg_norm"))


def scalar(spark, d):
    return vectors(spark, d).select("vec_id", codes_text(scalar_codes(F.col("embedding"), 4), ",").alias("codes"))


def kmeans(spark, d):
    """The codebook that k-means fits to all vectors: its size, and whether it is nearer to them than the first vectors taken as centroids.

    Centroids themselves depend on the engine's start, so they are held to this bound.
    """
    v = vectors(spark, d)
    fitted, first = q.trained_codebook(v, 8, 2, 2), q.seeded_codebook(v, 8, 2, 2)
    error = {k: q.reconstruction_error(v, q.decode(q.encode(v, b), b)).first()["mse"] for k, b in (("fitted", fitted), ("first", first))}
    near = error["fitted"] is not None and error["fitted"] < error["first"]
    return fitted.groupBy("level", "subspace").agg(F.count_distinct("code").alias("codes"), F.max(F.size("centroid")).alias("dim")).withColumn("nearer", F.lit(near))


def dead(spark, d):
    return q.dead_codes(codes(spark, d, RQ), 32, 3, vectors(spark, d))


def ir_losses(spark, d):
    v = vectors(spark, d)
    n = v.count()
    pos = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    neg = v.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("n"))
    t = v.where(F.col("vec_id") + 2 < n).join(pos, "vec_id").join(neg, "vec_id")
    return t.agg(F.round(F.avg(q.info_nce(F.col("embedding"), F.col("p"), F.col("n"))), 6).alias("info_nce"), F.round(F.avg(q.triplet_loss(F.col("embedding"), F.col("p"), F.col("n"))), 6).alias("triplet"))


QUERIES = {
    "pq_codes": lambda s, d: _text(codes(s, d, PQ)), "rq_codes": lambda s, d: _text(codes(s, d, RQ)), "pqrq_codes": lambda s, d: _text(codes(s, d, PQRQ)),
    "rq_decoded": decoded, "pqrq_reconstruction_mse": mse, "pqrq_tokens": tokens, "pq_code_strings": code_strings, "rq_code_usage": usage,
    "mlp_rq_codes": behind_layers(RQ), "mlp_pqrq_codes": behind_layers(PQRQ),
    "rq_residual_norm": residual_norm, "scalar_codes": scalar, "kmeans_codebook": kmeans, "dead_code_resets": dead, "ir_losses": ir_losses,
}

def _layer(e: str, rows: int, columns: int) -> str:
    return f"list_transform(range({rows}), lambda j: list_sum(list_transform(range({columns}), lambda i: {e}[i + 1] * (((7 * i + 13 * j) % 11 - 5) / 10.0))) + (j % 3) / 10.0)"


_HIDDEN = "hidden AS (SELECT vec_id, list_transform(" + _layer("e", 32, 64) + ", lambda x: greatest(x, 0.0)) AS h FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), behind AS (SELECT vec_id, " + _layer("h", 16, 32) + " AS embedding FROM hidden)"


def _behind(shape) -> str:
    return codes_cte(*shape, dim=16).replace("FROM embeddings,", "FROM behind,").replace("WITH ", f"WITH {_HIDDEN}, ", 1)


_LIST = "list_transform(codes, lambda x: x::VARCHAR)"
_NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * {}.embedding[i]::DOUBLE))"
_SQ = "list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - {0}.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - {0}.embedding[i]::DOUBLE)))"
SQL = {
    **{k: codes_cte(*shape) + f" SELECT vec_id, array_to_string({_LIST}, ',') AS codes FROM codes" for k, shape in (("pq_codes", PQ), ("rq_codes", RQ), ("pqrq_codes", PQRQ))},
    **{k: _behind(shape) + f" SELECT vec_id, array_to_string({_LIST}, ',') AS codes FROM codes" for k, shape in (("mlp_rq_codes", RQ), ("mlp_pqrq_codes", PQRQ))},
    "rq_decoded": codes_cte(*RQ) + " SELECT e.vec_id, i - 1 AS i, round(e.embedding[i]::DOUBLE - l.r[i], 6) AS x FROM embeddings e JOIN last l ON e.vec_id = l.vec_id, range(1, 65) t(i)",
    "pqrq_reconstruction_mse": codes_cte(*PQRQ) + " SELECT round(avg(q), 8) AS mse, count(*) AS vectors FROM (SELECT vec_id, sum(list_sum(list_transform(r, lambda x: x * x))) / 64 AS q FROM last GROUP BY 1)",
    "pqrq_tokens": codes_cte(*PQRQ) + " SELECT vec_id, array_to_string(list_transform(range(1, 5), lambda i: (codes[i] + (i - 1) * 16 + 32128)::VARCHAR), ',') AS tokens, true AS same FROM codes",
    "pq_code_strings": codes_cte(*PQ) + f" SELECT vec_id, array_to_string({_LIST}, ' - ') AS docid, 4 AS positions FROM codes",
    "rq_code_usage": codes_cte(*RQ) + " SELECT i - 1 AS level, count(DISTINCT codes[i]) AS used, 16 - count(DISTINCT codes[i]) AS unused, round(count(DISTINCT codes[i]) / 16.0, 6) AS usage_rate FROM codes, range(1, 4) t(i) GROUP BY 1",
    "rq_residual_norm": codes_cte(*RQ) + " SELECT round(avg(sqrt(list_sum(list_transform(r, lambda x: x * x)))), 6) AS avg_norm FROM last",
    "scalar_codes": f"SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: trunc((x / {_NORM} + 1) / 2 * 15)::INT::VARCHAR), ',') AS codes FROM embeddings",
    "kmeans_codebook": "SELECT l::INT AS level, s::INT AS subspace, 8 AS codes, 32 AS dim, true AS nearer FROM range(2) a(l), range(2) b(s)",
    "dead_code_resets": codes_cte(*RQ) + """, u AS (SELECT i - 1 AS level, c AS code, row_number() OVER (ORDER BY i, c) AS n FROM range(1, 4) t(i), range(32) x(c) WHERE NOT EXISTS (SELECT 1 FROM codes WHERE codes[i] = c)),
h AS (SELECT vec_id AS reset_to, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS n FROM embeddings)
SELECT level::INT AS level, code::INT AS code, reset_to FROM u JOIN h USING (n)""",
    "ir_losses": f"""SELECT round(avg(ln(1 + exp(({_DOT.format("n")} - {_DOT.format("p")}) / 0.1))), 6) AS info_nce, round(avg(greatest(0, {_SQ.format("p")} - {_SQ.format("n")} + 1.0)), 6) AS triplet
FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2""",
}
