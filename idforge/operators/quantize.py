"""Vector quantisation into short integer codes: PQ, RQ and both together.

A codebook is a table ``(level, subspace, code, centroid)``. PQ has one level,
RQ one subspace. Codes are level-major: position = level * subspaces +
subspace. A codebook holds levels * subspaces * size centroids, a number given
by parameters and not by the data, so it is what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idforge.functions.similarity import dot, squared_distance
from idforge.operators.lineage import cut

CODEBOOK = "level int, subspace int, code int, centroid array<double>"
MOST_CENTROIDS = 1 << 20


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid for each row; the first of equals."""
    d = (centroids**2).sum(1)[None, :] - 2.0 * (x @ centroids.T)
    return d.argmin(1)


def load_codebook(codebook: DataFrame) -> list[list[np.ndarray]]:
    """Centroids by level and subspace."""
    rows = codebook.select("level", "subspace", "code", "centroid").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError("a codebook of more than 2**20 centroids")
    levels, spaces = (1 + max((r[k] for r in rows), default=-1) for k in (0, 1))
    return [[np.array([r[3] for r in sorted((r for r in rows if r[0] == lv and r[1] == s), key=lambda r: r[2])], float) for s in range(spaces)] for lv in range(levels)]


def encode(vectors: DataFrame, codebook: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, ``codes`` and ``residual_norm`` of each vector; null vectors are left out."""
    book = vectors.sparkSession.sparkContext.broadcast(load_codebook(codebook))
    kind = vectors.schema[key].dataType.simpleString()

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            spaces = len(book.value[0])
            parts = np.split(x, spaces, axis=1)
            codes = []
            for level in book.value:
                for s, centroids in enumerate(level):
                    c = _nearest(parts[s], centroids)
                    parts[s] = parts[s] - centroids[c]
                    codes.append(c)
            grid = np.stack(codes, 1).astype(np.int32)
            ends = np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32)
            norm = np.sqrt(sum((p**2).sum(1) for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(grid.ravel())), pa.array(norm)], [key, "codes", "residual_norm"])

    return vectors.select(key, column).where(F.col(column).isNotNull()).mapInArrow(work, f"{key} {kind}, codes array<int>, residual_norm double")


def encode_layers(vectors: DataFrame, layers: list[tuple[list, list]], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Vectors behind a small network: ``key``, ``column``. ``layers`` are (weights by output, biases), with a rectifier between them.

    What comes out is quantised as vectors are; the weights are parameters, so they are broadcast. Null vectors are left out.
    """
    known = vectors.sparkSession.sparkContext.broadcast([(np.array(w, float), np.array(b, float)) for w, b in layers])
    kind = vectors.schema[key].dataType.simpleString()

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for k, (weights, bias) in enumerate(known.value):
                x = x @ weights.T + bias
                x = np.maximum(x, 0.0) if k + 1 < len(known.value) else x
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], [key, column])

    return vectors.select(key, column).where(F.col(column).isNotNull()).mapInArrow(work, f"{key} {kind}, {column} array<double>")


def decode(codes: DataFrame, codebook: DataFrame, key: str = "vec_id") -> DataFrame:
    """``key``, ``decoded``: centroids summed over levels, subspaces side by side."""
    book = load_codebook(codebook)
    spaces = len(book[0])
    known = codes.sparkSession.sparkContext.broadcast(book)
    kind = codes.schema[key].dataType.simpleString()

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            grid = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            out = np.concatenate([sum(known.value[lv][s][grid[:, lv * spaces + s]] for lv in range(len(known.value))) for s in range(spaces)], axis=1)
            ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], [key, "decoded"])

    return codes.select(key, "codes").mapInArrow(work, f"{key} {kind}, decoded array<double>")


def seeded_codebook(vectors: DataFrame, size: int, subspaces: int = 1, levels: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A reproducible codebook: level l has the residuals of keys l*size to l*size+size-1.

    Reads ``levels * size`` vectors, a bounded sample fixed by parameters.
    """
    rows = vectors.where(F.col(key) < size * levels).select(key, column).orderBy(key).collect()
    x = {r[0]: np.array(r[1], float) for r in rows}
    spark, out = vectors.sparkSession, []
    for s in range(subspaces):
        parts = {k: np.split(v, subspaces)[s] for k, v in x.items()}
        for level in range(levels):
            keys = [k for k in sorted(parts) if level * size <= k < (level + 1) * size]
            centroids = np.array([parts[k] for k in keys])
            out += [(level, s, c, centroids[c].tolist()) for c in range(len(keys))]
            every = sorted(parts)
            if every:
                near = _nearest(np.array([parts[k] for k in every]), centroids)
                parts = {k: parts[k] - centroids[n] for k, n in zip(every, near, strict=True)}
    return spark.createDataFrame(out, CODEBOOK)


def _slice(column: str, s: int, subspaces: int) -> Column:
    n = (F.size(column) / subspaces).cast("int")
    return F.slice(column, F.lit(s) * n + 1, n)


def trained_codebook(vectors: DataFrame, size: int, subspaces: int = 1, levels: int = 1, column: str = "embedding", seed: int = 42, iterations: int = 20) -> DataFrame:
    """Codebook by distributed k-means over all vectors: each subspace, level by level on residuals."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    out = []
    spark = vectors.sparkSession
    for s in range(subspaces):
        rest = cut(vectors.where(F.col(column).isNotNull()).select(_slice(column, s, subspaces).cast("array<double>").alias("r")), "residuals")
        for level in range(levels):
            model = KMeans(k=size, seed=seed, maxIter=iterations, featuresCol="f").fit(rest.select(array_to_vector("r").alias("f")))
            centres = [c.tolist() for c in model.clusterCenters()]
            out += [(level, s, k, c) for k, c in enumerate(centres)]
            if level + 1 < levels:
                known = spark.sparkContext.broadcast(np.array(centres))

                def subtract(batches, known=known):
                    for b in batches:
                        if b.num_rows:
                            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                            x = x - known.value[_nearest(x, known.value)]
                            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["r"])

                rest = cut(rest.mapInArrow(subtract, "r array<double>"), "residuals")
    return spark.createDataFrame(out, CODEBOOK)


def reconstruction_error(vectors: DataFrame, decoded: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Mean squared error per dimension: ``mse``, ``vectors``."""
    both = vectors.join(decoded, key)
    return both.agg(F.avg(squared_distance(F.col(column), F.col("decoded")) / F.size(column)).alias("mse"), F.count("*").alias("vectors"))


def code_usage(codes: DataFrame, size: int) -> DataFrame:
    """Used and unused codes of each position: ``level``, ``used``, ``unused``, ``usage_rate``."""
    by = codes.select(F.posexplode("codes").alias("level", "token")).groupBy("level").agg(F.countDistinct("token").alias("used"))
    return by.select("level", "used", (F.lit(size) - F.col("used")).alias("unused"), (F.col("used") / F.lit(size)).alias("usage_rate"))


def dead_codes(codes: DataFrame, codebook_size: int, positions: int, residuals: DataFrame, key: str = "vec_id", seed: int = 42) -> DataFrame:
    """Unused codes and the vector each is reset to: ``level``, ``code``, ``reset_to``; vectors in hash order, each used once."""
    spark = codes.sparkSession
    every = spark.range(positions * codebook_size).select(F.expr(f"int(id div {codebook_size})").alias("level"), (F.col("id") % codebook_size).cast("int").alias("code"))
    used = codes.select(F.posexplode("codes").alias("level", "code")).distinct()
    dead = every.join(used, ["level", "code"], "left_anti").withColumn("n", F.expr("row_number() over (order by level, code)"))
    draw = residuals.select(F.col(key).alias("reset_to")).orderBy(F.md5(F.concat_ws("|", F.lit(seed), "reset_to")), "reset_to").limit(positions * codebook_size)
    draw = draw.withColumn("n", F.row_number().over(_by_hash(seed)))
    return dead.join(draw, "n").select("level", "code", "reset_to")


def _by_hash(seed: int):
    from pyspark.sql import Window

    return Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "reset_to")), "reset_to")


def info_nce(query: Column, positive: Column, negative: Column, temperature: float = 0.1) -> Column:
    """-log of the positive's softmax share against one negative."""
    return F.log1p(F.exp((dot(query, negative) - dot(query, positive)) / F.lit(temperature)))


def triplet_loss(query: Column, positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), squared_distance(query, positive) - squared_distance(query, negative) + margin)
