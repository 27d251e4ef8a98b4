"""Places for learned models. Each has a deterministic default that needs none.

A hook is a function of columns to a column. A model would come in as a pandas
UDF of the same form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idforge.functions.text import tokens


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Feature hashing of the words into a unit vector: the default text encoder. A null or wordless text gives zeros.

    A word counts at the place that the first eight digits of its MD5 give.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(words: pa.Array) -> pa.Array:
        n, each = len(words), words.flatten().dictionary_encode()
        place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in each.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        x = np.bincount(row * dim + place[each.indices.to_numpy(zero_copy_only=False)], minlength=n * dim).astype(float).reshape(n, dim)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, (x / np.where(norm > 0, norm, 1.0)).ravel())

    return run(tokens(text))


def perturb_text(text: Column, every: int = 10) -> Column:
    """Each ``every``-th word dropped: the default paraphrase."""
    return F.array_join(F.filter(F.split(text, " "), lambda _, i: (i + 1) % every != 0), " ")


def perturb_vector(vector: Column, every: int = 10) -> Column:
    """Each ``every``-th dimension set to 0."""
    return F.transform(vector, lambda x, i: F.when((i + 1) % every == 0, F.lit(0.0).cast("float")).otherwise(x))


def leading_queries(text: Column, n: int = 10, words: int = 8) -> Column:
    """The first ``n`` runs of ``words`` words: the default query generator."""
    t = tokens(text)
    many = F.least(F.lit(n), F.ceil(F.size(t) / words).cast("int"))
    return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.array_join(F.slice(t, i * words + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words in the passage: the default cross-encoder."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(passage))) / F.size(q))


HOOKS: dict[str, Callable] = {"embed": hashed_embedding, "paraphrase": perturb_text, "generate": leading_queries, "score": overlap_score}


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.4) -> Column:
    """-log sigmoid(beta * ((chosen - ref) - (rejected - ref)))."""
    m = F.lit(beta) * ((chosen - ref_chosen) - (rejected - ref_rejected))
    return F.greatest(F.lit(0.0), -m) + F.log1p(F.exp(-F.abs(m)))


def initial_embedding(doc_tokens: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """Sum of a document's distinct token vectors over their number plus one: ``docid``, ``i``, ``x``.

    ``doc_tokens`` has ``docid``, ``token``; ``token_vectors`` has ``token``, ``vector``.
    """
    each = doc_tokens.distinct().join(token_vectors, "token").select("docid", F.posexplode("vector").alias("i", "v"))
    n = doc_tokens.distinct().groupBy("docid").agg(F.count("*").alias("n"))
    return each.groupBy("docid", "i").agg(F.sum(F.col("v").cast("double")).alias("s")).join(n, "docid").select("docid", "i", (F.col("s") / (F.col("n") + 1)).alias("x"))
