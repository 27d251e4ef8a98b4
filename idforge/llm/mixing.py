"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be used ``f`` times, the source's target
tokens over its tokens (at most the cap). The whole part of ``f`` is certain.
The fractions are rounded in pairs: mass moves at random between two documents
so that their expected tokens stay as they are, until one of them is in or
out; the other meets the next. Documents meet in buckets by a seeded hash of
their ids, in the order of that hash, so the choice doesn't depend on how the
table is laid out. Each bucket ends with one open document a source at most,
and these are paired again over a tree of buckets until one is left, which is
drawn by its fraction. So each document is used ``f`` times in expectation and
a source's tokens miss the target by at most one document.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idforge.operators.lineage import cut, release

FAN_IN = 64
BUCKET = 50_000  # documents that a bucket holds on average
#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Setting of the session that names the rank file of the tokenizer, and where it is looked for otherwise.
SETTING, TOKENIZER = "spark.idforge.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
_OPEN: dict[str, object] = {}


def shipped_tokenizer(spark: SparkSession, path: str | None = None) -> str:
    """Name of the rank file, once it is sent to all executors; only the driver needs to have it."""
    path = path or spark.conf.get(SETTING, TOKENIZER)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def tokenizer(name: str):
    """The byte-level tokenizer of a rank file that was sent here, opened once per process."""
    if name not in _OPEN:
        import base64

        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _OPEN[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[name]


def clean_source(source: Column) -> Column:
    """Lower case, separators as underscores, no padding; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(source), "^[\\s_-]+|[\\s_-]+$", ""), "[\\s_-]+", "_")
    return F.when(bare != "", bare)


def with_tokens(docs: DataFrame, doc: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """``doc_id``, ``source`` (clean), ``tokens`` of every document with an id and a source; a null text has none."""
    name = shipped_tokenizer(docs.sparkSession, path)

    def work(batches):
        encode = tokenizer(name).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.where("doc_id is not null and source is not null").mapInArrow(work, "doc_id bigint, source string, tokens bigint")


def pivot(a: tuple[float, float], b: tuple[float, float], draw: float) -> tuple[float, float]:
    """New fractions of two (fraction, tokens): their expected tokens stay, and one of them becomes 0 or 1."""
    (p, v), (q, w) = a, b
    up, down = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
    move = up if draw * (up + down) < down else -down
    p, q = p + move / v, q - move / w
    near = 1e-9
    return (0.0 if p < near else 1.0 if p > 1 - near else p), (0.0 if q < near else 1.0 if q > 1 - near else q)


ROUNDED = "node bigint, source string, doc_id bigint, tokens bigint, base int, p double"
_MASK = (1 << 64) - 1


def draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the three alone."""
    x = (seed * 0x9E3779B97F4A7C15 ^ a * 0xBF58476D1CE4E5B9 ^ b * 0x94D049BB133111EB) & _MASK
    for _ in range(2):
        x = ((x ^ x >> 31) * 0xD6E8FEB86659FD93) & _MASK
    return (x >> 11) / (1 << 53)


def _round(batches, seed: int):
    """Pairs the open documents of each (node, source) in their order; rows come sorted by these. What stays open is given as it is."""
    key, held, done = None, None, []

    def out():
        cols = list(zip(*done, strict=True)) if done else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["node", "source", "doc_id", "tokens", "base", "p"])

    for batch in batches:
        for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if (row[0], row[1]) != key:
                if held is not None:
                    done.append(held)
                key, held = (row[0], row[1]), None
            if held is None:
                held = row
                continue
            held[5], row[5] = pivot((held[5], held[3]), (row[5], row[3]), draw(seed, held[2], row[2]))
            open_ = [x for x in (held, row) if 0 < x[5] < 1]
            done += [x for x in (held, row) if not 0 < x[5] < 1]
            held = open_[0] if open_ else None
        yield out()
    if held is not None:
        done.append(held)
    yield out()


def mix_sources(docs: DataFrame, weights: DataFrame, total: int | None = None, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the shares reached.

    ``weights`` (``source``, ``target_share``, ``max_repeats``) is a small
    configuration table; its size is checked. ``total`` is the size of the mix
    in tokens, by default that of all documents of the listed sources. Returns
    (``doc_id``, ``source``, ``tokens``, ``repeats`` of at least 1) and one row
    per listed source (``source``, ``target_share``, ``max_repeats``,
    ``available_tokens``, ``target_tokens``, ``tokens``, ``actual_share``,
    ``met``). A source that can't reach its target is used to its cap and shown
    as not met; one without documents has 0. Sources that aren't listed are
    left out, as are documents with a null id or source. A document without
    tokens is never drawn by chance. A repeated doc_id counts as several
    documents; empty tables give empty results. The same tables give the same
    choice, however they are partitioned. ``path`` is the rank file of the
    tokenizer on the driver, by default that of the setting
    ``spark.idforge.tokenizer``.
    """
    listed = weights.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).where("source is not null").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 sources in the weights")
    spark = docs.sparkSession
    names = spark.createDataFrame([(r["source"],) for r in listed], "source string")
    sized = cut(with_tokens(docs, doc, text, source, path).join(F.broadcast(names), "source").select("doc_id", "source", "tokens"), "sized")
    counted = sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count_if(F.col("tokens") > 0).alias("docs")).collect()
    have, docs_of = {r["source"]: r["n"] for r in counted}, {r["source"]: r["docs"] for r in counted}
    total = sum(have.values()) if total is None else total
    plan = []
    for r in listed:
        n, target = have.get(r["source"], 0) or 0, (r["share"] or 0.0) * total
        f = min(float(r["cap"] or 0), target / n) if n else 0.0
        plan.append((r["source"], r["share"] or 0.0, r["cap"] or 0, n, target, f))
    plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens bigint, target_tokens double, f double")
    copies = F.floor(F.col("f") + 1e-12).cast("int")
    rows = sized.join(F.broadcast(plan.select("source", "f")), "source").select("doc_id", "source", "tokens", copies.alias("base"), F.when(F.col("tokens") > 0, F.greatest(F.col("f") - copies, F.lit(0.0))).otherwise(0.0).alias("p"))
    rows = cut(rows, "fractions")
    done, left = rows.where("p = 0 or p = 1"), rows.where("p > 0 and p < 1")
    place = F.xxhash64(F.lit(seed), "doc_id")
    levels: list[DataFrame] = []
    nodes = max(1, -(-sum(docs_of.values()) // BUCKET))
    left = left.withColumn("node", F.pmod(place, F.lit(nodes)))
    while True:
        ordered = left.select("node", "source", "doc_id", "tokens", "base", "p").repartition("node").sortWithinPartitions("node", "source", place, "doc_id", "tokens")
        level = cut(ordered.mapInArrow(lambda x: _round(x, seed), ROUNDED), "rounded")
        levels.append(level)
        done = done.union(level.where("p = 0 or p = 1").select(done.columns))
        left = level.where("p > 0 and p < 1")
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        left = left.withColumn("node", F.expr(f"node div {FAN_IN}"))
    last = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    left = left.select("doc_id", "source", "tokens", "base", F.when(last < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    chosen = cut(done.union(left).select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats")).where("repeats > 0"), "mix")
    for table in (sized, rows, *levels):
        release(table)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    got = used.agg(F.sum("tokens")).first()[0] or 0
    shares = plan.join(used, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "target_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(got, 1)))).alias("actual_share"), ((F.col("available_tokens") * F.col("max_repeats") >= F.col("target_tokens")) & (F.col("available_tokens") > 0)).alias("met"))
    return chosen, shares

