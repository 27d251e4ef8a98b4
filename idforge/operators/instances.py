"""Training rows: token sequences paired with identifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idforge.functions.text import padded, tokens

END = "</s>"


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """``term``, ``df``: documents that hold each term."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """``term``, ``df``, ``idf`` = ln(documents / (df + 1)), negative for a term of all documents."""
    return document_frequency(docs, text).select("term", "df", F.log(F.lit(docs.count()) / (F.col("df") + 1)).alias("idf"))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values of a list column without nulls, and where each list begins and ends in them."""
    if not len(column):
        return pa.array([], column.type.value_type), np.zeros(1, np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])


def passage_rows(docs: DataFrame, key: str, title: Column, sentences: Column, max_len: int = 128, most: int = 10) -> DataFrame:
    """Passages packed from sentences: ``key``, ``part``, ``tokens``.

    A passage starts with the title's tokens and takes sentences until it has
    ``max_len`` - 1 tokens or the sentences end; it is cut to that length and
    ends with the end token. At most ``most`` passages a document; what follows
    the last is not looked at. A null or empty list of sentences gives none.
    Packing walks the sentences' sizes; the tokens of a passage are slices of
    those that came in, so no string is made.
    """
    room = max_len - 1

    def work(batches):
        for batch in batches:
            head, head_at = _lists(batch.column(1))
            sents, sent_at = _lists(batch.column(2))
            flat, token_at = _lists(sents)
            rows, parts, pieces, size = [], [], [], []
            for r in range(batch.num_rows):
                h = np.arange(head_at[r], head_at[r + 1])[:room]
                begin, made = int(token_at[sent_at[r]]), 0
                for k in range(sent_at[r] + 1, sent_at[r + 1] + 1):
                    end = int(token_at[k])
                    if len(h) + end - begin < room and k < sent_at[r + 1]:
                        continue
                    body = np.arange(begin, min(end, begin + room - len(h)))
                    pieces += [h, body + len(head), [len(head) + len(flat)]]
                    rows.append(r)
                    parts.append(made)
                    size.append(len(h) + len(body) + 1)
                    begin, made = end, made + 1
                    if made == most:
                        break
            all_ = pa.concat_arrays([head, flat, pa.array([END], flat.type)])
            taken = all_.take(pa.array(np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)))
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), taken)], [key, "part", "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    told = docs.select(key, tokens(title).alias("head"), F.transform(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: tokens(s)).alias("parts"))
    return told.mapInArrow(work, f"`{key}` {kind}, part int, tokens array<string>")


def term_places(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """Each term of a document once: key, ``n`` (terms of the document), ``term``, ``c`` (its count), ``at`` (its places, from 0). Grouped inside the row, so nothing is shuffled."""

    def work(batches):
        for batch in batches:
            flat, at = _lists(batch.column(1))
            n = np.diff(at)
            rows, code = np.repeat(np.arange(len(n)), n), flat.dictionary_encode()
            ids = code.indices.to_numpy().astype(np.int64)
            order = np.lexsort((ids, rows))  # stable, so places ascend
            r, t = rows[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])) if len(r) else np.zeros(0, np.int64)
            ends = np.concatenate([first, [len(r)]])
            place = (np.arange(len(rows)) - at[:-1][rows])[order] if len(rows) else rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(r[first])), pa.array(n[r[first]].astype(np.int32)), code.dictionary.take(pa.array(t[first])), pa.array(np.diff(ends).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
            ], [key, "n", "term", "c", "at"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, terms.alias("t")).where("t is not null").mapInArrow(work, f"`{key}` {kind}, n int, term string, c int, at array<int>")


def salient_terms(docs: DataFrame, key: str, text: Column, max_len: int = 128, longest: int = 1024, fewest: int = 10) -> DataFrame:
    """The terms of each document with the highest tf-idf, in document order: ``key``, ``tokens``.

    Occurrences count, not distinct terms: the threshold is the value at rank
    min(max_len - 1, occurrences), ties above it are kept, and the result is
    cut to max_len - 1 and ends with the end token. Documents with fewer than
    ``fewest`` occurrences or fewer than two distinct kept terms give no row.
    Terms are counted inside the row; the join with their idf is the one
    shuffle by term, and what comes back is one document's terms at a time.
    """
    room = max_len - 1
    idf = inverse_frequency(docs, text).select("term", "idf")
    tf = term_places(docs.where(F.col(key).isNotNull()), key, F.slice(tokens(text), 1, longest)).where(F.col("n") >= fewest)
    # What Spark takes for the size of either side is that of the compressed texts; the terms are many times as large, too large for a broadcast.
    scored = tf.join(idf.hint("merge"), "term").select(key, "n", F.struct((-F.round(F.col("c") / F.col("n") * F.col("idf"), 9)).alias("s"), "c", "term", "at").alias("x"))
    by = scored.groupBy(key, "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    # Counts add up from the highest value on; the threshold is where they reach the room. It is known
    # only where the fold ends: a column that a lambda uses once would be computed for every element.
    start = F.struct(F.lit(0).alias("c"), F.lit(None).cast("double").alias("least"))
    upto = F.least(F.lit(room), F.col("n"))
    fold = lambda a, t: F.struct((a["c"] + t["c"]).alias("c"), F.when(a["c"] < upto, t["s"]).otherwise(a["least"]).alias("least"))
    kept = by.select(key, F.aggregate("x", start, fold, lambda a: F.filter("x", lambda t: t["s"] <= a["least"])).alias("x")).where(F.size("x") >= 2)
    places = F.flatten(F.transform("x", lambda t: F.transform(t["at"], lambda p: F.struct(p.alias("p"), t["term"].alias("w")))))
    return kept.select(key, F.concat(F.transform(F.slice(F.array_sort(places), 1, room), lambda x: x["w"]), F.array(F.lit(END))).alias("tokens"))


def vocabulary(docs: DataFrame, text: Column, first: int = 2) -> DataFrame:
    """``term``, ``id``: dense numbers by term after the special ids 0 (padding) and 1 (end)."""
    from idforge.operators.ordering import dense_index

    terms = docs.select(F.explode(tokens(text)).alias("term")).distinct()
    return dense_index(terms, ["term"], "id", first)


def to_ids(rows: DataFrame, key: list[str], column: str, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Token arrays to id arrays, unknown tokens to ``unknown``. A join, as a vocabulary may be large."""
    each = rows.select(*key, F.posexplode(column).alias("pos", "term"))
    ids = each.join(vocab, "term", "left").select(*key, "pos", F.coalesce(F.col("id").cast("int"), F.when(F.col("term") == END, 1).otherwise(unknown)).alias("id"))
    packed = ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return rows.select(*key).join(packed, key)


def paired_instances(queries: DataFrame, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Query text with its document's codes: ``qid``, ``docid``, ``tokens``, ``codes``; pairs without either are left out."""
    return pairs.join(queries, "qid").join(codes, "docid").select("qid", "docid", tokens(F.col("query")).alias("tokens"), "codes")


def instance_losses(queries: DataFrame, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Why pairs gave no instance: ``reason``, ``n``."""
    q = queries.select("qid").distinct().withColumn("q", F.lit(1))
    c = codes.select("docid").distinct().withColumn("c", F.lit(1))
    s = pairs.join(q, "qid", "left").join(c, "docid", "left")
    reason = F.when(F.col("q").isNull(), "no_query").when(F.col("c").isNull(), "no_code").otherwise("kept")
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: Which builders a stage uses, and how many passages of a document.
STAGES = {"general_pretrain": (("passage", "sampled_terms", "enhanced_docid"), 10), "search_pretrain": (("fake_query",), 0), "finetune": (("query",), 0)}


def label_rows(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """A document's codes as input and its label codes as output: ``docid``, ``tokens``, ``codes``."""
    return codes.select("docid", F.transform("codes", lambda x: x.cast("string")).alias("tokens")).join(labels.select("docid", "codes"), "docid")


def eval_instances(queries: DataFrame, pairs: DataFrame, codes: DataFrame, max_len: int = 128) -> DataFrame:
    """As ``paired_instances``, each query cut to ``max_len`` - 1 tokens and closed by the end token."""
    cut_ = F.concat(F.slice("tokens", 1, max_len - 1), F.array(F.lit(END)))
    return paired_instances(queries, pairs, codes).withColumn("tokens", cut_)


def stage_rows(stage: str, builders: dict[str, DataFrame]) -> DataFrame:
    """All training rows of a stage: ``kind``, ``docid``, ``tokens``, ``codes``. Passages have a ``part``; as many as the stage takes are kept."""
    kinds, most = STAGES[stage]
    out = None
    for kind in kinds:
        rows = builders[kind]
        rows = rows.where(F.col("part") < most) if kind == "passage" else rows
        rows = rows.select(F.lit(kind).alias("kind"), "docid", "tokens", "codes")
        out = rows if out is None else out.unionByName(rows)
    return out


def model_inputs(rows: DataFrame, n: int) -> DataFrame:
    """Padded ``input_ids`` with their ``attention_mask``."""
    from idforge.functions.text import mask

    return rows.withColumn("input_ids", padded(F.col("ids"), n)).withColumn("attention_mask", mask(F.col("ids"), n)).drop("ids")
