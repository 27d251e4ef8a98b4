"""Records that differ only in white space, letter case, punctuation or the order of their fields.

No canonical string is built to find copies: each text streams through the
skip-and-fold table into polynomial hashes of its words, and a sum over the
words makes the key independent of their order. Records with the same key are
then compared with their group's first record by a two-pointer walk that skips
what the table skips; where the order differs, the folded words are counted
against each other. A record that fails the comparison (a hash collision) is
placed by its exact key instead, so no result rests on a hash alone. The key
that is given out is only made once for each class, from its first text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idforge.llm.fold import fold_table, mix, split_words, sum_by_row
from idforge.llm.words import title_key_col
from idforge.operators.lineage import cut


def fold_keys(df: DataFrame, row: str, text: str) -> DataFrame:
    """Order-free key of each text with words: ``row_no``, ``text``, ``h1``, ``h2``, ``n`` (its words)."""

    def work(batches):
        for batch in batches:
            w = split_words(batch.column(1).to_pylist())
            n = w.per_row()
            h1, h2 = (sum_by_row(w.row, mix(w.hashes(np.uint64(b))), w.rows).view(np.int64) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
            kept = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(h1), pa.array(h2), pa.array(n.astype(np.int32))], ["row_no", "text", "h1", "h2", "n"]).filter(kept)

    return df.select(F.col(row).alias("row_no"), F.col(text).alias("text")).where("row_no is not null and text is not null").mapInArrow(work, "row_no bigint, text string, h1 bigint, h2 bigint, n int")


def same_words(a: str, b: str) -> bool:
    """Whether two texts have the same words, by two pointers; by counting the folded words where the order differs."""
    if a == b:
        return True
    table = fold_table()
    x, y = (table[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist() for t in (a, b))
    i = j = 0
    while True:
        gap_i = gap_j = False
        while i < len(x) and not x[i]:
            i, gap_i = i + 1, True
        while j < len(y) and not y[j]:
            j, gap_j = j + 1, True
        if i == len(x) or j == len(y):
            if i == len(x) and j == len(y):
                return True
            break
        if x[i] != y[j] or (gap_i != gap_j and 0 < i and 0 < j and not _at_start(x, i, y, j)):
            break
        i, j = i + 1, j + 1
    return _counted(a) == _counted(b)


def _counted(text: str) -> Counter:
    """How often each folded word occurs, the words as slices of the folded characters."""
    w = split_words([text])
    folded = w.codes.tobytes()
    return Counter(folded[4 * a : 4 * (a + n)] for a, n in zip(w.start.tolist(), w.size.tolist()))


def _at_start(x: list[int], i: int, y: list[int], j: int) -> bool:
    """Whether nothing but skipped characters lies before both pointers."""
    return not any(x[:i]) and not any(y[:j])


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], bool] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = same_words(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=bool)


def _classes(df: DataFrame, row: str, text: str) -> DataFrame:
    """Class of each record whose text has words: ``row_no``, ``first_row_no``, ``first_text``, ``copies``."""
    keyed = cut(fold_keys(df, row, text), "keyed")
    key = ["h1", "h2", "n"]
    firsts = keyed.groupBy(*key).agg(F.min(F.struct("row_no", "text")).alias("first"), F.count("*").alias("copies"))
    firsts = firsts.select(*key, F.col("first.row_no").alias("first_row_no"), F.col("first.text").alias("first_text"), "copies")
    ok = F.when(F.col("text") == F.col("first_text"), True).otherwise(_same("text", "first_text"))
    checked = cut(keyed.join(firsts, key).withColumn("ok", ok).select("row_no", "first_row_no", "first_text", "copies", F.when(~F.col("ok"), F.col("text")).alias("other")), "classes")
    kept = ["row_no", "first_row_no", "first_text", "copies"]
    mixed = checked.where("other is not null").select("first_row_no").distinct()
    if mixed.isEmpty():
        return checked.select(kept)
    # Hash collisions: these classes are taken apart by the exact key.
    mixed = cut(mixed, "mixed")
    apart = checked.join(mixed, "first_row_no", "left_semi").select("row_no", F.coalesce("other", "first_text").alias("text"))
    apart = cut(apart.withColumn("title_key", title_key_col(F.col("text"))), "apart")
    by = apart.groupBy("title_key").agg(F.min(F.struct("row_no", "text")).alias("first"), F.count("*").alias("copies"))
    exact = apart.join(by, "title_key").select("row_no", F.col("first.row_no").alias("first_row_no"), F.col("first.text").alias("first_text"), "copies")
    return checked.join(mixed, "first_row_no", "left_anti").select(kept).union(exact)


def format_copies(df: DataFrame, row: str, text: str, least: int = 1) -> DataFrame:
    """Class of each record with at least ``least`` copies: ``row_no``, ``first_row_no``, ``title_key``, ``copies``.

    Texts are the same if their sorted words are. Nulls and texts without a
    word are left out; an empty table gives an empty result. The classes'
    counts and first records are combined before the shuffle, and the join
    back is one that adaptive execution splits where a class is large.
    """
    kept = _classes(df, row, text).where(F.col("copies") >= least)
    return kept.select("row_no", "first_row_no", title_key_col(F.col("first_text")).alias("title_key"), "copies")


def collapse_formats(df: DataFrame, row: str, text: str) -> DataFrame:
    """One record per distinct text: ``row_no``, ``text`` (of the first record), ``title_key``, ``copies``."""
    firsts = _classes(df, row, text).where("row_no = first_row_no").select("row_no", F.col("first_text").alias("text"), "copies").distinct()
    return firsts.select("row_no", "text", title_key_col(F.col("text")).alias("title_key"), "copies")
