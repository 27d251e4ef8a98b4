"""Records of evaluation splits that turn up in the training split.

Queries are compared by their sets of character trigrams, exactly: an
evaluation text and a training text can only be similar enough if they share a
rare trigram within their prefixes. Evaluation prefixes are the index, training
prefixes the probes; a pair must also fit by length, by the place of the shared
trigram, and by a bound from parity sketches (bits that differ between two
sketches never outnumber the trigrams that differ). What is left is verified
on the whole sets.

A trigram of more than ``LIST`` texts isn't a key by itself: if the rarest one
that a pair shares is that common, so is the second, and the key is the two
together. A text has so many keys whatever the lengths of the lists, so what is
shuffled grows with the rows. The index of a list is sorted by length and
searched by range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.llm.fold import distinct_in_row, in_parts, mix, split_words, sum_by_row
from idforge.llm.rarity import bits_for, code_of, flat, rare_first, token_codes
from idforge.operators.lineage import cut

WIDTH = 3
LIST = 8192  # texts of one trigram up to which it is a key by itself
SHORT = 160  # trigrams up to which a text has keys of two (at most some 800)
HELD = 500_000  # postings of one list that a task holds besides its index


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct character trigrams (packed, so exact) of each text's words joined by one space, and their rows."""
    w = split_words(texts)
    later = np.concatenate([[False], w.row[1:] == w.row[:-1]]) if len(w.row) else np.zeros(0, bool)
    codes = np.insert(w.codes, w.start[later], ord(" ")).astype(np.uint64)
    rows = np.repeat(w.row, w.size + later)
    n = len(codes) - WIDTH + 1
    if n <= 0:
        return rows[:0], codes[:0], len(texts)
    whole = rows[:n] == rows[WIDTH - 1 :]
    packed = codes[:n] | codes[1 : n + 1] << np.uint64(21) | codes[2:] << np.uint64(42)
    return *distinct_in_row(rows[:n][whole], packed[whole]), len(texts)


def trigrams(df: DataFrame) -> DataFrame:
    """``row_no``, ``probe`` (a training row), ``n``, signatures ``s1`` and ``s2``, ``h`` from ``row_no``, ``probe``, ``text``."""

    def work(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_parts(texts):
                rows, grams, size = _grams(texts[a:b])
                n = np.bincount(rows, minlength=size)
                s1, s2 = (sum_by_row(rows, mix(grams ^ np.uint64(x)), size).view(np.int64) for x in (0x51ED270B, 0xA0761D65))
                kept = n > 0
                ends = np.concatenate([[0], np.cumsum(n[kept])]).astype(np.int32)
                mask = pa.array(kept)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask), pa.array(n[kept].astype(np.int32)), pa.array(s1[kept]), pa.array(s2[kept]), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64)))], ["row_no", "probe", "n", "s1", "s2", "h"])

    return df.select("row_no", "probe", "text").where("row_no is not null and text is not null").mapInArrow(work, "row_no bigint, probe boolean, n int, s1 bigint, s2 bigint, h array<bigint>")


def _parity(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each row: bit b is the parity of its tokens that hash to b."""
    place = (mix(tokens ^ np.uint64(0x5851F42D)) >> np.uint64(57)).astype(np.int64)
    bits = (np.bincount(rows * 128 + place, minlength=n * 128).reshape(n, 128) & 1).astype(np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return words[:, 0], words[:, 1]


def _keys(tokens, rows, place, often, n, t: float, short: int):
    """Keys of sorted prefixes: (key, row, place). ``place`` counts for the last token of the key, less the others.

    A text of at most ``short`` trigrams may be similar to one of more, so those
    that may have such a partner use common trigrams by themselves, too.
    """
    least = np.ceil(t * n - 1e-9).astype(np.int64)
    first = n - least + 1  # the rarest shared token is among these, the second among one more
    alone = (n > t * short) | (least < 2)
    single = (place < first[rows]) & (~often | alone[rows])
    at = np.flatnonzero((place <= first[rows]) & often & (n <= short)[rows])
    keys, owners, places = [tokens[single]], [rows[single]], [place[single]]
    left, right = at, at
    while len(left):  # each with the next, then with the one after it
        right = right + 1
        fits = right < len(rows)
        left, right = left[fits], right[fits]
        fits = (rows[right] == rows[left]) & (place[right] <= first[rows[left]])
        left, right = left[fits], right[fits]
        keys.append(mix(tokens[left] * np.uint64(0x9E3779B97F4A7C15) ^ tokens[right]))
        owners.append(rows[left])
        places.append(place[right] - 1)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


def _postings(sets: DataFrame, codes: np.ndarray, t: float) -> DataFrame:
    """Keys of each class with its row, size, place and sketch."""
    known, common, short = sets.sparkSession.sparkContext.broadcast(codes), int(code_of(LIST)), SHORT
    names = ["tok", "probe", "row", "n", "place", "p1", "p2"]

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                ids, probe, n = (batch.column(k).slice(a, 2000).to_numpy(zero_copy_only=False) for k in range(3))
                n = n.astype(np.int64)
                tokens, rows = flat(batch.column(3).slice(a, 2000))
                p1, p2 = _parity(tokens, rows, len(ids))
                tokens, rows, place, seen = rare_first(mix(tokens), rows, known.value)
                with np.errstate(over="ignore"):
                    key, r, place = _keys(tokens, rows, place, seen > common, n, t, short)
                cols = [key.view(np.int64), probe[r], ids[r], n[r].astype(np.int32), place.astype(np.int32), p1[r].view(np.int64), p2[r].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return sets.select("row_no", "probe", "n", "h").mapInArrow(work, "tok bigint, probe boolean, row bigint, n int, place int, p1 bigint, p2 bigint")


def _match(index: list[np.ndarray], probes: list[np.ndarray], t: float, best: bool, step: int = 2_000_000):
    """Candidate (evaluation, training) rows, and whether there are more. Both sides: (list, row, n, place, p1, p2), sorted by list and n. ``best``: only the closest of each posting."""
    if not len(index[0]) or not len(probes[0]):
        return
    by = probes[0] << 32 | probes[2]
    low = np.searchsorted(by, index[0] << 32 | np.ceil(t * index[2] - 1e-9).astype(np.int64), "left")
    count = np.searchsorted(by, index[0] << 32 | np.floor(index[2] / t + 1e-9).astype(np.int64), "right") - low
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        some = count[a:b]
        i = np.repeat(np.arange(a, b), some)
        j = np.repeat(low[a:b] - (np.cumsum(some) - some), some) + np.arange(len(i))
        n1, n2 = index[2][i], probes[2][j]
        need = np.ceil(t / (1 + t) * (n1 + n2) - 1e-9)
        fits = np.minimum(n1 - index[3][i], n2 - probes[3][j]) >= need
        i, j, room = i[fits], j[fits], (n1 + n2 - 2 * need)[fits]
        differ = np.bitwise_count(index[4][i] ^ probes[4][j]).astype(np.int64) + np.bitwise_count(index[5][i] ^ probes[5][j])
        near = differ <= room
        i, j, differ = i[near], j[near], differ[near]
        more = np.zeros(len(i), bool)
        if best and len(i):
            order = np.lexsort((differ, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            more = np.diff(np.concatenate([first, [len(i)]])) > 1
            i, j = i[first], j[first]
        yield index[1][i], probes[1][j], more
        a = b


def _candidates(batches, t: float, best: bool, most: int = HELD):
    """Walks lists in order (index before probes); of a long list its index is held and its probes come in blocks."""
    held: list[np.ndarray] | None = None

    def run(cols):
        tok, probe, *rest = cols
        lists = np.cumsum(np.concatenate([[0], tok[1:] != tok[:-1]])) if len(tok) else tok
        for a, b, more in _match(*([lists[side], *(c[side] for c in rest)] for side in (~probe, probe)), t, best):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more)], ["a", "b", "more"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        cols = [cols[0], cols[1].astype(bool), cols[2], cols[3].astype(np.int64), cols[4].astype(np.int64), cols[5].view(np.uint64), cols[6].view(np.uint64)]
        held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
        yield from run([c[:last] for c in held])
        held = [c[last:] for c in held]
        if held[1].sum() > most:
            # Blocks don't know of each other's candidates, so all are told to have more.
            yield from (pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(np.ones(x.num_rows, bool))], ["a", "b", "more"]) for x in run(held))
            held = [c[~held[1]] for c in held]
    if held is not None:
        yield from run(held)


def similar_to_train(sets: DataFrame, t: float) -> DataFrame:
    """Evaluation classes with a training class at t or more: ``row_no``.

    ``sets`` has the columns of ``trigrams``. Rows with the same set are one
    class; a class with rows of both sides needs no partner. Then only the
    closest candidate of each list is verified, which settles nearly all rows
    that have a partner, however many it has. All candidates follow for the
    rows that this leaves open: those of which a list had more.
    """
    keys = ["s1", "s2", "n"]
    sides = sets.groupBy(*keys).agg(F.min("row_no").alias("row_no"), F.first("h").alias("h"), F.max("probe").alias("probe"), F.min("probe").alias("pure"))
    classes = cut(sides, "classes")
    members = sets.where("not probe").select(F.col("row_no").alias("member"), *keys)
    # The order must be the same for tokens on either side, so the counts are of mixed tokens.
    codes = token_codes(_mixed(classes), "h", bits_for(classes.agg(F.sum("n")).first()[0] or 0))
    posts = cut(_postings(classes, codes, t), "postings")
    full, most = classes.select("row_no", "h"), HELD

    def candidates(index: DataFrame, probes: DataFrame, best: bool) -> DataFrame:
        dealt = index.unionByName(probes).repartition("tok").sortWithinPartitions("tok", "probe", "n")
        return dealt.mapInArrow(lambda x: _candidates(x, t, best, most), "a bigint, b bigint, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(full.select(F.col("row_no").alias("a"), F.col("h").alias("x")), "a").join(full.select(F.col("row_no").alias("b"), F.col("h").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= F.lit(t) * (F.size("x") + F.size("y") - shared) - 1e-9).select(F.col("a").alias("row_no")).distinct()

    index, probes = posts.where("not probe"), posts.where("probe")
    pairs = cut(candidates(index, probes, True), "pairs")
    hits = cut(verified(pairs), "matched").union(classes.where("probe and not pure").select("row_no"))
    open_ = cut(pairs.where("more").select(F.col("a").alias("row")).distinct().join(hits.withColumnRenamed("row_no", "row"), "row", "left_anti"), "open")
    if not open_.isEmpty():
        index = cut(index.join(open_, "row", "left_semi").select(posts.columns), "index")
        probes = probes.join(index.select("tok").distinct(), "tok", "left_semi").select(posts.columns)
        hits = hits.union(verified(candidates(index, probes, False)))
    met = classes.select(*keys, "row_no").join(hits, "row_no").drop("row_no")
    return members.join(met, keys).select(F.col("member").alias("row_no"))


def _mixed(sets: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            lists = batch.column(0)
            values, _ = flat(lists)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lists.offsets, pa.array(mix(values).view(np.int64)))], ["h"])

    return sets.select("h").mapInArrow(work, "h array<bigint>")


def cross_split_overlaps(df: DataFrame, title_keys: DataFrame, row: str = "row_no", query: str = "query", split: str = "split", train: str = "train", threshold: float = 0.75) -> DataFrame:
    """Evaluation records that turn up in the training split: ``row_no``, ``field_name`` (``title`` or ``query``).

    A title turns up if a training record has the same key in ``title_keys``
    (``row_no``, ``title_key``); a query if a training query's set of character
    trigrams has a Jaccard coefficient of at least ``threshold`` with its own.
    Nulls, blanks and texts of fewer than three characters match nothing; a
    record with a null split is on neither side. Empty tables give an empty
    result.
    """
    rows = df.select(F.col(row).alias("row_no"), F.col(query).alias("text"), (F.col(split) == train).alias("probe")).where("probe is not null")
    keyed = title_keys.join(rows.select("row_no", "probe"), "row_no")
    sides = keyed.groupBy("title_key").agg(F.max("probe").alias("in_train"), F.min("probe").alias("only_train")).where("in_train and not only_train")
    titles = keyed.where("not probe").join(sides, "title_key").select("row_no", F.lit("title").alias("field_name"))
    sets = cut(trigrams(rows), "trigrams")
    queries = similar_to_train(sets, threshold).select("row_no", F.lit("query").alias("field_name"))
    return titles.union(queries)
