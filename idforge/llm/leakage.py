"""Evaluation texts inside a corpus.

A passage may be in a document in part. So the windows compared are runs of
``run`` words (the whole item where it is shorter), and every such window of a
document gets a 64-bit SimHash of its words. The items' fingerprints are
indexed by ``radius + 1`` blocks of bits: two fingerprints within ``radius``
agree in a block, so no pair within the radius is missed. What agrees is
verified on the words themselves: exact equality of the run, or the similarity
of weighted shingles.

An edited copy may differ in every such window. So windows as long as the whole
item are compared, too, by shingles narrow enough for one replaced word in each
run to keep the wanted similarity. Their candidates share the item's rarest shingles: what
the rest weighs alone can't reach the threshold, so no pair is missed.

Only the items are broadcast, in blocks of at most ``ITEM_WINDOWS`` windows; more
items mean more passes, not a larger broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.llm.fold import in_parts, split_words
from idforge.operators.lineage import spread

ITEM_WINDOWS = 500_000
FOUND = "doc_id bigint, item_id bigint, similarity double, whole boolean"


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bits whose count, given as binary digits in ``planes`` (lowest first), is ``least`` or more."""
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return above | equal


def simhashes(words: np.ndarray, sizes: list[int], step: int = 32_768):
    """SimHashes of the windows of each size from every word: (first word, size, fingerprints); ties give a 0 bit.

    The 64 counts of a window are held as binary digits, a 64-bit word for each
    digit, so that adding a word to all windows takes a few operations on whole
    words. A window grows by one word at a time and gives its fingerprint at
    each size that is asked for.
    """
    wanted = set(sizes)
    for a in range(0, len(words), step):
        n, planes = min(step, len(words) - a), []
        for size in range(1, min(max(wanted, default=0), len(words) - a) + 1):
            n = min(n, len(words) - a - size + 1)
            carry = words[a + size - 1 : a + size - 1 + n].copy()
            planes = [x[:n] for x in planes] + [np.zeros(n, np.uint64)] * (size.bit_length() - len(planes))
            for k, x in enumerate(planes):
                planes[k], carry = x ^ carry, x & carry
            if size in wanted:
                yield a, size, _at_least(planes, size // 2 + 1)


class ItemIndex:
    """Windows of the items, by length, with their fingerprints in blocks."""

    def __init__(self, items: list[tuple[int, str]], run: int, radius: int, shingle: int):
        self.radius, self.shingle = radius, shingle
        w = split_words([t for _, t in items])
        hashes, per_row = w.hashes(), w.per_row()
        starts = np.cumsum(per_row) - per_row
        by: dict[int, list[tuple[int, int]]] = {}
        for (item, _), s, n in zip(items, starts, per_row, strict=True):
            size = min(run, int(n))
            if size:
                by.setdefault(size, []).extend((item, int(s) + k) for k in range(int(n) - size + 1))
        self.words, self.sizes = hashes, {}
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for size, rows in by.items():
            ids, at = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            prints = np.concatenate([p for _, _, p in simhashes(hashes, [size])])[at]
            blocks = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                key = self.block(prints, lo, hi)
                order = np.argsort(key, kind="stable")
                # Narrow blocks are looked up in a table of where each value begins.
                begins = np.searchsorted(key[order], np.arange((1 << int(hi - lo)) + 1, dtype=np.uint64)) if hi - lo <= 20 else None
                blocks.append((int(lo), int(hi), key[order], order, begins))
            self.sizes[size] = (ids, at, prints, blocks)
        grams = Counter(g for _, (_, at, _, _) in self.sizes.items() for p in at for g in [self.gram(hashes, int(p))] if g is not None)
        total = sum(grams.values()) or 1
        self.weight = {g: math.log(1 + total / c) for g, c in grams.items()}
        self.unseen = math.log(1 + total)

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def gram(self, words: np.ndarray, at: int):
        return tuple(words[at : at + self.shingle].tolist()) if at + self.shingle <= len(words) else None

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard coefficient of the shingles of two windows (of their words where a window is shorter)."""
        k = min(self.shingle, len(a), len(b))
        x, y = ({tuple(v[i : i + k].tolist()) for i in range(len(v) - k + 1)} for v in (a, b))
        weigh = lambda s: sum(self.weight.get(g, self.unseen) for g in s)
        return weigh(x & y) / weigh(x | y)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) pairs within the radius."""
        _, _, own, blocks = self.sizes[size]
        a_all, b_all = [], []
        for lo, hi, keys, order, begins in blocks:
            key = self.block(prints, lo, hi)
            if begins is None:
                left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            else:
                left, right = begins[key], begins[key + np.uint64(1)]
            n = right - left
            a = np.repeat(np.arange(len(prints)), n)
            b = order[np.repeat(left, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(prints[a] ^ own[b]) <= self.radius
            a_all.append(a[near])
            b_all.append(b[near])
        pair = np.unique(np.concatenate(a_all) * len(own) + np.concatenate(b_all)) if a_all else np.zeros(0, np.int64)
        return pair // len(own), pair % len(own)


MIX = np.uint64(0x9E3779B97F4A7C15)
#: Share of an item's weight that is looked up, its rarest shingles first.
LOOKED_UP = 0.6


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


class WholeItems:
    """Items as sets of weighted shingles, for windows as long as the item."""

    def __init__(self, items: list[tuple[int, str]], run: int, shingle: int, threshold: float):
        self.threshold, self.widths = threshold, {}
        w = split_words([t for _, t in items])
        hashes, per_row = w.hashes(), w.per_row()
        starts = np.cumsum(per_row) - per_row
        by: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for (item, _), s, n in zip(items, starts, per_row, strict=True):
            if n:
                # One word replaced in each run changes k of run shingles on both sides.
                k = max(1, min(shingle, int(run * (1 - threshold) / (1 + threshold))))
                by.setdefault(k, []).append((item, int(n), np.unique(shingle_hashes(hashes[s : s + n], k))))
        for k, rows in by.items():
            known, counts = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
            weight = np.log(1 + counts.sum() / counts)
            own = [weight[np.searchsorted(known, g)] for _, _, g in rows]
            keys, at, least = [], [], np.zeros(len(rows))
            for i, ((_, _, g), x) in enumerate(zip(rows, own, strict=True)):
                order = np.argsort(-x, kind="stable")
                cut = int(np.searchsorted(np.cumsum(x[order]), LOOKED_UP * x.sum())) + 1
                keys.append(g[order[:cut]])
                at.append(np.full(len(keys[-1]), i))
                least[i] = threshold * x.sum() - x[order[cut:]].sum() - 1e-9
            keys, at = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            total = np.array([x.sum() for x in own])
            self.widths[k] = ([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows], own, total, known, weight, float(np.log(1 + counts.sum())), keys[order], at[order], least)

    def found(self, words: np.ndarray, row: np.ndarray):
        """(row, item, similarity) of the best window of each row and item at the threshold."""
        if not len(words):
            return
        ends = np.searchsorted(row, np.arange(row[-1] + 2))
        for k, (ids, sizes, grams, own, total, known, weight, unseen, keys, at, least) in self.widths.items():
            h = shingle_hashes(words, k)
            pos = np.flatnonzero(row[: len(h)] == row[k - 1 :])
            left = np.searchsorted(keys, h[pos], "left")
            n = np.searchsorted(keys, h[pos], "right") - left
            hit = np.repeat(pos, n)
            if not len(hit):
                continue
            key = np.repeat(left, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
            # Each shingle of an item once a row.
            once = np.unique(row[hit].astype(np.int64) * len(keys) + key)
            r, key = once // len(keys), once % len(keys)
            pair, group = np.unique(r * len(ids) + at[key], return_inverse=True)
            held = np.bincount(group, weight[np.searchsorted(known, keys[key])])
            for q in pair[held >= least[pair % len(ids)]].tolist():
                d, i = divmod(q, len(ids))
                mine = h[ends[d] : max(ends[d], ends[d + 1] - k + 1)]
                s = self.best(mine, int(sizes[i]) - k + 1, grams[i], own[i], total[i], known, weight, unseen)
                if s >= self.threshold:
                    yield d, ids[i], s

    def best(self, mine, size, grams, own, total, known, weight, unseen) -> float:
        """The highest similarity of a window of ``size`` shingles (all of them, where there are fewer)."""
        size = min(size, len(mine))
        at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
        shared = np.where(grams[at] == mine, own[at], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(shared)])
        top = 0.0
        for p in np.flatnonzero(sums[size:] - sums[:-size] >= self.threshold * total - 1e-9).tolist():
            x = np.unique(mine[p : p + size])
            to = np.minimum(np.searchsorted(known, x), len(known) - 1)
            each = np.where(known[to] == x, weight[to], unseen)
            both = each[np.isin(x, grams)].sum()
            top = max(top, float(both / (each.sum() + total - both)))
        return min(top, 1.0)


def _search(batches, index: ItemIndex, threshold: float, whole_items: WholeItems | None = None):
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for lo, hi in in_parts(texts, 400_000):
            w = split_words(texts[lo:hi])
            words = w.hashes()
            for start, size, prints in simhashes(words, list(index.sizes)):
                items, at, _, _ = index.sizes[size]
                stop = start + len(prints)
                first = np.flatnonzero(w.row[start:stop] == w.row[start + size - 1 : stop + size - 1])
                a, b = index.near(prints[first], size)
                first += start
                for p, q, r in zip(first[a].tolist(), at[b].tolist(), items[b].tolist(), strict=True):
                    key = (int(ids[lo + w.row[p]]), r)
                    if best.get(key, (0.0, False))[1]:
                        continue
                    x, y = words[p : p + size], index.words[q : q + size]
                    whole = bool((x == y).all())
                    s = 1.0 if whole else index.similarity(x, y)
                    if s >= threshold:
                        best[key] = max(best.get(key, (0.0, False)), (s, whole), key=lambda x: (x[1], x[0]))
            for d, r, s in whole_items.found(words, w.row) if whole_items else ():
                key = (int(ids[lo + d]), r)
                best[key] = max(best.get(key, (0.0, False)), (s, False), key=lambda x: (x[1], x[0]))
        cols = zip(*((d, i, s, x) for (d, i), (s, x) in best.items()), strict=True) if best else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "similarity", "whole"])


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", run: int = 13, radius: int = 3, shingle: int = 5, threshold: float = 0.8, near: bool = True) -> DataFrame:
    """Documents that hold a passage of an item: ``doc_id``, ``item_id``, ``similarity``, ``whole``.

    ``whole``: a run of ``run`` consecutive words is the same in both (for an
    item with fewer words, all its words are one run of the document); these
    are found without exception. Otherwise a window of the document as long as
    the item is ``threshold`` similar to it by weighted shingles, narrow
    enough for one replaced word in each run (found without exception, unless ``near`` is false), or a
    window of a run is within ``radius`` bits of one of the item and as similar. Null and wordless texts and items match nothing.
    Documents with a repeated id are one document; empty tables give an empty
    result.
    """
    given = items.select(F.col(item).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    windows = given.agg(F.sum(F.greatest(F.lit(1), F.length("p") / 2))).first()[0] or 0
    passes = max(1, math.ceil(windows / ITEM_WINDOWS))
    texts = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    texts, out = spread(texts), None
    for k in range(passes):
        rows = [(r["i"], r["p"]) for r in given.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).orderBy("i").collect()]
        sent = docs.sparkSession.sparkContext.broadcast((ItemIndex(rows, run, radius, shingle), WholeItems(rows, run, shingle, threshold) if near else None))
        found = texts.mapInArrow(lambda x, sent=sent: _search(x, sent.value[0], threshold, sent.value[1]), FOUND)
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("whole").alias("whole"))
