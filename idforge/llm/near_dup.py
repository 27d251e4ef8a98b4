"""Groups of records whose texts are nearly the same.

Similarity is the Jaccard coefficient of the sets of word runs, and the result
is exact. Two sets are at integer Hamming distance ``|A ^ B|`` of each other
(over the indicator of all runs), and J >= t is the same as
``|A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|)``: a radius search in a metric
space. BK-trees answer it inside shards. A tree over the whole table would
visit nearly all nodes at these radii (most pairs are equally far apart, so
the triangle inequality prunes nothing), so the shards are cut first, in a way
that provably loses no pair. Runs are ordered from rare to common, and those
of more than ``COMMON`` texts (boilerplate, set phrases) are the common ones.

1. exact copies (equal run sets) are folded into one class;
2. classes that share rare runs early in their prefixes are counted, pair by
   pair, and pairs whose shared count can't reach the radius are dropped. No
   common run is looked up, so the lists stay short whatever the texts share;
3. a linked pair that this doesn't find shares common runs only, so that these
   alone reach the radius. For most texts they are too few. The others are
   folded by their set of common runs: two records of one such pattern are
   linked, unread, where the pattern is large enough for their sizes. The rest
   are linked to the smallest record with the same common run that their sizes
   allow (a star, which joins all pairs that the sizes allow);
4. the components of 2 and of 3 are the shards. Every linked pair lies in one
   shard, or follows from links in it.

A shard beyond ``shard_rows`` is split into blocks, and every pair of blocks
gets its own task: one builds the tree, the other searches it. Branches of a
tree whose records are all linked already are not searched again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idforge.llm.fold import distinct_in_row, in_parts, mix, runs_of, split_words, sum_by_row
from idforge.llm.rarity import bits_for, code_of, codes_at, flat, rare_first, token_codes
from idforge.operators.components import connected_components
from idforge.operators.lineage import cut, release, spread

SHARED = 4  # tokens that a pair must share within its prefixes, which are longer by SHARED - 1 for it
COMMON = 1024  # a run of more texts is a common one; where counters are shared, of more than 8 times their mean
PLACES = 27  # bits of a packed place; 8 bits of a share and the size lie above
TEXTS = "row_no bigint, n int, s1 bigint, s2 bigint, h array<bigint>"


def shingled(df: DataFrame, row: Column, text: Column, width: int, min_words: int) -> DataFrame:
    """Distinct word runs of each text: ``row_no``, ``n``, signatures ``s1`` and ``s2``, ``h`` (sorted)."""

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in in_parts(texts):
                words = split_words(texts[a:b])
                enough = (words.per_row() >= max(min_words, width))[words.row]
                rows, runs = distinct_in_row(*runs_of(words.row[enough], words.hashes()[enough], width))
                n = np.bincount(rows, minlength=b - a)
                s1, s2 = (sum_by_row(rows, mix(runs ^ np.uint64(x)), b - a).view(np.int64) for x in (0x51ED270B, 0xA0761D65))
                kept = n > 0
                ends = np.concatenate([[0], np.cumsum(n[kept])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][kept].astype(np.int64)), pa.array(n[kept].astype(np.int32)), pa.array(s1[kept]), pa.array(s2[kept]), pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64)))], ["row_no", "n", "s1", "s2", "h"])

    return spread(df.select(row.alias("row_no"), text.alias("text")).where("row_no is not null and text is not null")).mapInArrow(work, TEXTS)


def prefix_size(n: np.ndarray, t: float) -> np.ndarray:
    """Rarest tokens of a set of n among which any t-similar partner shares SHARED (or all that it must)."""
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + SHARED)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (y := self.up.get(at, at)) != at:
            at = y
        while (y := self.up.get(x, x)) != at:
            self.up[x], x = at, y
        return at

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class BKTree:
    """Sets of integers under the Hamming distance of their indicators.

    Children are keyed by the integer distance to their parent. Each node also
    keeps the largest set below it, from which the radius of a search follows,
    and whether its branch holds records of several groups.
    """

    def __init__(self, t: float, forest: Forest):
        self.share = (1 - t) / (1 + t)
        self.forest = forest
        self.root: list | None = None

    def add(self, item: int, tokens: frozenset) -> None:
        if self.root is None:
            self.root = [item, tokens, {}, len(tokens), False]
            return
        node, own = self.root, self.forest.root(item)
        while True:
            node[3] = max(node[3], len(tokens))
            node[4] = node[4] or self.forest.root(node[0]) != own
            d = len(tokens) + len(node[1]) - 2 * len(tokens & node[1])
            if d not in node[2]:
                node[2][d] = [item, tokens, {}, len(tokens), False]
                return
            node = node[2][d]

    def link(self, row: int, tokens: frozenset) -> Iterator[int]:
        """Joins ``row`` with all items at t or more and gives those it wasn't joined with before.

        Only edges within the radius are followed, and no branch that is one group with ``row`` already.
        """
        todo, seen, joined = [self.root] if self.root else [], [], False
        n = len(tokens)
        while todo:
            node = todo.pop()
            item, other, children, largest, mixed = node
            if not mixed and self.forest.root(item) == self.forest.root(row):
                continue
            seen.append(node)
            d = n + len(other) - 2 * len(tokens & other)
            if d <= self.share * (n + len(other)) + 1e-9 and self.forest.join(row, item):
                joined = True
                yield item
            radius = self.share * (n + largest) + 1e-9
            todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        if joined:  # branches may have become one group
            for node in reversed(seen):
                own = self.forest.root(node[0])
                node[4] = any(c[4] or self.forest.root(c[0]) != own for c in node[2].values())


def _postings(reps: DataFrame, codes: np.ndarray, common: int, t: float) -> DataFrame:
    """Prefix tokens of each class, without the common ones.

    ``at`` packs the size of the class, the share of its common tokens (0 where
    the prefix doesn't get to them; never below the true one) and the token's place.
    """
    known = reps.sparkSession.sparkContext.broadcast(codes)

    def work(batches):
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            step = max(1, 400_000 // max(1, int(n.mean() if len(n) else 1)))
            for a in range(0, len(ids), step):
                tokens, rows = flat(batch.column(2).slice(a, step))
                tokens, rows, place, seen = rare_first(tokens, rows, known.value)
                m = n[a : a + step]
                size, rare = prefix_size(m, t), seen <= common
                often = m - np.bincount(rows[rare], minlength=len(m))
                share = np.where(m - often < size, -(-often * 255 // np.maximum(m, 1)), 0)
                kept = rare & (place < size[rows])
                r = rows[kept]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(ids[r + a]), pa.array(m[r] << (PLACES + 8) | share[r] << PLACES | place[kept])], ["tok", "row", "at"])

    return reps.select("row_no", "n", "h").mapInArrow(work, "tok bigint, row bigint, at bigint")


def _patterns(reps: DataFrame, codes: np.ndarray, common: int, t: float) -> DataFrame:
    """Classes whose common tokens alone could make a link: ``row_no``, ``n``, ``k`` (common tokens), ``s1``, ``s2`` (their signatures), ``most`` (the size up to which a partner may be that shares only these) and ``toks`` (their prefix)."""
    known = reps.sparkSession.sparkContext.broadcast(codes)

    def work(batches):
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            tokens, rows = flat(batch.column(2))
            often = codes_at(tokens, known.value) > common
            tokens, rows = tokens[often], rows[often]
            k = np.bincount(rows, minlength=len(n))
            least = np.ceil(t * n - 1e-9).astype(np.int64)
            kept = (k >= least) & (k > 0)
            if not kept.any():
                continue
            tokens, rows = tokens[kept[rows]], rows[kept[rows]]
            s1, s2 = (sum_by_row(rows, mix(tokens ^ np.uint64(x)), len(n)).view(np.int64) for x in (0x51ED270B, 0xA0761D65))
            tokens, rows, place, _ = rare_first(tokens, rows, known.value)
            early = place < (k - least + 1)[rows]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[early], minlength=len(n))[kept])]).astype(np.int32)
            most = np.floor(k * (1 + t) / t - n + 1e-9).astype(np.int64)
            cols = [ids[kept], n[kept], k[kept], s1[kept], s2[kept], most[kept]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[early].view(np.int64)))], ["row_no", "n", "k", "s1", "s2", "most", "toks"])

    return reps.select("row_no", "n", "h").mapInArrow(work, "row_no bigint, n bigint, k bigint, s1 bigint, s2 bigint, most bigint, toks array<bigint>")


def _common_links(patterns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What follows from common tokens: links (``u``, ``v``), edges of shards (``u``, ``v``), and the rows (``row_no``) that a tree must hold.

    Two records with the pattern P are linked if their sizes allow it with
    ``|P|`` shared, and then each is linked to the smallest record of P; so
    only that one and the records too large for it go on. A pair of these that
    may be linked has a smaller record whose size is within its own ``most``;
    only such records are stars' centres and held in trees.
    """
    by = ["s1", "s2", "k"]
    firsts = patterns.groupBy(*by).agg(F.min(F.struct("n", "row_no")).alias("m"))
    rows = patterns.join(firsts, by)
    own = F.col("row_no") == F.col("m.row_no")
    links = rows.where(~own & (F.col("m.n") <= F.col("most"))).select(F.col("row_no").alias("u"), F.col("m.row_no").alias("v"))
    rest = rows.where(own | (F.col("m.n") > F.col("most"))).select("row_no", "n", "most", "toks")
    lists = rest.select("row_no", "n", "most", F.explode("toks").alias("tok"))
    centres = lists.where("n <= most").groupBy("tok").agg(F.min(F.struct("n", "row_no")).alias("hub"))
    stars = lists.join(centres, "tok").where((F.col("row_no") != F.col("hub.row_no")) & (F.col("hub.n") <= F.col("most")))
    return links, stars.select(F.col("row_no").alias("u"), F.col("hub.row_no").alias("v")).distinct(), rest.where("n <= most").select("row_no")


def _pair_batch(a, b, x, y) -> pa.RecordBatch:
    """Pairs with the packed size and place of either side; ``a`` is the smaller row."""
    flip = a > b
    cols = [np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "x", "y"])


def _early(a, b, x, y, t: float):
    """Pairs whose token is early enough in both sets.

    Two sets that share o tokens share the first SHARED of these within their
    first n - o + SHARED tokens, so a token further on needn't be counted.
    """
    na, nb = x >> (PLACES + 8), y >> (PLACES + 8)
    o = np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)
    more, low = np.minimum(SHARED, o) - 1, (1 << PLACES) - 1
    kept = ((x & low) <= na - o + more) & ((y & low) <= nb - o + more)
    return a[kept], b[kept], x[kept], y[kept]


def _within_lists(tok, row, at_, t: float):
    """All pairs of rows within each list that their sizes allow; lists ascend by size."""
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(tok)]]))
    n = at_ >> (PLACES + 8)
    end, at, k = np.repeat(first + size, size), np.arange(len(tok)), 0
    while len(at):
        k += 1
        at = at[at + k < end[at]]
        at = at[n[at + k] * t <= n[at] + 1e-9]  # what fails now fails further on
        if len(at):
            yield _pair_batch(*_early(row[at], row[at + k], at_[at], at_[at + k], t))


def _pairs(batches, t: float):
    """Candidate pairs from postings sorted by (tok, n, row); a list holds no more rows than its token may have without being common."""
    kept = [np.zeros(0, np.int64)] * 3
    for batch in _and_end(batches):
        cols = kept if batch is None else [np.concatenate([x, c.to_numpy().astype(np.int64)]) for x, c in zip(kept, batch.columns, strict=True)]
        tok = cols[0]
        # The last list may go on in the next batch.
        last = int(np.searchsorted(tok, tok[-1])) if batch is not None and len(tok) else len(tok)
        yield from _within_lists(*(c[:last] for c in cols), t)
        kept = [c[last:] for c in cols]


def _and_end(batches):
    yield from batches
    yield None


def _solve(task: tuple, items: list[tuple], t: float, apart: bool) -> list[tuple]:
    """Links found in one task. ``items``: (row, block, keep, tokens) of a shard or of two of its blocks; only those to keep are held by trees."""
    _, _, low, high, blocks = task
    forest, links = Forest(), []
    items = [(row, block, keep, frozenset(tokens)) for row, block, keep, tokens in sorted(items, key=lambda x: (len(x[3]), x[0]))]

    def search(held, asked, tree: BKTree):
        for row, block, keep, tokens in items:
            if asked(block, keep):
                links.extend((row, other, False) for other in tree.link(row, tokens))
            if held(block) and keep:
                tree.add(row, tokens)

    if low == high:
        search(lambda b: True, lambda b, k: True, BKTree(t, forest))
    else:
        for mine, other, all_ in ((low, high, True), (high, low, False)):
            tree = BKTree(t, forest)
            for row, block, keep, tokens in items:
                if block == mine and keep:
                    tree.add(row, tokens)
            search(lambda b: False, lambda b, k, o=other, e=all_: b == o and (e or not k), tree)
    if blocks == 1 and not apart:
        return [(row, forest.root(row), True) for row, *_ in items if forest.root(row) != row]
    return links


def _search(batches, t: float, apart: bool):
    """Runs ``_solve`` for each task; rows come sorted by task. ``apart``: a record may be in two shards, so none has a group whole."""
    task, items, found = None, [], []

    def out():
        u, v, whole = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(whole, pa.bool_())], ["u", "v", "whole"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        for key, row, block, keep, tokens in zip(keys, *(batch.column(k).to_pylist() for k in (5, 6, 7)), batch.column(8), strict=True):
            if key != task:
                if items:
                    found += _solve(task, items, t, apart)
                task, items = key, []
            items.append((row, block, keep, tokens.values.to_numpy().tolist()))
        if len(found) > 10_000:
            yield out()
            found.clear()
    if items:
        found += _solve(task, items, t, apart)
    yield out()


def _members(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts that may be among the nodes: a filter of bounded size, so that the join needn't shuffle all texts."""
    bits = bits_for(64 * nodes.count())
    there = np.packbits(token_codes(nodes.select(F.array(F.xxhash64("node")).alias("h")), "h", bits) > 0, bitorder="little")
    known = texts.sparkSession.sparkContext.broadcast(there)

    def work(batches):
        for batch in batches:
            at = batch.column(2).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
            yield batch.select([0, 1]).filter(pa.array(known.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1))

    return texts.withColumn("x", F.xxhash64("row_no")).mapInArrow(work, "row_no bigint, h array<bigint>")


def _tasks(shards: DataFrame, kind: int, keep: Column, shard_rows: int) -> DataFrame:
    """Rows of the tasks of each shard: every pair of its blocks is one."""
    sizes = shards.groupBy("component").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("g"))
    dealt = shards.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.select(F.col("node").alias("row_no"), F.lit(kind).alias("kind"), "component", F.least("block", "x").alias("low"), F.greatest("block", "x").alias("high"), "g", "block", keep.alias("keep"))


def near_duplicate_groups(df: DataFrame, row: str | Column, text: Column, width: int = 5, threshold: float = 0.8, min_words: int = 5, shard_rows: int = 20_000) -> DataFrame:
    """Group of every record that has a near-duplicate: ``row_no``, ``first_row_no`` (the group's smallest).

    Two records are linked if the sets of their runs of ``width`` words have a
    Jaccard coefficient of at least ``threshold``; groups are the connected
    components. Records with a null or blank text or fewer than ``min_words``
    (or ``width``) words take no part. Repeated row numbers are one record.
    The result holds the first record of a group too; records alone in their
    group are left out. An empty table gives an empty result.
    """
    t, row = threshold, F.col(row) if isinstance(row, str) else row
    texts = cut(shingled(df, row, text, width, min_words), "texts")
    light = texts.select("row_no", "s1", "s2", "n")
    classes = light.groupBy("s1", "s2", "n").agg(F.min("row_no").alias("node"), F.count("*").alias("c")).where("c > 1")
    copies = cut(light.join(classes, ["s1", "s2", "n"]).select("row_no", "node"), "copies")
    again = copies.where("row_no <> node").select("row_no")
    reps = texts.join(again, "row_no", "left_anti")
    tokens = texts.agg(F.sum("n")).first()[0] or 0
    codes = token_codes(texts, "h", bits_for(tokens))
    common = int(code_of(max(COMMON, 8 * tokens // len(codes))))
    posts = _postings(reps, codes, common, t).repartition("tok").sortWithinPartitions("tok", "at", "row")
    # Sizes are the same in all postings of a row, so the largest packed value has the last shared place.
    pairs = posts.mapInArrow(lambda x: _pairs(x, t), "a bigint, b bigint, x bigint, y bigint").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("x").alias("x"), F.max("y").alias("y"))
    (na, ha, pa_), (nb, hb, pb) = ((n := F.shiftright(F.col(k), PLACES + 8), F.ceil(F.shiftright(F.col(k), PLACES).bitwiseAND(255) * n / 255), F.col(k).bitwiseAND((1 << PLACES) - 1)) for k in "xy")

    # Enough is shared early, and what lies behind the last shared token could make up the rest; or common tokens could.
    needed = F.ceil(F.lit(t / (1 + t)) * (na + nb) - 1e-9)
    early = (F.col("c") >= F.least(F.lit(SHARED), needed)) & (F.col("c") + F.least(na - pa_ - 1, nb - pb - 1) >= needed)
    edges = pairs.where(early | (F.col("c") + F.least(ha, hb) >= needed)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    shards = cut(connected_components(edges), "shards")
    tasks, nodes, proven = _tasks(shards, 0, F.lit(True), shard_rows), shards.select("node"), None
    patterns = cut(_patterns(texts, codes, common, t).join(again, "row_no", "left_anti"), "patterns") if int(codes.max(initial=0)) > common else None
    if patterns is not None and not patterns.isEmpty():
        proven, stars, kept = _common_links(patterns)
        others = connected_components(stars).join(kept.withColumnRenamed("row_no", "node").withColumn("keep", F.lit(True)), "node", "left")
        others = cut(others, "shards")
        tasks = tasks.union(_tasks(others, 1, F.coalesce("keep", F.lit(False)), shard_rows))
        nodes = cut(nodes.union(others.select("node")), "nodes")
    loaded = tasks.join(_members(texts.select("row_no", "h"), nodes), "row_no").select("kind", "component", "low", "high", "g", "row_no", "block", "keep", "h")
    loaded = loaded.repartition("kind", "component", "low", "high").sortWithinPartitions("kind", "component", "low", "high", "row_no")
    apart = proven is not None
    links = cut(loaded.mapInArrow(lambda x: _search(x, t, apart), "u bigint, v bigint, whole boolean"), "links")
    roots = links.where("whole").select(F.col("u").alias("node"), F.col("v").alias("root"))
    open_ = links.where("not whole").select("u", "v")
    open_ = open_ if proven is None else open_.union(proven)
    if not open_.isEmpty():
        roots = cut(roots.union(connected_components(open_).where("node <> component")), "roots")
    for done in (texts, shards, nodes, patterns):
        release(done)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    members = copies.union(roots.select(F.col("node").alias("row_no"), F.col("node").alias("own"))).distinct()
    return members.join(roots, "node", "left").select("row_no", F.coalesce("root", "node").alias("first_row_no"))
