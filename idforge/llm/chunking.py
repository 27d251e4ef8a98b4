"""Cutting long texts at natural boundaries by dynamic programming.

A cut costs 0 after a sentence, more at white space and most inside a word;
each piece also pays for the square of its distance from an even size. The
program minimises the sum over all chains of cut positions in which every
piece, with its overlap into the piece before, is within the limit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.operators.lineage import spread

KINDS = ("sentence", "word", "char")
PENALTY = (0.0, 1e3, 1e6)
_GAP = re.compile(r"[ \t\r\n]+")


class Boundaries:
    """Where a text may be cut: after sentences, after other white space, anywhere."""

    def __init__(self, text: str):
        self.n = len(text)
        spans = [(m.start(), m.end()) for m in _GAP.finditer(text)]
        self.words = np.array(spans, np.int64).reshape(-1, 2)
        self.sentences = self.words[[a > 0 and text[a - 1] in ".!?" for a, _ in spans]] if spans else self.words

    def _stretches(self, gaps: np.ndarray) -> np.ndarray:
        return np.concatenate([gaps[:, 0], [self.n]]) - np.concatenate([[0], gaps[:, 1]])

    def kind(self, limit: int) -> str:
        """Weakest boundary needed: whether all stretches between sentence gaps, else between white space, fit the limit."""
        for kind, gaps in zip(KINDS, (self.sentences, self.words)):
            if self._stretches(gaps).max() <= limit:
                return kind
        return "char"

    def candidates(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a cut may lie, ascending, and the penalty of each.

        White space counts as a candidate only where sentence ends are more than
        ``step`` apart, single characters (all of them) only where white space
        is: a cheaper chain never uses a dearer cut elsewhere.
        """
        found, last = [], np.array([0, self.n])
        for penalty, ends in zip(PENALTY, (self.sentences[:, 1], self.words[:, 1], np.arange(1, self.n))):
            wide = np.flatnonzero(np.diff(last) > step)
            if penalty and not len(wide):
                break
            ends = ends[(ends > 0) & (ends < self.n)]
            if penalty:
                low, high = np.searchsorted(ends, last[wide], "right"), np.searchsorted(ends, last[wide + 1], "left")
                ends = np.concatenate([ends[a:b] for a, b in zip(low, high)])
            found.append((ends, np.full(len(ends), penalty)))
            last = np.sort(np.concatenate([last, ends]))
        at, cost = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        return at[order], cost[order]


def cut_kind(text: str, limit: int) -> str:
    """Weakest boundary that a text needs (see ``Boundaries.kind``)."""
    return Boundaries(text).kind(limit)


def best_cuts(text: str, limit: int, overlap: int, bounds: Boundaries | None = None) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces that cover the text; each starts ``overlap`` before the last one's end."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    pieces = -(-(n - overlap) // step)
    even = (n - overlap) / pieces + overlap
    at, penalty = (bounds or Boundaries(text)).candidates(step)
    at, penalty = np.concatenate([[0], at, [n]]), np.concatenate([[0.0], penalty, [0.0]])
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0
    low = np.searchsorted(at, at - step, "left")
    low[at <= limit] = 0  # the first piece has no overlap
    begin, own = np.maximum(at - overlap, 0), 1.0 / even
    late = np.searchsorted(at, overlap, "right")  # but for the start, a piece must get past the one before
    for k in range(1, len(at)):
        a = max(low[k], late)
        cost = best[a:k] + ((at[k] - begin[a:k]) * own - 1.0) ** 2
        m = int(np.argmin(cost)) if len(cost) else -1
        least = cost[m] if len(cost) else np.inf
        if low[k] == 0 and at[k] <= limit and (first := (at[k] * own - 1.0) ** 2) <= least:
            m, least = -a, first  # the piece from the start, which has no overlap
        best[k], back[k] = least + 0.05 + penalty[k], max(a + m, 0)
    out, k = [], len(at) - 1
    while k:
        j = back[k]
        out.append((int(max(at[j] - overlap, 0)), int(at[k])))
        k = j
    return out[::-1]


def cut_long_texts(df: DataFrame, row: str, fields: list[str], limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every value of ``fields`` longer than ``limit`` code points.

    Returns ``row_no``, ``field_name``, ``piece`` (from 0), ``start``, ``end``
    (code points, end exclusive), ``text`` and ``cut``: the weakest boundary
    that the value needs. Pieces cover the value, are at most ``limit`` long,
    and each starts ``overlap`` before the end of the one before. Values that
    are null, empty or within the limit give no piece; nor does an empty table.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    values = F.filter(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)), lambda x: F.length(x["value"]) > limit)
    long = df.select(F.col(row).alias("row_no"), F.explode(values).alias("v")).select("row_no", "v.field_name", "v.value")

    def work(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for r, field, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds = Boundaries(text)
                kind = bounds.kind(limit)
                for k, (a, b) in enumerate(best_cuts(text, limit, overlap, bounds)):
                    for c, x in zip(cols, (r, field, k, a, b, text[a:b], kind), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row_no", "field_name", "piece", "start", "end", "text", "cut"])

    return spread(long).mapInArrow(work, "row_no bigint, field_name string, piece int, start int, end int, text string, cut string")
