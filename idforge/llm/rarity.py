"""A rarity order of tokens from a table whose size is bounded.

Prefix filters are exact under any one order of the tokens; a good order puts
rare tokens first. The counts of all tokens are kept in 2**bits counters that
tokens share by hash. What is sent to the executors is the logarithm of each
counter in one byte. ``bits`` follows the number of tokens up to ``MOST_BITS``
(32 MB); beyond some 10**9 tokens counters are shared by more tokens, which
costs order, never exactness. A token's count is never below the true one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 256
FAN_IN = 64
LEAST_BITS, MOST_BITS = 16, 25
STEPS = 8  # codes per doubling of a count


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list<bigint> column as unsigned numbers, and the row of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64), np.repeat(np.arange(len(lists)), sizes)


def bits_for(tokens: int) -> int:
    """Counters for so many tokens: one for every four to eight, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, tokens))) - 3))


def code_of(count: int | np.ndarray):
    """A count as one byte: ``STEPS`` for each doubling; 0 for 0."""
    return np.minimum(255, np.floor(STEPS * np.log2(1 + np.asarray(count, np.float64)))).astype(np.uint8)


def token_codes(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Counters over every token of an array<bigint> column of all rows, as ``code_of`` gives them.

    Each task counts its own tokens; the counters are added over a tree in
    which no group holds more than FAN_IN of them, so no task grows with the
    number of tasks. ``df`` is read as it is and shouldn't hold a shuffle.
    """
    size, part = 1 << bits, (1 << bits) // CHUNKS
    kind = "node int, chunk int, counts binary"

    def count(batches):
        held = np.zeros(size, np.uint32)
        some = False
        for b in batches:
            tokens, _ = flat(b.column(0))
            some = some or len(tokens) > 0
            at, n = np.unique((tokens & np.uint64(size - 1)).astype(np.int64), return_counts=True)
            held[at] += n.astype(np.uint32)
        if some:
            for k in range(CHUNKS):
                yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int32()), "chunk": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(held[k * part : (k + 1) * part].tobytes(), 1)])})

    def total(key, parts):
        held = np.zeros(part, np.uint64)
        for x in parts["counts"]:
            held += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        held = np.minimum(held, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([zlib.compress(held.tobytes(), 1)])})

    def coded(batches):
        for b in batches:
            done = [zlib.compress(code_of(np.frombuffer(zlib.decompress(x.as_py()), np.uint32)).tobytes(), 1) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.binary())], ["node", "chunk", "counts"])

    parts = df.select(F.col(column)).mapInArrow(count, kind)
    nodes = max(1, df.rdd.getNumPartitions())
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        parts = parts.withColumn("node", F.expr(f"int(node div {FAN_IN})")).groupBy("node", "chunk").applyInArrow(lambda k, t: total(k, t), kind)
    out = np.zeros(size, np.uint8)
    for r in parts.mapInArrow(coded, kind).collect():
        out[r["chunk"] * part : (r["chunk"] + 1) * part] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def codes_at(tokens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes[(tokens & np.uint64(len(codes) - 1)).astype(np.int64)]


def rare_first(tokens: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row from rare to common (ties by value): tokens, rows, places from 0, codes."""
    seen = codes_at(tokens, codes)
    order = np.lexsort((tokens, seen, rows))
    tokens, rows, seen = tokens[order], rows[order], seen[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.concatenate([first, [len(rows)]])))
    return tokens, rows, place, seen
