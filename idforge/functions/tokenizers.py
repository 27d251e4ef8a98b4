"""Tokenizers from vocabulary files, for the places where the default word tokens won't do.

A file in the ``tokenizers`` library's JSON form is named by the setting
``spark.idforge.pieces`` or given, and sent to the executors by Spark; the
library is only imported where it is used.
"""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING, PIECES = "spark.idforge.pieces", "/opt/tokenizers/word_bpe_49k.json"
_OPEN: dict[str, object] = {}


def _shipped(path: str | None) -> str:
    spark = SparkSession.getActiveSession()
    path = path or spark.conf.get(SETTING, PIECES)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _opened(name: str):
    if name not in _OPEN:
        from tokenizers import Tokenizer

        _OPEN[name] = Tokenizer.from_file(SparkFiles.get(name))
        _OPEN[name].encode_special_tokens = True
    return _OPEN[name]


def _each(texts: pd.Series, name: str, of) -> pd.Series:
    """``of`` the pieces of every text, None for null."""
    there = [t is not None for t in texts]
    encoded = iter(_opened(name).encode_batch([t for t in texts if t is not None], add_special_tokens=False))
    return pd.Series([of(next(encoded)) if known else None for known in there], dtype=object)


def piece_ids(text: Column, path: str | None = None) -> Column:
    """Ids of a text's pieces, without special tokens; null for null."""
    name = _shipped(path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, name, lambda e: e.ids)

    return run(text)


@functools.cache
def _alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)} | {" ": 32}


def _joined(pieces: list[str]) -> str:
    """Pieces as text; a word's last piece ends with a mark."""
    text, known = "".join(pieces).replace("</w>", " "), _alphabet()
    return bytes(known[c] for c in text).decode("utf-8", "replace").strip() if all(c in known for c in text) else text.strip()


def piece_round_trip(text: Column, path: str | None = None) -> Column:
    """A text as it comes back from its pieces, e.g. in lower case with punctuation set apart; null for null."""
    name = _shipped(path)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, name, lambda e: _joined(e.tokens))

    return run(text)
