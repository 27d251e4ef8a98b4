"""One definition of a word, for the JVM and for Python.

Words are the maximal runs of Unicode letters and digits of the lower-cased
text. An underscore or a combining sign ends a word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
JVM_WORD = "[\\p{L}\\p{N}]+"


def words(text: str | None) -> list[str]:
    """Words of a text; none for null."""
    return WORD.findall(text.lower()) if text else []


def words_col(text: Column) -> Column:
    """Array of words, computed in the JVM; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(JVM_WORD), F.lit(0))


def title_key_col(title: Column) -> Column:
    """Words sorted by code point and joined by a space; null if there is none."""
    key = F.array_join(F.array_sort(words_col(title)), " ")
    return F.when(key != "", key)


def clean_id_col(raw: Column) -> Column:
    """Id without square brackets and outer white space; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(raw, "[\\[\\]]", ""), "^\\s+|\\s+$", "")
    return F.when(bare != "", bare)


def blank_to_null(text: Column) -> Column:
    """Null for a text that is empty or only white space (Unicode white space included)."""
    return F.when(text.rlike("[^\\s\\p{Z}\\x{85}\\x1c-\\x1f]"), text)
