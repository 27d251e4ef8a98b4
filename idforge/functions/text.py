"""Expressions on page text, spans, prompts and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits: the default tokenizer."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip_tags(text: Column) -> Column:
    """Without markup and line ends, blanks squeezed."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^<]+?>", ""), "[\\n\\r]", "")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def before_mark(text: Column, mark: str) -> Column:
    """What stands before the first ``mark``; all of it where there is none."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def after_mark(text: Column, mark: str) -> Column:
    """What stands from the first ``mark`` on; empty where there is none."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def before_last(text: Column, mark: str) -> Column:
    """What stands before the last ``mark``; all of it where there is none."""
    n = F.size(F.split(text, _literal(mark), -1))
    return F.when(n > 1, F.array_join(F.slice(F.split(text, _literal(mark), -1), F.lit(1), n - 1), mark)).otherwise(text)


def _literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def span(words: Column, start: Column, end: Column) -> Column:
    """Words ``start`` to before ``end`` (from 0), joined; empty for a missing span."""
    there = (start >= 0) & (end > start)
    return F.when(there, F.array_join(F.slice(words, start + 1, F.greatest(end - start, F.lit(0))), " ")).otherwise("")


def blank_if_missing(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def rough_wordpiece(title: Column) -> Column:
    """Lower case with punctuation set apart, as a lower-casing word-piece round trip leaves it."""
    plain = F.regexp_replace(F.lower(title), "[\\s\\p{Z}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "([^\\p{L}\\p{N} ])", " $1 "), " +", " "))


def padded(ids: Column, n: int, pad: int = 0) -> Column:
    """Cut or filled to exactly ``n`` ids."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def mask(ids: Column, n: int) -> Column:
    """1 for each real id among ``n``, 0 for the padding."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.size(ids)).cast("int"))


def labels(ids: Column, n: int, ignore: int = -100) -> Column:
    """Target ids with padding that the loss ignores."""
    return padded(ids, n, ignore)


def without_prompt(text: Column) -> Column:
    """Without a leading ``Passage: ``, then without a leading ``Question: ``."""
    return F.regexp_replace(F.regexp_replace(text, "^Passage: ", ""), "^Question: ", "")


def question_prompt(lang: Column, title: Column, passage: Column) -> Column:
    return F.format_string("Generate a %s question for this passage: %s %s", lang, title, passage)


def section_title(raw: Column) -> Column:
    """What stands from the seventh character to ``_parentSection``; without that mark the last character is lost."""
    at = F.locate("_parentSection", raw)
    return F.when(at > 0, F.substring(raw, F.lit(7), at - 7)).otherwise(F.substring(raw, F.lit(7), F.length(raw) - 7))


def ranker_text(query: Column, title: Column | None, text: Column, sep: str = " [SEP] ", answer: Column | None = None) -> Column:
    """Query and context for a ranker; the context is the text, with the title and the answer before it where given."""
    return F.concat(query, F.lit(sep), F.concat_ws(" ", *(c for c in (answer, title, text) if c is not None)))


def dotted_sentences(text: Column) -> Column:
    """Pieces between full stops, trimmed, each with its full stop."""
    return F.transform(F.filter(F.split(text, "\\."), lambda s: F.trim(s) != ""), lambda s: F.concat(F.trim(s), F.lit(".")))


def sentences(text: Column) -> Column:
    """Sentences with their closing marks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def encoder_text(passage: Column, most: int) -> Column:
    """``Passage: `` and the first ``most`` characters."""
    return F.concat(F.lit("Passage: "), F.substring(passage, 1, most))


def title_of(text: Column) -> Column:
    """First line of a text."""
    return F.trim(F.substring_index(text, "\n", 1))


def padded_number(x: Column) -> Column:
    """A number from a padded field, null where it is none."""
    return F.trim(x).try_cast("double")
