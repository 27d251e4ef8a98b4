"""Expressions on document identifiers, their codes and the URLs they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that say nothing about a page.
GENERIC_SEGMENTS = ("index", "page", "item", "view", "default", "home")
VOCABULARY = 32128


def bracketed(docid: Column) -> Column:
    """``[id]`` in lower case, whatever brackets the id had; null stays null."""
    return F.concat(F.lit("["), F.lower(F.regexp_replace(F.trim(docid), "^[\\[\\] ]+|[\\[\\] ]+$", "")), F.lit("]"))


def unbracketed(docid: Column) -> Column:
    """The id in lower case without brackets and outer blanks."""
    return F.lower(F.regexp_replace(F.trim(docid), "^[\\[\\] ]+|[\\[\\] ]+$", ""))


def normal_url(url: Column) -> Column:
    """Trimmed, lower case, without scheme, dashes as blanks."""
    u = F.lower(F.trim(url))
    for a, b in (("http://", ""), ("https://", ""), ("-", " ")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return u


def url_segments(url: Column) -> Column:
    """Non-empty segments of the normalised URL; the first is the domain."""
    return F.filter(F.split(normal_url(url), "/"), lambda s: s != "")


def rich_segments(segments: Column) -> Column:
    """Whether most segments are neither numeric nor generic nor at most two characters long."""
    good = F.filter(segments, lambda s: ~s.rlike("^\\p{N}+$") & ~s.isin(*GENERIC_SEGMENTS) & (F.length(s) > 2))
    return F.size(good) > F.size(segments) / 2


def url_title_docid(url: Column, title: Column) -> tuple[Column, Column]:
    """(text of the identifier, branch): rich URL, else title with domain, else title, else domain, else skipped.

    A rich URL reads from its last segment to the first after the domain.
    """
    seg = url_segments(F.coalesce(url, F.lit("")))
    domain = F.get(seg, F.lit(0))
    tail = F.array_join(F.reverse(F.slice(seg, 2, F.greatest(F.size(seg), F.lit(1)))), " ")
    named = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    branch = (
        F.when((F.size(seg) > 0) & rich_segments(seg), "url")
        .when((named != "") & domain.isNotNull(), "title_domain")
        .when(named != "", "title")
        .when(domain.isNotNull(), "domain")
        .otherwise("skipped")
    )
    text = F.when(branch == "url", F.trim(F.concat_ws(" ", tail, domain))).when(branch == "title_domain", F.concat_ws(" ", named, domain)).when(branch == "title", named).when(branch == "domain", domain)
    return text, branch


def end_tokens(tokens: Column, most: int, end: int = 1) -> Column:
    """At most ``most`` tokens and the end token."""
    return F.concat(F.slice(tokens, 1, most), F.array(F.lit(end)))


def codes_to_tokens(codes: Column, size: int, vocabulary: int = VOCABULARY) -> Column:
    """Code at position i to the token ``vocabulary + i * size + code``."""
    return F.transform(codes, lambda x, i: x + i * size + vocabulary)


def tokens_to_codes(tokens: Column, size: int, vocabulary: int = VOCABULARY) -> Column:
    """Inverse of ``codes_to_tokens``."""
    return F.transform(tokens, lambda x, i: x - vocabulary - i * size)


def codes_text(codes: Column, sep: str = " - ") -> Column:
    return F.array_join(F.transform(codes, lambda x: x.cast("string")), sep)


def text_codes(text: Column, sep: str = " - ") -> Column:
    return F.transform(F.split(text, sep), lambda x: x.cast("int"))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` white-space separated words."""
    return F.array_join(F.slice(F.filter(F.split(text, "\\s+"), lambda x: x != ""), 1, n), " ")


def content_uuid(text: Column) -> Column:
    """A stable identifier of UUID form from the text's hash."""
    h = F.md5(text)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def unit(vector: Column) -> Column:
    """Vector over its Euclidean norm; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def scalar_codes(vector: Column, bits: int) -> Column:
    """Each dimension of the unit vector in ``bits`` bits, truncated."""
    return F.transform(unit(vector), lambda x: ((x + 1) / 2 * (2**bits - 1)).cast("int"))
