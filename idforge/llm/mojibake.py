"""Text that was decoded with another encoding than it was written in.

Characters are mapped back to the bytes of a legacy encoding, and a byte
automaton for well-formed UTF-8 sequences finds the maximal multibyte spans;
only these are decoded, so what was right stays as it is. A span counts if what
it decodes to is plausible and the characters as they stand are not. Text whose
bytes were of a single-byte encoding has no multibyte structure; it shows in
words that can't be right as they stand (mixed scripts, a capital or a symbol
inside a small-letter word) and become right under another reading.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idforge.llm.single_byte import reread_single
from idforge.operators.lineage import spread

#: Encodings that UTF-8 bytes are often read with.
MULTIBYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r")
_FORMED = re.compile(rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+")
#: Punctuation that closes or joins words in right text, so that it may follow an accented letter.
_CLOSING = set("”’»…–—“‘›„‚«‹")
#: What may also follow a letter in right text: spaces, signs of Spanish, ё and the letters of Ukrainian.
_SOFT = _CLOSING | set("\xa0¡¿°²³¹ªº·÷ёЁіІїЇєЄґҐ№")
_LATIN = "À-ÖØ-öø-ÿĀ-ſȘșȚțẞẠ-ỹ"
_PLAIN = re.compile(f"[{_LATIN}\\xa0-\\xbf×÷‐-‧‰-⁞₠-₿ℂ-ⅎ←-⇿∀-⋿─-╿А-яЁёІіЇїЄєҐґ]")
_CJK = re.compile("[㐀-鿿︰-﹯]+(?:[�\x00-\x7f])?")
_LETTERS = f"A-Za-z{_LATIN}"
_CONTROL = re.compile("[\x80-\x9f]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
#: One-letter Russian words under a Cyrillic reading that are no word of any Cyrillic text.
_NO_WORD = re.compile("[РС][ЃѓєѕЏ]|[пя][╦╡╨╬┐▐]")
#: Lead characters of Cyrillic whose second byte is gone.
_HALF = re.compile("[ÐÑ](?=[а-яё])|(?<=[а-яё])[ÐÑ]")
_ALONE = re.compile(r"(?<!\S)Ã[ \xa0](?=\S)")
_WESTERN = re.compile(f"[{_LETTERS}]")


@functools.cache
def _to_bytes(codec: str) -> dict[int, str]:
    """Character to the byte (as latin-1) that ``codec`` gives for it; others become NUL. C1 controls stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
        if codec == "cp1252":
            out.setdefault(b, chr(b))
    return out


def _as_bytes(text: str, codec: str) -> bytes:
    """One byte for each character, a question mark for what ``codec`` doesn't have."""
    if codec in ("cp1252", "cp1251") and _CONTROL.search(text):
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(codec, "replace") for c in text)
    return text.encode(codec, "replace")


@functools.cache
def _rare(c: str) -> bool:
    """Whether ``c`` is an assigned character that needs more evidence than those of ``_PLAIN``."""
    return unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")


def _pieces(a: int, got: str, codec: str) -> list[tuple[int, int, str]]:
    """A well-formed span from ``a``, cut at characters that no text has: (start, end, decoded)."""
    control = codec == "cp1252" and len(got) > 1  # what was misread twice shows controls after the first pass
    out, start, held = [], a, ""
    for c in got:
        n = 2 if c < "\u0800" else 3 if c <= "\uffff" else 4
        if _PLAIN.match(c) or _rare(c) or control and "\x80" <= c <= "\x9f":
            held += c
        else:
            if held:
                out.append((start, a, held))
            start, held = a + n, ""
        a += n
    return [*out, (start, a, held)] if held else out


def _rare_stands(got: str, was: str, before: str, after: str, codec: str) -> bool:
    """Whether a span with characters outside ``_PLAIN`` counts."""
    if "\ufeff" in got or "\ufffd" in got:
        return True
    cased = was.isalpha() and (was.islower() or was.isupper() or was.istitle())
    if cased and (codec in ("mac_roman", "cp850") or codec == "cp437" and len(was) == 2):
        return False  # accented letters only, as in single-byte text
    if len(got) > 1:
        # Letters of other scripts come in words. Frames drawn with lines may be well-formed, too.
        framed = codec in ("cp437", "koi8_r", "cp850") and all("─" <= c <= "▟" for c in was)
        return not framed or sum(map(str.isalpha, got)) > 2
    if before.isupper():
        return False
    if len(was) > 2:
        if "\u2000" <= got <= "\u206f" or codec == "cp1252" and was[0] == "â" and not before.isalpha():
            return True
        return was[1] != "\xa0" and not all(c in _SOFT or c in "©®™€" for c in was[1:])
    if all(c in _SOFT for c in was[1:]) or was.isalpha() or all("─" <= c <= "▟" for c in was):
        return False
    if codec == "mac_roman" and was[0] in _SOFT:
        return False
    if unicodedata.combining(got):
        return got < "Ͱ" and before.isalpha()
    # Latin's rare letters are Ç to É before a symbol; under the others right text has such pairs ("«Ç", "ã¼").
    return "ɐ" <= got <= "Ͽ" or "ƀ" <= got and got < "ɐ" and codec not in ("mac_roman", "cp437", "cp850")


def _plausible(got: str, was: str, before: str, after: str, codec: str) -> bool:
    if any(not _PLAIN.match(c) and _rare(c) for c in got):
        return _rare_stands(got, was, before, after, codec)
    if codec in ("cp437", "cp850") and len(got) == 1 and all("─" <= c <= "▟" for c in (*was, before or after or " ")) and not _CYRILLIC.match(got):
        return False  # a corner of a frame
    if len(got) == 1 and _CYRILLIC.match(got):
        # A word of its own, or beside Cyrillic and what is left of it.
        return not any(c.isalpha() and not _CYRILLIC.match(c) and (codec != "cp1252" or c not in "ÐÑ") for c in (before, after))
    # An accented letter and closing punctuation may just be the end of a quoted word.
    if len(was) == 2 and was[1] in _CLOSING and was[0].isalpha() and codec in ("cp1252", "mac_roman"):
        if codec == "mac_roman" or was[0] not in "ÃÂ":
            return codec == "cp1252" and after.isalpha() and not before.isupper()
        return after.isalpha() or before.islower() or not before.strip()
    if codec in ("mac_roman", "cp850") and all(c.isalpha() for c in was):
        return len(was) > 2 or was[0].isupper() and before.islower()
    return True


def _single_stands(was: str, before: str, after: str, foreign: bool, others: bool) -> bool:
    """Whether a span of one character that isn't Cyrillic counts under a Cyrillic encoding.

    Right Russian has such spans too ("её", "В»", "в…”"), among letters of its own.
    ``foreign``: the text has Cyrillic outside the spans; ``others``: other spans count.
    """
    if _CYRILLIC.match(before) or _CYRILLIC.match(after):
        return False
    if _WESTERN.match(before) or _WESTERN.match(after) or others:
        return True
    closed = all(c in _SOFT for c in was[1:])
    if foreign:
        return len(was) > 2 and not closed
    return not closed or not before.strip()


def _spans(text: str, codec: str) -> tuple[str, int]:
    """Text with its well-formed spans under ``codec`` decoded, and how many characters they had."""
    raw = _as_bytes(text, codec)
    spans = [x for m in _FORMED.finditer(raw) for x in _pieces(m.start(), m[0].decode("utf-8"), codec)]
    if not spans:
        return text, 0
    good = [_plausible(got, text[a:b], text[max(0, a - 1) : a], text[b : b + 1], codec) for a, b, got in spans]
    own = codec in ("cp1251", "koi8_r")  # the misread characters are Cyrillic themselves
    alone = [k for k, (_, _, got) in enumerate(spans) if good[k] and (len(got) == 1 and (own or _CYRILLIC.match(got)) or own and not all(map(_PLAIN.match, got)))]
    for k in alone:
        good[k] = False
    if alone:
        foreign = len(_CYRILLIC.findall(text)) > sum(len(_CYRILLIC.findall(text[a:b])) for a, b, _ in spans)
        russian = not own and foreign or any(g and _CYRILLIC.search(got) for g, (_, _, got) in zip(good, spans, strict=True))
        for others in (False, True):
            if others and not any(g and not _CYRILLIC.search(got) for g, (_, _, got) in zip(good, spans, strict=True)):
                break
            for k in alone:
                a, b, got = spans[k]
                # The words и, в, с, к, у, о, я are one letter; they need Russian around them.
                good[k] = good[k] or (russian or foreign and bool(_NO_WORD.fullmatch(text[a:b])) if _CYRILLIC.match(got) else _single_stands(text[a:b], text[max(0, a - 1) : a], text[b : b + 1], foreign, others))
    out, at, n = [], 0, 0
    for (a, b, got), g in zip(spans, good, strict=True):
        if g:
            out += [text[at:a], got]
            at, n = b, n + b - a
    return "".join([*out, text[at:]]), n


#: Lower-casing after the wrong reading changes the lead characters; (character, byte).
_LOWER = re.compile("(?<![\\w])ã[‘“”•–—](?=[a-z])|â[€‚ƒ„…†‡ˆ‰š‹œž\x80-\x9f][\x80-\xbfŒ-ƒˆ-™]|(?:[ãâ][¡-¬®-¿‡†‰€¤¥ƒˆš\x80-\x9f\xadÿ])|(?:[ðñ][€-™\x80-\xbfŒ-ƒˆ-™ÿ])+")


def _lowered(text: str) -> tuple[str, int]:
    """Spans whose lead characters were lower-cased after the wrong reading."""
    n = 0
    if not _LOWER.search(text):
        return text, 0
    russian = bool(_CYRILLIC.search(text)) or any(m[0][0] in "ðñ" and len(m[0]) >= 4 for m in _LOWER.finditer(text))

    def fix(m: re.Match) -> str:
        nonlocal n
        was = m[0]
        # A word that begins with such a pair (ñ, ó, õ, ...) can't be right, a word that ends with it can.
        opens = text[m.end() : m.end() + 1].isalpha() and not text[max(0, m.start() - 1) : m.start()].isalpha()
        if was[0] in "ãâ" and len(was) == 2 and was[1] in _CLOSING and not opens:
            return was
        if was[0] in "ðñ" and len(was) < 4 and not (russian and not re.match("[A-Za-z]", text[max(0, m.start() - 1) : m.start()]) and not re.match("[A-Za-z]", text[m.end() : m.end() + 1])):
            return was
        raw = []
        for k, c in enumerate(was):
            lead = c in "ãâðñ" and (k == 0 or was[0] in "ðñ" and k % 2 == 0)
            up = {"ã": 0xC3, "â": 0xE2 if len(was) == 3 else 0xC2, "ð": 0xD0, "ñ": 0xD1}.get(c) if lead else None
            if up is None and k and was[k - 1] == "ñ" and c in "šœž":
                up = {"š": 0x8A, "œ": 0x8C, "ž": 0x8E}[c]  # ъ, ь, ю
            if up is None:
                up = 0x9F if c == "ÿ" else ord(_to_bytes("cp1252").get(ord(c), "\0"))
            raw.append(up)
        try:
            got = bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return was
        if not all(_PLAIN.match(c) for c in got):
            return was
        n += len(was)
        return got

    return _LOWER.sub(fix, text), n


def _from_gbk(text: str) -> tuple[str, int]:
    """Runs of Chinese characters that are UTF-8 bytes read two at a time."""
    n = 0

    def fix(m: re.Match) -> str:
        nonlocal n
        tail = m[0][-1] if m[0][-1] < "\x80" else ""
        body = m[0][:-1] if tail or m[0][-1] == "�" else m[0]
        try:
            raw = body.encode("gb18030")
        except UnicodeEncodeError:
            return m[0]
        got = raw.decode("utf-8", "replace")
        lost = got.rstrip("�") != got and m[0][-1] == "�"
        kept = got.rstrip("�") if lost else got
        if not all(_PLAIN.match(c) or c < "\x80" for c in kept) or (not kept and not lost):
            return m[0]
        n += 2 * len(body)
        return kept + ("�" if lost else "") + tail

    return _CJK.sub(fix, text), n


@functools.cache
def _pair(codec: str) -> re.Pattern:
    """A lead and a continuation byte as ``codec`` shows them; without such a pair a text has no span."""
    at = {ord(b): chr(c) for c, b in reversed(_to_bytes(codec).items())}  # controls come last there
    lead, more = (re.escape("".join(at[b] for b in r if b in at)) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    controls = "\x80-\x9f" if codec in ("cp1252", "cp1251") else ""
    return re.compile(f"[{lead}][{more}{controls}]")


def repair(text: str | None) -> tuple[str | None, str | None, bool]:
    """(restored text, how it was found, whether the original couldn't be had in full).

    Found by ``bytes`` (the automaton), ``single`` (no multibyte structure, see
    ``single_byte``) or ``lost`` (only U+FFFD or controls are left); None for a
    right text.
    """
    if text is None or text.isascii():
        return text, None, False
    by, now = None, text
    # Wrong readings can be on top of each other. Each pass leaves fewer misread characters, so it ends.
    while True:
        # The reading that explains the most characters goes first.
        tried = [_spans(now, codec) for codec in MULTIBYTE if _pair(codec).search(now)] + [_from_gbk(now), _lowered(now)]
        best, n = max(tried, key=lambda x: x[1])
        if not n or best == now:
            break
        now, by = best, "bytes"
    if by:
        # The pair C3 A0 ("à") whose second byte has become a plain space; the first one is no word by itself.
        now = _ALONE.sub("à ", now)
    else:
        now, mended = reread_single(now)
        by = "single" if mended else None
    lost = "�" in now or bool(_CONTROL.search(now)) or by is not None and bool(_HALF.search(now))
    return now, by or ("lost" if lost else None), lost


def restore(text: str | None) -> tuple[str | None, bool, bool]:
    """(restored text, whether any of it was wrongly decoded, whether the original couldn't be had in full)."""
    now, by, lost = repair(text)
    return now, by is not None, lost


def garbled(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with wrongly decoded parts: ``doc_id``, ``text``, ``restored``, ``lost``, ``by``.

    ``restored`` is the text with all spans mended that can be; ``lost`` says
    that some original characters can't be had (they had become U+FFFD or
    controls); ``by`` is how the text was found (see ``repair``). Right texts
    are left out, as are nulls. Repeated rows give repeated rows; an empty
    table gives an empty result.
    """

    def work(batches):
        for batch in batches:
            rows = [(i, t, *repair(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(i, t, r, lost, by) for i, t, r, by, lost in rows if by]
            cols = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], ["doc_id", "text", "restored", "lost", "by"])

    # Plain ASCII can't be garbled and never leaves the JVM.
    rows = df.select(F.col(row).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > F.length("text"))
    return spread(rows).mapInArrow(work, "doc_id bigint, text string, restored string, lost boolean, by string")
