"""Single-byte text that was read with another single-byte encoding.

There is no multibyte structure to find here, so this is a separate operator
beside the byte automaton of ``mojibake``: it shows in words that can't be right
as they stand (mixed scripts, a capital or a symbol inside a small-letter word)
and become right under another reading, or in sentences without any small
Cyrillic letter that get Russian's letters under one.
"""

from __future__ import annotations

import re

_LATIN = "À-ÖØ-öø-ÿĀ-ſȘșȚțẞẠ-ỹ"
_LETTERS = f"A-Za-z{_LATIN}"
_CONTROL = re.compile("[\x80-\x9f]")
#: (read with, written with) of single-byte text.
SINGLE = (("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"))
CYRILLIC = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251"))
#: What can't stand in a word of right text.
_ODD = re.compile(
    f"[A-Za-z][Ͱ-ϿЀ-ӿ⁰-₟](?![A-Za-z]?\\d)|[Ͱ-ϿЀ-ӿ][A-Za-z]"  # two scripts in one word
    f"|[a-z][À-ÖØ-Þ](?=[a-zß-ÿ])"  # a capital within small letters
    f"|[A-Za-z{_LATIN}][÷─-▟¢£¥§©®±´µ¶¸°¿¡‡†ˆ-˝¯‰√∫≈∆◊∏∑π∂Ω∞≤≥≠⌐⌠⌡₧∙ⁿ²ƒ¬«»ºª‡ﬁﬂ€„‚](?=[a-z{_LATIN}])"  # a symbol within a word
    f"|[a-z{_LATIN}][ˆ˜˙˚˛˝ˇ¨¯¸´](?![\\w])"  # an accent by itself that closes a word
    f"|(?<![\\w])[─│-┋┍-┓┕-┛┝-╿¯˘˙˚˝˛ˇ°¸√∫≈∆◊∂∏∑¢£¥§µ¶±≤≥≠ΣΘΦΩα└┴┬╤╨╥][A-Za-z][a-z]|(?<![\\w])[øìîíôÚ][A-Z][a-z]"  # a symbol that opens a word
)
#: A word as it stands in right text.
_RIGHT = re.compile(f"[“„«‘(¿¡]*[{_LETTERS}]+(?:[’'-][{_LETTERS}]+)*[”“»’).,;:!?…]*")
_CASE = re.compile("[а-яё][А-ЯЁ]")
#: Letters that make up most of Russian text.
_COMMON = set("оеаинтсрвлкмдпу")
#: What ``_other_cyrillic`` could mend has such a run.
_RUN = re.compile("[Ѐ-ӿ]{4}|[À-ÿ]{4}|[─-╿▀-▟]{4}")


def reread_single(text: str) -> tuple[str, bool]:
    """The reading of single-byte text that mends the most words, if any word can't be right as it stands."""
    best, gain = text, 0
    # No white space takes part in _ODD, so what it finds lies in one word.
    odd = [w for w in set(text.split()) if not w.isascii()] if _ODD.search(text) else []
    bad = {w for w in odd if _ODD.search(w)}
    if bad:
        for read, written in SINGLE:
            score, mended = 0, {}
            for w in odd:
                try:
                    got = w.encode(read).decode(written)
                except UnicodeError:
                    score -= 1
                    continue
                if _CONTROL.search(got):
                    score -= 1
                    continue
                score += 2 * ((w in bad) - bool(_ODD.search(got)))
                # Right words lose letters under a wrong reading.
                score -= w not in bad and sum(map(str.isalpha, got)) < sum(map(str.isalpha, w))
                mended[w] = got
            if score <= 0:  # only a part was misread: mend just the words that can't be right
                mended = {w: g for w, g in mended.items() if w in bad and _RIGHT.fullmatch(g) and not _ODD.search(g)}
                score = len(mended) / (1 + len(odd))
            if score > gain:
                best, gain = re.sub(r"\S+", lambda m, t=mended: t.get(m[0], m[0]), text), score
    if not _RUN.search(best):
        return best, gain > 0
    parts = re.split(r"(?<=[.!?\n])", best)
    mended = [_other_cyrillic(p) for p in parts]
    return "".join(mended), gain > 0 or mended != parts


def _other_cyrillic(text: str) -> str:
    """The reading of a sentence in which it has Russian's letters and small letters, if it has neither as it stands."""
    if not (_CASE.search(text) or not re.search("[а-яё]", text)):
        return text
    words = re.findall("[Ѐ-ӿ]+|[À-ÿ]+|[─-╿▀-▟]+", text)
    if sum(map(len, words)) < 10 or sum(len(w) >= 4 for w in words) < 2:
        return text
    best, held = text, common(text)
    for read, written in CYRILLIC:
        got = re.sub(r"[^\x00-\x7f]+", lambda m, r=read, w=written: _reread(m[0], r, w), text)
        if got != text and common(got) > held + 0.15 and len(re.findall("[а-яё]", got)) > 2 * len(re.findall("[А-ЯЁ]", got)):
            best, held = got, common(got)
    return best


def common(text: str) -> float:
    """Share of frequent letters among the Cyrillic ones; 0 for fewer than ten of these."""
    own = re.findall("[Ѐ-ӿ]", text)
    return sum(c.lower() in _COMMON for c in own) / len(own) if len(own) >= 10 else 0.0


def _reread(part: str, read: str, written: str) -> str:
    try:
        return part.encode(read).decode(written)
    except UnicodeError:
        return part
