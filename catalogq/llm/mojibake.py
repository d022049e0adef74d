"""Text that was decoded with the wrong character encoding: found, and restored where possible.

A text is viewed through each legacy encoding: characters go back to the bytes they stand for, and an automaton over
the byte structure of UTF-8 finds the maximal well-formed multibyte spans. Only those spans are decoded, again
and again while that finds more (text may have been garbled twice). Persian text in its single-byte encoding
read as another single-byte encoding has no such structure; there whole words that decode to Arabic letters
and can not be words of the script they are written in make the span. A replacement character is a
passage whose bytes are lost.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Views tried for UTF-8 read as another encoding. latin is Windows-1252 with ISO 8859-1's control codes.
VIEWS = {"latin": ("cp1252", "latin-1"), "cyrillic": ("cp1251",), "arabic": ("cp1256",), "dos": ("cp437",), "dos2": ("cp850",), "mac": ("mac_roman",), "turkish": ("cp1254",), "central": ("cp1250",), "greek": ("cp1253",), "hebrew": ("cp1255",), "baltic": ("cp1257",), "latin9": ("iso8859_15",), "iso_arabic": ("iso8859_6",), "iso_cyrillic": ("iso8859_5",), "koi8": ("koi8_r",), "dos_cyrillic": ("cp866",), "dos_arabic": ("cp864",)}
#: Views tried for single-byte Persian read as another single-byte encoding.
SINGLE_VIEWS = ("latin", "cyrillic", "dos", "dos2", "mac", "greek", "central", "turkish")
#: Views whose letters are ordinary ones in Persian text.
ARABIC_VIEWS = ("arabic", "iso_arabic", "dos_arabic")
PERSIAN_BYTES = "cp1256"
LOST = "�"


@cache
def to_byte(view: str) -> dict[str, int]:
    """The byte of each non-ASCII character of a view. Bytes that an encoding leaves open are control codes."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        for codec in VIEWS[view]:
            try:
                c = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                c = chr(b)
            if ord(c) >= 0x80:
                out.setdefault(c, b)
        if b < 0xA0:
            out.setdefault(chr(b), b)
    return out


@cache
def automaton(view: str) -> re.Pattern:
    """Well-formed multibyte sequences of UTF-8, over the characters of a view; matches are maximal spans."""
    by_byte: dict[int, list[str]] = {}
    for c, b in to_byte(view).items():
        by_byte.setdefault(b, []).append(c)

    def of(low: int, high: int) -> str:
        found = "".join(re.escape(c) for b in range(low, high + 1) for c in by_byte.get(b, ()))
        return f"[{found}]" if found else "(?!)"

    more = of(0x80, 0xBF)
    forms = [
        of(0xC2, 0xDF) + more,
        of(0xE0, 0xE0) + of(0xA0, 0xBF) + more,
        of(0xE1, 0xEC) + more * 2,
        of(0xED, 0xED) + of(0x80, 0x9F) + more,
        of(0xEE, 0xEF) + more * 2,
        of(0xF0, 0xF0) + of(0x90, 0xBF) + more * 2,
        of(0xF1, 0xF3) + more * 3,
        of(0xF4, 0xF4) + of(0x80, 0x8F) + more * 2,
    ]
    return re.compile(f"(?:{'|'.join(forms)})+")


@cache
def opening(view: str) -> re.Pattern:
    """A lead byte and a continuation byte; texts of a view without this pair need not be scanned further."""
    by: dict[bool, list[str]] = {True: [], False: []}
    for c, b in to_byte(view).items():
        if b < 0xC0 or 0xC2 <= b <= 0xF4:
            by[b >= 0xC0].append(re.escape(c))
    return re.compile(f"[{''.join(by[True])}][{''.join(by[False])}]")


def decoded(span: str, view: str) -> str:
    table = to_byte(view)
    return bytes(table[c] for c in span).decode("utf-8")


# Blocks whose characters a restored text may hold.
_EXPECTED = re.compile("[\x80-ɏʹ-˿̀-ͯͰ-ӿ؀-ۿḀ-ỿ​-‧‪-⁯₠-⃏℀-↿∀-⋿─-➿⬀-⯿。-〃ﭐ-﷿︎-️ﹰ-﻿！-｠�\U0001F000-\U0001FAFF]+")
_CLOSING = "»”’…–—°.·™®"


def _believable(text: str, m: re.Match, plain: str, view: str) -> bool:
    """Whether a well-formed span is garbled text, not letters that happen to follow each other."""
    if not _EXPECTED.fullmatch(plain):
        return False
    span = m.group()
    if len(span) == 2 and span[1] in _CLOSING and m.start() and text[m.start() - 1].isupper() and span[0].isupper():
        return False  # a word in capitals before a closing mark
    if len(span) == 2 and span[0].isalpha() and span[1].isalpha() and unicodedata.category(plain) not in ("Lu", "Ll", "Lo"):
        return False
    return True


_ARABIC = re.compile("[ء-يٮ-ە]")
#: Characters of the Arabic view that do not follow an Arabic letter in sound text.
_ODD = re.compile("[ء-ي][\x80-\x9f€‚ƒ„†‡ˆ‰ŒٹڈڑںھŠ‘’“•–—™›œ\xa0¢£¤¥¦§¨©¬\xad®¯°±²³´µ¶·¸¹¼½¾]|[ -~][أآ][©¨§¢ª¯±³´µ¶®°¼½¾\xad\xa0ھ‚ƒ„†‡ˆ‰]|â€")
_TOKEN = re.compile(r"[^ \t\n\r]+")


def _from_utf8(text: str, view: str, whole: bool = False) -> tuple[int, str, int]:
    """Characters explained by a view, the text with its garbled spans decoded, and their number.

    With ``whole`` a span has to fill its run of characters of the view: for texts that hold single-byte passages too, whose
    letters may follow each other as those of a span do.
    """
    if not opening(view).search(text) or (view in ARABIC_VIEWS and not _ODD.search(text)):
        return 0, text, 0
    pattern, table = automaton(view), to_byte(view)
    count = used = 0
    if view in ARABIC_VIEWS:  # the letters are ordinary ones here: whole tokens have to fit
        tokens = list(_TOKEN.finditer(text))
        fits, odd = [], []
        for t in tokens:
            s = t.group()
            rest = s if s.isascii() else pattern.sub("", s)
            fits.append(len(rest) < len(s) and rest.isascii() and all(_EXPECTED.fullmatch(decoded(m.group(), view)) for m in pattern.finditer(s)))
            odd.append(fits[-1] and bool(_ODD.search(s)))
        out, at = [], 0
        for i, t in enumerate(tokens):
            if odd[i] or fits[i] and (i and odd[i - 1] or i + 1 < len(tokens) and odd[i + 1]):
                out += [text[at : t.start()], pattern.sub(lambda m: decoded(m.group(), view), t.group())]
                at = t.end()
                count, used = count + 1, used + len(t.group())
        return used, "".join([*out, text[at:]]), count

    def one(m: re.Match) -> str:
        nonlocal count, used
        plain = decoded(m.group(), view)
        if not _believable(text, m, plain, view) or whole and any(c in table for c in text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]):
            return m.group()
        count, used = count + 1, used + len(m.group())
        return plain

    got = pattern.sub(one, text)
    return used, got, count


@cache
def _persian_letters(view: str) -> tuple[re.Pattern, dict[int, str]]:
    """Words of a view all of whose characters decode to Arabic letters, and the table that decodes them."""
    table, letters = {}, []
    for c, b in to_byte(view).items():
        try:
            p = bytes([b]).decode(PERSIAN_BYTES)
        except UnicodeDecodeError:
            continue
        table[ord(c)] = {"ي": "ی", "ك": "ک"}.get(p, p)
        if _ARABIC.match(p) or p == "‌":
            letters.append(c)
    return re.compile(f"(?<![^\\W\\d_])[{''.join(map(re.escape, letters))}]{{2,}}(?![^\\W\\d_])"), table


@cache
def _beside(view: str) -> re.Pattern:
    """A blank and a word of a view's characters that decode to something."""
    return re.compile(f" [{''.join(re.escape(chr(c)) for c in _persian_letters(view)[1] if c >= 0x80)}]+(?![^\\W\\d_])")


_FOREIGN = re.compile("[^\x00-\x7f\u0600-\u06ff]")
_ONE_CASE = re.compile(r"\w[a-zß-öø-ÿа-џα-ώ]*|[A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ω]+")


def _impossible(word: str, view: str) -> bool:
    """Whether a word of foreign letters can not be one of their own alphabet."""
    if view in ("cyrillic", "greek"):
        return not _ONE_CASE.fullmatch(word)
    return len(word) >= 3  # no word of Latin script has three accented letters and nothing else


def _from_persian(text: str, view: str) -> tuple[int, str, int]:
    """As _from_utf8, for Persian in single bytes."""
    pattern, table = _persian_letters(view)
    found = list(pattern.finditer(text))
    if not found:
        return 0, text, 0
    odd = [m for m in found if _impossible(m.group(), view)]
    if len(odd) < 2 and not any(len(m.group()) >= 5 for m in odd):
        return 0, text, 0
    # a passage reaches over words of the view and what is neither of them nor a letter of another script
    first_last: list[list[int]] = []
    foreign = re.compile("[A-Za-z]{2,}|[ء-يپچژکگی]{2,}|\n")
    beside = _beside(view)
    for m in found:
        if first_last and not foreign.search(text, first_last[-1][1], m.start()):
            first_last[-1][1] = m.end()
        else:
            first_last.append([m.start(), m.end()])
    out, at, count = [], 0, 0
    for a, b in first_last:
        if any(a <= m.start() < b for m in odd):
            while b < len(text) and ord(text[b]) in table and ord(text[b]) >= 0x80:
                b += 1
            while a > at and ord(text[a - 1]) in table and ord(text[a - 1]) >= 0x80:
                a -= 1
            # words beside it that hold a mark of the view's letters, such as a question mark, belong to it as well
            while (m := beside.match(text, b)) and sum(bool(_ARABIC.match(table[ord(c)])) for c in m.group().strip()) > 1:
                b = m.end()
            out += [text[at:a], text[a:b].translate(table)]
            at, count = b, count + 1
    return sum(len(m.group()) for m in found), "".join([*out, text[at:]]), count


def _size(text: str) -> tuple[int, int]:
    """Length and number of characters that are neither ASCII nor Arabic; every pass lessens it, so passes end."""
    return len(text), len(_FOREIGN.findall(text))


#: Two characters in a row that are neither ASCII nor Arabic; the least that a view other than the Arabic ones makes of a letter.
_PAIR = re.compile("[^\x00-\x7f\u0600-\u06ff]{2}")


def restore(text: str) -> tuple[str, int, str]:
    """The text with its garbled passages decoded, their number, and the views that did it ("lost" for lost bytes)."""
    total, how, used, beside = 0, [], [], False

    def best(views: list[str], single_views: tuple[str, ...]) -> tuple[int, str, int, str, bool]:
        if not _PAIR.search(text):  # only the Arabic views have letters that such a text can be garbled into
            views, single_views = [v for v in views if v in ARABIC_VIEWS], ()
        tried = [(*_from_utf8(text, v, beside), v, False) for v in views] + [(*_from_persian(text, v), v, True) for v in single_views]
        left = _size(text) if any(t[2] and t[4] for t in tried) else (0, 0)
        tried = [t for t in tried if t[2] and (not t[4] or _size(t[1]) < left)]
        return max(tried, key=lambda t: t[0], default=(0, text, 0, "", False))  # explains most; the first of equal ones

    while True:
        # what was garbled again was so through the same encoding or the usual one; then other passages through any other
        found = best(list(dict.fromkeys([*used, "latin"])), SINGLE_VIEWS) if how else (0, text, 0, "", False)
        if not found[2]:
            found = best(list(VIEWS), SINGLE_VIEWS)
        _, got, n, view, single = found
        if not n:
            break
        text, total = got, total + n
        how.append(f"persian as {view}" if single else view)
        if single:
            beside = True
        else:
            used.append(view)
    if lost := sum(LOST in run for run in re.findall(f"[?{LOST}]+", text)) if LOST in text else 0:
        total += lost
        how.append("lost")
    return text, total, ", ".join(dict.fromkeys(how))


#: Texts that can not hold a garbled passage match none of these (Java's regular expressions): control codes, lost
#: bytes, letters and signs that only garbling or another alphabet brings; two characters in a row that are neither
#: ASCII nor Arabic; an Arabic letter before such a one, or before one that _ODD has. Ranges, one pattern each: that is
#: several times faster than one pattern. Quotes and dashes of the mac view before a lone letter are left out on purpose:
#: there sound text looks the same.
SUSPECT = (
    r"[\u0080-\u009f�Ѐ-ӿͰ-Ͽ─-▟ÔΓ]",
    r"[¡-׿܀-​‍-‏ -￿][\u0080-׿܀-​‍-￿]",
    r"[ء-ي][\u0080-׿܀-​‍-￿]",
    r"[\u0621-\u064a][\u0679\u0688\u0691\u06ba\u06be]",
)


def suspect(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in SUSPECT])


def garbled_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``restored``, ``passages``, ``how`` of the texts that hold a garbled passage.

    ``restored`` has the passages decoded where possible and is else the text as it was. Every text is judged
    alone and whole, by a pattern inside the JVM first; nothing is shuffled. Null and empty texts hold no passage.
    """
    rows = df.select(key, F.col(text).alias("__text")).where(suspect(F.col(text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [restore(t) for t in pdf["__text"]]
            out = pd.DataFrame({key: pdf[key], "restored": [g[0] for g in got], "passages": [g[1] for g in got], "how": [g[2] for g in got]})
            yield out[out["passages"] > 0]

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, restored string, passages int, how string")
