"""One consistent form for text that looks the same but is made of other characters.

A token's letters each have a resolved script set: their own script and the scripts that hold a twin of them. The
intersection over the token tells which scripts could spell it. A token of several scripts (mixed confusable)
is spelled in a script of the intersection. A token of one foreign script whose letters all have Latin twins (whole-script
confusable) is judged with its neighbours: it stays if any word of that script in its sentence needs its own alphabet,
else it is spelled in Latin. A token that mixes scripts and that no script can spell stays and is reported. The remaining forms - compatibility
forms, decomposed accents, Arabic code points of Persian letters, odd spaces, invisible characters - are normalized.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Latin twins of single letters of other scripts, as Unicode's confusables data has them.
TWINS = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХЗаеѕіјкорсухԁһԛԝъвмнтӀӏҮүѴѵԌЬб", "ABESIJKMHOPCTYX3aesijkopcyxdhqwbBMHTliYyVvGb6")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχτϹϲͿϳϱσ", "ABEZHIKMNOPTYXayiKvopuxTCcJjpo")),
    "Armenian": dict(zip("ՕօՏՍԼսհոցզյա", "OoSULuhngqjw")),
    "Cherokee": dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGZ4bRWSVSLCPKdGB")),
    "Lisu": dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU")),
    "Coptic": dict(zip("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX")),
}
# Letters of Latin script for phonetics that stand in for plain ones.
PHONETIC = dict(zip("ɑɡɩɪ", "agii"))
# Twins too unlike Latin letters to make a whole word suspicious.
LOOSE_TWINS = set("ЗкъвмнтүѵЬбαγικυχτσսհոցզյաᏎᏏᏧ")
# Arabic code points and the standard Persian ones.
PERSIAN_LETTERS = {"ي": "ی", "ى": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ە": "ه", "ہ": "ه", "ھ": "ه"}
PERSIAN_DIGITS = {chr(base + i): str(i) for base in (0x660, 0x6F0) for i in range(10)}
# Invisible characters that Unicode does not class as format characters.
OTHER_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"

ZWNJ, ZWJ = "‌", "‍"

#: Values made of these alone need no work; Java's regular expressions.
USUAL = r"[\t\n\r -~«»À-ſ،؛؟ء-ؤئ-غفقل-وً-ْپچژکگی‌]"
BAD_JOINER = r"(?<![\p{L}\p{M}])‌|‌(?![\p{L}\p{M}])"

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_SCRIPTS = "".join(f"\\p{{{s}}}" for s in TWINS)
_FOREIGN = regex.compile(f"[{_SCRIPTS}{''.join(PHONETIC)}]")
_LETTER = regex.compile(f"[\\p{{Latin}}{_SCRIPTS}]")
#: A Latin letter and one of another script in a token, but for digits and marks between them; Java's regular expressions.
_JAVA_SCRIPTS = "".join(f"\\p{{Is{s}}}" for s in TWINS)
MIXED = f"\\p{{IsLatin}}[\\p{{M}}\\p{{Nd}}]*[{_JAVA_SCRIPTS}]|[{_JAVA_SCRIPTS}][\\p{{M}}\\p{{Nd}}]*\\p{{IsLatin}}"
_SENTENCE = regex.compile(r"[.!?؟\n]")
_JOINERS = regex.compile(r"‌+")
_EMOJI_PART = regex.compile(r"(?<=[\p{Extended_Pictographic}\p{Emoji_Modifier}️])[︎️‍](?=\p{Extended_Pictographic})|(?<=\p{Extended_Pictographic})[︎️]")
_COMPATIBILITY = regex.compile(r"[ﬀ-﷿ﹰ-ﻼ！-￮\U0001D400-\U0001D7FF℀-⅏Ⅰ-ⅿ]")


@lru_cache(maxsize=1 << 12)
def script(c: str) -> str:
    name = unicodedata.name(c, "").partition(" ")[0].capitalize()
    return name if name == "Latin" or name in TWINS else ""


_TWINS = {k: v for of in TWINS.values() for k, v in of.items()}
_BACK = {s: {v: k for k, v in of.items()} for s, of in TWINS.items()}


def _base(c: str) -> str:
    """The letter without its accents; a letter with a twin is its own."""
    return c if c in _TWINS or c.isascii() else unicodedata.normalize("NFD", c)[0]


@lru_cache(maxsize=1 << 12)
def resolved(c: str) -> frozenset[str]:
    """The scripts that can spell a letter: its own, and those with a twin of its base."""
    found, latin = {script(c)}, _base(c) if script(c) == "Latin" else _TWINS.get(_base(c))
    if latin:
        found.add("Latin")
        found |= {s for s, back in _BACK.items() if latin in back}
    return frozenset(found)


def respelled(c: str, into: str) -> str:
    if script(c) == into:
        return c
    base, marks = _base(c), "" if _base(c) == c else unicodedata.normalize("NFD", c)[1:]
    latin = base if script(c) == "Latin" else _TWINS.get(base)
    twin = latin if into == "Latin" else _BACK[into].get(latin)
    return unicodedata.normalize("NFC", twin + marks) if twin else c


def needs_alphabet(token: str) -> bool:
    """Whether a token of one foreign script has a letter that Latin can not, or only loosely, stand for."""
    return any(_base(c) not in _TWINS or c in LOOSE_TWINS for c in _LETTER.findall(token))


@lru_cache(maxsize=1 << 16)
def mixed_spelled(token: str) -> str:
    """A token of several scripts in the script that can spell all of it, else in that of most of its letters as far as it goes."""
    letters = _LETTER.findall(token)
    own = {script(c) for c in letters}
    able = frozenset.intersection(*map(resolved, letters))
    if "Latin" in able:
        into = "Latin"
    elif able & own:
        into = min(able & own)
    else:
        into = max(sorted(own), key=lambda s: sum(script(c) == s for c in letters))
    return "".join(respelled(c, into) if _LETTER.match(c) else c for c in token)


def in_one_script(text: str) -> str:
    """The text with every token in a consistent script; words of one foreign script are judged by those of their sentence."""
    spelled: list[tuple[regex.Match, str]] = []
    words: dict[str, list[regex.Match]] = {}

    def settle() -> None:
        for of in words.values():
            if not any(needs_alphabet(m.group()) for m in of):
                spelled.extend((m, "".join(respelled(c, "Latin") for c in m.group())) for m in of)
        words.clear()

    end = 0
    for m in _TOKEN.finditer(text):
        if _SENTENCE.search(text, end, m.start()):
            settle()
        end = m.end()
        if m.group().isascii():
            continue
        own = {script(c) for c in _LETTER.findall(m.group())}
        if len(own) > 1:
            spelled.append((m, mixed_spelled(m.group())))
        elif own and "Latin" not in own:
            words.setdefault(*own, []).append(m)
    settle()
    out, at = [], 0
    for m, new in sorted(spelled, key=lambda x: x[0].start()):
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join([*out, text[at:]])


def _invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return (kind in ("Cf", "Cc", "Co", "Cs") and c not in "\t\n\r" + ZWNJ) or c in OTHER_INVISIBLE


def consistent_form(text: str) -> str:
    """The text in its one form. Letter case, punctuation and the number of spaces are left alone."""
    once = _normal(text)
    while once != text:  # a letter that became a digit, say, may leave a joiner without its letter
        text, once = once, _normal(once)
    return once


def _normal(text: str) -> str:
    kept = _EMOJI_PART.sub(lambda m: chr(0xF0000 + ord(m.group())), text) if regex.search(r"[‍︎️]", text) else text
    out = []
    for c in kept:
        if 0xF0000 <= ord(c) < 0xF0000 + 0x10000:
            out.append(chr(ord(c) - 0xF0000))
        elif c < "\x7f" and c >= " ":
            out.append(c)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif unicodedata.category(c) in ("Zl", "Zp") or c in "\x85\x0b\x0c":
            out.append("\n")
        elif _invisible(c):
            continue
        else:
            out.append(c)
    s = "".join(out)
    s = _COMPATIBILITY.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    s = unicodedata.normalize("NFC", s)
    s = "".join(PERSIAN_LETTERS.get(c) or PERSIAN_DIGITS.get(c) or c for c in s)
    s = unicodedata.normalize("NFC", s.replace("یٔ", "ئ"))
    if ZWNJ in s:
        s = _JOINERS.sub(lambda m, whole=s: _joiner(whole, m), s)
    if _FOREIGN.search(s):
        s = unicodedata.normalize("NFC", in_one_script("".join(PHONETIC.get(c, c) for c in s)))
    return s


def _joiner(s: str, m: regex.Match) -> str:
    """One joiner inside a word, none elsewhere."""
    inside = 0 < m.start() and m.end() < len(s) and unicodedata.category(s[m.start() - 1])[0] in "LM" and unicodedata.category(s[m.end()])[0] in "LM"
    return ZWNJ if inside else ""


@pandas_udf(StringType())
def _consistent(values: pd.Series) -> pd.Series:
    return values.map(consistent_form, na_action="ignore")


def suspicious(c: Column) -> Column:
    """Whether a value may hold anything to normalize; judged inside the JVM."""
    return ~c.rlike(f"\\A{USUAL}*\\z") | c.rlike(BAD_JOINER)


def normalized(c: Column) -> Column:
    """``c`` in its one form; only suspicious values go to Python. Null stays null, empty stays empty."""
    return F.coalesce(_consistent(F.when(suspicious(c), c)), c)


def odd_values(df: DataFrame, row: str, fields: list[str], table_name: str) -> DataFrame:
    """``table_name``, ``source_row``, ``field``, ``value``, ``normal``: the values that are not in their one form, or mix
    scripts in a word no script can spell, which then is its own normal form.

    Works on each value alone, so repeats, ties and other columns do not matter; nothing is shuffled.
    """
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = df.select(F.col(row).alias("source_row"), value.alias("v")).select("source_row", "v.*")
    odd = long.where(F.col("value").isNotNull() & suspicious(F.col("value"))).withColumn("normal", _consistent("value"))
    return odd.where((F.col("normal") != F.col("value")) | F.col("normal").rlike(MIXED)).select(F.lit(table_name).alias("table_name"), "source_row", "field", "value", "normal")
