"""Text functions as Column expressions; only the stemmer and highlighting need Arrow functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "[^\\p{L}\\p{N}]+"
SPLIT = re.compile(r"[^\W_]+")
#: Words that carry no content in an English question or command. Scores depend on the set, so it is fixed.
STOP_WORDS = tuple(
    (
        "a about also am an and are as at be but by can could did do does for from get give got how i if in into is it just "
        "me my need no not of on or our please should show such tell than that the their then there these they this to "
        "want was we what when where who why will with would you your"
    ).split()
)


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), lambda t: ~t.isin(*STOP_WORDS))


def whitespace_tokens(text: Column) -> Column:
    """Runs between white space of any script."""
    return F.filter(F.split(text, "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"), lambda t: t != "")


def prefix_tokens(text: Column, low: int = 2, high: int = 5) -> Column:
    """Every token's prefixes of low..high characters, and the token itself where it is longer."""

    def each(t: Column) -> Column:
        top = F.least(F.length(t), F.lit(high))
        some = F.when(top >= low, F.transform(F.sequence(F.lit(low), F.greatest(top, F.lit(low))), lambda n: F.substr(t, F.lit(1), n))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(F.length(t) > high, F.concat(some, F.array(t))).otherwise(some)

    return F.flatten(F.transform(tokenize(text), each))


@dataclass(frozen=True)
class Analyzer:
    """tokenizer -> lower case -> stop words -> stems, fixed for a store's lifetime."""

    tokenizer: str = "word"  # word | whitespace | prefix
    lowercase: bool = True
    stop_words: bool = True
    stem: bool = False
    low: int = 2
    high: int = 5

    def __call__(self, text: Column) -> Column:
        if self.tokenizer == "whitespace":
            out = whitespace_tokens(text)
            if self.lowercase:
                out = F.transform(out, lambda t: F.lower(t))
        elif self.tokenizer == "prefix":
            out = prefix_tokens(text, self.low, self.high)
        elif self.lowercase:
            out = tokenize(text)
        else:
            out = F.filter(F.split(text, SEPARATOR), lambda t: t != "")
        if self.stop_words:
            out = F.filter(out, lambda t: ~t.isin(*STOP_WORDS))
        return stem_all(out) if self.stem else out


# -- Porter (1980), written from the paper ------------------------------------

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _marks(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _marks(stem)))


def _cvc(w: str) -> bool:
    return _marks(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case ASCII word; anything else, and words of one or two letters, as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _marks(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _marks(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _marks(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    known = {x: porter(x) for x in words.dropna().unique()}
    return words.map(known)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(ts):
        if ts is None:
            return None
        for t in ts:
            if t not in known:
                known[t] = porter(t)
        return [known[t] for t in ts]

    return tokens.map(one)


def spans(text: str | None, terms: set[str], stemmed: bool = False) -> list[tuple[int, int]]:
    """Byte offsets (start, end) of the tokens of ``text`` that are among ``terms``."""
    out, at, seen = [], 0, 0  # bytes and characters so far
    for m in SPLIT.finditer(text or ""):
        t = m.group().lower()
        if (porter(t) if stemmed else t) in terms:
            at, seen = at + len(text[seen : m.start()].encode()), m.start()
            out.append((at, at + len(m.group().encode())))
    return out


def highlight(text: Column, query: str, stemmed: bool = False) -> Column:
    """array<struct<start,end>> in bytes; meant for the few rows of a result page."""
    terms = {porter(t) if stemmed else t for t in (m.group().lower() for m in re.finditer(r"[^\W_]+", query)) if t not in STOP_WORDS}
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t, terms, stemmed)])

    return run(text)


def shorten(text: Column, most: int = 60) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def portable_hash(value: Column) -> Column:
    """A 60-bit hash that other engines can compute too: the first 15 hex digits of MD5."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")
