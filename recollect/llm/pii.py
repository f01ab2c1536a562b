"""PII surrogates: keyed, type-consistent, distinct and coreferent.

Pass 1 finds the distinct entities of the corpus. An entity's surrogate is
drawn from an HMAC of (type, entity, attempt) under a secret key and keeps
what a reader relies on: gender, script and case of names, separators and
grouping of numbers, check digits of cards and IBANs, letter case and length of
tokens, the domain's shape of addresses. The same entity gets the same
surrogate in every document.

A name is an entity by word: given names and family names have surrogates of
their own, so "Mr Otto Braun", "Dr Otto Braun" and "Mr Braun" stay one person.
A name is found after a title; once found, its words are replaced wherever they
stand in that document, titled or not. The gender of a given name is that of
the titles it has in the corpus, else guessed from its form.

The collision check looks at all surrogates at once: two entities that drew
one surrogate, or a surrogate that is itself an entity of the corpus, are
drawn again at the next attempt until none is left; later attempts draw longer
names, addresses and numbers, so surrogates never run out. Pass 2 replaces the
entities; it only needs to know the few whose attempt is not 0 or whose gender
is not the guessed one. If those are more than ``MOST_TRAVELLING``, they reach
the documents by a join instead of with the tasks.

Types: email, phone, card (16 digits, or 13 to 19 with a right check digit), ip
(both versions), token (hexadecimal or mixed, 32 characters and more, or shorter
with a known prefix), iban, ssn, and names after a title in en, fr, de, es.

Defined results: a null text stays null, an empty one empty, both with
``n_entities`` 0; a name counts by its words. Overlapping findings go to the
earlier, then longer one. Repeated rows are treated alike. The columns of the
input are kept, of which ``text`` and, if present, ``n_chars`` change; a column
named like ``count`` gives way to the count. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.memory import tidy
from recollect.runtime import cut

KEY = b"recollect demonstration key"  # a deployment passes its own
MOST_TRAVELLING = 100_000

_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?!\w)"
    r"|(?<![\w.-])0\d(?:[ .]\d\d){4}(?![\w.]?\d)|(?<![\w.-])0\d{2,4}[ /-]\d{5,8}(?!\w))"
)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*\d)(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}(?![A-Za-z0-9_-])")
_PREFIXES = ("akia", "asia", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "xoxa-", "ghp_", "gho_", "aiza")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|[spr]k_(?:live|test)_[0-9A-Za-z]{16,}|xox[abp]-[0-9A-Za-z-]{10,}|gh[po]_[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{30,})(?![A-Za-z0-9_-])")
_EMAIL = re.compile(r"[^\W_](?:[\w.+%-]*[\w+%-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_TITLES = {
    "f": "Mrs Ms Miss Madam Mme Madame Mlle Frau Sra Señora Señorita Doña".split(),
    "m": "Mr Mister Sir Monsieur Herr Sr Señor Don".split(),
    "n": "Dr Prof Mx".split(),
}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e31-\u0e4e])"
_WORD = r"[^\W\d_a-z]" + _LETTER + r"+(?:['’-]" + _LETTER + r"+)*"
_ANY = "|".join(sorted(_GENDER, key=len, reverse=True))
_NAME = re.compile(rf"\b(?:(?:{_ANY})\.? )*({_ANY})(\.? )({_WORD}(?: {_WORD}){{0,2}})")
#: What every mention has: names the stem of a title, all but addresses and names a digit (those after Unicode 9 are beyond the first plane).
_STEMS = sorted(t for t in _GENDER if not any(t != x and t.startswith(x) for x in _GENDER))
_HINT = r"[@\p{Nd}\x{10000}-\x{10FFFF}]|" + "|".join(_STEMS)
_NUMERIC = re.compile(r"[(+\d]\d*")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_PREFIX_STEMS = ("AKIA", "ASIA", "k_live_", "k_test_", "xox", "ghp_", "gho_", "AIza")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_PART = re.compile(_LETTER + r"+(?:['’-]" + _LETTER + r"+)*")
_FIRST = {
    "f": "Anna Clara Elena Julia Laura Lena Maria Marta Nora Paula Sara Sofia Vera Alice Emma Ines Irene Lucia Olga Rosa".split(),
    "m": "Adam Bruno Carl David Emil Felix Hugo Jonas Karl Leon Marco Martin Oscar Paul Simon Tom Victor Walter Anton Luis".split(),
}
_ENDS = {"f": "a ia ina elle ette".split(), "m": "o us in ard er".split()}
_FEMALE = frozenset("alice agnes astrid beatrix birgit carmen doris edith elisabeth elizabeth ellen esther gertrud gudrun heike helen ines ingrid iris isabel janet judith karen karin kathryn kim lilian margaret marion mercedes miriam pilar rachel ruth sarah susan".split()) | {x.casefold() for x in _FIRST["f"]}
_MALE = frozenset("andrea luca joshua sascha mischa nikita elia noah george pierre philippe antoine mike steve dave jose rené rene maurice claude".split()) | {x.casefold() for x in _FIRST["m"]}
_SYLLABLES = "bal ber cor dan del fel gar han hel jor kan kel lan lor mal mar mel nor pal par ras ren sal san sel sol tan tor val ver".split()
_TAILS = "ier ez mann son elli ot ard is en er a o".split()
#: What surrogates of other scripts are made of; scripts that aren't named take the letters around the original's.
_PIECES = {
    "CYRILLIC": "бал бер вар гор дан дел зар кал кор лан мар мел нор пав рас сел сол тар тор вер".split(),
    "GREEK": "βαλ γαρ δελ ζαρ θαν καλ λαν μαρ μελ νορ παλ ραν σελ ταν φιλ χαρ".split(),
    "CJK": list("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧明华强伟芳娜敏静丽军洋勇艳杰娟涛超秀霞平刚桂英建文玉红云"),
    "HIRAGANA": "あき いと うえ かわ きた さと たか なか はま まつ みや もり やま よし".split(),
    "KATAKANA": "アキ イト ウエ カワ キタ サト タカ ナカ ハマ マツ ミヤ モリ ヤマ ヨシ".split(),
    "HANGUL": list("김이박최정강조윤장임한오서신권황안송류홍민준연지우현수영은하"),
    "ARABIC": list("ابتجحدرزسشصطعفقكلمنهوي"),
    "HEBREW": list("אבגדהוזחטילמנסעפצקרשת"),
    "DEVANAGARI": "रा मी शा नी दे वी का ली मो हन गो पा सु जा ता बा".split(),
    "THAI": list("กขคงจชดตทนบปพมยรลวสหอ"),
}


class Draws:
    """A stream of small numbers that the key, type, entity and attempt decide."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.block, self.pool, self.size = (key, f"{kind}\0{entity}\0{attempt}".encode()), 0, 0, 1

    def __call__(self, n: int) -> int:
        if self.size < n << 20:
            d = hmac.new(self.seed[0], self.seed[1] + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
            self.pool, self.size = self.pool * (1 << 256) + int.from_bytes(d, "big"), self.size << 256
        self.pool, r = divmod(self.pool, n)
        self.size //= n
        return r

    def of(self, pool: list[str]) -> str:
        return pool[self(len(pool))]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def normal(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "ip" and ":" in found:
        return ipaddress.IPv6Address(found).exploded
    if kind in ("email", "token", "ip"):
        return found.lower()
    if kind == "iban":
        return found.replace(" ", "")
    return found.casefold()


def _script(c: str) -> str:
    return unicodedata.name(c, "LATIN").split()[0]


@lru_cache(maxsize=4096)
def _around(c: str) -> tuple[str, ...]:
    """The letters of the script of ``c`` that stand near it in Unicode."""
    base, script = ord(c) & ~0x7F, _script(c)
    near = [chr(x) for x in range(base, base + 128)]
    return tuple(x for x in near if unicodedata.category(x) in ("Ll", "Lo") and _script(x) == script) or (c.lower(),)


def _like(c: str, draw: Draws) -> str:
    """A letter or digit of the kind of ``c``; anything else is kept."""
    if c.isdigit():
        return str(draw(10))
    if c.isalpha():
        letters = "abcdefghijklmnopqrstuvwxyz" if c.isascii() else _around(c)
        x = letters[draw(len(letters))]
        return x.upper() if c.isupper() else x
    return c


def guess(given: str) -> str:
    """The gender that the form of a given name suggests."""
    if given in _FEMALE:
        return "f"
    return "f" if given[-1:] in ("a", "e") and given not in _MALE else "m"


def _name(draw: Draws, kind: str, entity: str, gender: str, attempt: int) -> str:
    script, more = _script(entity[0]), (attempt + 1) // 2
    if script in _PIECES:
        pool = _PIECES[script]
        size = max(1, round(sum(map(str.isalpha, entity)) / (sum(map(len, pool)) / len(pool))))
        return "".join(draw.of(pool) for _ in range(size + more))
    if script != "LATIN":
        return "".join(_like(c, draw) for c in entity + next(c for c in entity if c.isalpha()) * more)
    if kind == "given":
        if attempt == 0:
            return draw.of(_FIRST[gender]).casefold()
        return "".join(draw.of(_SYLLABLES) for _ in range(1 + more)) + draw.of(_ENDS[gender])
    return "".join(draw.of(_SYLLABLES) for _ in range(2 + more)) + draw.of(_TAILS)


def draw_surrogate(key: bytes, kind: str, entity: str, attempt: int, gender: str | None = None) -> str:
    """The surrogate of a normalised entity, in its plain form."""
    draw = Draws(key, kind, entity, attempt)
    digits = lambda n: "".join(str(draw(10)) for _ in range(n))
    if kind == "card":
        body = str(1 + draw(9)) + digits(len(entity) - 2)
        last = draw(10)
        right = next(d for d in range(10) if luhn(body + str(d)))
        if luhn(entity):
            return body + str(right)
        return body + str(last if last != right else (last + 1) % 10)
    if kind == "phone":
        return str(1 + draw(9)) + digits(len(entity) - 1 + attempt // 8)
    if kind == "ssn":
        return str(9) + digits(len(entity) - 1 + attempt // 8)
    if kind == "ip" and ":" in entity:
        return ipaddress.IPv6Address((0x20010DB8 << 96) + sum(draw(1 << 16) << (16 * i) for i in range(6))).exploded
    if kind == "ip":
        return ".".join(str(draw(256) if i else 1 + draw(223)) for i in range(4))
    if kind == "email":
        user, _, host = entity.partition("@")
        word = "".join(draw.of(_SYLLABLES) for _ in range(4 + (attempt + 1) // 2))
        return f"{word}{draw(10_000):04d}@{'mail' if host.count('.') > 1 else 'box'}{draw(1000)}.example.org"
    if kind == "token":
        hexa = all(c in "0123456789abcdef" for c in entity)
        kept = next((p for p in _PREFIXES if entity.startswith(p)), "")
        return kept + "".join(("0123456789abcdef"[draw(16)] if hexa else _like(c, draw)) for c in entity[len(kept) :])
    if kind == "iban":
        body = "".join(_like(c, draw) for c in entity[4:])
        check = 98 - mod97(entity[:2] + "00" + body)
        if mod97(entity) != 1:
            check = (check + 1 + draw(90)) % 97 if check != 98 else draw(90)
        return f"{entity[:2]}{check:02d}{body}"
    return _name(draw, kind, entity, gender or guess(entity), attempt)


def dress(kind: str, found: str, plain: str) -> str:
    """The surrogate in the form of one mention: its separators and letter case."""
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(plain)
        return "".join(next(it) if c.isalnum() else c for c in found) + "".join(it)
    if kind == "token":
        if found.isupper() or found.islower():
            return plain.upper() if found.isupper() else plain
        return "".join(p.upper() if f.isupper() else p for f, p in zip(found, plain))
    if kind == "ip" and ":" in found and "::" in found:
        plain = ipaddress.IPv6Address(plain).compressed
    if kind in ("email", "ip"):
        return plain.upper() if found.isupper() else plain
    if found.isupper() and found.lower() != found:
        return plain.upper()
    return plain.capitalize() if found[:1].isupper() else plain


def hinted(texts: pa.Array) -> pa.Array:
    """Which texts may have a mention; ``find`` finds nothing in the others, nulls among them."""
    return pa.compute.fill_null(pa.compute.match_substring_regex(texts, _HINT), False)


def _matches(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """What ``pattern.finditer`` yields, if it can only match at one of ``starts``, which ascend."""
    end = 0
    for i in starts:
        if i >= end and (m := pattern.match(text, i)):
            end = m.end()
            yield m


def _tokens(text: str, digits: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Long runs of the letters of tokens that have one of the ``digits``."""
    end = 0
    for low, high in digits:
        if low < end:
            continue
        while low > end and text[low - 1] in _TOKEN_CHARS:
            low -= 1
        while high < len(text) and text[high] in _TOKEN_CHARS:
            high += 1
        end = high
        if high - low >= 32 and (m := _TOKEN.match(text, low)):
            yield m


def _names(text: str) -> list[tuple[int, int, str]]:
    """Words of names: those after a title, and the same words wherever else they stand capitalised alike."""
    known: dict[str, str] = {}
    spans: list[tuple[int, int, str]] = []
    starts = []
    for stem in _STEMS:
        i = text.find(stem)
        while i >= 0:
            starts.append(i)
            i = text.find(stem, i + 1)
    for m in _matches(_NAME, text, sorted(starts)):
        parts = list(_PART.finditer(text, m.start(3), m.end(3)))
        for i, p in enumerate(parts):
            given = i == 0 and len(parts) > 1
            kind = "given_" + _GENDER[m.group(1)] if given else "family"
            spans.append((p.start(), p.end(), kind))
            for form in (p.group(), p.group().upper()):
                if known.get(form, "given_n") == "given_n" or not given:  # a family name wins, then a known gender
                    known[form] = kind
    if known:
        taken = {s[0] for s in spans}
        for p in _PART.finditer(text):
            if p.start() not in taken and p.group() in known:
                spans.append((p.start(), p.end(), known[p.group()]))
        # a word that is both reads as a family name in all of the document
        spans = [(x, y, known[text[x:y]] if known[text[x:y]] == "family" else k) for x, y, k in spans]
    return spans


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, in order and without overlaps."""
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        at = 0
        while (i := text.find("@", at)) >= 0:
            low, high = i, i + 1
            while low > at and (text[low - 1].isalnum() or text[low - 1] in "._+%-"):
                low -= 1
            while high < len(text) and (text[high].isalnum() or text[high] in "._-"):
                high += 1
            m = _EMAIL.search(text, low, high)
            if m:
                spans.append((m.start(), m.end(), "email"))
                at = max(i + 1, m.end())
            else:
                at = i + 1
    starts, digits = [], []
    for m in _NUMERIC.finditer(text):  # digits in a row, or a mark and the digits after it
        low, high = m.span()
        starts.append(low)
        if text[low] in "(+":
            low += 1
            starts += [low] * (low < high)
        if low < high:
            digits.append((low, high))
    if digits:
        for m in _matches(_NUMBERS, text, starts):
            kind = m.lastgroup or "card"
            if kind == "card" and len(d := normal("card", m.group())) != 16 and not luhn(d):
                continue
            spans.append((m.start(), m.end(), kind))
        plain = text.isascii() or all(text[x:y].isascii() for x, y in digits)
        spans += [(m.start(), m.end(), "token") for m in (_tokens(text, digits) if plain else _TOKEN.finditer(text))]
        if any(x in text for x in _PREFIX_STEMS):
            spans += [(m.start(), m.end(), "token") for m in _PREFIXED.finditer(text)]
        spans += [(m.start(), m.end(), "iban") for m in _matches(_IBAN, text, [x - 2 for x, _ in digits if x > 1])]
        if _COLONS.search(text):
            spans += [(m.start(), m.end(), "ip") for m in _IP6.finditer(text) if _is_ip6(m.group())]
    spans += _names(text)
    spans.sort(key=lambda s: (s[0], s[0] - s[1]))
    out, end = [], 0
    for s in spans:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def _is_ip6(found: str) -> bool:
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return sum(map(bool, found.split(":"))) > 1  # neither "::" nor "::1"


def kind_of(found: str) -> tuple[str, str]:
    """(kind of the entity, gender it was met with)."""
    return ("given", found[-1]) if found.startswith("given_") else (found, "n")


def entities(docs: DataFrame) -> DataFrame:
    """(kind, entity, gender): the distinct entities of the texts; ``gender`` of given names by most titles, null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for t in b.column(0).filter(hinted(b.column(0))).to_pylist():
                for x, y, k in find(t):
                    kind, gender = kind_of(k)
                    key = (kind, normal(kind, t[x:y]))
                    seen[key] = seen.get(key, 0) + {"f": 1, "m": -1, "n": 0}[gender]
            rows = sorted(seen.items())
            cols = ([k for (k, _), _ in rows], [e for (_, e), _ in rows], [v for _, v in rows])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["kind", "entity", "votes"])

    found = docs.select("text").mapInArrow(tidy(run), "kind string, entity string, votes bigint").groupBy("kind", "entity").agg(F.sum("votes").alias("votes"))
    gender = F.when(F.col("kind") != "given", None).when(F.col("votes") > 0, "f").when(F.col("votes") < 0, "m")
    return found.select("kind", "entity", gender.alias("gender"))


def assign(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, gender, attempt, surrogate, odd): one surrogate an entity, no two alike in a type, none an entity itself.

    ``odd`` tells which can't be drawn from the entity alone.
    """
    shape = "kind string, entity string, gender string, attempt int, surrogate string, odd boolean"
    names = [x.split()[0] for x in shape.split(", ")]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            gender = [g or (guess(e) if k == "given" else None) for k, e, g in zip(p["kind"], p["entity"], p["gender"])]
            made = [draw_surrogate(key, k, e, a, g) for k, e, a, g in zip(p["kind"], p["entity"], p["attempt"], gender)]
            odd = [a > 0 or (k == "given" and g != guess(e)) for k, e, a, g in zip(p["kind"], p["entity"], p["attempt"], gender)]
            yield p.assign(gender=gender, surrogate=made, odd=odd)[names]

    if "gender" not in found.columns:
        found = found.withColumn("gender", F.lit(None).cast("string"))
    found = cut(found)
    # given and family names must not be mistaken for each other either
    family = F.when(F.col("kind").isin("given", "family"), F.lit("name")).otherwise(F.col("kind"))
    real = found.select(family.alias("family"), F.col("entity").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    current = cut(found.withColumn("attempt", F.lit(0)).mapInPandas(draw, shape))
    for _ in count():
        # the one that drew first keeps the surrogate, so a settled entity never moves again
        order = Window.partitionBy("family", "surrogate").orderBy("attempt", F.xxhash64("entity"), "kind", "entity")
        judged = current.withColumn("family", family).join(real, ["family", "surrogate"], "left")
        judged = judged.withColumn("clash", F.col("taken").isNotNull() | (F.row_number().over(order) > 1))
        judged = cut(judged.select(*names, "clash"))
        if judged.where("clash").isEmpty():
            break
        again = judged.where("clash").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, shape)
        current = cut(judged.where("not clash").drop("clash").unionByName(again))
    return judged.drop("clash")


Known = dict[tuple[str, str], tuple[int, str | None]]


def replace(text: str, key: bytes, known: Known) -> tuple[str, int]:
    """``known``: (attempt, gender) of the entities whose surrogate isn't that of attempt 0 and the guessed gender."""
    spans = find(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for x, y, k in spans:
        found, (kind, _) = text[x:y], kind_of(k)
        entity = normal(kind, found)
        attempt, gender = known.get((kind, entity), (0, None))
        out += [text[at:x], dress(kind, found, draw_surrogate(key, kind, entity, attempt, gender))]
        at = y
    return "".join(out) + text[at:], len(spans)


def pseudonymise(docs: DataFrame, key: bytes = KEY, count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text`` and, unless None, the number of mentions in ``count``."""
    late = assign(entities(docs), key).where("odd").select("kind", "entity", "attempt", "gender")
    moved = late.limit(MOST_TRAVELLING + 1).collect()
    out = [c for c in docs.columns if c != count]
    source = docs.select(*(F.col(f"`{c}`") for c in out))
    schema = T.StructType([docs.schema[c] for c in out] + ([T.StructField(count, T.LongType())] if count else []))
    if len(moved) <= MOST_TRAVELLING:
        fixed = {(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in moved}
    else:
        fixed, source = None, _carry(source, late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(out.index("text"))
            some = hinted(text)
            texts = text.filter(some).to_pylist()
            if fixed is None:
                known = [{(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in (e or [])} for e in b.column(len(out)).filter(some).to_pylist()]
            else:
                known = [fixed] * len(texts)
            done = [replace(t, key, k) for t, k in zip(texts, known)]
            text = pa.compute.replace_with_mask(text, some, pa.array([t for t, _ in done], text.type))
            arrays = []
            for i, c in enumerate(out):
                if c == "text":
                    arrays.append(text)
                elif c == "n_chars":
                    arrays.append(pa.compute.utf8_length(text).cast(b.column(i).type))
                else:
                    arrays.append(b.column(i))
            if count:
                arrays.append(pa.compute.replace_with_mask(pa.array(np.zeros(len(text), np.int64)), some, pa.array([n for _, n in done], pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def _carry(docs: DataFrame, late: DataFrame) -> DataFrame:
    """Adds to each document, as its last column, what is known of its own entities, for when that is too much to send with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple[int, str, str]] = set()
            some = hinted(b.column(0))
            for t, h in zip(b.column(0).filter(some).to_pylist(), b.column(1).filter(some).to_pylist()):
                for x, y, k in find(t):
                    kind, _ = kind_of(k)
                    rows.add((h, kind, normal(kind, t[x:y])))
            h, k, e = zip(*sorted(rows)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(h), pa.int64()), pa.array(list(k), pa.string()), pa.array(list(e), pa.string())], names=["h", "kind", "entity"])

    key, carried = (_free(docs, c) for c in ("text_hash", "carried"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    mentions = keyed.select("text", key).mapInArrow(tidy(run), "h bigint, kind string, entity string")
    known = mentions.join(late, ["kind", "entity"]).groupBy("h").agg(F.collect_set(F.struct("kind", "entity", "attempt", "gender")).alias(carried))
    return keyed.join(known.withColumnRenamed("h", key), key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), carried)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
