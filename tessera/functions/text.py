"""Column functions over names and addresses. All run in the JVM but the Arrow UDFs of ``plain_records``, ``latin_udf`` and ``folded_exactly``."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T


def words_in(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def mapped(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


@functools.cache
def _fold_pairs() -> tuple[str, str]:
    """Characters outside ASCII whose compatibility decomposition without marks is one character, and that character."""
    a, b = [], []
    for cp in range(0x80, 0x3000):
        c = chr(cp)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if len(d) == 1 and d != c:
            a.append(c)
            b.append(d)
    return "".join(a), "".join(b)


def fold(c: Column) -> Column:
    """Null to empty, accents and compatibility forms of one letter taken off, lower case."""
    a, b = _fold_pairs()
    text = F.coalesce(c, F.lit(""))
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, a, b), r"\p{Mn}", "")).otherwise(text))


@F.pandas_udf(StringType())
def folded_exactly(s: pd.Series) -> pd.Series:
    """Full NFKD, ligatures and fractions too; for the rows that ``fold`` leaves with characters outside ASCII."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x or "") if unicodedata.category(c) != "Mn").lower())


def collapse_dots(c: Column) -> Column:
    for _ in range(3):
        c = F.regexp_replace(c, r"([a-z])\.([a-z])", "$1$2")
    return F.regexp_replace(c, r"\.", " ")


def base_clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(collapse_dots(fold(c)), "[&+]", " and "), r"^\s*none\s*$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(base_clean(c), F.lit("[a-z0-9]+"), F.lit(0))


def leet(token: Column) -> Column:
    return F.when(
        token.rlike("^[a-z]*[0-9][a-z]*$") & (F.length(token) >= 4), F.translate(token, "".join(T.LEET), "".join(T.LEET.values()))
    ).otherwise(token)


def skeleton(word: Column) -> Column:
    for a, b in (("c([eiy])", "s$1"), ("z", "s"), ("ksh", "x"), ("ph", "f"), ("([bcdgjkpstz])h", "$1"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), (r"\B[aeiouy]", "")):
        word = F.regexp_replace(word, a, b)
    return F.regexp_replace(word, "([bdfgjklmnprstvx])\\1", "$1")


def street_words(c: Column) -> Column:
    part = F.get(F.filter(F.split(fold(c), ","), lambda x: x.rlike(r"\d")), F.lit(0))
    bare = F.regexp_replace(F.coalesce(part, F.lit("")), r"\d+[a-z]?", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit("[a-z]{2,}"), F.lit(0)), lambda x: ~x.isin(T.STREET_DROP))


_ALIAS = r"(?i)^(.*?)\s(" + "|".join(m.replace("/", r"\s*/\s*") for m in T.ALIAS_MARKERS) + r")[:\s](.*)$"


def alias_split(name: Column) -> tuple[Column, Column]:
    """(main, alias) of 'X f/k/a Y': Y and X; the name and an empty text without a marker."""
    hit = name.rlike(_ALIAS)
    return F.when(hit, F.regexp_extract(name, _ALIAS, 3)).otherwise(name), F.when(hit, F.regexp_extract(name, _ALIAS, 1)).otherwise("")


def plain_tokens(name: Column) -> Column:
    """Words of a clean name without record numbers such as '# 12' and '(id 77)'."""
    clean = F.regexp_replace(base_clean(name), r"#\s*\d+|\(id:?\s*\d+\)", " ")
    return F.regexp_extract_all(clean, F.lit("[a-z0-9]+"), F.lit(0))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.transform(plain_tokens(name), leet))


def digits(address: Column) -> Column:
    """The clean address with number words as digits and ordinal endings off."""
    for word, d in T.NUMBER_WORDS.items():
        address = F.regexp_replace(address, rf"\b{word}\b", d)
    return F.regexp_replace(address, r"\b(\d+)(st|nd|rd|th)\b", "$1")


def numbers(clean: Column) -> Column:
    found = F.regexp_extract_all(clean, F.lit(r"\d+"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.ltrim(x, F.lit("0"))), lambda x: x != "")


def units(clean: Column) -> Column:
    found = F.regexp_extract_all(clean, F.lit(r"\b[a-z]{1,3}[-/ ]?\d+[a-z]?\b"), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[-/ ]", ""), "^([a-z]+)0+", "$1"))
    return F.array_distinct(F.filter(bare, lambda x: ~F.regexp_extract(x, "^[a-z]+", 0).isin(T.UNIT_EXCLUDE)))


def street_canonical(words: Column, country: Column) -> Column:
    """Street types in full (French 'St' is a saint), words of one letter and stop words dropped, in order, once each."""
    plain = mapped(T.STREET)
    own = {k: mapped(v) for k, v in T.STREET_COUNTRY.items()}

    def full(x: Column) -> Column:
        out = F.coalesce(F.element_at(plain, x), x)
        for k, m in own.items():
            out = F.when(country == k, F.coalesce(F.element_at(m, x), out)).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(words, full), lambda x: (F.length(x) >= 2) & ~x.isin(T.ADDR_STOP)))


def sorted_bag(words: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.array_join(words, ""), ""), lambda x: x != "")), "")


def translit(text: str) -> str:
    """Brahmic scripts to Latin by offset in the block, with inherent vowels and without the last one of a word."""
    out: list[str] = []
    waits = False  # a consonant waits for its inherent vowel
    for ch in text:
        cp = ord(ch)
        if not 0x900 <= cp < 0xD80:
            waits = False
            out.append(ch)
            continue
        at = cp & 0x7F
        if at == T.NUKTA:
            if out and out[-1] == "j":
                out[-1] = "z"
            continue
        said = T.CONSONANTS.get(at) or T.VOWELS.get(at) or T.SIGNS.get(at) or (str(at - 0x66) if 0x66 <= at <= 0x6F else None)
        if waits and at not in T.MATRAS and at != T.VIRAMA:
            out.append("a")
        if at in T.MATRAS:
            said = T.MATRAS[at]
        if said and at != T.VIRAMA:
            out.append(said)
        waits = at in T.CONSONANTS
    return "".join(out)


@F.pandas_udf(StringType())
def latin_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else translit(x))


def segment(handle: str, logp: dict[str, float], longest: int = 20) -> list[str]:
    """The likeliest split of a web handle into words of the vocabulary (Viterbi); unknown stretches cost by length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(handle) + 1):
        best.append(max((best[j][0] + logp.get(handle[j:i], -30.0 - 5 * (i - j)), -(i - j)) for j in range(max(0, i - longest), i)))
    out, i = [], len(handle)
    while i:
        n = -best[i][1]
        out.append(handle[i - n : i])
        i -= n
    return out[::-1]


INDIC = "[\u0900-\u0d7f]"
WEB = r"(?i)(^@|www\.|\.(com|in|net|org|co|fr|biz|info)\b)"
_WORD = re.compile(r"[^\s.,()\[\]\-/]+")  # a word of a name in any script
_NO_WEB = re.compile(r"(?i)^@|www\.|\.(com|in|net|org|co|fr|biz|info)\b.*$|#\s*\d+")


def latin_name(name: str, lexicon: dict[str, str]) -> str:
    """Indic words by the lexicon, else by sound; other words as they are."""
    return " ".join(lexicon.get(w) or translit(w) if re.search(INDIC, w) else w for w in _WORD.findall(name))


def web_words(name: str, logp: dict[str, float]) -> str:
    """A web handle's words: what is around the host's name is taken off, runs of eight letters and more are segmented."""
    runs = re.findall("[a-z]+", _NO_WEB.sub(" ", name).lower())
    return " ".join(w for r in runs for w in (segment(r, logp) if len(r) >= 8 and logp else [r]))


@functools.cache
def _odd_class() -> str:
    """A character class of what ``fold`` does not take apart as NFKD does: decompositions into several letters, and signs beyond its table."""
    known = set(_fold_pairs()[0])
    odd = [cp for cp in range(0x80, 0x10000) if not 0xD800 <= cp < 0xE000 and chr(cp) not in known]
    odd = [cp for cp in odd if (d := "".join(x for x in unicodedata.normalize("NFKD", chr(cp)) if unicodedata.category(x) != "Mn")) != chr(cp) and len(d) and not 0xAC00 <= cp < 0xD7A4]
    runs: list[list[int]] = []
    for cp in odd:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def needs_python(name: Column, address: Column) -> Column:
    """Whether a record has Indic letters, a web handle or compatibility forms of several letters."""
    either = F.concat_ws("\n", name, address)
    beyond = F.when(either.rlike(r"[^\x00-\x7F]"), either.rlike(INDIC) | either.rlike(_odd_class())).otherwise(False)  # the long class is slow
    return F.coalesce(beyond, F.lit(False)) | F.coalesce(name.rlike(WEB), F.lit(False))


def plain_records(df: DataFrame, lexicon: dict[str, str], logp: dict[str, dict[str, float]], name: str = "business_name", address: str = "business_address") -> DataFrame:
    """``df`` with names and addresses that the JVM expressions handle; rows that are plain already never leave the JVM.

    lexicon: Indic word to Latin word; logp: by country the log-probabilities of its words. Both are sent to the executors.
    """
    sent = df.sparkSession.sparkContext.broadcast((lexicon, logp))

    @F.pandas_udf(StringType())
    def names(n: pd.Series, country: pd.Series) -> pd.Series:
        words, by = sent.value
        out = []
        for x, c in zip(n, country):
            x = x or ""
            if re.search(INDIC, x):
                x = latin_name(x, words)
            if re.search(WEB, x):
                x = web_words(x, by.get(c, {}))
            out.append(unicodedata.normalize("NFKD", x))
        return pd.Series(out, dtype=object)

    @F.pandas_udf(StringType())
    def addresses(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else unicodedata.normalize("NFKD", translit(x) if re.search(INDIC, x) else x))

    odd = needs_python(F.col(name), F.col(address))
    other = df.filter(odd).withColumns({name: names(F.col(name), F.col("country")), address: addresses(F.col(address))})
    return df.filter(~odd).unionByName(other)
