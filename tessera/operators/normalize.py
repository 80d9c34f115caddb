"""One normaliser for every source: record table to token arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..sources.shared import stored


# what comes of the name, and what of the address
NAME = ("nw", "core", "alias", "legal", "decoy", "sk")
ADDRESS = ("aw", "ad", "au", "stw", "noaddr")


def word_logp(vocab: DataFrame, most: int = 2_000_000) -> dict[str, dict[str, float]]:
    """By country the log-probabilities of the words (two letters or more) of a vocabulary (country, token, n) of bounded size."""
    rows = vocab.groupBy("country", "token").agg(F.sum("n").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of over {most} words: raise min_n")
    total: dict[str, int] = {}
    for r in rows:
        total[r.country] = total.get(r.country, 0) + r.n
    out: dict[str, dict[str, float]] = {c: {} for c in total}
    for r in rows:
        if len(r.token) >= 2:
            out[r.country][r.token] = math.log(r.n / total[r.country])
    return out


def _looked_up(words: Column, table: Column) -> Column:
    return F.transform(words, lambda x: F.element_at(table, x))


def _places(aw: Column) -> Column:
    """Canonical words of places besides the words themselves: names of one word, then of several words."""
    none = F.array().cast("array<string>")
    one = F.lit(None).cast("array<string>")
    for country, names in T.PLACE_ALIAS.items():
        one = F.when(F.col("country") == country, F.array_compact(_looked_up(aw, X.mapped(names)))).otherwise(one)
    phrases = [F.when((F.col("country") == c) & F.forall(X.words_in(words), lambda w: F.array_contains(aw, w)), F.lit(said)) for c, rows in T.PLACE_PHRASE.items() for words, said in rows]
    return F.array_distinct(F.concat(aw, F.coalesce(one, none), F.array_compact(F.array(*phrases))))


def normalise(
    df: DataFrame,
    synonyms: dict[str, list[str]] | None = None,
    decoys: list[str] | None = None,
    lexicon: dict[str, str] | None = None,
    logp: dict[str, dict[str, float]] | None = None,
    country_synonyms: dict[str, dict[str, list[str]]] | None = None,
    places: bool = False,
) -> DataFrame:
    """(entity_id, country, nw, core, alias, legal, decoy, sk, aw, ad, au, stw, noaddr, k...) of records.

    An address that is empty or says 'None' counts as missing. ``synonyms`` add words to aw and replace none, those of the
    country besides those of all. Indic names become Latin by ``lexicon`` or by sound, web handles are segmented by ``logp``.
    ``places`` adds the canonical words of places, which then take no part in synonyms.
    """
    df = X.plain_records(df, lexicon or {}, logp or {})
    main, former = X.alias_split(F.coalesce(F.col("business_name"), F.lit("")))
    keep = [c for c in df.columns if c not in ("business_name", "business_address")]
    df = df.select(*keep, main.alias("main"), former.alias("former"), X.digits(X.base_clean(F.col("business_address"))).alias("addr"), X.street_words(F.col("business_address")).alias("stw"))
    df = df.select(*keep, X.name_tokens(F.col("main")).alias("nw"), X.plain_tokens(F.col("former")).alias("alias"), "addr", "stw")
    noise = [*T.HONORIFIC, *T.NAME_STOP]
    gone = [*T.LEGAL, *noise]
    aw = X.street_canonical(F.regexp_extract_all("addr", F.lit("[a-z]+"), F.lit(0)), F.col("country"))
    df = df.withColumn("aw", aw)
    if places:
        df = df.withColumn("aw", F.filter("aw", lambda x: ~x.isin(T.PLACE_ADDR_STOP))).withColumn("aw", _places(F.col("aw")))
    added = [_synonyms(synonyms, F.lit(True), places)] if synonyms else []
    added += [_synonyms(m, F.col("country") == c, places) for c, m in (country_synonyms or {}).items()]
    if added:
        df = df.withColumn("aw", F.array_distinct(F.concat("aw", *added)))
    core = F.filter("nw", lambda x: ~x.isin(gone))
    return df.select(
        *keep,
        "nw",
        core.alias("core"),
        "alias",
        F.filter("nw", lambda x: x.isin(T.LEGAL)).alias("legal"),
        F.filter("nw", lambda x: x.isin(decoys) if decoys else F.lit(False)).alias("decoy"),
        F.array_distinct(F.filter(F.transform(core, X.skeleton), lambda x: F.length(x) >= 2)).alias("sk"),
        "aw",
        X.numbers(F.col("addr")).alias("ad"),
        X.units(F.col("addr")).alias("au"),
        "stw",
        (F.trim("addr") == "").alias("noaddr"),
    )


def normalise_once(df: DataFrame, **options) -> DataFrame:
    """``normalise``, stored; each name and each address of a country is worked on once, however many records have it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df
    for column, other in (("business_name", "business_address"), ("business_address", "business_name")):
        texts = stored(df.select(F.col("country").alias("country_"), F.col(column).alias("text_")).distinct().repartition(parts), "texts")
        said = normalise(texts.select("*", F.col("country_").alias("country"), F.col("text_").alias(column), F.lit(None).cast("string").alias(other)), **options)
        kept = [c for c in said.columns if c in (NAME if column == "business_name" else ADDRESS)]
        same = F.col("country").eqNullSafe(F.col("country_")) & F.col(column).eqNullSafe(F.col("text_"))
        out = out.join(said.select("country_", "text_", *kept), same).drop("country_", "text_")
    return stored(out.drop("business_name", "business_address"), "normalised")


def _synonyms(table: dict[str, list[str]], where: Column, places: bool) -> Column:
    """The words that stand for those of aw, where the condition holds."""
    cut = set(T.PLACE_SYN_BLOCK) if places else set()
    kept = {k: [w for w in v if w not in cut] for k, v in table.items() if k not in cut}
    none = F.array().cast("array<string>")
    if not kept:
        return none
    more = F.create_map(*(y for k, v in kept.items() for y in (F.lit(k), X.words_in(v) if v else none)))
    return F.when(where, F.flatten(F.transform("aw", lambda x: F.coalesce(F.element_at(more, x), none)))).otherwise(none)
