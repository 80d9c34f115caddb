"""Tables learnt from pairs and records: lexicon, synonyms, extra words, vocabulary, label-free pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def indic_lexicon(pairs: DataFrame, min_n: int = 3, min_share: float = 0.6) -> DataFrame:
    """(indic, latin, n, share) from pairs (a, b) of token arrays of equal length, aligned by place."""
    z = pairs.filter(F.size("a") == F.size("b")).select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("indic"), F.col("z.b").alias("latin"))
    n = z.groupBy("indic", "latin").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("indic")
    n = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("k", F.row_number().over(w.orderBy(F.col("n").desc(), "latin")))
    return n.filter((F.col("k") == 1) & (F.col("n") >= min_n) & (F.col("share") >= min_share)).drop("k")


def equivalences(pairs: DataFrame, min_n: int = 100, min_p: float = 0.5, min_other: float = 0.1, max_diff: int = 3) -> DataFrame:
    """(token, equiv, n_ab): tokens that stand for each other where pairs (a, b) differ in one to three tokens a side."""
    only_a, only_b = (F.filter(F.array_except(x, y), lambda t: ~t.rlike("^[0-9]+$")) for x, y in (("a", "b"), ("b", "a")))
    d = pairs.select(only_a.alias("x"), only_b.alias("y")).filter(F.size("x").between(1, max_diff) & F.size("y").between(1, max_diff))
    nx = d.select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("nx"))
    ny = d.select(F.explode("y").alias("y")).groupBy("y").agg(F.count("*").alias("ny"))
    nab = d.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n_ab"))
    e = nab.join(nx, "x").join(ny, "y").withColumn("pa", F.col("n_ab") / F.col("nx")).withColumn("pb", F.col("n_ab") / F.col("ny"))
    e = e.filter((F.col("n_ab") >= min_n) & (F.greatest("pa", "pb") >= min_p) & (F.least("pa", "pb") >= min_other))
    both = e.select(F.col("x").alias("token"), F.col("y").alias("equiv"), "n_ab").union(e.select("y", "x", "n_ab"))
    return both.groupBy("token", "equiv").agg(F.max("n_ab").alias("n_ab"))


def extra_words(s1: DataFrame, r: DataFrame, truth: DataFrame, max_tokens: int = 8) -> DataFrame:
    """(t, n_true, n_other): words by which a record's name differs from a query's as its only extra token.

    The key of a name is an order-free sum of token hashes, so taking a token off is a subtraction and the rest an equi-join.
    """
    h = lambda x: F.shiftrightunsigned(F.xxhash64(x), 24)
    total = F.aggregate("nw", F.lit(0).cast("long"), lambda a, x: a + h(x))
    a = s1.filter(F.size("nw") <= max_tokens).select("country", F.col("entity_id").alias("s1"), total.alias("k"))
    b = r.filter(F.size("nw") <= max_tokens + 1).select("country", F.col("entity_id").alias("r"), total.alias("k"), F.explode("nw").alias("t"))
    b = b.select("country", "r", "t", (F.col("k") - h(F.col("t"))).alias("k"))
    hit = a.join(b, ["country", "k"]).join(truth.select("s1", "r", F.lit(1).alias("y")), ["s1", "r"], "left")
    return hit.groupBy("t").agg(F.count("y").alias("n_true"), (F.count("*") - F.count("y")).alias("n_other"))


def sibling_lexicon(records: DataFrame, lexicon: DataFrame, min_votes: int = 2, min_share: float = 0.5, max_group: int = 15) -> DataFrame:
    """(indic, latin, n, share) without labels: Indic and Latin names with one country and number set, aligned by place.

    Known words of an aligned pair must all agree; the unknown ones are counted.
    """
    sig = F.array_join(F.array_sort(F.array_distinct("ad")), " ")
    d = records.select("country", sig.alias("sig"), "words", F.array_join("words", "").rlike("[ऀ-ൿ]").alias("indic")).filter(F.length(F.replace("sig", F.lit(" "), F.lit(""))) >= 3)
    d = d.withColumn("n", F.count("*").over(W.Window.partitionBy("country", "sig"))).filter(F.col("n") <= max_group)
    p = d.filter("indic").select("country", "sig", F.col("words").alias("a")).join(d.filter("not indic").select("country", "sig", F.col("words").alias("b")), ["country", "sig"]).filter(F.size("a") == F.size("b"))
    z = p.withColumn("pid", F.xxhash64("country", "sig", "a", "b")).select("pid", F.explode(F.arrays_zip("a", "b")).alias("z")).select("pid", F.col("z.a").alias("indic"), F.col("z.b").alias("latin"))
    known = z.join(lexicon.select("indic", F.col("latin").alias("want")), "indic", "left")
    ok = known.groupBy("pid").agg(F.bool_and(F.coalesce(F.col("want") == F.col("latin"), F.lit(True))).alias("ok")).filter("ok")
    votes = known.join(ok, "pid").filter("want is null").groupBy("indic", "latin").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("indic")
    votes = votes.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("n").desc(), "latin")))
    return votes.filter((F.col("k") == 1) & (F.col("n") >= min_votes) & (F.col("share") >= min_share)).drop("k")


def oov_map(words: DataFrame, vocab: DataFrame, least: float = 70.0, top: int = 200_000) -> DataFrame:
    """(indic, latin, how): transliteration, then the most frequent word of the vocabulary with its skeleton, else a like one, else itself."""
    from ..functions import text as X

    t = words.select("indic", X.latin_udf("indic").alias("latin")).withColumn("sk", X.skeleton(F.col("latin")))
    v = vocab.groupBy("token").agg(F.sum("n").alias("n")).withColumn("sk", X.skeleton(F.col("token")))
    best = v.groupBy("sk").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    first = t.join(best, "sk", "left")
    # words that no skeleton finds: the likest word of equal first letter among the most frequent ones, lengths alike
    rest = first.filter("token is null").select("indic", "latin")
    often = v.orderBy(F.col("n").desc(), "token").limit(top).select(F.col("token").alias("near"), F.col("n"))
    ratio = F.round(F.lit(100.0) * (1 - F.levenshtein("latin", "near") / F.greatest(F.length("latin"), F.length("near"), F.lit(1))), 6)
    by = [F.substring("latin", 1, 1) == F.substring("near", 1, 1), F.abs(F.length("latin") - F.length("near")) <= 0.3 * F.greatest(F.length("latin"), F.length("near"))]
    like = rest.join(often, by).withColumn("score", ratio).filter(F.col("score") >= least)
    like = like.groupBy("indic").agg(F.max_by("near", F.struct("score", "n", "near")).alias("near"))
    how = F.when(F.col("token").isNotNull(), "skeleton").when(F.col("near").isNotNull(), "fuzzy").otherwise("translit")
    return first.join(like, "indic", "left").select("indic", F.coalesce("token", "near", "latin").alias("latin"), how.alias("how"))


def vocabulary(records: DataFrame, min_n: int = 2) -> DataFrame:
    return records.select("country", F.explode("nw").alias("token")).groupBy("country", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)


def alias_sides(pairs: DataFrame) -> DataFrame:
    """On which side of an alias marker the query's words are: shares over pairs (core_s, core_r, alias_r) with an alias."""
    a, m = F.size(F.array_intersect("core_s", "alias_r")), F.size(F.array_intersect("core_s", "core_r"))
    d = pairs.filter(F.size("alias_r") > 0)
    return d.agg(F.count("*").alias("n"), F.round(F.avg((m > a).cast("double")), 6).alias("main_better"), F.round(F.avg((a > m).cast("double")), 6).alias("alias_better"))


def pseudo_pairs(s1: DataFrame, r: DataFrame, min_shared: int = 3) -> DataFrame:
    """(s1, r): equal first number, equal core words, equal number sets and ``min_shared`` address words in common."""
    key = lambda d, n: d.filter((F.size("ad") > 0) & (F.size("core") > 0)).select("country", F.get("ad", F.lit(0)).alias("n0"), F.array_join(F.array_sort("core"), " ").alias("c"), F.col("entity_id").alias(n), F.col("aw").alias(f"aw_{n}"), F.array_sort(F.array_distinct("ad")).alias(f"ad_{n}"))
    d = key(s1, "s1").join(key(r, "r"), ["country", "n0", "c"])
    return d.filter((F.col("ad_s1") == F.col("ad_r")) & (F.size(F.array_intersect("aw_s1", "aw_r")) >= min_shared)).select("s1", "r")


def country_synonyms(pairs: DataFrame, min_n: int = 50) -> DataFrame:
    """(country, token, equiv, n_ab): equivalences of label-free pairs (country, a, b), all countries in one plan.

    Words of two letters, and stop words of addresses, stand for nothing.
    """
    from ..functions import tables as T

    mark = lambda c: F.transform(c, lambda t: F.concat("country", F.lit("\u0001"), t))
    e = equivalences(pairs.select(mark("a").alias("a"), mark("b").alias("b")), min_n=min_n)
    part = lambda c, i: F.split(c, "\u0001").getItem(i)
    e = e.select(part("token", 0).alias("country"), part("token", 1).alias("token"), part("equiv", 1).alias("equiv"), "n_ab")
    return e.filter((F.length("token") > 2) & (F.length("equiv") > 2) & ~F.col("token").isin(T.ADDR_STOP) & ~F.col("equiv").isin(T.ADDR_STOP))


def hidden_words(lexicon: DataFrame, learn, share: int = 30) -> DataFrame:
    """(n_hidden, coverage, accuracy): hides a fixed share of a lexicon (by md5) and asks ``learn(shown, hidden words)`` for them."""
    bucket = F.conv(F.substring(F.md5("indic"), 1, 8), 16, 10).cast("long") % 100
    shown, hidden = lexicon.filter(bucket >= share), lexicon.filter(bucket < share)
    got = learn(shown, hidden.select("indic")).select("indic", F.col("latin").alias("said"))
    d = hidden.select("indic", "latin").join(got, "indic", "left")
    return d.agg(
        F.count("*").alias("n_hidden"),
        F.round(F.avg(F.col("said").isNotNull().cast("double")), 6).alias("coverage"),
        F.round(F.avg(F.when(F.col("said").isNotNull(), (F.col("said") == F.col("latin")).cast("double"))), 6).alias("accuracy"),
    )
