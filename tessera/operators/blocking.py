"""Candidates by an inverted index with several arms: tokens, integer idf, top-k per arm, expansion, annotation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.shared import stored

# fixed values: rows kept per arm, and caps on the document frequency of tokens
CAPS = {0: 100, 3: 30, 4: 30, 5: 40, 6: 25, 7: 20, 8: 10}
DF_CAP, KEY_CAP = 2000, 200
ADDR_TAIL = 3
BLOCK = 1024  # queries that are scored at once
NAMED = ((3, 4, 5, 6, 7), ("core", "sk", "alias", "noaddr"))  # arms that read the name alone, and its columns
SENT = 500_000  # tokens within the caps that are broadcast at most, about 40 MB


def window(a: Column, n: int) -> Column:
    """The first n and the last three of an array, once each."""
    return F.array_distinct(F.concat(F.slice(a, 1, n), F.slice(a, F.greatest(F.size(a) - (ADDR_TAIL - 1), F.lit(1)), ADDR_TAIL)))


def _tag(prefix: str, a: Column) -> Column:
    return F.transform(a, lambda x: F.concat(F.lit(prefix), x))


def _pairs(prefix: str, a: Column) -> Column:
    both = F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.concat(F.lit(prefix), F.least(x, y), F.lit("|"), F.greatest(x, y))))
    return F.flatten(both)


def _cross(prefix: str, a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(F.lit(prefix), x, F.lit("|"), y))))


def _long(a: Column) -> Column:
    return F.filter(a, lambda x: F.length(x) > 3)


def arms(query: bool = False) -> dict[int, Column]:
    """Token array of each arm over a normalised record; ``query`` is the S1 side."""
    c = F.col
    core, sk, aw, ad = c("core"), c("sk"), c("aw"), c("ad")
    plain = _long(F.concat(_tag("n:", core), _tag("k:", sk), _tag("a:", aw), _tag("#:", ad), _tag("u:", c("au"))))
    combos = [_cross("x:", F.slice(ad, 1, 2), window(aw, 6)), _pairs("w:", F.slice(aw, 1, 5)), _cross("y:", F.slice(core, 1, 3), window(aw, 4))]
    if query:
        long_ad = F.filter(F.slice(ad, 1, 2), lambda x: F.length(x) >= 3)
        cut = F.flatten(F.transform(long_ad, lambda x: F.array(F.substring(x, F.lit(2), F.length(x)), F.substring(x, F.lit(1), F.length(x) - 1))))
        combos.append(_cross("x:", cut, window(aw, 6)))
    some = F.size(core) > 0
    none = F.array().cast("array<string>")
    keys = F.when(
        some,
        F.concat(
            F.array(F.concat(F.lit("N:"), F.array_join(F.array_sort(core), " ")), F.concat(F.lit("C:"), F.array_join(core, "")), F.concat(F.lit("C:"), F.array_join(F.slice(core, 1, 2), ""))),
            F.when(F.size(sk) > 0, F.array(F.concat(F.lit("K:"), F.array_join(F.array_sort(sk), " ")))).otherwise(none),
        ),
    ).otherwise(none)
    joined = F.concat(F.lit("^"), F.array_join(F.slice(core, 1, 2), ""), F.lit("$"))
    grams = F.when(F.length(joined) >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 2, F.lit(1))), lambda i: F.concat(F.lit("t:"), F.substring(joined, i, F.lit(3))))).otherwise(none)
    bare = _long(F.concat(_tag("z:", core), _tag("zk:", sk)))
    key = F.array_join(F.array_sort(core), " ")
    by_key = F.when(
        F.length(key) >= 3,
        F.concat(F.transform(F.slice(F.array_distinct(ad), 1, 4), lambda x: F.concat(F.lit("K#:"), key, F.lit("|"), x)), F.transform(window(aw, 8), lambda x: F.concat(F.lit("Kw:"), key, F.lit("|"), x))),
    ).otherwise(none)
    return {
        0: F.array_distinct(F.concat(plain, *combos)),
        3: F.array_distinct(_long(_pairs("p:", F.slice(core, 1, 4)))),
        4: F.array_distinct(_long(keys)),
        5: F.array_distinct(_long(F.concat(_tag("m:", core), _tag("q:", sk), _tag("m:", c("alias"))))),
        6: F.array_distinct(grams),
        7: F.array_distinct(bare) if query else F.when(c("noaddr"), F.array_distinct(bare)).otherwise(none),
        8: F.array_distinct(by_key),
    }


def tokens(records: DataFrame, query: bool = False, only=None, more=()) -> DataFrame:
    """(country, id, arm, t, *more): one row per distinct token of a record in an arm; a single pass over the records."""
    found = {k: v for k, v in arms(query).items() if only is None or k in only}
    rows = F.flatten(F.array(*(_armed(k, v) for k, v in found.items())))
    return records.select("country", F.col("entity_id").alias("id"), *more, F.explode(rows).alias("x")).select("country", "id", "x.arm", "x.t", *more)


def _armed(k: int, tokens_: Column) -> Column:
    return F.transform(tokens_, lambda t: F.struct(F.lit(k).alias("arm"), t.alias("t")))


def idf(index: DataFrame, records: DataFrame, df_cap: int = DF_CAP, key_cap: int = KEY_CAP) -> DataFrame:
    """(country, arm, t, df, idf): tokens within the caps; idf in 1/1024 as an integer, so that sums have no order."""
    return _capped(index.groupBy("country", "arm", "t").agg(F.count("*").alias("df")), records, df_cap, key_cap)


def _capped(df: DataFrame, records: DataFrame, df_cap: int = DF_CAP, key_cap: int = KEY_CAP) -> DataFrame:
    n = records.groupBy("country").agg(F.count("*").alias("n_records"))
    df = df.filter(F.col("df") <= F.when(F.col("arm") == 4, key_cap).otherwise(df_cap))
    return df.join(F.broadcast(n), "country").select("country", "arm", "t", "df", F.rint((F.log("n_records") - F.log("df")) * 1024).cast("long").alias("idf"))


def retrieve(asked: DataFrame, index: DataFrame, weights: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """(s1, r, arm, sc, rk): per query and arm the best records by summed idf, ties to the smaller id."""
    return best(asked, index, weights, caps or CAPS)


def best(asked: DataFrame, index: DataFrame, weights: DataFrame, caps: dict[int, int] | int) -> DataFrame:
    """(s1, r, arm, sc, rk): the best records of each query and arm up to the arm's cap; of all arms as one (arm 0) if ``caps`` is a number."""
    return scored(asked, index, weights, _best(caps), {"sc": "long", "rk": "int"}, merged=isinstance(caps, int))


def _best(caps: dict[int, int] | int):
    def pick(arm, sc, shared, low, true):
        import numpy as np

        n = caps if isinstance(caps, int) else caps.get(arm, 0)
        key = sc * len(sc) + np.arange(len(sc) - 1, -1, -1)  # equal scores: the smaller id first
        top = np.argpartition(-key, n)[:n] if n < len(key) else np.arange(len(key))
        top = top[np.argsort(-key[top])]
        return top, {"sc": sc[top], "rk": np.arange(1, len(top) + 1)}

    return pick


def retrieve_records(queries: DataFrame, records: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """(s1, arm, hits): ``retrieve`` for normalised tables, which are read several times; a row holds all hits (r, sc, rk), see ``unpacked``.

    The arms of names are cut into tokens once for each distinct name, with the number of its records for the df, and only tokens within
    the caps are given the ids of all its records.
    """
    only, cols = NAMED
    key, rest = ["country", "arm", "t"], [k for k in CAPS if k not in only]
    have = records.select("country", *cols, F.col("entity_id").alias("own"))
    name = F.sha2(F.to_json(F.struct("country", *cols)), 256)
    part = have.groupBy("country", *cols).agg(F.count("*").alias("n")).withColumn("entity_id", name)
    whole = tokens(records, only=rest)
    df = tokens(part, only=only, more=("n",)).groupBy(*key).agg(F.sum("n").alias("df")).unionByName(whole.groupBy(*key).agg(F.count("*").alias("df")))
    weights = stored(_capped(df, records), "weights")
    few = F.broadcast if weights.count() <= SENT else lambda d: d
    index = tokens(part, only=only).join(few(weights.select(*key)), key).join(have.select(name.alias("id"), "own"), "id").select(*key, F.col("own").alias("id"))
    index = index.unionByName(whole.join(few(weights.select(*key)), key).select(*key, "id"))
    rows = queries.filter("entity_id is not null").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("country", *cols))).alias("rows"))
    rows = rows.select(F.col("entity_id").alias("s1"), "rows", F.sha2(F.to_json(F.struct("rows")), 256).alias("entity_id"))
    asked = tokens(rows.dropDuplicates(["entity_id"]).select("entity_id", F.explode("rows").alias("x")).select("entity_id", "x.*"), True, only=only)
    askers = rows.select("s1", F.col("entity_id").alias("id"))
    caps, columns = caps or CAPS, {"sc": "long", "rk": "int"}
    lists = index.filter("id is not null").join(weights, key).groupBy(*key).agg(F.first("df").alias("df"), F.first("idf").alias("idf"), F.collect_list("id").alias("ids"))
    lists = stored(lists, "lists")
    found = [scored(x, lists, few(weights), _best(caps), columns, askers=who, packed=True) for x, who in ((asked, askers), (tokens(queries, True, only=rest), None))]
    return found[0].unionByName(found[1])


def scored(asked: DataFrame, index: DataFrame, weights: DataFrame, pick, columns: dict[str, str], merged: bool = False, truth: DataFrame | None = None, askers: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """(s1, r, arm, *columns), or (s1, arm, hits) if ``packed``: what ``pick`` takes of all records that share a token with a query, by arm or ``merged`` as arm 0.

    ``index`` has rows (country, arm, t, id), or lists (country, arm, t, df, idf, ids). Queries that ask for the same weighted tokens are scored once; ``askers`` (s1, id) tells whose the ids of ``asked`` are, if not their own.
    They go in blocks of about ``BLOCK`` to Python, each with the posting lists of its distinct tokens, so a list that many queries ask
    for is sent once a block and no row is made for a hit; queries with the same longest list share a block. A list has at most
    ``df_cap`` ids, which bounds a block.
    ``pick(arm, sc, shared, low, true)`` gets, in the order of ids, the summed idf of the records and their number of shared tokens, a
    function that gives the lowest df of some of them, and the places of those records that ``truth`` (s1, r) holds; it returns
    places and their columns. With ``truth`` only its queries are asked, one by one. Null ids take no part.
    """
    key = ["country", "arm", "t"]
    lists = index
    if "ids" not in index.columns:
        lists = index.filter("id is not null").join(weights, key).groupBy(*key).agg(F.first("df").alias("df"), F.first("idf").alias("idf"), F.collect_list("id").alias("ids"))
    part = F.lit(0) if merged else F.col("arm")
    by = asked.filter("id is not null").join(weights.select(*key, "df"), key).groupBy("id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("df", *key))).alias("ts"))
    if truth is None:
        by = stored(by.withColumn("q", F.sha2(F.to_json(F.struct("part", "ts")), 256)), "asked")
        each = by.select("part", "q", "ts").dropDuplicates(["q"])
    else:
        each = by.withColumnRenamed("id", "q")
    longest = F.element_at("ts", -1)
    sizes = each.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    each = each.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64(longest["country"], longest["t"]), "blocks"))
    full = each.groupBy("part", "block").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    each = each.join(F.broadcast(full), ["part", "block"]).withColumn("piece", F.pmod(F.xxhash64("q"), "pieces"))
    group = ["part", "block", "piece"]
    needs = each.select(*group, "q", F.explode("ts").alias("x")).groupBy(*group, "x.country", "x.arm", "x.t").agg(F.collect_list("q").alias("qs"))
    sent = needs.join(lists, key).select(*group, "df", "idf", "ids", "qs")
    kind = {"q": each.schema["q"].dataType.simpleString(), "r": lists.schema["ids"].dataType.elementType.simpleString()}
    hit = ", ".join([f"r: {kind['r']}", *(f"{c}: {k.replace('long', 'bigint')}" for c, k in columns.items())])
    schema = f"q {kind['q']}, arm int, hits array<struct<{hit}>>"
    if truth is None:
        found = sent.groupBy(*group).applyInArrow(lambda t: _score(t, None, pick, list(columns)), schema)
        own = by.select("id", "q")
        own = own.withColumnRenamed("id", "s1") if askers is None else own.join(askers, "id").select("s1", "q")
        found = own.join(found, "q").drop("q")
    else:
        true = each.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("q").alias("s1")).join(truth.select("s1", "r").distinct(), "s1")
        found = sent.groupBy(*group).cogroup(true.groupBy(*(f"{c}_" for c in group))).applyInArrow(lambda t, true: _score(t, true, pick, list(columns)), schema).withColumnRenamed("q", "s1")
    found = found.select("s1", "arm", "hits")
    return found if packed else found.select("s1", "arm", F.inline("hits")).select("s1", "r", "arm", *columns)


def _score(table, true, pick, columns: list[str]):
    """Scores the queries of one block; a sum's lower 20 bits count the shared tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = {"rk": pa.int32()}

    def coded(col):
        """(sorted values, places in them) of a list column's items, and where each row's begin."""
        col = col.combine_chunks()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))))
        items = col.flatten().dictionary_encode()
        order = pc.sort_indices(items.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return items.dictionary.take(pa.array(order)), place[items.indices.to_numpy()], ends

    found = []
    if table.num_rows:
        arm = table["part"][0].as_py()
        df, idf = (table[c].to_numpy() for c in ("df", "idf"))
        ids, at, ends = coded(table["ids"])
        queries, asks, ask_ends = coded(table["qs"])
        row = np.repeat(np.arange(table.num_rows), np.diff(ask_ends))
        order = np.argsort(asks, kind="stable")
        row, starts = row[order], np.searchsorted(asks[order], np.arange(len(queries) + 1))
        trues = None
        if true is not None:
            trues = {}
            known = pc.index_in(true["r"], ids).to_pylist()
            for q, i in zip(true["s1"].to_pylist(), known):
                if i is not None:
                    trues.setdefault(q, []).append(i)
            names = queries.to_pylist()
        for q in range(len(queries)):
            own = None
            if trues is not None:
                own = trues.get(names[q])
                if own is None:
                    continue
            rows = row[starts[q] : starts[q + 1]]
            hits = np.concatenate([at[ends[i] : ends[i + 1]] for i in rows])
            of = np.repeat(rows, ends[rows + 1] - ends[rows])
            total = np.bincount(hits, weights=(idf[of] * float(1 << 20) + 1), minlength=len(ids)).astype(np.int64)
            some = np.flatnonzero(total)
            sums = total[some]
            low = lambda places, hits=hits, of=of, some=some: np.array([df[of[hits == some[i]]].min() for i in places], dtype=np.int64)
            mine = None if own is None else np.flatnonzero(np.isin(some, own))
            top, cols = pick(arm, sums >> 20, sums & ((1 << 20) - 1), low, mine)
            found.append((np.full(len(top), q), some[top], *(cols[c] for c in columns)))
    ids_of = pa.array([], table["ids"].type.value_type) if not found else ids
    q, r, *rest = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64) for _ in range(2 + len(columns)))
    at = np.flatnonzero(np.diff(q, prepend=-1))
    hits = pa.StructArray.from_arrays([ids_of.take(pa.array(r)), *(pa.array(x, kinds.get(c, pa.int64())) for c, x in zip(columns, rest))], names=["r", *columns])
    names = queries.take(pa.array(q[at])) if found else pa.array([], table["qs"].type.value_type)
    return pa.table({"q": names, "arm": pa.array(np.full(len(at), arm if found else 0), pa.int32()), "hits": pa.ListArray.from_arrays(pa.array(np.append(at, len(q)), pa.int32()), hits)})


def unpacked(found: DataFrame) -> DataFrame:
    """(s1, r, arm, ...) of a query's lists of hits; its rows are in one partition, so what groups by query moves them no more."""
    return found.repartition("s1").select("s1", "arm", F.inline("hits")).select("s1", "r", "arm", *found.schema["hits"].dataType.elementType.names[1:])


def pool(found: DataFrame) -> DataFrame:
    """(s1, r, sc, prk, xrk, a0, a3..a8): one row per pair; arm 0 gives score and first rank, others the best rank."""
    first = F.col("arm") == 0
    flags = [F.bool_or(F.col("arm") == k).alias(f"a{k}") for k in CAPS]
    return found.groupBy("s1", "r").agg(
        F.coalesce(F.max(F.when(first, F.col("sc"))), F.lit(0)).cast("long").alias("sc"), F.min(F.when(first, F.col("rk"))).alias("prk"), F.min(F.when(~first, F.col("rk"))).alias("xrk"), *flags
    )


def signatures(records: DataFrame) -> DataFrame:
    """(country, r, sig): the set of numbers with three digits or more in all, else the skeleton of two words or more."""
    nums = F.array_sort(F.array_distinct("ad"))
    sig = F.when(F.length(F.array_join(nums, "")) >= 3, F.concat(F.lit("#"), F.array_join(nums, " "))).when(F.size("sk") >= 2, F.concat(F.lit("k"), F.array_join(F.array_sort("sk"), " ")))
    return records.select("country", F.col("entity_id").alias("r"), sig.alias("sig")).filter("sig is not null")


def expand(pairs: DataFrame, sigs: DataFrame, top: int = 10, group: int = 12) -> DataFrame:
    """(s1, r) new pairs: members of small signature groups that a query's ``top`` first candidates touch."""
    small = sigs.withColumn("n", F.count("*").over(W.Window.partitionBy("country", "sig"))).filter(F.col("n") <= group).drop("n")
    touched = pairs.filter(F.col("prk") <= top).select("s1", "r").join(small, "r").select("s1", "country", "sig").distinct()
    return touched.join(small, ["country", "sig"]).select("s1", "r").distinct().join(pairs.select("s1", "r"), ["s1", "r"], "left_anti")


def number_relation(a: Column, b: Column) -> Column:
    """missing, equal, subset, overlap, trunc (one digit off at either end of a number of three or more) or disjoint."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))

    def near(p: Column, q: Column) -> Column:
        return (F.length(p) - F.length(q) == 1) & (F.length(p) >= 3) & (p.startswith(q) | p.endswith(q))

    cut = F.exists(x, lambda p: F.exists(y, lambda q: near(p, q) | near(q, p)))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), "missing")
        .when((both == F.size(x)) & (both == F.size(y)), "equal")
        .when((both == F.size(x)) | (both == F.size(y)), "subset")
        .when(both > 0, "overlap")
        .when(cut, "trunc")
        .otherwise("disjoint")
    )


def reverse_margin(pairs: DataFrame) -> DataFrame:
    """Adds rev_margin: how far the score stays behind the best that any query gives the record."""
    best = F.max("sc").over(W.Window.partitionBy("r"))
    return pairs.withColumn("rev_margin", F.coalesce(F.try_divide(F.col("sc") - best, best), F.lit(0.0)))


def grouped(pairs: DataFrame) -> DataFrame:
    """Adds (g, gs, top, grk, odd): a pair's group, its best score, the query's best, the group's rank, and whether nothing speaks for the group.

    A null ``gid`` is a group of its own. Without ``rel`` and ``a4`` no group is odd.
    """
    df = pairs.withColumn("g", F.coalesce("gid", F.concat(F.lit("r:"), F.col("r"))))
    own = W.Window.partitionBy("s1", "g")
    df = df.withColumn("gs", F.max("sc").over(own)).withColumn("top", F.max("sc").over(W.Window.partitionBy("s1")))
    df = df.withColumn("grk", F.dense_rank().over(W.Window.partitionBy("s1").orderBy(F.col("gs").desc(), "g")))
    odd = F.lit(False)
    if "rel" in pairs.columns and "a4" in pairs.columns:
        odd = (F.min((F.col("rel") == "disjoint").cast("int")).over(own) == 1) & (F.max(F.col("a4").cast("int")).over(own) == 0)
    return df.withColumn("odd", odd)


def group_rule(alpha: float = 0.0, groups: int = 99, beta: float | None = None, gate: bool = False) -> Column:
    """Over ``grouped`` pairs: group score ratio and rank, the gate against odd groups, the reverse margin."""
    keep = (F.col("gs") >= F.col("top") * F.lit(alpha)) & (F.col("grk") <= groups)
    if gate:
        keep = keep & ~F.col("odd")
    return keep if beta is None else keep & (F.coalesce("rev_margin", F.lit(0.0)) >= -beta)


def prune(pairs: DataFrame, alpha: float = 0.0, groups: int = 99, beta: float | None = None, kmax: int = 999, gate: bool = False) -> DataFrame:
    """Pairs that ``group_rule`` keeps, the best ``kmax`` of a query.

    ``gate`` drops groups whose number relations (``rel``) are all disjoint and that no key (``a4``) has found.
    """
    rank = F.row_number().over(W.Window.partitionBy("s1").orderBy(F.col("sc").desc(), "r"))
    return grouped(pairs).filter(group_rule(alpha, groups, beta, gate)).withColumn("k", rank).filter(F.col("k") <= kmax).drop("g", "gs", "top", "grk", "k", "odd")


def cosine_topk(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(s1, erk, r, esim): exact cosine neighbours; queries in bounded broadcast blocks, candidates never shuffled whole."""
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    asked = df.filter(is_query).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    waves = max(1, -(-asked.count() // block))
    out = None
    for w in range(waves):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).toPandas()
        q = np.stack(got["v"].tolist()).astype(float) if len(got) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

        def run(batches, sent=sent):
            ids, q = sent.value
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                v = np.stack(pdf["v"].tolist()).astype(float)
                s = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 6)
                s[ids[:, None] == pdf["id"].to_numpy()[None, :]] = -2
                top = np.lexsort((np.broadcast_to(pdf["id"].to_numpy(), s.shape), -s), axis=1)[:, :k]
                row = np.repeat(np.arange(len(ids)), top.shape[1])
                yield pd.DataFrame({"s1": ids[row], "r": pdf["id"].to_numpy()[top.ravel()], "esim": s[row, top.ravel()]}).query("esim > -2")

        part = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(run, "s1 long, r long, esim double")
        out = part if out is None else out.unionByName(part)
    order = W.Window.partitionBy("s1").orderBy(F.col("esim").desc(), "r")
    return out.withColumn("erk", F.row_number().over(order)).filter(F.col("erk") <= k)
