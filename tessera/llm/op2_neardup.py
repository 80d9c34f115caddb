"""Near-duplicate detection with order MinHash, verified by banded alignment.

A text's words (lower case, letters and digits) are cut in the JVM and from then on are hashes, of 64 bits in sketches and of 32 in alignments. They give five-word
k-mers, each labelled by how often it has occurred before. For each of ``sketches`` hash functions the ``ell`` smallest
labelled k-mers, kept in text order, make one sketch value: equal values need equal k-mers in an equal order, which is close
to edit similarity. Each value is a bucket key.

A pair's similarity is 1 - (edits between the word sequences) / (words of the longer one): a bit-parallel alignment inside the
band that the threshold leaves, after equal ends are cut off and a bound by common words is passed. Texts of which every seventh
word differs are still found, though they share few five-word k-mers; the sketches set the recall.

Texts of equal words collapse first to one node (128 bits of hash), so exact copies, however many, cost one aggregation.
In a bucket no pairs are listed. In each of three rounds some members are hubs (the one that meets most others in all buckets, then one
of each of four hash groups), found by maxima, and each member that is not in a hub's class by then is compared with it: near copies end up in
one class after a round or two. Pairs that 512 parities of word counts show to be too far apart are not compared. Buckets whose other members are still of several classes are left. There, pairs come from an
equi-join on rare runs of words: a text is cut into runs of one to three words, as short as a common counter table allows; an edit
spoils one run at most, so of the (1 - threshold)n + 1 rarest runs of the longer text one is left in any similar text, and that
text has it among its own runs. The counter table has a fixed size. So no link between members of a bucket is lost, but for pairs that are of one
class anyway, which are not compared.

Worst case: texts of which a very common passage makes up nearly as much as the threshold have no rare run left to tell them apart;
their pairs meet in the join, where the parities tell most apart, as numbers, before a row is made; the others are aligned. Parities of texts of
a thousand words or more tell little.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Stored, cut, table

NAME = "op2_neardup"

_SPLIT = r"[^\p{L}\p{N}]+"
_HUBS, _ROUNDS, _COUNTERS, _BITS, _LOCAL = 4, 3, 1 << 18, 1 << 22, 1 << 17
_MARK = 8  # numbers of 64 bits
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _kmers(words: np.ndarray, k: int) -> np.ndarray:
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = _mix(out * _M1 + words[i : i + n])
    return out


def order_minhash(words: np.ndarray, k: int, ell: int, seeds: np.ndarray) -> np.ndarray:
    """One 64-bit value per seed for a sequence of word hashes (uint64)."""
    kmers = _kmers(words, k)
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    fresh = np.concatenate(([True], kmers[order][1:] != kmers[order][:-1]))
    place = np.arange(n)
    seen = np.empty(n, dtype=np.uint64)  # how often the k-mer has occurred before
    seen[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    labelled = _mix(kmers + seen * _M1)
    out = np.empty(len(seeds), dtype=np.uint64)
    step = max(1, (1 << 18) // n)  # bounded memory for long texts
    for a in range(0, len(seeds), step):
        h = _mix(labelled[None, :] ^ seeds[a : a + step, None])
        best = np.sort(np.argpartition(h, ell - 1, axis=1)[:, :ell], axis=1) if n > ell else np.broadcast_to(place, h.shape)
        value = np.full(len(h), n if n < ell else 0, dtype=np.uint64)  # ell k-mers in all may be the smallest of a longer text
        for c in range(best.shape[1]):
            value = _mix(value * _M1 + labelled[best[:, c]])
        out[a : a + step] = value
    return out


def _ends(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start on are equal."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


def similarity(a, b, threshold: float = 0.0) -> float:
    """1 - edit distance / words of the longer sequence (1 for two empty ones); 0.0 where that is surely below the threshold.

    The alignment stays in the band of the edits that the threshold leaves.
    """
    a, b = np.asarray(a), np.asarray(b)
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    limit = math.floor((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return 0.0
    lo = _ends(a, b)
    a, b = a[lo:], b[lo:]
    hi = _ends(a[::-1], b[::-1])
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / longer
    words, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    common = np.minimum(np.bincount(a, minlength=len(words)), np.bincount(b, minlength=len(words))).sum()
    if max(len(a), len(b)) - common > limit:
        return 0.0
    return 1 - _distance(a.tolist(), b.tolist(), limit) / longer


def _distance(a: list[int], b: list[int], band: int) -> int:
    """Edit distance by Myers' bit vectors, matches at most ``band`` places apart; exact where it is at most ``band``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, top, wide = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << (2 * band + 1)) - 1
    up, down, score = full, 0, len(a)
    for j, x in enumerate(b):
        eq = where.get(x, 0)
        if eq:
            eq &= (wide << (j - band)) if j >= band else (wide >> (band - j))
        free = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(flat | up))
        minus = up & flat
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up = minus | (full & ~(free | plus))
        down = plus & free
    return score


def mark(words: np.ndarray) -> np.ndarray:
    """``_MARK`` numbers with a bit for each of 64 * ``_MARK`` groups of words: whether the text has an odd number of them.

    An inserted or deleted word changes one bit, a replaced one two at most.
    """
    odd = np.bincount(words & (64 * _MARK - 1), minlength=64 * _MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_near(n_x: Column, x: list[Column], n_y: Column, y: list[Column], threshold: float) -> Column:
    """Whether two texts' words and marks leave room for the threshold: no pair that reaches it is left out."""
    flips = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y)), F.lit(0))
    longer, apart = F.greatest(n_x, n_y), F.abs(n_x - n_y)
    return flips + apart <= 2 * F.floor(F.lit(1 - threshold) * longer + F.lit(1e-9))


def _merged(batches):
    """(a, next) of each node of the edges (a, b) of all batches; next is the smallest node of its component."""
    ends = [(pdf["a"].to_numpy(), pdf["b"].to_numpy()) for pdf in batches]
    at, nodes = pd.factorize(np.concatenate([x for e in zip(*ends) for x in e]) if ends else np.zeros(0, dtype=object))
    order = np.argsort(nodes, kind="stable")
    place = np.empty(len(nodes), dtype=np.int64)
    place[order] = np.arange(len(nodes))
    at, root = place[at], list(range(len(nodes)))  # roots are the smallest of their trees
    for x, y in zip(at[: len(at) // 2].tolist(), at[len(at) // 2 :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for i, x in enumerate(root):
        root[i] = root[x]
    yield pd.DataFrame({"a": nodes[order], "next": nodes[order][np.array(root, dtype=np.int64)]})


def connected(edges: DataFrame) -> DataFrame:
    """(node, class) for edges (a, b): class is the smallest node of the component.

    While there are over ``_LOCAL`` edges, each round sends a node to the neighbour (or itself) with the smallest hash under
    the round's seed and contracts the edges; the number of nodes falls geometrically, whatever the shape. Hot nodes are
    summed up before shuffles. The bounded rest is named by one task, as dozens of tiny rounds would cost the driver a plan
    and hundreds of tasks each. Tables of earlier rounds are deleted, the last one stays in the shared folder for whoever
    reads the result.
    """
    left = Stored(edges.select("a", "b").filter("a <> b"), "edges")
    kind = left.df.schema["a"].dataType.simpleString()
    steps: list[Stored] = []
    while left.df.count() > _LOCAL:
        k = len(steps)
        both = left.df.select("a", "b").union(left.df.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("v"))
        goes = Stored(near.select("a", F.least("m", own)["v"].alias("next")), "goes")
        to_a, to_b = goes.df.select("a", F.col("next").alias("ta")), goes.df.select(F.col("a").alias("b"), F.col("next").alias("tb"))
        joined = left.df.join(to_a, "a").join(to_b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        shorter = Stored(joined.filter("a <> b").distinct(), "edges")
        left.drop()
        left = shorter
        steps.append(goes)
    steps.append(Stored(left.df.coalesce(1).mapInPandas(_merged, f"a {kind}, next {kind}"), "goes"))
    left.drop()
    names = steps[0].df.select(F.col("a").alias("node"), F.col("next").alias("class"))
    if len(steps) == 1:
        return names
    names = names.withColumnRenamed("class", "at")
    for goes in steps[1:]:
        names = names.join(goes.df, F.col("at") == F.col("a"), "left").select("node", F.coalesce("next", "at").alias("at"))
    least = names.groupBy("at").agg(F.min("node").alias("class"))
    named = Stored(names.join(least, "at").select("node", "class"), "names")
    for t in steps:
        t.drop()
    return named.df


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.85, sketches: int = 16, ell: int = 2, seed: int = 7
) -> DataFrame:
    """(id, class_id, kept) of every row; class_id is the smallest id of the class, kept is true for one row of the class, which has that id.

    Rows of equal words are one class; texts without words (null, empty, signs only) are equal where their characters are.
    Repeated rows (equal id and text) have equal results, of which all but one are not kept. Different texts under one id are rows of
    their own, each with its text's class. A row with a null id takes its class's id; a class of null ids alone has class_id null and
    keeps one of them. ``sketches`` and ``ell`` set the recall: with a share s of common k-mers about 1 - (1 - s**ell)**sketches a pair.
    Texts of under k words are one k-mer and meet equal ones alone. Columns other than the two named are not read.
    """
    if not 0.85 <= threshold <= 1:
        raise ValueError("the segments suffice for thresholds from 0.85 on")
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, sketches, dtype=np.uint64)
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketch(batches):
        for pdf in batches:
            sk = [order_minhash(np.asarray(w, dtype=np.int64).view(np.uint64), k, ell, seeds).view(np.int64) if len(w) else np.zeros(0, dtype=np.int64) for w in pdf["w"]]
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "node": pdf["node"], "sk": sk})

    cutter = _worded(src.select("id", F.xxhash64("text").alias("h"), "text")).select("id", "h", "node", "w")
    rows = cut(cutter.mapInPandas(sketch, f"id {kind}, h long, node binary, sk array<long>"))
    # the smallest id of a node that has one, and the hash of a text of that id
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    reps = cut(rows.groupBy("node").agg(first, F.first("sk").alias("sk")).select("node", F.col("first.id").alias("rep"), F.col("first.h").alias("h"), "sk"))
    cells = reps.select("node", F.posexplode("sk").alias("f", "v")).select(F.xxhash64("f", "v").alias("key"), "node")

    def words(nodes: DataFrame) -> DataFrame:
        """(node, w) of some nodes, w: 32-bit hashes of the words; of all rows one a node is taken by id and text hash before its words are cut."""
        need = reps.join(nodes, "node").select(F.col("rep").alias("need"), F.col("h").alias("need_h"), F.col("node").alias("need_node"))
        texts = src.withColumn("h", F.xxhash64("text"))
        found = texts.join(need, (F.col("h") == F.col("need_h")) & F.col("id").eqNullSafe(F.col("need"))).select(F.col("need_node").alias("node"), "text")
        return found.withColumn("words", words_of(F.col("text"))).select("node", F.transform("words", lambda x: F.hash(x)).alias("w")).groupBy("node").agg(F.first("w").alias("w"))

    classes = _classes(cells, words, threshold)
    named = reps.select("node", "rep").join(classes, "node", "left").select("node", "rep", F.coalesce("class", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("rep").alias("class_id"), F.min_by("node", F.struct(F.col("rep").isNull(), "rep", "node")).alias("chosen"))
    named = named.join(least, "class").select("node", "class_id", (F.col("node") == F.col("chosen")).alias("own"))
    # equal rows as one with their number, of which the first is kept
    once = rows.groupBy("id", "node").agg(F.count("*").alias("n")).join(named, "node")
    if_kept = F.col("own") & F.col("id").eqNullSafe(F.col("class_id"))
    out = once.select("id", "class_id", if_kept.alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("own") & (F.col("i") == 1)).alias("kept"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT, -1), lambda w: w != "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _worded(df: DataFrame) -> DataFrame:
    """``df`` with the hashes ``w`` of the words of ``text`` and 128 bits ``node`` that stand for the words, or for the text if it has none."""
    norm = F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.concat(F.lit("\u0000"), F.col("text")))
    return df.withColumn("words", words_of(F.col("text"))).select(*df.columns, F.unhex(F.md5(norm.cast("binary"))).alias("node"), hashes(F.col("words")).alias("w"))


def grams_of(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of one, two and three words, by their start."""
    return [_mix(_kmers(words, k) + np.uint64(k)) if len(words) >= k else np.zeros(0, dtype=np.uint64) for k in (1, 2, 3)]


def segments(grams: list[np.ndarray], often: list[np.ndarray], rare: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, count, length) at each word's place: the shortest run of one to three words there with a count up to ``rare``, else three words.

    It depends on the run's words alone. The last places that are too short for theirs have the length 0.
    """
    n = len(grams[0])
    token, count, size = grams[0].copy(), often[0].copy(), np.ones(n, dtype=np.int64)
    for k in (2, 3):
        long = np.flatnonzero(count > rare) if k == 2 else np.flatnonzero((size == 2) & (count > rare))
        size[long] = k
        there = long[long < len(grams[k - 1])]
        token[there], count[there] = grams[k - 1][there], often[k - 1][there]
        size[long[long >= len(grams[k - 1])]] = 0
    return token, count, size


def chosen(token: np.ndarray, count: np.ndarray, size: np.ndarray, edits: int) -> np.ndarray:
    """Places of the ``edits + 1`` rarest of the segments that follow each other from the first word on."""
    places, i, jump = [], 0, size.tolist()
    while i < len(jump):
        if jump[i]:
            places.append(i)
        i += max(1, jump[i])
    at = np.array(places, dtype=np.int64)
    return at[np.lexsort((token[at], count[at]))[: edits + 1]]


def _tokens(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(token, node, n, of, mark) twice from (node, w, n, mark, of), mark as one column a number: the rare segments of each text, and of all texts those runs of words that may be asked for.

    One of its rare segments is left in whatever is similar to a text and no longer.
    """
    cells, bits = np.uint64(_COUNTERS - 1), np.uint64(_BITS - 1)

    def cell(x: np.ndarray) -> np.ndarray:
        return (x & cells).astype(np.int64)

    def hashed(w) -> list[np.ndarray]:
        return grams_of(np.asarray(w, dtype=np.int64).view(np.uint64))

    def count(batches):
        total = np.zeros(_COUNTERS, dtype=np.int64)
        for pdf in batches:
            own = [cell(np.unique(np.concatenate(hashed(w)))) for w in pdf["w"]]
            if own:
                total += np.bincount(np.concatenate(own), minlength=_COUNTERS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"cell": some, "n": total[some]})

    spark = members.sparkSession
    table_ = np.zeros(_COUNTERS, dtype=np.int64)
    counts = members.select("w").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # of fixed size; as columns, not a Python object a cell
    table_[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    sent = spark.sparkContext.broadcast((np.minimum(table_, 2**31 - 1).astype(np.int32), 8 + 4 * float(table_.mean())))

    def emit(pick):
        def run(batches):
            often, rare = sent.value
            for pdf in (b.iloc[i : i + 256] for b in batches for i in range(0, len(b), 256)):
                found = []
                for w in pdf["w"]:
                    grams = hashed(w)
                    token, n, size = segments(grams, [often[cell(g)] for g in grams], rare)
                    found.append(np.unique(pick(token, n, size, len(w))).view(np.int64))
                each = np.repeat(np.arange(len(pdf)), [len(x) for x in found])
                out = {"token": np.concatenate(found) if found else np.zeros(0, dtype=np.int64)} | {c: pdf[c].to_numpy()[each] for c in ("node", "n", "of")}
                marks = np.stack(pdf["mark"].tolist()) if len(pdf) else np.zeros((0, _MARK), dtype=np.int64)
                yield pd.DataFrame(out | {f"mark{i}": marks[each, i] for i in range(_MARK)})

        return members.mapInPandas(run, ", ".join(["token long, node binary, n long, of binary", *(f"mark{i} long" for i in range(_MARK))]))

    def asked(token, n, size, words):
        at = chosen(token, n, size, math.floor((1 - threshold) * words + 1e-9))
        return token[at[n[at] > 1]]  # a run that occurs in one text leads nowhere

    asks = cut(emit(asked))
    bit = F.col("token").bitwiseAND(F.lit(_BITS - 1))
    some = asks.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()  # of fixed size
    mask = np.zeros(_BITS // 32, dtype=np.uint32)
    mask[some["at"].to_numpy()] = some["bits"].to_numpy().astype(np.uint32)
    wanted = spark.sparkContext.broadcast(mask)

    def answers(token, n, size, words):
        at = token & bits
        hit = (wanted.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
        return token[(size > 0) & (hit > 0)]

    return asks, emit(answers)


def _classes(cells: DataFrame, words, threshold: float) -> DataFrame:
    """(node, class) of the nodes with links, from bucket rows (key, node); ``words`` gives (node, w) of a frame of nodes."""

    def verify(batches):
        for pdf in batches:
            ok = [similarity(a, b, threshold) >= threshold - 1e-9 for a, b in zip(pdf["wa"], pdf["wb"])]
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    def marked(batches):
        for pdf in batches:
            yield pdf.assign(n=pdf["w"].str.len().astype(np.int64), mark=[mark(np.asarray(w, dtype=np.int64)) for w in pdf["w"]])

    shared = cells.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    base = cut(cells.join(shared, "key"))
    central = base.groupBy("node").agg(F.sum("n").alias("rank"))
    held = cut(words(central.select("node")).mapInPandas(marked, "node binary, w array<int>, n long, mark array<long>"))
    wa, wb = held.select(F.col("node").alias("a"), F.col("w").alias("wa")), held.select(F.col("node").alias("b"), F.col("w").alias("wb"))

    def pairs(d: DataFrame, x: str, y: str) -> DataFrame:
        return d.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()

    def verified(asked: DataFrame) -> DataFrame:
        return cut(asked.join(wa, "a").join(wb, "b").mapInPandas(verify, "a binary, b binary"))

    links, named, asked, used = None, None, None, None
    base = cut(base.join(central, "node").join(held.select("node", F.struct("n", "mark").alias("mark")), "node").select("key", "node", "rank", "mark"))

    def near(x: Column, y: Column) -> Column:
        return _may_be_near(x["n"], [x["mark"][i] for i in range(_MARK)], y["n"], [y["mark"][i] for i in range(_MARK)], threshold)

    left = base.withColumn("of", F.col("node"))
    for r in range(_ROUNDS):
        # hubs by maxima: first the most central member of a bucket, later one of each of _HUBS groups of those that are left
        if r:
            picks = [F.max(F.when(F.pmod(F.xxhash64("node", F.lit(-r)), F.lit(_HUBS)) == i, F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "of", "mark"))) for i in range(_HUBS)]
        else:
            picks = [F.max(F.struct("rank", "node", "of", "mark"))]
        tops = left.groupBy("key").agg(*(p.alias(f"m{i}") for i, p in enumerate(picks)))
        hubs = cut(tops.select("key", F.explode(F.array_compact(F.array(*(f"m{i}" for i in range(len(picks)))))).alias("m")).select("key", F.col("m.node").alias("hub"), F.col("m.of").alias("of_hub"), "m.mark"))
        listed = hubs.groupBy("key").agg(F.collect_list(F.struct("hub", "of_hub", "mark")).alias("hubs"))  # _HUBS at most
        to = F.filter("hubs", lambda h: (h["of_hub"] != F.col("of")) & near(h["mark"], F.col("mark")))
        now = pairs(left.join(listed, "key").select("node", F.explode(F.transform(to, lambda h: h["hub"])).alias("hub")), "node", "hub")
        now = cut(now if asked is None else now.join(asked, ["a", "b"], "left_anti"))
        found = verified(now)
        asked = now if asked is None else asked.unionByName(now)
        used = hubs.select("key", F.col("hub").alias("node")) if used is None else used.unionByName(hubs.select("key", F.col("hub").alias("node")))
        links = found if named is None else named.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(found)
        named = connected(links)
        # what is left: members that have been no hubs, of buckets where these are of several classes
        of = named.select("node", F.col("class").alias("of"))
        left = base.join(used, ["key", "node"], "left_anti").join(of, "node", "left").withColumn("of", F.coalesce("of", "node"))
        mixed = left.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).filter("lo <> hi").select("key")
        left = cut(left.join(mixed, "key"))
        if not left.take(1):
            return named
    members = cut(left.groupBy("node").agg(F.first("of").alias("of")))
    asks, answers = _tokens(held.join(members, "node"), threshold)
    x, y = (d.select("token", F.col("node").alias(c), F.col("of").alias(f"of_{c}"), F.col("n").alias(f"n_{c}"), *(F.col(f"mark{i}").alias(f"{c}{i}") for i in range(_MARK))) for c, d in (("x", asks), ("y", answers)))
    shorter = (F.col("n_y") < F.col("n_x")) | (F.col("n_y") == F.col("n_x")) & (F.col("x") < F.col("y"))
    near_ = _may_be_near(F.col("n_x"), [F.col(f"x{i}") for i in range(_MARK)], F.col("n_y"), [F.col(f"y{i}") for i in range(_MARK)], threshold)
    met = x.join(y, "token").filter((F.col("of_x") != F.col("of_y")) & shorter & near_)
    last = pairs(met, "x", "y").join(asked, ["a", "b"], "left_anti")
    star = named.select(F.col("node").alias("a"), F.col("class").alias("b"))
    return connected(star.unionByName(verified(last)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
