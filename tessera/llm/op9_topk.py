"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are quantised to sparse integer rows (term: component, weight: floor(scale * x)). Candidates arrive in blocks;
a block becomes postings, for each term the rows that have it and their weights. For each query the weights
of its terms times the postings are scattered into a dense array of scores, one per candidate of the block; a term that
most rows have is added as a whole column. Partition selection keeps a block's best k, which merge into the best k so far.

Queries are taken in blocks of at most ``query_rows`` rows, each broadcast in turn and set against all candidates, so a
broadcast never exceeds query_rows * dimensions * 8 bytes. The partitions' best lists merge in one aggregation by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

NAME = "op9_topk"


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, no component null, NaN or infinite."""
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False)
    )


def postings(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term: rows that have it (None: the column as a whole, where most have) and their weights."""
    out = []
    for t in range(block.shape[1]):
        col = np.ascontiguousarray(block[:, t])
        rows = np.flatnonzero(col)
        out.append((None, col) if 2 * len(rows) > len(col) else (rows, col[rows]))
    return out


def accumulate(queries: np.ndarray, lists: list, size: int) -> np.ndarray:
    """Scores (queries x size): for each query its terms' weighted postings scattered into a dense row."""
    scores = np.zeros((len(queries), size), dtype=queries.dtype)
    line = np.empty(size, dtype=queries.dtype)
    for q, row in enumerate(queries):
        dense = scores[q]
        for t in np.flatnonzero(row):
            rows, weights = lists[t]
            if rows is None:
                np.multiply(weights, row[t], out=line)
                dense += line
            else:
                dense[rows] += weights * row[t]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k best (ties: smaller id, ids ascend by column): scores and ids."""
    n = scores.shape[1]
    if float(np.abs(scores.astype(np.float64)).max(initial=0)) * n < 2**62:
        key = scores.astype(np.int64) * n - np.arange(n)  # unique, ordered as (score, smaller id)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    else:
        top = np.argsort(~scores.astype(np.int64), axis=1, kind="stable")[:, :k]  # ~x falls as x rises, without an overflow
    return np.take_along_axis(scores, top, 1).astype(np.int64), ids[top]


LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def scored(q: np.ndarray, block: np.ndarray, lists: dict) -> np.ndarray:
    """Exact scores of queries and a block's rows; beyond 64 bits by Python's integers, cut off at their limits."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(block.astype(np.float64)).max(initial=0)) * block.shape[1]
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    if kind not in lists:
        lists[kind] = postings(block.astype(kind))
    scores = accumulate(q.astype(kind), lists[kind], len(block))
    return scores if kind is not object else np.clip(scores, LEAST, MOST).astype(np.int64)


def search(
    df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, query_rows: int = 32768
) -> DataFrame:
    """(query_id, query_row, rank, id, score): each query's k best candidates, ties to the smaller id; all where there are fewer.

    Candidates of a query are all rows with another id; rows of equal id are never each other's candidates, and repeated
    candidate rows appear once each. Queries of equal id and equal components are one query; those of equal id and other components
    are queries of their own, told apart by ``query_row`` (0, 1, ... by components). Vectors that are null or hold null, NaN or infinite
    components take no part, nor do rows with a null id. Of shorter vectors the missing terms weigh 0. Scaled components beyond 64
    bits count as the limit of 64 bits, and so do scores (ties then go to the smaller id). Other columns are not read.
    """
    spark = df.sparkSession
    src = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    cand = src.select("id", "v")
    each = src.filter("q").groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("vs"))  # rows of one id
    asked = each.select("id", F.posexplode("vs").alias("row", "v"))
    total = asked.count()
    waves = max(1, -(-total // query_rows))
    found = None
    for w in range(waves):
        own = asked if waves == 1 else asked.filter(F.pmod(F.xxhash64("id", "row"), F.lit(waves)) == w)
        got = own.toPandas().sort_values(["id", "row"])
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(np.int64), got["row"].to_numpy(np.int32), _matrix(got["v"])))

        def run(batches, sent=sent):
            qids, rows, q = sent.value
            if not len(qids):
                return
            # the best so far; how many of them there are
            best, who, have = np.zeros((len(qids), 0), dtype=np.int64), np.zeros((len(qids), 0), dtype=np.int64), np.zeros((len(qids), 0), dtype=bool)
            for ids, block in _blocks(batches, block_rows):
                lists: dict = {}
                dims = min(q.shape[1], block.shape[1])
                tops, names, real = [], [], []
                for a in range(0, len(qids), 256):
                    s = slice(a, a + 256)
                    scores = scored(q[s, :dims], block[:, :dims], lists)
                    lo, hi = np.searchsorted(ids, qids[s]), np.searchsorted(ids, qids[s], side="right")
                    own_rows = np.flatnonzero(hi > lo)
                    if len(own_rows):
                        scores = scores.astype(np.int64)
                    for r in own_rows:
                        scores[r, lo[r] : hi[r]] = LEAST - 1
                    top, at = _best(scores, ids, k)
                    score, name = np.concatenate((best[s], top), 1), np.concatenate((who[s], at), 1)
                    there = np.concatenate((have[s], (top >= LEAST) & (at != qids[s][:, None])), 1)
                    order = np.lexsort((name, ~score, ~there), axis=1)[:, :k]
                    tops.append(np.take_along_axis(score, order, 1))
                    names.append(np.take_along_axis(name, order, 1))
                    real.append(np.take_along_axis(there, order, 1))
                best, who, have = np.concatenate(tops), np.concatenate(names), np.concatenate(real)
            if have.any():
                yield pd.DataFrame({"query_id": qids, "row": rows, "s": [b[h] for b, h in zip(best, have)], "i": [x[h] for x, h in zip(who, have)]})

        part = cand.mapInPandas(run, "query_id long, row int, s array<long>, i array<long>")
        found = part if found is None else found.unionByName(part)
    lists = found.select("query_id", "row", F.zip_with("s", "i", lambda s, i: F.struct(F.bitwise_not(s).alias("s"), i.alias("i"))).alias("l"))
    merged = lists.groupBy("query_id", "row").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, k).alias("l"))
    return merged.select("query_id", F.col("row").alias("query_row"), F.posexplode("l").alias("r", "x")).select(
        "query_id", "query_row", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.i").alias(id_col), F.bitwise_not("x.s").alias("score")
    )


def _matrix(rows) -> np.ndarray:
    rows = [np.asarray(x, dtype=np.int64) for x in rows]
    width = max((len(x) for x in rows), default=0)
    if all(len(x) == width for x in rows):
        return np.stack(rows) if rows else np.zeros((0, 0), dtype=np.int64)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _blocks(batches, rows: int):
    """(ids ascending, matrix) of at most ``rows`` rows."""
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            part = pdf.iloc[a : a + rows]
            ids, block = part["id"].to_numpy(np.int64), _matrix(part["v"])
            order = np.argsort(ids, kind="stable")
            yield ids[order], block[order]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
asked as (select *, cast(row_number() over (partition by vec_id order by v) - 1 as int) as query_row from (select distinct vec_id, v from e where vec_id % 20 = 0)),
s as (select q.vec_id as query_id, query_row, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))) as score
      from asked q join e c on q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id, query_row order by score desc, vec_id) as rank from s)
select query_id, query_row, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 20"""
