"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated.

(1) Random indexing over the whole corpus: every token (a word, a run of signs, and as a second stream each token's shape)
hashes to one of ``BUCKETS`` cells; a cell has a sparse ternary index vector from the seed, and its context vector is the sum of
its neighbours' index vectors within two places. Partitions sum integers in arrays of fixed size, which merge in two steps, so the
result does not depend on partitions and the table sent to executors is BUCKETS * (DIMS + 1) numbers whatever the corpus.
(2) A document's features are its tokens' mean context and index vectors, by stream, and the logarithms of its size.
(3) A hidden layer and an output unit are trained on at most ``max_train`` labelled rows, those of the smallest id hashes;
a fifth of them is left out to fit the temperature of the probabilities.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table
from ._words import SEP, WordTable, joined

NAME = "op6_quality"

BUCKETS, DIMS, NONZERO, CHUNK, ROWS = 8192, 32, 4, 256, 128


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each cell's non-zero components."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1


def dense_index() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    np.put_along_axis(out, places, signs.astype(np.float32), axis=1)
    return out


def _shape(t: str) -> str:
    if t.isalpha():
        return "AA" if t.isupper() and len(t) > 1 else "Aa" if t[0].isupper() else "aa" if t.islower() else "aA"
    return "9" if t.isdigit() else "a9" if t.isalnum() else t[:3]


_KIND = np.full(256, 2, dtype=np.int8)  # 0 white space, 1 letters and digits, 2 signs, 3 a line feed or the end of a text, each a token of its own
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 255)]] = 1
_KIND[[10, SEP]] = 3


class Cells:
    """Cell numbers of the tokens of texts; those of known tokens are kept, ``limit`` of them at most and a batch's.

    A token is a run of letters and digits (all characters beyond ASCII count as letters), a run of signs, or a line feed.
    """

    def __init__(self, limit: int = 200_000):
        self.known, self.limit = WordTable(), limit
        self.cells = np.zeros((2, 0), dtype=np.int32)

    def _learn(self, new: list[bytes]) -> None:
        own = []
        for raw in new:
            if raw == b"\xff":
                own.append((-1, -1))
                continue
            t = raw.decode("utf-8", "surrogatepass")
            own.append((zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"\0" + _shape(t).encode("utf-8", "surrogatepass")) % BUCKETS))
        self.cells = np.concatenate((self.cells, np.array(own, dtype=np.int32).T), axis=1)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(2 x n cells: of the tokens in lower case, of their shapes; -1 ends a text), and where the texts end."""
        if self.known.size > self.limit:
            self.known.clear()
            self.cells = self.cells[:, :0]
        data = joined([t.encode("utf-8", "surrogatepass") for t in texts])
        kind = _KIND[data]
        edge = np.ones(len(data) + 1, dtype=bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        number = self.known.numbers(data, starts, ends, self._learn)
        return self.cells[:, number], np.flatnonzero(data[starts] == SEP)


@functools.lru_cache(1)
def _cells() -> Cells:
    """One for all tasks of a worker process."""
    return Cells()


def _add_context(table_: np.ndarray, streams: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to the flat table (cells x (DIMS + 1), the last column counts) the contexts of streams in which -1 parts texts."""
    wide = DIMS + 1
    for line in streams:
        real = line[line >= 0]
        table_ += np.bincount(real * wide + DIMS, minlength=len(table_)).astype(np.int64)
        for gap in (1, 2):
            a, b = line[:-gap], line[gap:]
            both = (a >= 0) & (b >= 0) & (line[1 : len(line) - gap + 1] >= 0)  # none between them is the end of a text
            a, b = a[both], b[both]
            for at, by in ((a, b), (b, a)):
                for z in range(NONZERO):
                    table_ += np.rint(np.bincount(at * wide + places[by, z], weights=signs[by, z], minlength=len(table_))).astype(np.int64)


def corpus_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x (DIMS + 1) integers: context sums and counts over all rows of ``df``."""

    def gather(batches):
        places, signs = index_vectors()
        cells, table_ = _cells(), np.zeros(BUCKETS * (DIMS + 1), dtype=np.int64)
        held, size = [], 0
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                held.append(cells.of(pdf["text"].iloc[a : a + ROWS].tolist())[0])
                size += held[-1].shape[1]
                if size > 400_000:
                    _add_context(table_, np.concatenate(held, axis=1), places, signs)
                    held, size = [], 0
        if held:
            _add_context(table_, np.concatenate(held, axis=1), places, signs)
        yield from _rows(table_.reshape(BUCKETS // CHUNK, -1), TaskContext.get().partitionId() % 64)

    def _rows(chunks, salt):
        keep = [i for i in range(len(chunks)) if chunks[i].any()]
        yield pd.DataFrame({"chunk": keep, "salt": [salt] * len(keep), "sums": [chunks[i].astype("<i8").tobytes() for i in keep]}).astype({"chunk": "int32", "salt": "int32"})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for c, raw in zip(pdf["chunk"], pdf["sums"]):
                own = np.frombuffer(raw, dtype="<i8")
                sums[c] = sums[c] + own if c in sums else own
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "salt": [0] * len(sums), "sums": [x.astype("<i8").tobytes() for x in sums.values()]}).astype({"chunk": "int32", "salt": "int32"})

    schema = "chunk int, salt int, sums binary"
    parts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(gather, schema)
    once = parts.repartition("chunk", "salt").mapInPandas(merge, schema)
    out = np.zeros((BUCKETS // CHUNK, CHUNK * (DIMS + 1)), dtype=np.int64)
    for x in once.repartition("chunk").mapInPandas(merge, schema).collect():  # the table, of fixed size
        out[x.chunk] += np.frombuffer(x.sums, dtype="<i8")
    return out.reshape(BUCKETS, DIMS + 1)


def word_table(sums: np.ndarray) -> np.ndarray:
    """BUCKETS x 2 DIMS: context vectors of length one after the common direction is taken out, and index vectors."""
    context = sums[:, :DIMS] / np.maximum(sums[:, DIMS:], 1)
    weight = sums[:, DIMS:] / max(1, sums[:, DIMS].sum())
    context = context - (context * weight).sum(axis=0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return np.concatenate((context, dense_index()), axis=1).astype(np.float32)


def features(streams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean vectors of one text's tokens by stream, and the logarithms of its size and kinds of tokens."""
    n = streams.shape[1]
    if not n:
        return np.zeros(4 * DIMS + 3, dtype=np.float32)
    pooled = [np.bincount(s, minlength=BUCKETS) for s in streams] if n > 4 * BUCKETS else None
    if pooled is None:
        means = [words[s].mean(axis=0) for s in streams]
    else:
        means = [(p[:, None] * words).sum(axis=0) / n for p in pooled]
    kinds = len(np.unique(streams[0]))
    return np.concatenate((*means, [np.log1p(n) / 8, np.log1p(kinds) / 8, kinds / n])).astype(np.float32)


def batch_features(texts: list[str], cells: Cells, words: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    out, at = [], 0
    streams, ends = cells.of(texts)
    for end in ends.tolist():
        out.append(features(streams[:, at:end], words))
        at = end + 1
    return np.stack(out) if out else np.zeros((0, 4 * DIMS + 3), dtype=np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the log loss over the rows not ``aside``, then the temperature with the least log loss on those aside."""
    rng = np.random.default_rng(seed)
    a, b = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    if not len(a):
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    net = Network(a.mean(axis=0), a.std(axis=0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    z = (a - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for k in range(0, len(z), 128):
            own = order[k : k + 128]
            pre = z[own] @ weights[0] + weights[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40)))
            d = (p - b[own]) / len(own)
            back = np.outer(d, weights[2]) * (pre > 0)
            grads = [z[own].T @ back + decay * weights[0], back.sum(axis=0), h.T @ d + decay * weights[2], d.sum(keepdims=True)]
            step += 1
            for w, g, mm, vv in zip(weights, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if aside.any() and len(set(y[aside].tolist())) > 1:
        l, t = net.logits(x[aside].astype(np.float64)), y[aside]
        loss = lambda c: float(np.logaddexp(0, np.where(t == 1, -l, l) / c).mean())
        net.temperature = min(np.exp(np.linspace(np.log(0.2), np.log(10), 60)).tolist(), key=loss)
    return net


def fold(id_col: str):
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _featured(df: DataFrame, words: np.ndarray, keep: list[str], then=None):
    """Rows of ``keep`` with the features of ``text``, or what ``then`` makes of a batch's features."""
    sent = df.sparkSession.sparkContext.broadcast((words, then))

    def run(batches):
        table_, net = sent.value
        cells = _cells()
        for pdf in (b.iloc[a : a + ROWS] for b in batches for a in range(0, len(b), ROWS)):
            x = batch_features(pdf["text"].tolist(), cells, table_)
            out = pdf[keep].copy()
            if net is None:
                out["x"] = list(x)
            else:
                out["score"] = net.score(x)
            yield out

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInPandas(run, f"{types}, " + ("x array<float>" if then is None else "score double"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000) -> tuple[np.ndarray, Network]:
    """(word table, network). Learns labels from rows with fold > 0 only; fold 1 sets the temperature."""
    words = word_table(corpus_vectors(docs, text_col))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(id_col).agg(F.min(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_train).select(F.col(id_col).alias("id"), "y", (fold(id_col) == 1).alias("aside"))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _featured(src.join(F.broadcast(chosen), "id"), words, ["id", "y", "aside"]).toPandas().sort_values("id", kind="stable")
    x = np.stack(rows["x"].tolist()) if len(rows) else np.zeros((0, 4 * DIMS + 3), dtype=np.float32)
    return words, fit(x, rows["y"].to_numpy(), rows["aside"].to_numpy(dtype=bool))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    A null text counts as empty and has the score of a text without tokens. Without any label all scores are 0.5. Repeated rows have
    equal scores; a null id is held out. Columns other than the two named are not read, and the id is no input of a score.
    """
    words, net = model
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _featured(src, words, ["id"], net).select(
        F.col("id").alias(id_col), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


ORACLE_SQL = None
