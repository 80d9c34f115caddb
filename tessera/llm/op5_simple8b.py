"""Token ids in word-aligned binary files (Simple-8b).

A file is a sequence of chunks; a chunk holds some documents:

    magic "S8B1" | n_docs u32 | n_ids u64 | n_blocks u32 | n_words u32 | n_escapes u32
    doc ids i64[n_docs] | ids per document u32[n_docs] | first word of each block u32[n_blocks + 1]
    first escape of each block u32[n_blocks + 1] | words u64[n_words] | escapes u64[n_escapes]

All little-endian. Blocks of 4096 ids (the last may be shorter) start at a word of their own, so one can be decoded
alone. The top four bits of a word select how many ids of how many bits it holds; selector 14 stands for one id of over 60
bits, which is among the escapes. Decoding handles all words of a selector at once.

A Spark job cannot write raw binary files to any store, so chunks are rows (part, seq, ...) of Parquet files in doc_id order:
the range partitions are the parts, seq counts chunks in a part. Where a part starts follows from one sum per part.
``write_file`` and ``read_file`` keep chunks in a plain local file.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import shared_path, table
from ._words import SEP, WordTable, joined, spaced_words, unplain

NAME = "op5_simple8b"

#: ids per word by selector; 60 // count bits each (fixed values of the format)
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
ESCAPE, BLOCK = 14, 4096
_HEAD = struct.Struct("<4sIQIII")
_NO_ID = np.iinfo(np.int64).min
_END = bytes([SEP])


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block and the end, first escape likewise) of an array of uint64."""
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    at = np.arange(n)
    room = np.minimum(block - at % block, n - at)  # ids left in the block
    selector = np.full(n, ESCAPE, dtype=np.int8)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # at most one more than needed, from 2**53 on
    for s in range(ESCAPE - 1, -1, -1):  # later ones hold more ids
        c = int(COUNTS[s])
        small = bits <= 60 // c
        if c == 1:
            selector[small] = s
            continue
        if not small.any():
            break
        bad = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(~small, dtype=np.int32, out=bad[1:])
        fits = np.zeros(n, dtype=bool)
        if n >= c:
            fits[: n - c + 1] = bad[c:] == bad[: n - c + 1]
        selector[fits & (room >= c)] = s
    jump = COUNTS[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    first = np.array(starts, dtype=np.int64)
    chosen = selector[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        c = int(COUNTS[s])
        own = np.flatnonzero(chosen == s)
        shifts = (np.arange(c) * (60 // c)).astype(np.uint64)
        words[own] |= np.bitwise_or.reduce(ids[first[own][:, None] + np.arange(c)] << shifts, axis=1)
    edges = np.append(np.arange(0, n, block), n)
    at_word = np.searchsorted(first, edges)
    at_escape = np.concatenate(([0], np.cumsum(chosen == ESCAPE)))[at_word]
    return words, ids[first[chosen == ESCAPE]], at_word.astype("<u4"), at_escape.astype("<u4")


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    stop = np.cumsum(counts)
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint64)
    first = stop - counts
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[first[own]] = escapes
            continue
        c = int(COUNTS[s])
        bits = 60 // c
        out[first[own][:, None] + np.arange(c)] = (words[own][:, None] >> (np.arange(c) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return out


def write_chunk(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint64)
    words, escapes, at_word, at_escape = pack(ids)
    names = np.array([_NO_ID if d is None or d != d else int(d) for d in doc_ids], dtype="<i8")
    return b"".join(
        (
            _HEAD.pack(b"S8B1", len(docs), len(ids), len(at_word) - 1, len(words), len(escapes)),
            names.tobytes(),
            np.array([len(d) for d in docs], dtype="<u4").tobytes(),
            at_word.tobytes(),
            at_escape.tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        )
    )


class Chunk:
    """A chunk's arrays as views of its bytes."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        magic, docs, self.n_ids, blocks, n_words, n_escapes = _HEAD.unpack_from(raw, at)
        if magic != b"S8B1":
            raise ValueError("not a chunk")
        at += _HEAD.size
        fields = (("doc_ids", "<i8", docs), ("lengths", "<u4", docs), ("at_word", "<u4", blocks + 1), ("at_escape", "<u4", blocks + 1), ("words", "<u8", n_words), ("escapes", "<u8", n_escapes))
        for name, kind, n in fields:
            setattr(self, name, np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        self.end = at

    def ids(self) -> np.ndarray:
        return unpack(self.words, self.escapes)

    def block(self, k: int) -> np.ndarray:
        return unpack(self.words[self.at_word[k] : self.at_word[k + 1]], self.escapes[self.at_escape[k] : self.at_escape[k + 1]])

    def docs(self):
        """(doc_id or None, ids) of each document."""
        ids, stops = self.ids(), np.cumsum(self.lengths)
        for d, n, stop in zip(self.doc_ids.tolist(), self.lengths, stops):
            yield None if d == _NO_ID else d, ids[int(stop) - int(n) : int(stop)]


def write_file(path: str, chunks: list[bytes]) -> None:
    with open(path, "wb") as f:
        f.writelines(chunks)


def read_file(path: str):
    with open(path, "rb") as f:
        raw, at = f.read(), 0
    while at < len(raw):
        chunk = Chunk(raw, at)
        at = chunk.end
        yield chunk


class Encoder:
    """The library's ids, word by word: the library encodes each distinct word once while the bounded cache lasts.

    Byte-level BPE handles the words of its pattern separately, so this changes no id. A batch's words are cut and numbered as
    arrays (``_words``). Texts with an added token, or with characters for which byte classes do not hold, go to the library whole.
    A word's ids lie one after the other in one array, from which all texts of a batch are gathered at once.
    """

    def __init__(self, path: str, cache_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.cache_words = cache_words
        self.known = WordTable()
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.starts, self.sizes, self.store = (np.zeros(0, dtype=kind) for kind in (np.int32, np.int32, np.uint32))

    def _learn(self, new: list[bytes]) -> None:
        starts, sizes, stores, at = [self.starts], [self.sizes], [self.store], len(self.store)
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            # the sign that ends a text becomes an empty word, which has no ids
            got = self.lib.encode(["" if w == _END else w.decode("utf-8") for w in part], is_pretokenized=True, add_special_tokens=False)
            n = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part))
            starts.append((at + np.cumsum(n) - n).astype(np.int32))
            sizes.append(n.astype(np.int32))
            stores.append(np.array(got.ids, dtype=np.uint32))
            at += len(stores[-1])
        self.starts, self.sizes, self.store = np.concatenate(starts), np.concatenate(sizes), np.concatenate(stores)

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Each text's ids with the end id."""
        if self.known.size > self.cache_words:
            self._clear()
        raw = [t.encode("utf-8") for t in texts]
        data = joined(raw)
        stops = np.cumsum([len(t) + 1 for t in raw])
        odd = set(np.searchsorted(stops, unplain(data), side="right").tolist())
        odd.update(k for k, t in enumerate(raw) if any(a in t for a in self.added))
        if odd:
            data = joined([b"" if k in odd else t for k, t in enumerate(raw)])
        firsts = spaced_words(data)
        number = self.known.numbers(data, firsts, np.append(firsts[1:], len(data)), self._learn)
        sizes = self.sizes[number]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.store[np.repeat(self.starts[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate(([0], ends[data[firsts] == SEP])).tolist()
        end = np.array([end_id], dtype=np.uint32)
        out = []
        for k, t in enumerate(texts):
            own = np.array(self.lib.encode(t, add_special_tokens=False).ids, dtype=np.uint32) if k in odd else ids[edges[k] : edges[k + 1]]
            out.append(np.concatenate((own, end)))
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, so that later tasks know the words of earlier ones."""
    return Encoder(path)


def write(df: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, chunk_ids: int = 1 << 17) -> None:
    """Encode the texts, each with ``end_id`` appended, and write them in ascending id order to the folder ``to``.

    A null text counts as empty (the end id alone). Ids are integers; null comes first. Repeated ids are ordered by text. A chunk is
    closed by the document with which it reaches ``chunk_ids`` ids, so it holds less than that and one text. An empty table writes no
    chunks. Other columns are not read.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches):
        enc = _encoder(path or default_path())
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        docs: list[np.ndarray] = []
        size = 0

        def chunk():
            nonlocal names, docs, size, seq, start
            row = {"part": part, "seq": seq, "start": start, "n_ids": size, "payload": write_chunk(names, docs)}
            seq, start = seq + 1, start + size
            names, docs, size = [], [], 0
            return pd.DataFrame([row])

        for pdf in batches:
            for a in range(0, len(pdf), 128):
                own = pdf.iloc[a : a + 128]
                for d, ids in zip(own["id"], enc.encode(own["text"].tolist(), end_id)):
                    names.append(d)
                    docs.append(ids)
                    size += len(ids)
                    if size >= chunk_ids:
                        yield chunk()
        if docs:
            yield chunk()

    src.mapInPandas(run, "part int, seq int, start long, n_ids long, payload binary").write.parquet(to)


def _starts(chunks: DataFrame) -> dict[int, int]:
    """Ids before each part; a part is a range partition, so this is a row per partition."""
    base, out = 0, {}
    for x in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        out[x.part] = base
        base += x.n
    return out


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, ids) of every document written to the folder; start: ids of all documents before it."""
    chunks = spark.read.parquet(at)
    sent = spark.sparkContext.broadcast(_starts(chunks))

    def run(batches):
        for pdf in batches:
            for part, start, raw in zip(pdf["part"], pdf["start"], pdf["payload"]):
                at = sent.value[part] + start
                names, starts, docs = [], [], []
                for d, ids in Chunk(bytes(raw)).docs():
                    names.append(d)
                    starts.append(at)
                    docs.append(ids.astype(np.int64))
                    at += len(ids)
                yield pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "start": starts, "ids": docs})

    return chunks.select("part", "start", "payload").mapInPandas(run, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the crc is over little-endian unsigned 32-bit ids."""
    chunks = spark.read.parquet(at)
    sent = spark.sparkContext.broadcast(_starts(chunks))

    def run(batches):
        for pdf in batches:
            for part, start, raw in zip(pdf["part"], pdf["start"], pdf["payload"]):
                at = sent.value[part] + start
                out = []
                for d, ids in Chunk(bytes(raw)).docs():
                    out.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return chunks.select("part", "start", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "simple8b")
    write(table(spark, sf_dir, "documents"), to)
    return digests(spark, to)


ORACLE_SQL = None
