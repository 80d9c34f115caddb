r"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

A text's words are its runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z. In UTF-8 all other characters
are bytes from 0x80, so one table maps a text's bytes to lower-case letters, digits, high bytes and spaces. Every window
of ten consecutive words of a benchmark item (all words of a shorter item) is a pattern; word starts and ends are
marked by single spaces. Matches give hit words, hit words give places in the original text.

The benchmark is streamed to the driver and cut into blocks whose windows together have at most ``block_chars`` characters, which bounds
the trie of a block's automaton; a long item is cut into overlapping stretches of windows first. A task keeps the last automaton
it has built. With more than one block it gathers rows up to ``batch_bytes`` of text, builds one block's automaton after the other and scans
the same rows with each, so a row's result is made in one place and does not depend on the number of blocks. Blocks beyond
``wave_chars`` (all that is broadcast at once) follow in another pass over the stored rows with what they have so far.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, table

NAME = "op3_decontaminate"

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def build(items: list[tuple[object, str | None]], width: int):
    """An automaton from marked windows to (number of words, ids of the items that have the window); None without windows."""
    import ahocorasick

    where: dict[bytes, set] = {}
    for item, text in items:
        for w in windows_of(words_of(text), width):
            where.setdefault(w, set()).add(item)
    if not where:
        return None
    auto = ahocorasick.Automaton()
    for w, ids in where.items():
        auto.add_word((b" " + w + b" ").decode("latin-1"), (w.count(b" ") + 1, frozenset(ids)))
    auto.make_automaton()
    return auto


def scan_text(auto, text: str | None) -> tuple[int, np.ndarray, set]:
    """Number of words, the hit ones' places among them, ids of items with occurring windows."""
    words = words_of(text)
    if auto is None or not words:
        return len(words), np.zeros(0, dtype=np.int64), set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = list(auto.iter(line))
    if not found:
        return len(words), np.zeros(0, dtype=np.int64), set()
    stops = np.cumsum([len(w) + 1 for w in words])  # where each word's closing space is
    last = np.searchsorted(stops, [end for end, _ in found])
    n = np.array([k for _, (k, _) in found])
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, last - n + 1, 1)
    np.add.at(edge, last + 1, -1)
    ids: set = set()
    for _, (_, x) in found:
        ids |= x
    return len(words), np.flatnonzero(np.cumsum(edge[:-1]) > 0), ids


def spans_of(text: str, hits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of hit words: code-point span in the original text, places of the first and last word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    word = np.frombuffer(_MAP, dtype=np.uint8)[raw] != 32
    at = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with this byte
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    return [(int(at[starts[r[0]]] - 1), int(at[ends[r[-1]] - 1]), int(r[0]), int(r[-1])) for r in runs if len(r)]


def _blocks(items, width: int, block_chars: int):
    """Lists of (item, text) whose windows have at most ``block_chars`` characters in all; a single window may be longer."""
    held: list[tuple[object, str]] = []
    size = 0
    for item, text in items:
        words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
        at = 0
        while at < len(words):
            stop, own = at + min(width, len(words)), 0
            own = sum(len(w) + 1 for w in words[at:stop])
            grown = own
            while stop < len(words) and size + own + grown <= block_chars:
                grown += len(words[stop]) - len(words[stop - width])
                own += grown
                stop += 1
            if held and size + own > block_chars:
                yield held
                held, size = [], 0
                continue
            held.append((item, " ".join(words[at:stop])))
            size += own
            if stop == len(words):
                break
            at = stop - width + 1  # the next window
    if held:
        yield held


_AUTO: dict = {}  # the last automaton of this worker process


def _automaton(key: str, block: list, width: int):
    if _AUTO.get("key") != key:
        _AUTO.clear()
        _AUTO.update(key=key, auto=build(block, width))
    return _AUTO["auto"]


def _gathered(batches, size: int):
    """Frames of about ``size`` bytes of text each; smaller ones are put together, larger ones stay."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += int(pdf["text"].str.len().sum())
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    width: int = 10,
    block_chars: int = 4 << 20,
    batch_bytes: int = 32 << 20,
    wave_chars: int = 256 << 20,
) -> DataFrame:
    """(id, n_words, hits, spans, items): hit words' places, their spans in the original text, item ids as strings.

    Null and empty texts have no words and no hits; items without words have no window. Every row, also a repeated one or one with a
    null id, gives its own result, whatever the number of blocks. Items with a null id count as one item, a null at the end of
    ``items``; equal ids are one item. An empty benchmark hits nothing. Columns other than those named are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    state = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<long>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))

    def wave(state: DataFrame, blocks: list, last: bool) -> DataFrame:
        sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in blocks]

        def run(batches):
            for pdf in batches if len(sent) == 1 else _gathered(batches, batch_bytes):
                texts = pdf["text"].tolist()
                hits = [set(h) if h is not None else set() for h in pdf["hits"]]
                ids = [set(i) if i is not None else set() for i in pdf["items"]]
                sizes = [0] * len(texts)
                for key, block in sent:
                    auto = _automaton(key, block.value, width)
                    for k, text in enumerate(texts):
                        sizes[k], at, found = scan_text(auto, text)
                        if len(at):
                            hits[k].update(at.tolist())
                            ids[k] |= found
                out = {"id": pdf["id"], "hits": [sorted(h) for h in hits], "items": [sorted(x, key=lambda i: (i is None, i or "")) for x in ids]}
                if last:
                    spans = [spans_of(t, np.array(h)) if h else [] for t, h in zip(texts, out["hits"])]
                    yield pd.DataFrame(out | {"n_words": sizes, "spans": [[{"start": s, "end": e} for s, e, _, _ in x] for x in spans]})
                else:
                    yield pd.DataFrame(out | {"text": pdf["text"]})

        more = "n_words long, spans array<struct<start:int,end:int>>" if last else "text string"
        return state.mapInPandas(run, f"id {kind}, hits array<long>, items array<string>, {more}")

    held: list = []
    size = 0
    for block in _blocks(((x.item, x.text) for x in items.toLocalIterator()), width, block_chars):
        if held and size + block_chars > wave_chars:
            state = cut(wave(state, held, False))
            held, size = [], 0
        held.append(block)
        size += block_chars
    out = wave(state, held or [[]], True)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "spans", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
win as (select item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as s
        from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
dw as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as s
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select rid, i, dw.n, item_id from dw join win on dw.s = win.s and dw.n = win.n),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
it as (select rid, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct rid, cast(item_id as varchar) as k from m) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)"""
