"""BPE encoding and decoding with a contiguous rank array.

A word's part boundaries and the ranks of adjacent parts stand in two short lists. The smallest rank is looked for by
a scan, its boundary deleted, and the two neighbouring ranks renewed, until no pair has a rank. Words are cut,
normalised and mapped to byte symbols as the vocabulary file says; results are kept per word in a bounded cache.

Supported: files of the tokenizers library with model BPE (no dropout, no byte fallback), a normaliser of NFC, regex
replacement and lower case, and a pre-tokeniser of Split and ByteLevel; added tokens that are not normalised.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

NAME = "op8_bpe"

_NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else extra))
        extra += b not in keep
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict, cache_words: int = 200_000):
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a], self.vocab[b]] = i, self.vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.bytes = byte_symbols()
        self.table = dict(enumerate(self.bytes))
        self.cache: dict[str, list[int]] = {}
        self.cache_words = cache_words
        # a plain-pattern fast path: text whose characters all fall in ranges where letters are what \w says
        import re

        self.plain = re.compile(r"[\x00-\x08\t-\r -~À-ÖØ-öø-ɏ]*\Z")
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+") if split["pattern"]["Regex"] == _CLIP else None

    def merge(self, word: str) -> list[int]:
        """Ids of one word (after normalisation), by the contiguous rank array."""
        symbols = list(word.encode("utf-8").decode("latin-1").translate(self.table))
        symbols[-1] += self.suffix
        parts = [self.vocab[s] for s in symbols]
        pair = self.ranks.get
        ranks = [pair(p, (_NEVER, 0))[0] for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [self.ranks[parts[i], parts[i + 1]][1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pair((parts[i], parts[i + 1]), (_NEVER, 0))[0]
            if i:
                ranks[i - 1] = pair((parts[i - 1], parts[i]), (_NEVER, 0))[0]
        return parts

    def words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            # character by character, as a final sigma has no form of its own here
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.plain_words is not None and self.plain.match(text):
            return self.plain_words.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for k, piece in enumerate(self.cut_added.split(text or "") if self.cut_added else [text or ""]):
            if k % 2:
                out.append(self.added[piece])
                continue
            for w in self.words(piece):
                ids = cache.get(w)
                if ids is None:
                    ids = self.merge(w)
                    if len(w) < 64:
                        if len(cache) >= self.cache_words:
                            cache.clear()
                        cache[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder in the file: the tokens' strings joined by one space."""
        return " ".join([self.names[i] for i in ids])


#: the pattern of the public file: fixed value
_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def checked(spec: dict) -> dict:
    """``spec``, if it is of the kind that ``WordBpe`` handles; else a ValueError says what is not."""
    model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in norm.get("normalizers", [norm])]
    cuts = pre.get("pretokenizers", [pre])
    split = cuts[0] if cuts else {}
    for ok, what in (
        (model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix"), "model"),
        (steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)], "normalizer"),
        ([p.get("type") for p in cuts] == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"] and not cuts[1]["add_prefix_space"], "pre_tokenizer"),
        (not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]), "added_tokens"),
    ):
        if not ok:
            raise ValueError(f"a {what} of another kind: {spec.get(what)!r:.300}")
    return spec


@functools.lru_cache(1)
def load(path: str) -> WordBpe:
    """The encoder of a file, one for all tasks of a worker process, so that later tasks know the words of earlier ones."""
    with open(path, encoding="utf-8") as f:
        return WordBpe(checked(json.load(f)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_text: bool = True) -> DataFrame:
    """(id, ids, decoded): token ids of each row's text and what they decode to.

    A null or empty text has no ids and decodes to an empty text. Rows are independent: repeated rows, null ids and very long texts
    need no care, an empty table gives none. Words over 63 characters are not cached. ``path`` names a file that
    every executor has; by default the installed vocabulary.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path or default_path())
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                ids = [bpe.encode(t) for t in part["text"]]
                decoded = pd.Series([bpe.decode(x) if with_text else None for x in ids], dtype=object)
                yield pd.DataFrame({"id": part["id"].reset_index(drop=True), "ids": ids, "decoded": decoded})

    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


ORACLE_SQL = None
