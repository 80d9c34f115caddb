"""Secret scanning with Spark expressions only.

Two families of spans over a text, in code points, end exclusive:

* base spans: ``assign`` (a credential word, a separator, a value of 12+ characters), ``access`` (``AKIA`` keys of
  18+ characters) and ``hex`` (runs of 16+ lower-case hex digits), leftmost and non-overlapping per kind;
* entropy spans: a window slides over each candidate string of a character class; counts per character are updated
  by one addition and one removal a step, and with them the sum of c*log2(c), so that the Shannon entropy of the
  window costs nothing to renew. Windows at or over the threshold of the class merge into spans. A candidate that an
  allow-list pattern matches gives none, nor does a span that base spans cover wholly; one that they cover in part stays
  as it is, and ``redacted`` masks overlapping spans as one.

``split`` and ``regexp_extract_all`` with one pattern give the pieces between matches and the matches; summed lengths
give their places. Nothing is shuffled and no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import running, table

NAME = "op1_secrets"

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal runs of ``alphabet`` (a regex class); ``min_bits`` is compared with each window's entropy."""

    name: str
    alphabet: str
    symbols: str
    window: int
    min_bits: float


CLASSES = (
    EntropyClass("entropy_hex", "0-9a-fA-F", "0123456789abcdefABCDEF", 24, 3.0),
    EntropyClass(
        "entropy_base64", "A-Za-z0-9+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 24, 4.0
    ),
)

#: Candidates that are no secrets: UUIDs, words or numbers joined by dashes, slashes
#: or underscores, documentation examples, the alphabet in order.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:(?:[A-Za-z]+|[0-9]+)[-_/+])+(?:[A-Za-z]+|[0-9]+)?$",
    r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefgh",
)


def candidates(cls: EntropyClass) -> str:
    """Pattern of the maximal runs of the class's alphabet that fill a window and hold a digit and a letter."""
    a = cls.alphabet
    letters = "".join(r for r in ("A-Z", "a-z", "a-f", "A-F") if r in a)
    others = a.replace("0-9", "")
    for r in ("A-Z", "a-z", "a-f", "A-F"):
        others = others.replace(r, "")
    return f"(?<![{a}])(?=[{a.replace('0-9', '')}]*[0-9])(?=[0-9{others}]*[{letters}])[{a}]{{{cls.window},}}"


def _located(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, n, value>>: each match's place, length and the given group's text."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(pieces.alias("p"), whole.alias("w"), value.alias("v"))
    none = F.array().cast("array<struct<start:int,n:int,value:string>>")

    def piece(at: Column, x: Column):
        start, n = at + F.length(x["p"]), F.coalesce(F.length(x["w"]), F.lit(0))  # the last piece has no match
        return start + n, F.when(x["w"].isNotNull(), F.array(F.struct(start.alias("start"), n.alias("n"), x["v"].alias("value")))).otherwise(none)

    return running(rows, 0, piece, "struct<start:int,n:int,value:string>")


def _spans(found: Column, order: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), (m["start"] + m["n"]).alias("end"), F.lit(kind).alias("kind")),
    )


def _clog(c: Column) -> Column:
    """c * log2(c), 0 at 0."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def hot_windows(value: Column, cls: EntropyClass) -> Column:
    """array<struct<start, end>>: merged windows of one candidate string whose entropy reaches the class's threshold."""
    w, bits = cls.window, float(cls.min_bits)
    zero = F.array_repeat(F.lit(0), len(cls.symbols) + 1)
    spans = F.array().cast("array<struct<start:int,end:int>>")

    def place(i: Column) -> Column:
        return F.instr(F.lit(cls.symbols), F.substring(value, i, F.lit(1)))

    def step(a: Column, i: Column) -> Column:
        coming, going = place(i), F.when(i > w, place(i - w)).otherwise(F.lit(-1))
        c_in = F.get(a["counts"], coming)
        c_out = F.when(going >= 0, F.get(a["counts"], going) + F.when(going == coming, 1).otherwise(0))
        total = a["sum"] + _clog(c_in + 1) - _clog(c_in) + F.when(going >= 0, _clog(c_out - 1) - _clog(c_out)).otherwise(F.lit(0.0))
        hot = (i >= w) & (F.log2(F.lit(float(w))) - total / w >= F.lit(bits - 1e-9))
        last = F.get(a["spans"], F.size(a["spans"]) - 1)
        begin = i - w
        fresh = F.array(F.struct(begin.alias("start"), i.alias("end")))
        joined = F.concat(
            F.slice(a["spans"], F.lit(1), F.greatest(F.size(a["spans"]) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), i.alias("end"))),
        )
        return F.struct(
            F.transform(a["counts"], lambda c, j: c + (j == coming).cast("int") - (j == going).cast("int")).alias("counts"),
            total.alias("sum"),
            F.when(~hot, a["spans"]).when((F.size(a["spans"]) > 0) & (last["end"] >= begin), joined).otherwise(F.concat(a["spans"], fresh)).alias("spans"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), spans.alias("spans")),
        step,
        lambda a: a["spans"],
    )


def _allowed(value: Column, allow: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in allow:
        out = out | value.rlike(pattern)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, text, base, spans): both span lists as array<struct<start, rank, end, kind>> in order of start, then kind.

    A null text counts as empty. Empty texts, texts without candidates and empty tables give empty lists; repeated rows
    are scanned one by one; other columns are not read, so their names cannot clash.
    """
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,n:int,value:string>>")
    # a look for any match keeps the location off texts without one
    src = src.select(
        "*",
        F.filter(F.when(text.rlike(ASSIGN), _located(text, ASSIGN, 2)).otherwise(none), lambda m: F.length(m["value"]) >= 12).alias("assign"),
        F.when(text.rlike(ACCESS), _located(text, ACCESS)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), _located(text, HEX)).otherwise(none).alias("hex"),
        *(
            F.filter(
                F.when(text.rlike(candidates(c)), _located(text, candidates(c))).otherwise(none),
                lambda m: ~_allowed(m["value"], allow),
            ).alias(c.name)
            for c in classes
        ),
    )
    src = src.select("id", "text", F.array_sort(F.concat(*(_spans(F.col(k), i, k) for i, k in enumerate(KINDS)))).alias("base"), *(c.name for c in classes))
    base = F.col("base")

    def entropy(i: int, c: EntropyClass) -> Column:
        def of(m: Column) -> Column:
            return F.transform(
                hot_windows(m["value"], c),
                lambda s: F.struct((m["start"] + s["start"]).alias("start"), F.lit(len(KINDS) + i).alias("rank"), (m["start"] + s["end"]).alias("end"), F.lit(c.name).alias("kind")),
            )

        return F.flatten(F.transform(F.col(c.name), of))

    any_class = F.exists(F.array(*(F.size(c.name) for c in classes)), lambda n: n > 0)
    src = src.select("id", "text", "base", F.when(any_class, F.concat(*(entropy(i, c) for i, c in enumerate(classes)))).alias("more"))
    more = F.filter(
        F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")),
        lambda s: F.aggregate(base, s["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)) < s["end"],
    )
    return src.select(F.col("id").alias(id_col), "text", "base", F.array_sort(F.concat(base, more)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start; overlaps count once) replaced by ``mask``."""
    kind = "struct<at:int,n:int>"

    def piece(at: Column, s: Column):
        before = F.array(F.struct((at + 1).alias("at"), (s["start"] - at).alias("n")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, before).otherwise(F.array().cast(f"array<{kind}>"))

    kept = F.transform(running(spans, 0, piece, kind), lambda p: F.concat(F.substring(text, p["at"], p["n"]), F.lit(mask)))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ORACLE_SQL = None
