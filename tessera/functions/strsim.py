"""String similarities (0 to 100; Jaro-Winkler 0 to 1) and one Arrow UDF that returns all of them for a pair."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

NAMES = ["nm_ratio", "nm_tsort", "nm_tset", "nm_partial", "co_jw"]


@functools.lru_cache(1 << 14)
def _places(a: str) -> dict[str, int]:
    """By character the bits of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


@functools.lru_cache(1 << 14)
def _words(a: str) -> frozenset[str]:
    return frozenset(a.split())


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if a == b:
        return len(a)
    if not a or not b:
        return 0
    get = _places(a).get
    full = v = (1 << len(a)) - 1
    for m in map(get, b):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


@functools.lru_cache(1 << 14)
def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    # the common words come first, so they are common to what is compared
    if not both:
        return ratio(p, q)
    n, np, nq = len(both), len(both) + 1 + len(p), len(both) + 1 + len(q)
    return max(200.0 * (n + 1 + lcs(p, q)) / (np + nq), 200.0 * n / (n + np), 200.0 * n / (n + nq))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with windows of its length in the longer one, cut at either end too.

    All windows are aligned at once: a number holds one field of bits for each, with a free bit for the carry.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, m, count = len(a), len(b), len(a) + len(b) - 1
    field = n + 1
    get = _places(a).get
    marks = int("".join([format(get(c, 0), f"0{field}b") for c in reversed(b)]), 2) << (n - 1) * field
    full = v = _fields(n, count)
    for _ in range(n):
        u = v & marks
        if u:
            v = ((v + u) | (v - u)) & full
        marks >>= field
    bits = format(v, f"0{count * field}b")  # the last window first
    left = [bits.count("1", i, i + field) for i in range(0, count * field, field)]
    whole = left[n - 1 : m]
    best = 200.0 * (n - min(whole)) / (n + n)
    for k in range(1, n):  # windows of k characters at the end and at the start
        best = max(best, 200.0 * (n - min(left[k - 1], left[count - k])) / (n + k))
    return best


@functools.lru_cache(1 << 10)
def _fields(n: int, count: int) -> int:
    """``count`` fields of n ones and a zero above them."""
    return int(("0" + "1" * n) * count, 2)


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    get, near, free, left = _places(b).get, (1 << 2 * reach + 1) - 1, (1 << len(b)) - 1, []
    for i, c in enumerate(a):
        at = get(c, 0) & free
        if at:
            at &= near << i - reach if i >= reach else near >> reach - i
            if at:
                free ^= at & -at  # the first one
                left.append(c)
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if not free >> j & 1]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in NAMES]))
def name_similarities(nw_s: pd.Series, nw_r: pd.Series, core_s: pd.Series, core_r: pd.Series) -> pd.DataFrame:
    """All name scores of a batch of pairs in one trip; equal pairs are scored once."""
    known: dict[tuple, tuple] = {}
    out = []
    for k in zip(nw_s, nw_r, core_s, core_r):
        if k not in known:
            a, b, c, d = (x or "" for x in k)
            known[k] = ratio(a, b), token_sort(a, b), token_set(a, b), partial(a, b), jaro_winkler(c, d)
        out.append(known[k])
    return pd.DataFrame(out, columns=NAMES)


@F.pandas_udf(DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
