"""Names, tokens and text scalars as column expressions; two Arrow functions where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph import dims


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and combining marks, and that letter."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(0x300 <= ord(m) <= 0x36F for m in marks):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), "[̀-ͯ]", "")


def _tokens(c: Column, stop: list[str]) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: (t != "") & ~t.isin(*stop))


def name_tokens(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "['’]", ""), r"[^a-z0-9\s-]", " ")
    return _tokens(clean, dims.HONORIFICS + dims.SUFFIXES)


def normalize_name(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def normalize_org(c: Column) -> Column:
    plain = F.lower(strip_accents(c))
    kept = _tokens(F.regexp_replace(plain, r"[^a-z0-9\s&-]", " "), dims.ORG_NOISE)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.trim(plain))


def name_parts(c: Column) -> Column:
    """struct(first, last, middle); one token has no last name."""
    t = name_tokens(c)
    n = F.size(t)
    return F.struct(
        F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"),
        F.when(n > 1, F.element_at(t, -1)).otherwise("").alias("last"),
        F.when(n > 2, F.slice(t, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")).alias("middle"),
    )


def blocking_keys(name: Column, email: Column, org: Column) -> Column:
    """Keys of a name: n: l: fl: or f:, e: d: o:. None if the name normalises to nothing."""
    norm, p = normalize_name(name), name_parts(name)
    first, last = p["first"], p["last"]
    keys = F.array(
        F.concat(F.lit("n:"), norm),
        F.when(last != "", F.concat(F.lit("l:"), last)),
        F.when((last != "") & (first != ""), F.concat(F.lit("fl:"), F.left(first, F.lit(1)), F.lit(":"), last)),
        F.when((last == "") & (first != ""), F.concat(F.lit("f:"), first)),
        F.when(email != "", F.concat(F.lit("e:"), F.lower(F.trim(email)))),
        F.when(email.contains("@"), F.concat(F.lit("d:"), F.lower(F.split_part(email, F.lit("@"), F.lit(2))))),
        F.when(org != "", F.concat(F.lit("o:"), normalize_org(org))),
    )
    return F.when(norm != "", F.array_distinct(F.array_compact(keys))).otherwise(F.array().cast("array<string>"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(strip_accents(c)), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…")))


def list_line(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", "))).otherwise("")


def join_present(sep: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def keywords(c: Column, most: int = 8) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*dims.QUERY_STOP_WORDS)), 1, most)


# Words that ask for a route, and for an explanation.
ROUTE_WORDS = r"\b(access|reach|intro|introduc|connect|get to|warm|path)\b"
EXPLAIN_WORDS = r"\bhow do i know\b|\bconnection to\b|\brelationship with\b"


def wants_path(c: Column) -> Column:
    return F.lower(c).rlike(ROUTE_WORDS)


def wants_explanation(c: Column) -> Column:
    return F.lower(c).rlike(EXPLAIN_WORDS)


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro with a prefix bonus (4 letters, 0.1 each) that applies at any similarity; half transpositions count."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(matched, (b[j] for j in range(len(b)) if taken[j]))) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def name_features(c: Column) -> Column:
    """struct(norm, first, last): what a comparison of person names needs, to be computed once per name."""
    p = name_parts(c)
    return F.struct(normalize_name(c).alias("norm"), p["first"].alias("first"), p["last"].alias("last"))


def feature_similarity(a: Column, b: Column) -> Column:
    """Similarity of two `name_features` with the surname rules; only the Jaro-Winkler parts leave the JVM."""
    whole, last = jaro_winkler(a["norm"], b["norm"]), jaro_winkler(a["last"], b["last"])
    initial = (F.length(a["first"]) == 1) | (F.length(b["first"]) == 1)
    first = (
        F.when(a["first"] == b["first"], 1.0)
        .when(initial, F.when(F.left(a["first"], F.lit(1)) == F.left(b["first"], F.lit(1)), 0.85).otherwise(0.0))
        .otherwise(jaro_winkler(a["first"], b["first"]))
    )
    return (
        F.when((a["norm"] == "") | (b["norm"] == ""), 0.0)
        .when(a["norm"] == b["norm"], 1.0)
        .when((a["last"] == "") | (b["last"] == ""), F.when((a["first"] != "") & (a["first"] == b["first"]), 0.55).otherwise(whole * 0.5))
        .when(last < 0.85, F.least(whole, F.lit(0.6)))
        .otherwise(last * 0.55 + first * 0.45)
    )


def name_similarity(a: Column, b: Column) -> Column:
    return feature_similarity(name_features(a), name_features(b))
