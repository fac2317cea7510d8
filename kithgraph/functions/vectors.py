"""Cosine and the feature-hash embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, unequal lengths and zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def hash_tokens(text: Column) -> Column:
    """array<struct(token, weight)>: words of two letters or more, and their character trigrams at 0.4."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))
    words = F.filter(F.split(clean, " "), lambda w: F.length(w) >= 2)
    one = lambda kind, token, weight: F.struct(F.concat(F.lit(kind), token).alias("token"), F.lit(weight).alias("weight"))
    grams = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: one("t:", F.substring(w, i, F.lit(3)), 0.4))))
    return F.concat(F.transform(words, lambda w: one("w:", w, 1.0)), grams)


def hash_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, value): the non-zero places of the L2-normalised hashed vector of each text.

    Place and sign come from the md5 digest: little-endian first bytes modulo 512, lowest bit of the fifth byte.
    Long format on purpose: one partial aggregation, and a dense array is never built for empty places.
    """
    h = F.md5("token")
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    tokens = df.select(key, F.inline(hash_tokens(F.col(text))))
    hashed = tokens.select(key, (byte(0) + 256 * F.pmod(byte(1), F.lit(2))).alias("idx"), F.when(F.pmod(byte(4), F.lit(2)) == 1, F.col("weight")).otherwise(-F.col("weight")).alias("w"))
    summed = hashed.groupBy(key, "idx").agg(F.round(F.sum("w"), 6).alias("w")).where("w <> 0")
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(norms, key).select(key, "idx", F.round(F.col("w") / F.col("norm"), 6).alias("value"))
