"""Joins and keys that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01
SALTS = 16


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys holding at least `share` of all rows: at most 1 / share values, whatever the size of the data."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return [r["_k"] for r in counts.crossJoin(F.broadcast(total)).where(F.col("_n") >= F.greatest(F.lit(2), F.col("_all") * share)).select("_k").collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = SALTS, share: float = HOT_SHARE) -> DataFrame:
    """Equi-join whose left side may be skewed on `key`: rows of hot keys are spread over `salts` copies of their
    right rows; all other keys join as usual. `how` is inner, left, left_semi or left_anti; null keys match nothing."""
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    others = [c for c in left.columns if c != key]
    salt = F.when(is_hot, F.pmod(F.xxhash64(*(others or [key]), F.monotonically_increasing_id()), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")
