"""Edge strength, traversal probability and other numeric scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph import dims


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def finite(c: Column, default: float) -> Column:
    """A number, or the default for null, text that is none, NaN and infinities."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(default))).otherwise(v)


def recency(last_seen: Column, as_of: Column) -> Column:
    months = (F.unix_micros(as_of) - F.unix_micros(last_seen)) / 1e6 / 86400 / dims.DAYS_PER_MONTH
    return F.when(last_seen.isNull(), 0.5).when(months <= 0, 1.0).otherwise(F.pow(F.lit(0.5), months / dims.HALF_LIFE_MONTHS))


def strength_terms(explicitness: Column, signal: Column, confidence: Column, evidence: Column, sources: Column, last_seen: Column, as_of: Column) -> Column:
    """struct(strength, base, volume, diversity, recency)."""
    # Saturation of evidence (3) and sources (2), and the weights of the terms
    base = explicitness * signal * (0.5 + 0.5 * confidence)
    volume, diversity, fresh = 1 - F.exp(-evidence / 3.0), 1 - F.exp(-sources / 2.0), recency(last_seen, as_of)
    strength = clamp01(base * (0.55 + 0.25 * volume + 0.2 * diversity) * (0.35 + 0.65 * fresh))
    return F.struct(strength.alias("strength"), base.alias("base"), volume.alias("volume"), diversity.alias("diversity"), fresh.alias("recency"))


def traversal_probability(relationship: Column, strength: Column, warmth: Column, ended: Column) -> Column:
    # What strength, warmth and an ended tie leave of the prior, and the bounds
    p = dims.prior(relationship) * (0.15 + 0.85 * clamp01(strength)) * (0.6 + 0.4 * clamp01(warmth)) * F.when(ended, 0.6).otherwise(1.0)
    return F.least(F.lit(0.97), F.greatest(F.lit(0.02), p))


def edge_cost(probability: Column) -> Column:
    return -F.log(probability)


def strength_label(p: Column) -> Column:
    out = F.when(p >= dims.STRENGTH_LABELS[0][0], dims.STRENGTH_LABELS[0][1])
    for least, name in dims.STRENGTH_LABELS[1:]:
        out = out.when(p >= least, name)
    return out.otherwise("faint")


def relevance(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.02), c))


def hop_limit(c: Column) -> Column:
    """1 to 4, rounded; 4 when missing."""
    return F.when(c.isNull(), 4).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.round(c).cast("int"))))


def neighbour_overlap(a: Column, b: Column) -> Column:
    """1 - e^(-shared / 1.5), counting occurrences in the first list; 0 without any."""
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when(a.isNull() | b.isNull() | (shared <= 0), 0.0).otherwise(1 - F.exp(-shared / 1.5))
