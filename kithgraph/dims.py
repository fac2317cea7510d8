"""Fixed values of the data model: relationship types, weights, thresholds, word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relationship type, label, prior probability of a useful introduction, symmetric.
RELATIONSHIPS = [
    ("colleague", "Colleague", 0.80, True),
    ("former_colleague", "Former colleague", 0.70, True),
    ("reports_to", "Reports to", 0.85, False),
    ("founded", "Founded", 0.90, False),
    ("works_at", "Works at", 0.75, False),
    ("investor_in", "Investor in", 0.80, False),
    ("advisor_to", "Advisor to", 0.75, False),
    ("board_member", "Board member", 0.85, False),
    ("client_of", "Client of", 0.60, False),
    ("friend", "Friend", 0.90, True),
    ("family", "Family", 0.95, True),
    ("introduced_by", "Introduced by", 0.85, False),
    ("can_intro_to", "Can introduce to", 0.90, False),
    ("met_with", "Met with", 0.45, True),
    ("mentioned", "Mentioned", 0.12, False),
    ("affiliated_with", "Affiliated with", 0.50, False),
]
UNKNOWN_PRIOR = 0.3
EXPLICITNESS = {"stated": 1.0, "reported": 0.75, "inferred": 0.5}
WARMTH_SIGNAL = {"warm": 0.85, "neutral": 0.5, "cool": 0.2, "unknown": 0.5}
STRENGTH_SIGNAL = {"strong": 1.0, "moderate": 0.75, "weak": 0.5, "unknown": 0.7}
FUND_ORG_TYPES = ("vc_fund", "pe_fund", "family_office", "lp")
HALF_LIFE_MONTHS, DAYS_PER_MONTH = 18.0, 30.44
MERGE_AT, REJECT_AT, CANDIDATE_CAP = 0.82, 0.45, 40
HONORIFICS = "mr mrs ms miss dr prof sir rev".split()
SUFFIXES = "jr sr ii iii iv phd md esq".split()
ORG_NOISE = "inc inc. llc l.l.c. ltd limited corp corporation co company plc gmbh sa nv ag holdings group partners capital ventures the".split()
QUERY_STOP_WORDS = (
    "want need find know some someone with that from into have help make give there their about would could should please "
    "anyone people person looking access intro introduction"
).split()
STRENGTH_LABELS = [(0.75, "very strong"), (0.55, "strong"), (0.35, "moderate"), (0.18, "weak")]

SYMMETRIC = [t for t, _, _, s in RELATIONSHIPS if s]
TYPES = [t for t, *_ in RELATIONSHIPS]


def lookup(key: Column, values: dict, default) -> Column:
    """A map literal lookup with a default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def prior(relationship: Column) -> Column:
    return lookup(relationship, {t: p for t, _, p, _ in RELATIONSHIPS}, UNKNOWN_PRIOR)


def label(relationship: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for t, n, _, _ in RELATIONSHIPS for x in (t, n)]), relationship), relationship)
