"""Scalar functions against hand-computed values and plain twins."""

import math

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import jsonx, months, scoring, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize("raw, want", [("Dr. José  O'Neil-Ruiz Jr.", "jose oneil-ruiz"), ("", ""), ("Łukasz", "ukasz"), ("MS. ANN", "ann")])
def test_person_names(spark, raw, want):
    assert one(spark, text.normalize_name(L(raw))) == want


@pytest.mark.parametrize("raw, want", [("The Acme Holdings, Inc.", "acme"), ("AT&T Corp", "at&t"), ("Capital Partners", "capital partners"), ("", "")])
def test_org_names(spark, raw, want):
    assert one(spark, text.normalize_org(L(raw))) == want


def test_blocking_keys(spark):
    assert set(one(spark, text.blocking_keys(L("Ann Lee"), L("A@X.io "), L("Acme Inc")))) == {"n:ann lee", "l:lee", "fl:a:lee", "e:a@x.io", "d:x.io ", "o:acme"}
    assert one(spark, text.blocking_keys(L("Ann"), L(None).cast("string"), L(None).cast("string"))) == ["n:ann", "f:ann"]
    assert one(spark, text.blocking_keys(L("!!"), L("a@x.io"), L("Acme"))) == []


def test_jaro_winkler():
    assert text.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert text.jaro_winkler_of("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)
    assert text.jaro_winkler_of("", "a") == 0
    assert text.jaro_winkler_of("same", "same") == 1


@pytest.mark.parametrize("a, b, want", [("Ann Lee", "Dr. Ann Lee", 1.0), ("Ann", "Ann Lee", 0.55), ("M. Chen", "Michael Chen", 0.55 + 0.45 * 0.85), ("B. Chen", "Michael Chen", 0.55), ("", "Ann", 0.0)])
def test_name_similarity(spark, a, b, want):
    assert one(spark, text.name_similarity(L(a), L(b))) == pytest.approx(want)


def test_name_similarity_is_symmetric(spark):
    rows = spark.createDataFrame([("Ann Lee", "Anne Leigh"), ("Bo Diaz", "Ann Lee"), ("Ann", "Anna Lee")], "a string, b string")
    for r in rows.select(text.name_similarity(F.col("a"), F.col("b")).alias("x"), text.name_similarity(F.col("b"), F.col("a")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"])


def test_scores(spark):
    day = F.to_timestamp(L("2024-01-01 00:00:00"))
    assert one(spark, scoring.recency(L(None).cast("timestamp"), day)) == 0.5
    assert one(spark, scoring.recency(F.to_timestamp(L("2025-01-01 00:00:00")), day)) == 1.0
    half = F.timestamp_micros(F.unix_micros(day) - L(int(18 * 30.44 * 86400 * 1e6)))
    assert one(spark, scoring.recency(half, day)) == pytest.approx(0.5)
    s = one(spark, scoring.strength_terms(L(1.0), L(1.0), L(1.0), L(3), L(2), day, day))
    assert s["strength"] == pytest.approx(0.55 + 0.25 * (1 - math.exp(-1)) + 0.2 * (1 - math.exp(-1)))
    assert one(spark, scoring.traversal_probability(L("friend"), L(1.0), L(1.0), L(False))) == pytest.approx(0.9)
    assert one(spark, scoring.traversal_probability(L("nothing known"), L(0.0), L(0.0), L(True))) == pytest.approx(max(0.02, 0.3 * 0.15 * 0.6 * 0.6))
    assert [one(spark, scoring.strength_label(L(p))) for p in (0.8, 0.6, 0.4, 0.2, 0.1)] == ["very strong", "strong", "moderate", "weak", "faint"]
    assert one(spark, scoring.finite(L("x"), 0.7)) == 0.7
    assert one(spark, scoring.finite(L(float("nan")), 0.7)) == 0.7
    assert [one(spark, scoring.hop_limit(L(x).cast("double"))) for x in (0.2, 2.6, 9.0, None)] == [1, 3, 4, 4]


def test_vectors(spark):
    a = lambda *x: F.array(*[L(float(v)) for v in x])
    assert one(spark, vectors.cosine(a(1, 0), a(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.cosine(a(1, 0), a(1, 0, 0))) == 0
    assert one(spark, vectors.cosine(a(0, 0), a(1, 0))) == 0
    assert one(spark, vectors.cosine(L(None).cast("array<double>"), a(1))) == 0
    h = vectors.hash_embedding(spark.createDataFrame([(1, "Warm intro"), (2, ""), (3, None), (1, "Warm intro")], "id int, t string"), "id", "t").collect()
    assert {r["id"] for r in h} == {1}
    assert sum(r["value"] ** 2 for r in h) == pytest.approx(1, abs=1e-4)


def test_json_and_months(spark):
    m = jsonx.merge(jsonx.as_map(L('{"a": 1, "b": 2}')), jsonx.as_map(L('{"b": 3, "c": null}')))
    assert one(spark, m) == {"a": "1", "b": "3", "c": None}
    assert one(spark, jsonx.strip_empty(m)) == {"a": "1", "b": "3"}
    assert one(spark, jsonx.as_map(L("no json"))) == {}
    assert one(spark, jsonx.strings(L('["x", "y"]'))) == ["x", "y"]
    assert one(spark, jsonx.strings(L("3"))) == []
    assert one(spark, jsonx.has_key(L('{"a": null}'), "a")) is True
    assert one(spark, months.add_months(L("2023-11"), L(3))) == "2024-02"
    assert one(spark, months.month_label(L("2024-02"))) == "Feb 2024"
    assert one(spark, months.month_x(L("2024-02"), L("2023-12"), 80.0)) == 160
