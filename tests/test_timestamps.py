"""The shape-mask reader against hand-computed instants and a row-at-a-time reader."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kithgraph.functions.zones import ZoneTables
from kithgraph.operators.timestamps import notes_in_utc, parser_of, read_texts

TABLES = ZoneTables()


def read(text, zone="America/New_York", order="mdy"):
    v, ok = read_texts(np.array([text], dtype=object), np.array([zone], dtype=object), np.array([order], dtype=object), TABLES)
    return int(v[0]) if ok[0] else None


def us(*a, **k):
    return int((datetime(*a, tzinfo=timezone.utc) + timedelta(**k) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


@pytest.mark.parametrize(
    "text, want",
    [
        ("2022-01-07T16:24:53.200854701Z", us(2022, 1, 7, 16, 24, 53, 200854)),
        ("Fri, 01 Dec 2023 18:42:32 GMT", us(2023, 12, 1, 18, 42, 32)),
        ("Sun, 04 May 2025 09:17:06 +1000", us(2025, 5, 3, 23, 17, 6)),
        (" 2022-02-13t18:04z ", us(2022, 2, 13, 18, 4)),
        ("2022-03-10 09:07:11−05:00", us(2022, 3, 10, 14, 7, 11)),
        ("2022-09-25 18:40:29-04", us(2022, 9, 25, 22, 40, 29)),
        ("2022-01-29T15:55:27[America/Denver]", us(2022, 1, 29, 22, 55, 27)),
        ("2022-01-01 15:43 Europe/Madrid", us(2022, 1, 1, 14, 43)),
        ("Sat Mar 22 2025 15:20:34 GMT+0100 (Central European Standard Time)", us(2025, 3, 22, 14, 20, 34)),
        ("11 de abril de 2025, 07:16", us(2025, 4, 11, 11, 16)),
        ("11. August 2025, 13:31 Uhr", us(2025, 8, 11, 17, 31)),
        ("22 décembre 2024 à 18h21", us(2024, 12, 22, 23, 21)),
        ("May 3rd, 2024 at 7:59am", us(2024, 5, 3, 11, 59)),
        ("Sep 13, 2024 11:07 AM CEST", us(2024, 9, 13, 9, 7)),
        ("1642184277", us(2022, 1, 14, 18, 17, 57)),
        ("1642184277973", us(2022, 1, 14, 18, 17, 57, 973000)),
        ("1642184277.973", us(2022, 1, 14, 18, 17, 57, 973000)),
        ("1641212013913131", us(2022, 1, 3, 12, 13, 33, 913131)),
        ("20220218T092058Z", us(2022, 2, 18, 9, 20, 58)),
        ("01.03.2023 13:32", us(2023, 3, 1, 18, 32)),
        ("7/14/24, 9:31AM", us(2024, 7, 14, 13, 31)),
        ("2022-07-04", us(2022, 7, 4, 4)),
        ("2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)),  # skipped: moves on by the skip
        ("2024-11-03 01:30:00", us(2024, 11, 3, 5, 30)),  # twice: the first
        ("12:00", None), ("2025-04-31T09:15:00Z", None), ("0000-00-00T00:00:00Z", None), ("31/31/2024 10:00", None), ("25:61", None),
        ("Q3", None), ("last Tuesday", None), ("", None), ("   ", None), (None, None), ("2024-01-01" * 500, None), ("13:00 PM 2024-01-01", None),
    ],
)
def test_forms(text, want):
    assert read(text) == want


def test_long_texts_are_read():
    assert read("2024-03-05" + " " * 120 + "10:00:00 UTC") == us(2024, 3, 5, hours=10)
    assert read(" ".join(["2024-03-05"] * 400)) is None


def test_slash_order_follows_the_workspace():
    assert read("03/04/2024 10:00", "UTC", "mdy") == us(2024, 3, 4, 10)
    assert read("03/04/2024 10:00", "UTC", "dmy") == us(2024, 4, 3, 10)
    assert read("31/05/2025 6:23 PM", "UTC", "mdy") is None
    assert read("2024/04/03 10:00:00", "UTC", "dmy") == us(2024, 4, 3, 10)


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney", "America/Sao_Paulo", "UTC"]))
def test_wall_clock_equals_the_library(at, zone):
    at = at.replace(microsecond=0)
    want = int(at.replace(tzinfo=ZoneInfo(zone)).timestamp()) * 10**6
    assert read(at.strftime("%Y-%m-%d %H:%M:%S"), zone) == want


def test_a_mask_is_parsed_once():
    parser_of.cache_clear()
    texts = np.array([f"2024-01-{d:02d} 10:{d:02d}" for d in range(1, 29)] * 50, dtype=object)
    zones = np.array(["UTC"] * len(texts), dtype=object)
    read_texts(texts, zones, zones, TABLES)
    assert parser_of.cache_info().misses == 1


def test_another_release_is_refused():
    with pytest.raises(RuntimeError):
        ZoneTables("1999a").get("UTC")


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    w = spark.createDataFrame([("w", '{"timezone": "Asia/Tokyo", "date_order": "dmy"}', 1), ("w", '{"timezone": "Asia/Tokyo", "date_order": "dmy"}', 2)], "id string, settings string, row_id int")
    rows = [(1, "w", None, "2024-01-01 09:00", None), (1, "w", None, "2024-01-01 09:00", None), (2, "x", "2024-01-01 09:00", None, None), (3, None, "junk", "", "2024-01-02"), (4, "w", None, None, None)]
    n = spark.createDataFrame(rows, "row_id long, workspace_id string, created_at string, createdat string, note_date string").selectExpr("*", "'x' AS id", "'y' AS settings", "'z' AS _tz")
    got = sorted((r["row_id"], r["utc_us"]) for r in notes_in_utc(n, w).collect())
    assert got == [(1, us(2024, 1, 1)), (1, us(2024, 1, 1)), (2, us(2024, 1, 1, 9)), (3, us(2024, 1, 2))]
    assert notes_in_utc(n.limit(0), w).count() == 0
    assert notes_in_utc(n, w.limit(0)).count() == 4
