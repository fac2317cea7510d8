from datetime import datetime

from kithgraph.llm.survivors import roots, survivors

SCHEMA = "id string, canonical_name string, attributes string, last_seen timestamp, updated_at timestamp, merged_into string"
DAY = [None, *[datetime(2024, 1, d) for d in range(1, 9)]]


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS root_id", "'y' AS value", "1 AS rank")
    return {(r["root_id"], r["field_name"]): r["field_value"] for r in survivors(df).collect()}


def test_fields(spark):
    rows = [
        ("r", "J. Ng", '{"title": "CEO", "org": "n/a", "email": " a@x.test "}', DAY[1], DAY[1], None),
        ("a", " Jo Ng ", '{"title": "CTO", "org": "Acme", "seniority": "?"}', DAY[3], DAY[1], "r"),
        ("b", "Joan Ng, PhD", '{"title": "TBD", "manual_profile": {"title": "Chair"}}', None, DAY[1], "a"),
        ("c", "-", None, DAY[5], DAY[1], "b"),
        ("d", None, "no json", DAY[6], None, "b"),
        ("alone", "Bo", '{"title": "x"}', DAY[2], DAY[1], None),
    ]
    assert got(spark, rows) == {("r", "canonical_name"): "Joan Ng, PhD", ("r", "title"): "Chair", ("r", "org"): "Acme", ("r", "email"): "a@x.test"}


def test_ties_nulls_cycles_repeats(spark):
    rows = [("r", "Ann", '{"title": "A"}', DAY[1], DAY[1], None), ("a", "Bea", '{"title": "B"}', DAY[1], DAY[2], "r"), ("a", "Bea", '{"title": "B"}', DAY[1], DAY[2], "r"), ("x", "X", None, None, None, "y"), ("y", "Y", None, None, None, "x"), ("z", "Z", None, None, None, "gone"), (None, None, None, None, None, None)]
    assert got(spark, rows) == {("r", "canonical_name"): "Bea", ("r", "title"): "B"}
    assert got(spark, []) == {}


def test_long_chain_and_hot_root(spark):
    chain = [("n0", "N0", None, DAY[1], DAY[1], None)] + [(f"n{i}", f"N{i}", None, DAY[1], DAY[1], f"n{i - 1}") for i in range(1, 40)]
    hot = [("h", "H", None, DAY[1], DAY[1], None)] + [(f"h{i}", f"Name {i}", None, DAY[1], DAY[1], "h") for i in range(500)]
    r = {(x["id"], x["root_id"]) for x in roots(spark.createDataFrame(chain + hot, SCHEMA)).collect()}
    assert len(r) == 539 and ("n39", "n0") in r and ("h499", "h") in r
