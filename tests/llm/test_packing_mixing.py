import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.llm.mixing import learn, mix, posteriors, shares
from kithgraph.llm.packing import fill, pack, plan, report
from kithgraph.llm.tokens import RANKS, count_tokens

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")


def test_fill_is_the_best_subset():
    r = np.random.default_rng(0)
    for _ in range(200):
        lengths = sorted(set(r.integers(1, 30, 5).tolist()), reverse=True)
        counts = r.integers(1, 4, len(lengths)).tolist()
        room = int(r.integers(0, 60))
        got = fill(room, lengths, counts)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[lengths.index(k)] for k, v in got.items())


def test_plan_uses_every_item_once():
    r = np.random.default_rng(1)
    h = {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, 100, 5000), return_counts=True))}
    p = plan(h, 128)
    used = {}
    for pattern, times in p:
        assert sum(k * c for k, c in pattern.items()) <= 128 and times > 0
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + c * times
    assert used == h
    total = sum(k * n for k, n in h.items())
    assert sum(t for _, t in p) <= 1.01 * total / 128 + 1 and len(p) <= 2 * len(h)


def _docs(spark):
    texts = [("pump " * n).strip() for n in (1, 3, 40, 40, 40, 90, 230)] + ["", None, "x"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'a' AS run_name", "1 AS tokens", "2 AS cap", "3 AS container")


def test_pack(spark):
    limits = spark.createDataFrame([("r", 64), ("big", 512)], "run_name string, capacity_tokens int").selectExpr("*", "1 AS tokens")
    docs = _docs(spark)
    size = {r["doc_id"]: r["n"] for r in docs.select("doc_id", count_tokens(F.col("text")).alias("n")).collect()}
    rows = pack(docs, limits).collect()
    held, got = {}, {}
    for x in rows:
        held[x["run_name"], x["container"]] = held.get((x["run_name"], x["container"]), 0) + x["tokens"]
        got.setdefault((x["run_name"], x["doc_id"]), []).append(x["tokens"])
    assert all(v <= {"r": 64, "big": 512}[run] for (run, _), v in held.items())
    for run, cap in (("r", 64), ("big", 512)):
        for d, n in size.items():
            parts = got.get((run, d))
            assert (parts is None) if n is None else sum(parts) == n and len(parts) == (1 if n <= cap else -(-n // cap))
    assert {r["run_name"] for r in report(pack(docs, limits), limits).collect()} == {"r", "big"}
    assert pack(docs.limit(0), limits).count() == 0 and pack(docs, limits.limit(0)).count() == 0
    twice = pack(docs.unionByName(docs), limits)
    assert twice.where("run_name = 'r'").count() == 2 * len([x for x in rows if x["run_name"] == "r"])
    with pytest.raises(ValueError):
        pack(docs, spark.createDataFrame([("r", 0)], "run_name string, capacity_tokens int")).count()


def test_mix(spark):
    rows = [(i, ("pump valve budget " if i % 3 else "hello dear friend ") * (1 + i % 7), "a" if i % 3 else "b") for i in range(900)] + [(1000 + i, "hello dear friend hello", None) for i in range(30)] + [(2000, None, "a"), (2001, "", "b"), (2002, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS tokens", "2 AS copies", "'m' AS member", "3 AS cell")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets).cache()
    assert {r["source"]: r["actual_share"] for r in shares(m, targets).collect()} == {"a": pytest.approx(0.4, abs=0.005), "b": pytest.approx(0.6, abs=0.005)}
    assert m.agg(F.max(F.when(F.col("source") == "a", F.col("copies")))).first()[0] <= 1 and m.agg(F.max("copies")).first()[0] <= 3
    assert {r["likeliest"] for r in m.where("source IS NULL").collect()} <= {"b"}
    assert m.where("doc_id >= 2000").count() == 0
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0
    assert mix(docs.where("source = 'a'"), targets).count() == 0  # b can't be reached at all


def test_classifier_on_held_out_rows(spark):
    r = np.random.default_rng(0)
    words = {"a": "pump valve motor the of".split(), "b": "pear apple plum the of".split()}
    data = [(s, " ".join(r.choice(words[s], 12))) for s in "ab" for _ in range(200)]
    w = learn(spark.createDataFrame(data[::2], "source string, text string"), ["a", "b"])
    p = posteriors([t for _, t in data[1::2]], w)
    assert (np.array(["a", "b"])[p.argmax(1)] == [s for s, _ in data[1::2]]).mean() > 0.97
