import itertools

import numpy as np

from kithgraph.llm.neighbours import DIM, hilbert, most_similar

SCHEMA = "id string, embedding array<float>"


def test_hilbert_is_a_walk():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1).max() == 1


def _clusters(n, sizes, seed=0):
    r = np.random.default_rng(seed)
    out = [r.standard_normal(DIM) for _ in range(n)]
    for s in sizes:
        c = r.standard_normal(DIM)
        c /= np.linalg.norm(c)
        out += [(c + r.standard_normal(DIM) * 0.033) * r.uniform(0.1, 9) for _ in range(s)]
    return np.array(out, dtype=np.float32)


def _truth(v, least, k):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(u)):
        for j in sorted(np.flatnonzero(s[i] >= least), key=lambda j: (-s[i, j], f"{j:06d}"))[:k]:
            out.add((f"{min(i, j):06d}", f"{max(i, j):06d}"))
    return out


def test_against_brute_force(spark):
    v = _clusters(4000, [2, 3, 5, 8, 13, 30] * 12)
    df = spark.createDataFrame([(f"{i:06d}", x.tolist()) for i, x in enumerate(v)], SCHEMA).selectExpr("*", "1 AS rid", "'x' AS code", "2 AS keys", "3 AS p")
    got = {(r["id_a"], r["id_b"]) for r in most_similar(df, 0.9).collect()}
    want = _truth(v, 0.9, 5)
    assert len(got & want) / len(want) >= 0.99 and len(got - want) <= 0.01 * len(want)


def test_unusable_copies_and_empty(spark):
    one = [float(x) for x in range(1, DIM + 1)]
    bad = [("n1", None), ("n2", [0.0] * DIM), ("n3", one[:-1]), ("n4", [float("nan"), *one[1:]]), ("n5", [float("inf"), *one[1:]]), ("n6", [None, *one[1:]]), ("n7", [])]
    copies = [(f"c{i:04d}", [x * (1 + i % 3) for x in one]) for i in range(1500)]
    got = most_similar(spark.createDataFrame(bad + copies + copies[:2], SCHEMA), 0.9).collect()
    assert all(r["id_a"].startswith("c") and r["id_b"].startswith("c") and r["id_a"] < r["id_b"] for r in got)
    assert {x for r in got for x in (r["id_a"], r["id_b"])} == {c for c, _ in copies} and len(got) <= 5 * 1500
    assert most_similar(spark.createDataFrame([], SCHEMA), 0.9).count() == 0
    assert most_similar(spark.createDataFrame(bad, SCHEMA), 0.9).count() == 0


def test_large_groups_of_copies_hide_nobody(spark):
    r = np.random.default_rng(4)
    c = r.standard_normal(DIM) / 8
    close = [c + r.standard_normal(DIM) * 1e-4 for _ in range(40)]  # more than any fixed number of partners, equal in 8 bits
    v = np.array([*close[:20], *[c] * 5000, *close[20:], *r.standard_normal((300, DIM))], dtype=np.float32)
    df = spark.createDataFrame([(f"{i:06d}", x.tolist()) for i, x in enumerate(v)], SCHEMA)
    got = {(x["id_a"], x["id_b"]) for x in most_similar(df, 0.9).collect()}
    first = [f"{i:06d}" for i in range(20, 26)]  # the smallest ids among the copies
    want = {(a, f"{i:06d}") for i in range(20, 5020) for a in [x for x in first if x != f"{i:06d}"][:5] if a < f"{i:06d}"}
    assert want <= got
    solo = [*range(20), *range(5020, 5040)]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for i in solo:
        s = u @ u[i]
        s[i] = -2
        for j in sorted(range(len(v)), key=lambda j: (-round(s[j], 14), j))[:5]:
            assert (f"{min(i, j):06d}", f"{max(i, j):06d}") in got, (i, j)
