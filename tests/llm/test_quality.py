import numpy as np

from kithgraph.llm.quality import FUNCTIONS, learn, not_prose, statistics

PROSE = "The board met after the summer and it was clear that the plan is good for all of us. We will do it with them."


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'x' AS u", "2 AS chars", "'y' AS word")


def _words(spark):
    return spark.createDataFrame([("en", w) for w in "the of and to in is that for it was on with as at by be this from or but not are we will them all us do after".split()], "lang string, word string")


def test_types(spark):
    table = "| a | b | c |\n|---|---|---|\n" + "| x1 | 22 | 333 |\n" * 12
    junk = [table, "- pump\n- valve\n- cold chain\n- pricing\n- budget memo\n- site visit", "Click here to view the note.\n" * 8, "1.2\t3.4\t5.6\n7.8\t9.1\t2.3\n4.4\t5.5\t6.6", '[{"id": 3, "tags": ["x"]}, {"id": 4, "tags": ["y"]}]', "qzkf wrtl bnmp xcvd fghj klpq wrtz mnbv cxzl kjhg fdsp qwrt" * 3]
    prose = [f"{PROSE} Number {i} was said by them." for i in range(40)] + ["Ann Lee: it was on the list for all of us\nBo Ray: and we will do it with them after the summer", PROSE.replace(" ", "\n", 3)]
    mixed = [PROSE * 4 + "\n" + "| a | b |\n" * 3]
    texts = prose + mixed + junk * 6 + [None, "", "   "]
    found = {r["doc_id"] for r in not_prose(_docs(spark, texts), _words(spark)).collect()}
    n = len(prose) + len(mixed)
    assert found == set(range(n, n + 6 * len(junk)))


def test_repeated_rows_long_and_empty(spark):
    docs = _docs(spark, [PROSE, "x" * 300_000, "- a\n- b\n- c"])
    three = docs.unionByName(docs).unionByName(docs)
    assert 0 not in {r["doc_id"] for r in not_prose(three, _words(spark)).collect()}
    assert not_prose(docs.limit(0), _words(spark)).count() == 0
    assert statistics(docs, _words(spark).limit(0)).count() == 3


def test_statistics(spark):
    s = {r["doc_id"]: r for r in statistics(_docs(spark, ["The plan is on.\nno end", "", None]), _words(spark)).collect()}
    assert (s[0]["n_words"], s[0]["punctuated_lines"], s[0]["common_share"]) == (6, 0.5, 0.5)
    assert s[1]["n_words"] == 0 and s[1]["mean_word_length"] is None and s[2]["n_words"] == 0


def test_expectation_maximization_finds_the_worthless_function():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.3
    votes = np.full((4000, len(FUNCTIONS)), 2)
    for k in range(1, len(FUNCTIONS)):
        good = 0.5 if k == 5 else 0.9
        votes[:, k] = np.where(r.random(4000) < good, truth, ~truth)
    codes, back, counts = np.unique((votes * 3 ** np.arange(len(FUNCTIONS))).sum(1), return_inverse=True, return_counts=True)
    post, model = learn(codes, counts.astype(float))
    assert ((post[back] > 0.5) == truth).mean() > 0.99 and abs(model["share"] - 0.3) < 0.03
    assert abs(model["junk"][5, 1] - model["prose"][5, 1]) < 0.05
