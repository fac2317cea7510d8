import random
import re

from kithgraph.llm import transcripts
from kithgraph.llm.arrivals import RADIUS, History, append_batch, first_arrivals, groups_of, levels, pivot_table, pivots_of, repeats, spoken_words
from kithgraph.session import written

SCHEMA = "source_seq long, workspace_id string, external_id string, content_hash string, body string, attendee_hints string"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe ri so tu".split() for b in "lan mor ten wick ford dell rix sun".split()]


def _talk(r, n=150):
    return [r.choice(WORDS) for _ in range(n)]


def _body(words, label="Ada Quill: ", per=12, tail=""):
    lines = [label + " ".join(words[i : i + per]) + "." for i in range(0, len(words), per)]
    return "[ATTENDEES]\n- Ada Quill\n\n[TRANSCRIPT]\n" + "\n".join(lines) + tail


def _changed(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = r.choice(WORDS)
    return out


def _rows(seed=0):
    r = random.Random(seed)
    a, b, c = _talk(r), _talk(r), _talk(r)
    rows = [
        (1, "w", "id-1", None, _body(a), None), (2, "w", "n/a", None, _body(b), None), (3, "w", "n/a", None, _body(c), None),
        (4, "w", None, None, "[SUMMARY]\nnew\n\n" + _body(a, "[00:00:01] ADA QUILL: ", 9).upper().replace("[TRANSCRIPT]", "[TRANSCRIPT]"), None),  # same talk in other form
        (5, "w", None, None, _body(_changed(r, b, 5)), None),  # a few words in a hundred
        (6, "w", None, None, _body(c[:60] + _talk(r, 90)), None),  # takes over the opening: no repeat
        (7, "v", None, None, _body(a), None),  # another workspace
        (8, "w", "id-1", None, _body(_talk(r)), None),  # same real id
        (9, "w", "id-9", "AB" * 32, None, None), (10, "w", None, "ab" * 32, "", None),  # no transcript, same hash
        (11, "w", "", None, _body(_changed(r, a, 4)), None), (12, None, "id-1", None, _body(a), None), (13, "w", None, None, None, None),
    ]
    return rows, {(1, 4), (2, 5), (1, 8), (9, 10), (1, 11)}


def test_repeats(spark):
    rows, want = _rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seq", "'x' AS ws", "2 AS n", "3 AS k")
    got = {(r["accepted_seq"], r["duplicate_seq"]) for r in repeats(df).collect()}
    assert got == want
    assert repeats(df.limit(0)).count() == 0
    assert {(r["accepted_seq"], r["duplicate_seq"]) for r in repeats(df.unionByName(df)).collect()} == want


def test_against_brute_force(spark):
    r = random.Random(5)
    talks = []
    for _ in range(60):
        t = _talk(r, r.randint(40, 260))
        talks.append(t)
        for _ in range(r.randint(0, 3)):
            talks.append(_changed(r, t, r.randint(0, len(t) // 8)))
    r.shuffle(talks)
    got = {(x["accepted_seq"], x["duplicate_seq"]) for x in repeats(spark.createDataFrame([(i, "w", None, None, _body(t), None) for i, t in enumerate(talks)], SCHEMA)).collect()}
    parent = {}
    for j in range(len(talks)):
        for i in range(j):
            a, b = talks[i], talks[j]
            apart = sum(abs(a.count(w) - b.count(w)) for w in set(a) | set(b))
            if apart <= RADIUS * max(len(a), len(b)):
                parent[j] = parent.get(i, i)
                break
    assert got == {(i, j) for j, i in parent.items()}


def _pairs(df):
    return {(x["accepted_seq"], x["duplicate_seq"]) for x in df.collect()}


def test_batches_one_by_one_find_what_all_at_once_find(spark):
    """Plain repeats; a chain a - b - c whose ends are beyond the radius; a family that drifts, so that rows tied to
    different members meet; and long texts, each in a workspace of its own, as one batch and as three."""
    rows, want = _rows(3)
    rows, want = [(i * 10, *rest) for i, *rest in rows], {(i * 10, j * 10) for i, j in want}
    a = [f"word{i}" for i in range(300)]
    b = [f"new{i}" if i < 10 else w for i, w in enumerate(a)]  # 0.07 apart
    c = [f"new{i}" if 9 < i < 20 else w for i, w in enumerate(b)]  # 0.07 from b, 0.13 from a
    rows += [(n, "c", None, None, _body(t), None) for n, t in ((11, a), (51, b), (101, c))]
    r = random.Random(4)
    talks = [_talk(r, 200)]
    for _ in range(24):
        talks.append(_changed(r, r.choice(talks[-4:]), 6))
    rows += [(2 + 5 * i, "d", None, None, _body(t), None) for i, t in enumerate(talks)]
    root = {}
    for j, y in enumerate(talks):
        near = [root[i] for i in range(j) if sum(abs(talks[i].count(w) - y.count(w)) for w in set(talks[i]) | set(y)) <= RADIUS * len(y)]
        root[j] = min(near, default=j)
    long = [f"w{r.randint(0, 9000)}" for _ in range(50_000)]
    near = list(long)
    for i in r.sample(range(50_000), 2_300):
        near[i] = f"v{i}"
    rows += [(13, "l", None, None, _body(long, per=400), None), (103, "l", None, None, _body(near, per=400), None)]
    want |= {(11, 51), (11, 101), (13, 103)} | {(2 + 5 * i, 2 + 5 * j) for j, i in root.items() if i < j}
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = lambda d: {(x["accepted_seq"], x["duplicate_seq"]) for x in d.collect()}
    assert pairs(first_arrivals(written(pivot_table(df), "all"))) == want
    assert pairs(repeats(df.selectExpr("*", "CAST(source_seq / 50 AS INT) AS batch_id"), one_by_one=True)) == want
    history = History(4)
    assert pairs(append_batch(history, df.where("source_seq < 60 AND workspace_id = 'c'"))) | pairs(append_batch(history, df.where("source_seq > 60 AND workspace_id = 'c'"))) == {(11, 51), (11, 101)}


def test_there_are_more_groups_than_the_radius_at_every_length():
    for n in (40, 741, 10_240, 20_000, 50_000, 400_000):
        for level in levels(n):
            assert groups_of(level) <= pivots_of(level) and RADIUS * 1.25**level < groups_of(level)


def test_words():
    assert spoken_words(None, None) == [] and spoken_words("no region", None) == []
    assert spoken_words("[TRANSCRIPT]\nUm, Hello there [laughter] WORLD", None) == ["hello", "there", "world"]


def test_a_large_family_of_near_copies(spark):
    r = random.Random(9)
    base, other = _talk(r, 120), _talk(r, 120)
    rows = [(0, "w", None, None, _body(base), None), (1, "w", None, None, _body(other), None)]
    rows += [(10 + i, "w", None, None, _body(_changed(r, base, 3)), None) for i in range(1200)]
    rows += [(5000, "w", None, None, _body(_changed(r, other, 2)), None)]
    got = {(x["accepted_seq"], x["duplicate_seq"]) for x in repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 10 + i) for i in range(1200)} | {(1, 5000)}


def test_every_row_is_spread_once_to_find_shared_keys(spark, monkeypatch):
    """Old and new rows that meet, rows of one root that don't; every row enters the aggregation and the join once."""
    from kithgraph.llm import arrivals

    stored = []
    monkeypatch.setattr(arrivals, "written", lambda df, label, *p: stored.append(df) or written(df, label, *p))
    rows = [(1, 10, 10, 100, False, True), (1, 20, 20, 100, True, True), (1, 30, 30, 200, True, True), (2, 20, 20, 100, True, True), (2, 21, 20, 100, True, True), (3, 40, 40, 100, True, False), (3, 50, 50, 100, True, True), (3, 60, 60, 101, True, False)]
    pairs = arrivals._candidates(spark.createDataFrame(rows, "key long, seq long, root long, n int, is_new boolean, early boolean"))
    assert {tuple(r) for r in pairs.collect()} == {(10, 20, 10), (50, 60, None)}
    assert [d._jdf.queryExecution().optimizedPlan().collectLeaves().size() for d in stored] == [1, 2]


def test_bags_and_keys_are_stored_once(spark, monkeypatch):
    from kithgraph.llm import arrivals

    stored = []
    monkeypatch.setattr(arrivals, "written", lambda df, label, *p: stored.append(df.dtypes) or written(df, label, *p))
    rows, want = _rows(7)
    assert _pairs(repeats(spark.createDataFrame([(*x, int(x[0] > 3)) for x in rows], SCHEMA + ", batch_id int"))) == want
    assert stored and not [x for x in stored if {"binary", "array<bigint>"} & {kind for _, kind in x}]


def test_each_lot_spreads_its_ids_and_leads_once(spark, monkeypatch):
    """Every table written, by the stored columns of arrivals its plan reads: one reads the ids, one the leads, of each of two lots."""
    from kithgraph.llm import arrivals

    read = []

    def noted(df, label, *p):
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        read.append(" ".join(leaves.apply(i).output().mkString(" ") for i in range(leaves.size())))
        return written(df, label, *p)

    monkeypatch.setattr(arrivals, "written", noted)
    rows, want = _rows(7)
    assert _pairs(repeats(spark.createDataFrame([(*x, int(x[0] > 3)) for x in rows], SCHEMA + ", batch_id int"))) == want
    assert [sum(f"{c}#" in x for x in read) for c in ("ext", "leads")] == [2, 2]


def test_words_in_plain_and_other_script():
    r = random.Random(8)
    bits = ["word", "Uh", "mm-hmm", "it's", "a_b", "12:30", "3.5", "[laughter]", "[Ann]", "(crosstalk (door))", "<c>", "*sighs*", "\u266a", "{x", "\x1c", "\x0b", "\xa0", "\u00c9t\u00e9", "\u0130", "\u00b2", "\u5b57"]
    for n in range(300):
        text = " ".join(r.choice(bits[: 16 if n % 2 else None]) for _ in range(12))
        want = [w for w in re.findall(r"[^\W_]+", transcripts.NOTE.sub(lambda m: " " if transcripts._is_sound(m[0]) else m[0], text.strip()).lower()) if not transcripts.HESITATION.fullmatch(w)]
        assert spoken_words("[TRANSCRIPT]\n" + text, None) == want
    assert transcripts.regions(" \t[Notes] \r\na\n\n\t[TRANSCRIPT]\nb [NOTES]\n[NOTES] x\n[NOTES]\nc") == {"NOTES": "a\nc", "TRANSCRIPT": "b [NOTES]\n[NOTES] x"}


def test_writes_leave_no_shuffle_files(spark):
    import time

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    counts = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and counts.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
