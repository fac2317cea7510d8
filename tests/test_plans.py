"""The pipeline on invented meetings, boards and notes; operators on small hand-made tables."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import graph
from kithgraph.operators.skew import salted_join
from kithgraph.plans import boards, ledger, project, resolve, search
from kithgraph.sources import notes, responses, store


def person(ref, name, **k):
    return {"ref": ref, "name": name, "confidence": 0.9, **k}


MEETING = {
    "meeting": {"attendee_refs": ["p1", "p2", "gone"], "occurred_at_hint": "2024-02-01 10:00:00"},
    "organizations": [{"ref": "o1", "name": "Brightwater Holdings", "org_type": "vc_fund", "sector": ["water", "power"], "stage": "seed", "confidence": 0.8}],
    "people": [person("p1", "Ada Quill", organization_ref="o1", email="ada@bright.test", title="Partner", role_in_meeting="attendee"), person("p2", "Bo Rand", organization_ref="nowhere", role_in_meeting="speaker", expertise=["pumps"]), person("p3", "Cy", role_in_meeting="mentioned")],
    "topics": [{"ref": "t1", "name": "Pumps", "discussed_by_refs": ["p1", "zz"]}],
    "relationships": [
        {"src_ref": "p1", "dst_ref": "p2", "type": "colleague", "polarity": "asserted", "strength_signal": "strong", "warmth_signal": "warm", "context": "met at school", "confidence": 0.9},
        {"src_ref": "p1", "dst_ref": "p1", "type": "friend"}, {"src_ref": "p1", "dst_ref": "zz", "type": "friend"}, {"src_ref": "p2", "dst_ref": "o1", "type": "works_at", "polarity": "negated", "strength_signal": "weak"},
    ],
    "intro_opportunities": [{"connector_ref": "p1", "target_ref": "p3", "offered": True, "basis": "school"}],
    "asks_and_offers": [{"actor_ref": "p2", "kind": "ask", "what": "a pump"}], "commitments": [{"actor_ref": "p1", "action": "call"}], "outreach_hooks": [{"person_ref": "p2", "hook": "sails", "kind": "personal"}],
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("r1", "s1", None, "succeeded", json.dumps(MEETING)), ("r2", "s2", None, "failed", json.dumps(MEETING)), ("r3", "s3", None, "succeeded", "no json"), ("r4", "s4", None, "succeeded", None)]
    return ledger.sanitize(ledger.read_extractions(spark.createDataFrame(rows, "run_id string, source_id string, occurred_at timestamp, status string, raw_output string")))


def test_mentions(runs):
    m = {r["local_ref"]: r for r in ledger.mentions(runs).collect()}
    assert set(m) == {"o1", "p1", "p2", "p3", "t1"}
    assert m["o1"]["entity_type"] == "fund" and m["o1"]["normalized"] == "brightwater"
    assert m["p1"]["org"] == "Brightwater Holdings" and m["p2"]["org"] is None
    assert m["p3"]["is_first_name_only"] and not m["p1"]["is_first_name_only"]
    assert [r["local_ref"] for r in sorted(m.values(), key=lambda r: r["mention_seq"])] == ["o1", "p1", "p2", "p3", "t1"]


def test_claims(runs):
    c = [(r["claim_type"], r["predicate"], r["polarity"]) for r in ledger.claims(runs).collect()]
    count = {k: sum(x[1] == k for x in c) for k in {x[1] for x in c}}
    assert count == {"title": 1, "email": 1, "expertise": 1, "sector": 2, "stage": 1, "works_at": 2, "colleague": 1, "can_intro_to": 1, "ask": 1, "commitment": 1, "outreach_hook": 1, "met_with": 1, "mentioned": 2}
    assert ("relationship", "works_at", -1) in c


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "claim_no long, id string, workspace_id string, source_id string, source_title string, claim_type string, predicate string, subject_entity string, object_entity string, value string, quote string, explicitness string, polarity smallint, warmth double, confidence double, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))


def test_edges(spark):
    row = lambda n, p, s, o, pol=1, at="2024-01-01", w=None, v="{}", src="s1": (n, f"c{n}", "w", src, f"T{src}", "relationship", p, s, o, v, "q", "stated", pol, w, 0.8, at)
    led = _ledger(spark, [
        row(1, "colleague", "b", "a", w=0.9), row(2, "colleague", "a", "b", src="s2", v='{"context": "same team"}'), row(3, "works_at", "a", "x"), row(4, "works_at", "a", "x", -1, "2024-02-01"),
        row(5, "friend", "a", "a"), row(6, "nothing", "a", "b"), row(7, "friend", "a", None), row(8, "reports_to", "a", "b", -1, "2023-01-01"), row(9, "reports_to", "a", "b", -1, "2023-01-01"),
    ])
    e = {(r["src"], r["dst"], r["relationship_type"]): r for r in project.edges(led, F.to_timestamp(F.lit("2024-03-01 00:00:00"))).collect()}
    assert set(e) == {("a", "b", "colleague"), ("a", "x", "works_at"), ("a", "b", "reports_to")}
    assert e["a", "b", "colleague"]["evidence_count"] == 2 and e["a", "b", "colleague"]["source_diversity"] == 2 and e["a", "b", "colleague"]["warmth"] == pytest.approx(0.9)
    assert e["a", "x", "works_at"]["ended"] and not e["a", "b", "colleague"]["ended"]
    assert all(0 <= r["strength"] <= 1 and 0.02 <= r["probability"] <= 0.97 for r in e.values())
    cards = {(r["src"], r["dst"], r["relationship_type"]): r["context_card"] for r in project.context_cards(led).collect()}
    assert cards["a", "b", "colleague"] == "same team" and cards["a", "x", "works_at"] == "Works at — established in Ts1."
    assert project.edges(led.limit(0), F.current_timestamp()).count() == 0


def test_fold_and_dossier(spark):
    row = lambda n, p, v, at, pol=1: (n, f"c{n}", "w", "s", "T", "attribute", p, "a", None, v, "q", "stated", pol, None, 0.8, at)
    led = _ledger(spark, [row(1, "title", '{"title": "Old"}', "2024-01-01"), row(2, "title", '{"title": "New"}', "2024-02-01"), row(3, "title", '{"title": "Never"}', "2024-03-01", -1), row(4, "expertise", '{"value": "b"}', "2024-01-01"), row(5, "expertise", '{"value": "a"}', "2024-01-01"), *[row(10 + i, "outreach_hook", json.dumps({"hook": f"h{i}"}), f"2024-01-{i + 1:02d}") for i in range(15)]])
    f = project.fold_attributes(led).first()
    assert f["title"] == "New" and f["expertise"] == ["a", "b"] and [h["hook"] for h in f["hooks"]] == [f"h{i}" for i in range(14, 2, -1)]
    n, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    d = project.dossier(F.lit("Ada"), F.lit("fund"), F.col("title"), n, n, F.col("expertise"), F.col("sector"), none, none, F.col("hooks"), none)
    assert project.fold_attributes(led).select(d.alias("d")).first()["d"].startswith("Ada — New\nExpertise: a, b\nHooks:\n- [professional] h14\n")


def _search(edges, start, cap):
    """Settle in cost order, hop-capped, one label a node: the plain search."""
    adj = {}
    for a, b, c in edges:
        adj.setdefault(a, []).append((b, c))
        adj.setdefault(b, []).append((a, c))
    dist, seen, front = {start: (0.0, 0)}, set(), {start}
    while front:
        cur = min(front, key=lambda x: dist[x])
        front.discard(cur)
        seen.add(cur)
        if dist[cur][1] >= cap:
            continue
        for to, c in adj.get(cur, []):
            if to not in seen and (to not in dist or dist[cur][0] + c < dist[to][0]):
                dist[to] = (dist[cur][0] + c, dist[cur][1] + 1)
                front.add(to)
    return dist


def test_paths_equal_the_plain_search(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        nodes = [f"n{i}" for i in range(9)]
        pairs = r.sample(list(itertools.combinations(nodes, 2)), 13)
        ps = [(a, b, round(r.uniform(0.05, 0.95), 4)) for a, b in pairs]
        rows += [(f"g{g}", a, b, "friend", 0.5, p) for a, b, p in ps]
        for node, (c, h) in _search([(a, b, -math.log(p)) for a, b, p in ps], "n0", 3).items():
            want[f"g{g}", node] = (pytest.approx(c), h)
    e = spark.createDataFrame(rows, "workspace_id string, src string, dst string, relationship_type string, strength double, probability double")
    starts = spark.createDataFrame([(f"g{g}", "n0") for g in range(12)], "workspace_id string, start string")
    got = {(x["workspace_id"], x["node"]): (x["cost"], x["hops"]) for x in graph.shortest_paths(e, starts, 3).collect()}
    assert got == want


EDGES = [("w", "a", "b", "friend", 0.5, 0.9), ("w", "b", "c", "friend", 0.5, 0.9), ("w", "a", "d", "friend", 0.5, 0.5), ("w", "d", "c", "friend", 0.5, 0.5), ("w", "x", "y", "friend", 0.5, 0.5)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(EDGES, "workspace_id string, src string, dst string, relationship_type string, strength double, probability double")


def test_alternatives_connectors_avoid(spark, small):
    pair = spark.createDataFrame([("w", "a", "c")], "workspace_id string, start string, target string")
    alt = [(r["path"], r["ban"]) for r in graph.alternatives(small, pair).orderBy("cost").collect()]
    assert alt == [(["a", "b", "c"], None), (["a", "d", "c"], "b")]
    paths = graph.shortest_paths(small, pair.select("workspace_id", "start"))
    c = graph.connectors(paths).collect()
    assert [(r["connector"], r["unlocks"]) for r in c] == [("b", 1)]
    avoid = spark.createDataFrame([("w", "b")], "workspace_id string, node string")
    assert {r["node"] for r in graph.shortest_paths(small, pair.select("workspace_id", "start"), avoid=avoid).collect()} == {"a", "d", "c"}


def test_reach_brokerage_components(spark, small):
    reach = {r["node"]: (r["reach"], r["brokerage"]) for r in graph.brokerage(small).collect()}
    assert reach["a"][0] == 3 and reach["x"] == (1, 1.0)
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "node string")
    comp = {r["node"]: r["component"] for r in graph.components(nodes, small.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_dependencies(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "task string, needs string")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, links).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    bad = links.unionByName(spark.createDataFrame([("a", "q")], "task string, needs string"))
    assert {(r["error"], r["node"]) for r in graph.dependency_errors(nodes, bad).collect()} >= {("missing target", "q"), ("cycle", "d")}
    down = {(r["source"], r["node"]) for r in graph.downstream(links.where("task < 'd'"), nodes).collect()}
    assert down == {("a", "b"), ("b", "c"), ("a", "c")}
    items = spark.createDataFrame([("a", False, []), ("b", True, ["a"]), ("c", False, ["b", "zz"])], "id string, resolved boolean, depends_on array<string>")
    assert [(r["id"], r["blocker"]) for r in boards.blockers(items).collect()] == [("b", "a")]
    assert [boards.connect(items, "a", x) for x in ("a", "q", "b", "c")] == ["self", "missing", "duplicate", None]
    assert boards.connect(items, "c", "a") == "cycle"
    assert {r["id"]: r["depends_on"] for r in boards.clean_dependencies(items).collect()} == {"a": [], "b": ["a"], "c": ["b"]}


def test_dependency_chains_of_any_depth(spark, monkeypatch):
    def light(df, label):  # the rounds are many and tiny
        table = df.toArrow()
        return spark.createDataFrame(table) if table.num_rows else spark.createDataFrame([], df.schema)

    monkeypatch.setattr(graph, "written", light)
    names = [f"{i:03d}" for i in range(103)]
    nodes = light(spark.createDataFrame([(x,) for x in names], "node string"), "")
    links = light(spark.createDataFrame(list(zip(names[1:], names)), "task string, needs string"), "")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, links).collect()} == {x: i for i, x in enumerate(names)}
    assert graph.downstream(links.where("task < '064'"), nodes).count() == 63 * 64 // 2


def test_resolution(spark):
    e = spark.createDataFrame([("e1", "w", "person", "Ada Quill", "ada@b.test", "Bright", "Partner"), ("e2", "w", "organization", "Bright Inc", None, None, None), ("e3", "v", "person", "Ada Quill", None, None, None)], "id string, workspace_id string, entity_type string, canonical_name string, email string, org string, title string")
    cols = "id string, run_id string, mention_seq int, workspace_id string, entity_type string, surface_form string, is_first_name_only boolean, email string, org string, title string"
    m = spark.createDataFrame([("m1", "r", 1, "w", "person", "Ada Quill", False, None, None, None), ("m2", "r", 2, "w", "person", "Ada", True, None, None, None), ("m3", "r", 0, "w", "organization", "Bright, Inc.", False, None, None, None), ("m4", "r", 3, "w", "person", "Ada Quill", False, None, None, None), ("m5", "r", 4, "w", "person", "Zed", True, None, None, None)], cols)
    p = resolve.scored_pairs(m, e)
    total = {(r["mention_id"], r["entity_id"]): (r["total"], r["verdict"]) for r in p.collect()}
    assert total["m1", "e1"][1] == "merge" and total["m3", "e2"] == (pytest.approx(0.93), "merge") and ("m1", "e3") not in total
    d = {r["mention_id"]: (r["action"], r["entity_id"], r["method"]) for r in resolve.decide(m, p).collect()}
    assert d["m1"] == ("link", "e1", "blocked_score") and d["m4"][0] == "create"  # e1 is taken by m1 in this run
    assert d["m3"] == ("link", "e2", "blocked_score") and d["m5"][0] == "defer" and d["m2"][0] == "defer"  # two full names fit
    one = m.where("id IN ('m1', 'm2')")
    assert {r["mention_id"]: r["method"] for r in resolve.decide(one, resolve.scored_pairs(one, e)).collect()}["m2"] == "exact"
    links, grown = resolve.replay([m.where("id = 'm4'"), m.where("id = 'm1'").withColumn("run_id", F.lit("r2"))], e.where("id = 'e2'"))
    got = {r["mention_id"]: r["entity_id"] for r in links.collect()}
    assert got["m1"] == got["m4"] and grown.count() == 2


def test_merges(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "loser string, winner string")
    assert {(r["loser"], r["winner"]) for r in resolve.apply_merges(m).collect()} == {("a", "c"), ("b", "c"), ("x", "c")}
    with pytest.raises(ValueError):
        resolve.apply_merges(spark.createDataFrame([("a", "b"), ("b", "a")], "loser string, winner string"))
    ents = spark.createDataFrame([("a", "person", "active", None), ("c", "fund", "active", None)], "id string, entity_type string, status string, merged_into string")
    with pytest.raises(ValueError):
        resolve.merge_entities(ents, spark.createDataFrame([("a", "c")], "loser string, winner string"))
    assert {r["id"]: r["status"] for r in resolve.delete_entities(ents, ents.where("id = 'a'")).collect()} == {"a": "deleted", "c": "active"}
    tags = spark.range(1).select(resolve.unique_tags(F.array(F.lit(" Warm"), F.lit("warm"), F.lit("LP"), F.lit(" "))).alias("t")).first()["t"]
    assert tags == ["Warm", "LP"]


def test_odd_merge_cycles_and_long_chains_are_told_apart(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "loser string, winner string")
    with pytest.raises(ValueError):
        resolve.apply_merges(ring)
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70)], "loser string, winner string")
    assert {r["winner"] for r in resolve.apply_merges(chain).collect()} == {"070"}


def test_context_neighbours_and_other_names_count(spark):
    m = spark.createDataFrame([("m1", "w", "person", "Bob Quill", False, None, None, None, "leads grid storage research", ["e7", "e8"])], "id string, workspace_id string, entity_type string, surface_form string, is_first_name_only boolean, email string, org string, title string, context string, neighbours array<string>")
    e = [("e1", "w", "person", "Robert Quill", ["Bob Quill", "bq@x.test"], None, None, None, "grid storage research", ["e7", "e8"])]
    schema = "id string, workspace_id string, entity_type string, canonical_name string, aliases array<string>, email string, org string, title string, dossier string, neighbours array<string>"
    full = resolve.scored_pairs(m, spark.createDataFrame(e, schema)).first()
    plain = resolve.scored_pairs(m.drop("context", "neighbours"), spark.createDataFrame(e, schema).drop("aliases")).first()
    assert full["name"] == 1.0 and plain["name"] < 1.0 and full["total"] >= 0.88 > plain["total"]
    told = resolve.scored_pairs(m, spark.createDataFrame(e, schema).drop("aliases")).first()
    overlap, context = 1 - math.exp(-2 / 1.5), 3 / 4
    assert abs(told["total"] - plain["total"] - (0.2 * context + 0.15 * overlap) / 1.35) < 1e-9
    fund = m.withColumn("entity_type", F.lit("fund")).withColumn("surface_form", F.lit("Acme"))
    assert resolve.candidates(fund, spark.createDataFrame([("e2", "w", "organization", "Acme", None, None, None, None, None, None)], schema)).count() == 1


def test_attributes_are_absorbed_with_the_manual_profile_last(spark):
    links = spark.createDataFrame([("m1", "e"), ("m2", "e")], "mention_id string, entity_id string")
    m = spark.createDataFrame([("m1", 1, {"title": "CEO", "org": "A", "email": None}), ("m2", 2, {"title": "Chair"})], "id string, mention_seq int, attributes map<string,string>")
    e = spark.createDataFrame([("e", {"title": "old", "email": "a@x", "manual_profile": '{"org": "M"}'}), ("f", None)], "id string, attributes map<string,string>")
    got = {r["id"]: r["attributes"] for r in resolve.absorb_attributes(links, m, e).collect()}
    assert {k: got["e"][k] for k in ("title", "org", "email")} == {"title": "Chair", "org": "M", "email": "a@x"} and not got["f"]


def test_workspaces_with_a_common_prefix_share_no_entity(spark):
    src = spark.createDataFrame([("s1", "12345678-a"), ("s2", "12345678-b")], "id string, workspace_id string")
    m = spark.createDataFrame([("m1", "s1"), ("m2", "s2")], "id string, source_id string").selectExpr("*", "'person' AS entity_type", "'ann lee' AS normalized", "'Ann Lee' AS surface_form")
    assert ledger.exact_links(m, src).select("entity_id").distinct().count() == 2


def test_search(spark):
    q = search.heuristic_plan(spark.createDataFrame([("Can you introduce me to allocators?",), ("pension board members",)], "question string")).collect()
    assert [(r["intent"], r["max_hops"], r["min_strength"]) for r in q] == [("find_people", 4, 0.0), ("find_people", 4, 0.0)] or q[0]["intent"] in ("find_path", "find_people")
    n = spark.createDataFrame([("1", "Acme Capital", "board", '{"sector": ["Water"]}', 9), ("2", "Bo", "works on a board at acme", '{"org": "Acme"}', 0), ("3", "Cy", None, None, 0)], "id string, name string, dossier string, attributes string, source_count int")
    got = {r["id"]: (r["score"], r["reasons"]) for r in search.hybrid_score(n, F.lit(0.0), F.array(F.lit("Board")), F.lit("acme"), F.array(F.lit("water"))).collect()}
    assert got["1"][0] == pytest.approx(0.12 + 0.45 + 0.2 + 0.08) and got["2"][0] == pytest.approx(0.12 + 0.40) and "3" not in got
    assert got["2"][1] == ["mentions Board", "works at Acme"]


def test_note_readers(spark, tmp_path):
    raw = spark.createDataFrame([(1, "w", "n1", " Title ", None, "2024-01-02", None, "S", None, "N", None, '[{"speaker": "A", "text": "hi"}, {"speaker": null, "text": " "}]', '["Ann Lee <ann@x.test> — Acme", "bo@x.test", {"name": "Cy"}, ""]', None)], "row_id long, workspace_id string, id string, title string, created_at string, createdat string, note_date string, summary string, ai_summary string, notes string, notes_markdown string, transcript string, attendees string, participants string")
    r = notes.read_json_notes(raw).first()
    assert r["title"] == "Title" and str(r["occurred_at"]) == "2024-01-02 00:00:00"
    assert r["body"] == "[ATTENDEES]\n- Ann Lee <ann@x.test> — Acme\n- bo@x.test <bo@x.test>\n- Cy\n\n[SUMMARY]\nS\n\n[NOTES]\nN\n\n[TRANSCRIPT]\nA: hi"
    md = spark.createDataFrame([(1, "# Kickoff\n## Participants\n- Ann <a@x.test>\n## Notes\nfirst\n## Action details\nlast\n## Unknown\nzip"), (2, "plain text on Jan 5, 2024")], "k int, t string")
    m = {x["k"]: x for x in notes.read_markdown(md, "k", "t").collect()}
    assert m[1]["title"] == "Kickoff" and m[1]["body"] == "[ATTENDEES]\n- Ann <a@x.test>\n\n[NOTES]\nlast"
    assert m[2]["title"] == "Pasted meeting" and m[2]["body"] == "[TRANSCRIPT]\nplain text on Jan 5, 2024" and str(m[2]["occurred_at"])[:10] == "2024-01-05"
    for name in ("b.md", "a.JSON", "c.csv"):
        (tmp_path / name).write_text("x")
    assert [x["file_name"] for x in notes.read_directory(spark, str(tmp_path)).collect()] == ["a.JSON", "b.md"]


def test_responses():
    assert responses.meetings_of('Here: ```json\n{"meetings": [{"id": "1", "title": "A"}, {"id": "1", "title": "B"}]}\n```') == ([{"id": "1", "title": "A", "date": None}], True)
    assert responses.meetings_of('<meeting id="7" title="A &amp; B"><date>2024</date></meeting>') == ([{"id": "7", "title": "A & B", "date": "2024"}], True)
    assert responses.meetings_of("No meetings found.") == ([], True) and responses.meetings_of("what?") == ([], False)
    assert responses.transcript_of({"content": [{"speaker": "A", "text": "hi"}]}) == "A: hi" and responses.transcript_of({}) is None
    assert responses.decode_entities("&lt;&#65;&#xD800;&amp;lt;") == "<A&#xD800;&lt;"
    assert responses.shape({"a": [1, "secret"]}) == "{a: [2 x number]}"
    deep = {"id": "1", "title": "t"}
    for _ in range(20):
        deep = {"data": deep}
    assert responses.meetings_of(deep) == ([], False)


def test_stores(spark):
    s = spark.createDataFrame([(1, "w", "x", "h1"), (2, "w", None, "h2"), (3, "w", "x", "h3"), (4, "w", None, "h1"), (5, "w", "y", "h5"), (6, "w", "z", "h5")], "source_seq long, workspace_id string, external_id string, content_hash string")
    assert [r["source_seq"] for r in store.new_sources(s.where("source_seq > 1"), s.where("source_seq = 1")).orderBy("source_seq").collect()] == [2, 5]
    again = spark.createDataFrame([(1, "w", "e1", "h1"), (2, "w", "e1", "h2"), (3, "w", "e2", "h2"), (4, "w", None, None), (5, "w", None, None), (6, "w", "e2", "h9")], "source_seq long, workspace_id string, external_id string, content_hash string")
    assert [r["source_seq"] for r in store.new_sources(again, again.limit(0)).orderBy("source_seq").collect()] == [1, 3, 4, 5]
    b = spark.createDataFrame([("w", 3, "old"), ("v", 1, "old")], "workspace_id string, revision int, document string")
    after, conflicts = store.replace_board(b, spark.createDataFrame([("w", 3, "new"), ("v", 0, "new")], "workspace_id string, revision int, document string"))
    assert {(r["workspace_id"], r["revision"], r["document"]) for r in after.collect()} == {("w", 4, "new"), ("v", 1, "old")}
    assert [r["workspace_id"] for r in conflicts.collect()] == ["v"]
    assert store.append_log(b, "/proc/nowhere/log") is False
    with pytest.raises(LookupError):
        store.workspace(spark.createDataFrame([("a",)], "slug string"), "b")


def test_boards(spark):
    x = spark.createDataFrame([("i", [("s1", "a", True, None), ("s2", "b", False, None), ("s3", "c", False, None)])], "id string, steps array<struct<id:string,text:string,done:boolean,completedAt:string>>")
    r = x.select(boards.complete_next(F.col("steps"), F.lit("now")).alias("n"), boards.trail(F.array(F.lit("old")), F.col("steps"), F.lit("call")).alias("t"), boards.toggle_step(F.col("steps"), F.lit("s1"), F.lit(False), F.lit("now")).alias("g")).first()
    assert [s["done"] for s in r["n"]] == [True, True, False] and r["t"] == ["old", "a", "call", "b", "c"] and r["g"][0]["done"] is False
    lines = spark.range(1).select(boards.plan_lines(F.lit("- one\n\n2. two\n" + "x" * 250)).alias("l")).first()["l"]
    assert [len(v["title"]) for v in lines] == [3, 3, 200] and len(lines[2]["rest"]) == 50
    moved = boards.move_item(spark.createDataFrame([("a", "l", 0), ("b", "l", 1), ("c", "m", 0)], "id string, list string, pos int"), "c", "l", "b")
    assert [r["id"] for r in moved.where("list = 'l'").orderBy("pos").collect()] == ["a", "c", "b"]


def test_salted_join_equals_a_plain_one(spark):
    left = spark.createDataFrame([(i % 50 if i % 3 else 7, i) for i in range(3000)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "k int, w string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        a, b = salted_join(left, right, "k", how), left.join(right, "k", how)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_stream(spark, data, tmp_path):
    from kithgraph.session import table
    from kithgraph.streaming import ingest

    n = table(spark, data, "granola_notes")
    folder = tmp_path / "in"
    n.limit(40).write.parquet(str(folder / "a"))
    files = [f for f in (folder / "a").iterdir() if f.suffix == ".parquet"]
    (tmp_path / "land").mkdir()
    for i, f in enumerate(files):
        f.rename(tmp_path / "land" / f"{i}.parquet")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.note_stream(spark, str(tmp_path / "land"), n.schema), table(spark, data, "workspaces"), out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert 0 < got.count() <= 40 and got.count() == got.dropDuplicates(["workspace_id", "content_hash"]).count()


def test_schemas(spark, tmp_path):
    from kithgraph import schemas

    schemas.create(spark, str(tmp_path))
    schemas.create(spark, str(tmp_path))
    assert all(spark.read.parquet(str(tmp_path / t)).count() == 0 for t in schemas.TABLES)
    w = spark.createDataFrame([("1", "a")], "id string, slug string")
    assert schemas.seed_workspace(w, spark.createDataFrame([("2", "a")], "id string, slug string")).count() == 1
