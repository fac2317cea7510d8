"""The core queries by name, each (spark, sf_dir) -> DataFrame, and the SQL that checks them.

The ledger queries read the tables of observations: a mention's entity is its exact normal form within workspace and
type, a claim counts once however often it was delivered, and everything is scored as of a fixed day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph import dims
from kithgraph.functions import jsonx, months, scoring, text, vectors
from kithgraph.operators import graph, timestamps
from kithgraph.plans import boards, ledger, project, resolve, search
from kithgraph.session import table, written
from kithgraph.sources import notes as note_sources
from kithgraph.sources import responses, store

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-06-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


def _r(c, n=6):
    return F.round(c, n)


def links(spark, d):
    return ledger.exact_links(table(spark, d, "mentions"), table(spark, d, "sources").select("id", "workspace_id"))


def joined(spark, d):
    return ledger.joined(table(spark, d, "claims"), links(spark, d), table(spark, d, "sources").select("id", "workspace_id", "title", "occurred_at", "ingested_at"))


def edges(spark, d):
    return project.edges(joined(spark, d), _as_of())


# --- SQL shared by the checks -------------------------------------------------------------------------------------

_SYM = ", ".join(f"'{t}'" for t in dims.SYMMETRIC)
_TYPES = ", ".join(f"'{t}'" for t in dims.TYPES)
_PRIOR = "CASE relationship_type " + " ".join(f"WHEN '{t}' THEN {p}" for t, _, p, _ in dims.RELATIONSHIPS) + f" ELSE {dims.UNKNOWN_PRIOR} END"
_LABEL = "CASE predicate " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n, _, _ in dims.RELATIONSHIPS) + " ELSE predicate END"
_WEIGHT = "CASE explicitness WHEN 'stated' THEN 1.0::DOUBLE WHEN 'reported' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END"
_ENTITY = "concat_ws(':', left(m.entity_type, 1), s.workspace_id, CASE WHEN trim(m.normalized) <> '' THEN trim(lower(m.normalized)) ELSE trim(lower(m.surface_form)) END)"
_LINKS = f"links AS (SELECT m.id AS mention_id, s.workspace_id, {_ENTITY} AS entity_id, m.entity_type, m.source_id FROM mentions m JOIN sources s ON s.id = m.source_id)"
_LED = f"""{_LINKS},
once AS (SELECT id, min(claim_no) AS claim_no FROM claims GROUP BY id),
led AS (
  SELECT c.* EXCLUDE (observed_at), coalesce(c.observed_at, s.occurred_at, s.ingested_at) AS observed_at, s.workspace_id, s.title AS source_title, a.entity_id AS subject_entity, b.entity_id AS object_entity
  FROM claims c JOIN once USING (id, claim_no) JOIN sources s ON s.id = c.source_id
  LEFT JOIN links a ON a.mention_id = c.subject_mention_id LEFT JOIN links b ON b.mention_id = c.object_mention_id
)"""
_EC = f"""{_LED},
ec AS (
  SELECT *, predicate AS relationship_type, CASE WHEN predicate IN ({_SYM}) THEN least(subject_entity, object_entity) ELSE subject_entity END AS src,
    CASE WHEN predicate IN ({_SYM}) THEN greatest(subject_entity, object_entity) ELSE object_entity END AS dst, predicate NOT IN ({_SYM}) AS directed,
    {_WEIGHT} AS w, coalesce(try_cast(value->>'strength_signal' AS DOUBLE), 0.7) AS sig
  FROM led WHERE claim_type IN ('relationship', 'capability') AND predicate IN ({_TYPES}) AND subject_entity <> object_entity
)"""
_EDGES = f"""{_EC},
g AS (
  SELECT workspace_id, src, dst, relationship_type, directed, count(*) FILTER (polarity = 1) AS supporting, count(*) AS evidence_count, count(DISTINCT source_id) AS source_diversity,
    coalesce(max(w) FILTER (polarity = 1), max(w)) AS w, coalesce(max(sig) FILTER (polarity = 1), max(sig)) AS sig,
    coalesce(avg(confidence::DOUBLE) FILTER (polarity = 1), avg(confidence::DOUBLE)) AS confidence, coalesce(avg(warmth::DOUBLE), 0.5) AS warmth,
    min(observed_at) AS first_seen, max(observed_at) AS last_seen, arg_max(polarity, (observed_at, claim_no)) = -1 AS ended,
    arg_min(value->>'since', (observed_at, claim_no)) FILTER (coalesce(value->>'since', '') <> '') AS since
  FROM ec GROUP BY ALL
), t AS (
  SELECT *, w * sig * (0.5 + 0.5 * confidence) AS base, 1 - exp(-evidence_count / 3.0) AS volume, 1 - exp(-source_diversity / 2.0) AS diversity,
    (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last_seen)) / 1e6 / 86400 / 30.44 AS months FROM g WHERE supporting > 0 OR ended
), u AS (
  SELECT *, CASE WHEN months <= 0 THEN 1.0 ELSE pow(0.5, months / 18.0) END AS recency FROM t
), v AS (
  SELECT *, least(1.0, greatest(0.0, base * (0.55 + 0.25 * volume + 0.2 * diversity) * (0.35 + 0.65 * recency))) * CASE WHEN ended THEN 0.5 ELSE 1.0 END AS strength FROM u
), edges AS (
  SELECT *, least(0.97, greatest(0.02, {_PRIOR} * (0.15 + 0.85 * strength) * (0.6 + 0.4 * least(1.0, greatest(0.0, warmth))) * CASE WHEN ended THEN 0.6 ELSE 1.0 END)) AS probability FROM v
)"""
_ADJ = "adj AS (SELECT workspace_id, src AS a, dst AS b, strength FROM edges UNION ALL SELECT workspace_id, dst, src, strength FROM edges)"


# --- timestamps ---------------------------------------------------------------------------------------------------


@query("p1_found")
def p1_found(spark, d):
    """(row_id, utc_us) of every note with a readable time."""
    return timestamps.notes_in_utc(table(spark, d, "granola_notes"), table(spark, d, "workspaces"))


# --- the core projection ------------------------------------------------------------------------------------------


@query("agg02_edges", f"""WITH {_EDGES} SELECT workspace_id, src, dst, relationship_type, directed, evidence_count, source_diversity, ended, since, round(strength, 6) AS strength, round(warmth, 6) AS warmth,
  round(confidence, 6) AS confidence, round(probability, 6) AS probability, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM edges""")
def agg02_edges(spark, d):
    return edges(spark, d).select("workspace_id", "src", "dst", "relationship_type", "directed", "evidence_count", "source_diversity", "ended", "since", _r("strength").alias("strength"), _r("warmth").alias("warmth"), _r("confidence").alias("confidence"), _r("probability").alias("probability"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query("q_top_edges", f"WITH {_EDGES} SELECT src, dst, relationship_type, round(probability, 6) AS probability FROM edges ORDER BY round(probability, 6) DESC, src, dst, relationship_type LIMIT 20")
def q_top_edges(spark, d):
    e = edges(spark, d).select("src", "dst", "relationship_type", _r("probability").alias("probability"))
    return e.orderBy(F.desc("probability"), "src", "dst", "relationship_type").limit(20)


@query("mat01_06_scores", f"""WITH {_EDGES} SELECT src, dst, relationship_type, round(base, 6) AS base, round(volume, 6) AS volume, round(diversity, 6) AS diversity, round(recency, 6) AS recency, round(-ln(probability), 6) AS cost,
  CASE WHEN probability >= 0.75 THEN 'very strong' WHEN probability >= 0.55 THEN 'strong' WHEN probability >= 0.35 THEN 'moderate' WHEN probability >= 0.18 THEN 'weak' ELSE 'faint' END AS label FROM edges""")
def mat01_06_scores(spark, d):
    return edges(spark, d).select("src", "dst", "relationship_type", *[_r(f"terms.{k}").alias(k) for k in ("base", "volume", "diversity", "recency")], _r(scoring.edge_cost(F.col("probability"))).alias("cost"), scoring.strength_label(F.col("probability")).alias("label"))


@query("agg03_04_explicitness_since", f"""WITH {_EC} SELECT workspace_id, src, dst, relationship_type, max(w) AS strongest, arg_min(value->>'since', (observed_at, claim_no)) FILTER (coalesce(value->>'since', '') <> '') AS since FROM ec GROUP BY ALL""")
def agg03_04(spark, d):
    c = project.edge_claims(joined(spark, d))
    at = F.struct("observed_at", "claim_no")
    since = jsonx.text_at(F.col("value"), "since")
    return c.groupBy("workspace_id", "src", "dst", F.col("predicate").alias("relationship_type")).agg(F.max(dims.lookup(F.col("explicitness"), dims.EXPLICITNESS, 0.5)).alias("strongest"), F.min_by(since, F.when(F.coalesce(since, F.lit("")) != "", at)).alias("since"))


@query("win01_ended_ties", f"WITH {_EDGES} SELECT workspace_id, src, dst, relationship_type FROM edges WHERE ended")
def win01_ended_ties(spark, d):
    return edges(spark, d).where("ended").select("workspace_id", "src", "dst", "relationship_type")


@query("win02_top_evidence", f"""WITH {_EC}, r AS (SELECT src, dst, relationship_type, id AS claim_id, row_number() OVER (PARTITION BY workspace_id, src, dst, relationship_type ORDER BY confidence::DOUBLE DESC, observed_at DESC, claim_no) AS rn FROM ec WHERE quote IS NOT NULL)
SELECT claim_id, rn FROM r WHERE rn <= 3""")
def win02_top_evidence(spark, d):
    return project.top_evidence(project.evidence(joined(spark, d))).select("claim_id", "rn")


@query("agg05_context_cards", f"""WITH {_EC}, f AS (SELECT workspace_id, src, dst, relationship_type, source_title, min((observed_at, claim_no)) AS seen FROM ec GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, src, dst, relationship_type ORDER BY seen) AS rn FROM f WHERE source_title IS NOT NULL),
w AS (SELECT workspace_id, src, dst, relationship_type, string_agg(source_title, ', ' ORDER BY rn) AS place FROM n WHERE rn <= 2 GROUP BY ALL),
e AS (SELECT DISTINCT workspace_id, src, dst, relationship_type, {_LABEL} AS label FROM ec)
SELECT e.workspace_id, e.src, e.dst, e.relationship_type, label || CASE WHEN coalesce(place, '') <> '' THEN ' — established in ' || place ELSE '' END || '.' AS context_card
FROM e LEFT JOIN w USING (workspace_id, src, dst, relationship_type)""")
def agg05_context_cards(spark, d):
    return project.context_cards(joined(spark, d))


@query("agg06_fold", f"""WITH {_LED}, p AS (SELECT * FROM led WHERE polarity = 1 AND subject_entity IS NOT NULL)
SELECT workspace_id, subject_entity AS entity_id,
  arg_max(value->>'title', (observed_at, claim_no)) FILTER (predicate = 'title' AND value->>'title' IS NOT NULL) AS title,
  arg_max(value->>'location', (observed_at, claim_no)) FILTER (predicate = 'location' AND value->>'location' IS NOT NULL) AS location,
  arg_max(value->>'seniority', (observed_at, claim_no)) FILTER (predicate = 'seniority' AND value->>'seniority' IS NOT NULL) AS seniority,
  coalesce(array_to_string(list_sort(list_distinct(list(value->>'value') FILTER (predicate = 'expertise' AND value->>'value' IS NOT NULL))), '|'), '') AS expertise,
  coalesce(array_to_string(list_sort(list_distinct(list(value->>'value') FILTER (predicate = 'sector' AND value->>'value' IS NOT NULL))), '|'), '') AS sector,
  least(12, count(*) FILTER (predicate = 'outreach_hook' AND coalesce(value->>'hook', value->>'what', '') <> '')) AS n_hooks
FROM p GROUP BY ALL""")
def agg06_fold(spark, d):
    f = project.fold_attributes(joined(spark, d))
    return f.select("workspace_id", "entity_id", "title", "location", "seniority", F.array_join("expertise", "|").alias("expertise"), F.array_join("sector", "|").alias("sector"), F.size("hooks").cast("long").alias("n_hooks"))


@query("agg07_dossiers")
def agg07_dossiers(spark, d):
    led = written(joined(spark, d), "ledger")
    f = project.fold_attributes(led).join(project.relationship_contexts(led), "entity_id", "left")
    kind = dims.lookup(F.left("entity_id", F.lit(1)), {"p": "person", "o": "organization", "f": "fund", "t": "topic"}, "person")
    none = F.array().cast("array<string>")
    text_ = project.dossier(F.split_part("entity_id", F.lit(":"), F.lit(3)), kind, F.col("title"), F.lit(None).cast("string"), F.col("location"), F.col("expertise"), F.col("sector"), F.col("interests"), F.col("notable_facts"), F.col("hooks"), F.coalesce("contexts", none))
    return f.select("workspace_id", "entity_id", text_.alias("dossier"))


@query("win03_newest_hooks", f"""WITH {_LED}, h AS (SELECT subject_entity, id, row_number() OVER (PARTITION BY workspace_id, subject_entity ORDER BY observed_at DESC, claim_no DESC) AS rn FROM led WHERE polarity = 1 AND predicate = 'outreach_hook' AND subject_entity IS NOT NULL)
SELECT subject_entity, id, rn FROM h WHERE rn <= 12""")
def win03_newest_hooks(spark, d):
    h = joined(spark, d).where("polarity = 1 AND predicate = 'outreach_hook' AND subject_entity IS NOT NULL")
    return h.withColumn("rn", F.row_number().over(W.partitionBy("workspace_id", "subject_entity").orderBy(F.desc("observed_at"), F.desc("claim_no")))).where("rn <= 12").select("subject_entity", "id", "rn")


@query("win04_last_relationships", f"""WITH {_LED}, h AS (SELECT subject_entity, id, row_number() OVER (PARTITION BY subject_entity ORDER BY observed_at DESC, claim_no DESC) AS rn FROM led WHERE claim_type = 'relationship' AND subject_entity IS NOT NULL)
SELECT subject_entity, id, rn FROM h WHERE rn <= 6""")
def win04_last_relationships(spark, d):
    h = joined(spark, d).where("claim_type = 'relationship' AND subject_entity IS NOT NULL")
    return h.withColumn("rn", F.row_number().over(W.partitionBy("subject_entity").orderBy(F.desc("observed_at"), F.desc("claim_no")))).where("rn <= 6").select("subject_entity", "id", "rn")


# --- joins and counters -------------------------------------------------------------------------------------------


@query("join03_ledger", f"WITH {_LED} SELECT id, claim_no, workspace_id, subject_entity, object_entity, epoch_us(observed_at) AS observed_us FROM led")
def join03_ledger(spark, d):
    return joined(spark, d).select("id", "claim_no", "workspace_id", "subject_entity", "object_entity", F.unix_micros("observed_at").alias("observed_us"))


@query("join03_anti_dead", f"""WITH {_LED}, dead AS (SELECT DISTINCT entity_id AS id FROM links WHERE entity_type = 'topic')
SELECT id, claim_no FROM led WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.id IN (led.subject_entity, led.object_entity))""")
def join03_anti_dead(spark, d):
    dead = links(spark, d).where("entity_type = 'topic'").select(F.col("entity_id").alias("id")).distinct()
    s = table(spark, d, "sources").select("id", "workspace_id", "title", "occurred_at", "ingested_at")
    return ledger.joined(table(spark, d, "claims"), links(spark, d), s, dead).select("id", "claim_no")


@query("join04_agg01_entity_counters", f"""WITH {_LINKS} SELECT entity_id, count(*) AS mention_count, count(DISTINCT l.source_id) AS source_count, epoch_us(min(coalesce(occurred_at, ingested_at))) AS first_us, epoch_us(max(coalesce(occurred_at, ingested_at))) AS last_us
FROM links l JOIN sources s ON s.id = l.source_id GROUP BY entity_id""")
def join04_agg01(spark, d):
    c = project.entity_counters(links(spark, d), table(spark, d, "sources").select("id", "occurred_at", "ingested_at"))
    return c.select("entity_id", "mention_count", "source_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query("join05_nodes_metrics", f"""WITH {_EDGES}, {_ADJ}, m AS (SELECT a AS node, count(*) AS degree, sum(strength) AS wd FROM adj GROUP BY 1), n AS (SELECT DISTINCT entity_id FROM links)
SELECT entity_id, coalesce(degree, 0) AS degree, round(coalesce(wd, 0), 5) AS weighted_degree FROM n LEFT JOIN m ON m.node = n.entity_id""")
def join05_nodes_metrics(spark, d):
    m = graph.degrees(edges(spark, d))
    n = links(spark, d).select("entity_id").distinct()
    return n.join(m, n.entity_id == m.node, "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"), _r(F.coalesce("weighted_degree", F.lit(0.0)), 5).alias("weighted_degree"))


@query("join06_set01_adjacency", f"WITH {_EDGES}, {_ADJ} SELECT workspace_id, a, b, count(*) AS n FROM adj GROUP BY ALL")
def join06_adjacency(spark, d):
    return graph.adjacency(edges(spark, d)).groupBy("workspace_id", "a", "b").agg(F.count("*").alias("n"))


@query("join07_fil05_edges_between_people", f"WITH {_EDGES}, p AS (SELECT DISTINCT entity_id FROM links WHERE entity_type = 'person') SELECT src, dst, relationship_type FROM edges WHERE src IN (SELECT entity_id FROM p) AND dst IN (SELECT entity_id FROM p)")
def join07_edges_between_people(spark, d):
    p = links(spark, d).where("entity_type = 'person'").select("entity_id").distinct()
    e = edges(spark, d).select("src", "dst", "relationship_type")
    return e.join(p.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(p.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select("src", "dst", "relationship_type")


@query("join08_evidence", f"WITH {_EC} SELECT src, dst, relationship_type, id AS claim_id, source_id, round(confidence::DOUBLE, 6) AS weight FROM ec WHERE quote IS NOT NULL")
def join08_evidence(spark, d):
    c = project.edge_claims(joined(spark, d)).where(F.col("quote").isNotNull())
    return c.select("src", "dst", F.col("predicate").alias("relationship_type"), F.col("id").alias("claim_id"), "source_id", _r(F.col("confidence").cast("double")).alias("weight"))


@query("join09_fil06_reviews", "SELECT e.id, e.canonical_name, w.slug FROM entities e JOIN workspaces w ON w.id = e.workspace_id WHERE e.status = 'needs_review'")
def join09_reviews(spark, d):
    w = table(spark, d, "workspaces").select(F.col("id").alias("workspace_id"), "slug")
    return table(spark, d, "entities").where("status = 'needs_review'").select("id", "canonical_name", "workspace_id").join(w, "workspace_id").select("id", "canonical_name", "slug")


@query("join10_unlinked_mentions", "SELECT m.id FROM mentions m LEFT JOIN (SELECT subject_mention_id AS i FROM claims UNION SELECT object_mention_id FROM claims) c ON c.i = m.id WHERE c.i IS NULL")
def join10_unlinked_mentions(spark, d):
    c = table(spark, d, "claims")
    used = c.select(F.col("subject_mention_id").alias("id")).unionByName(c.select(F.col("object_mention_id").alias("id"))).where("id IS NOT NULL").distinct()
    return table(spark, d, "mentions").select("id").join(used, "id", "left_anti")


@query("join11_source_counts", "SELECT s.source_seq, (SELECT count(*) FROM mentions m WHERE m.source_id = s.id) AS mention_count, (SELECT count(*) FROM claims c WHERE c.source_id = s.id) AS claim_count FROM sources s")
def join11_source_counts(spark, d):
    m = table(spark, d, "mentions").groupBy("source_id").agg(F.count("*").alias("mention_count"))
    c = table(spark, d, "claims").groupBy("source_id").agg(F.count("*").alias("claim_count"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "source_seq")
    return s.join(m, "source_id", "left").join(c, "source_id", "left").select("source_seq", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("claim_count", F.lit(0)).alias("claim_count"))


@query("join12_agg16_willing_pairs", f"""WITH {_EDGES}, i AS (SELECT DISTINCT workspace_id, least(src, dst) AS x, greatest(src, dst) AS y FROM edges WHERE relationship_type = 'can_intro_to')
SELECT e.src, e.dst, e.relationship_type, i.x IS NOT NULL AS willing FROM edges e LEFT JOIN i ON i.workspace_id = e.workspace_id AND i.x = least(e.src, e.dst) AND i.y = greatest(e.src, e.dst)""")
def join12_willing_pairs(spark, d):
    e = written(edges(spark, d).select("workspace_id", "src", "dst", "relationship_type"), "edges").withColumn("x", F.least("src", "dst")).withColumn("y", F.greatest("src", "dst"))
    i = e.where("relationship_type = 'can_intro_to'").select("workspace_id", "x", "y").distinct().withColumn("willing", F.lit(True))
    return e.join(i, ["workspace_id", "x", "y"], "left").select("src", "dst", "relationship_type", F.coalesce("willing", F.lit(False)).alias("willing"))


@query("join13_latest_link", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY claim_no DESC) AS n FROM claims) SELECT id, claim_no FROM r WHERE n = 1")
def join13_latest_link(spark, d):
    return table(spark, d, "claims").groupBy("id").agg(F.max("claim_no").alias("claim_no"))


@query("join14_in_subquery", "SELECT id FROM entities WHERE workspace_id IN (SELECT id FROM workspaces WHERE settings->>'date_order' = 'dmy')")
def join14_in_subquery(spark, d):
    w = table(spark, d, "workspaces").where(F.get_json_object("settings", "$.date_order") == "dmy").select(F.col("id").alias("workspace_id"))
    return table(spark, d, "entities").select("id", "workspace_id").join(w, "workspace_id", "left_semi").select("id")


@query("led12_join15_co_attendance", """SELECT a.run_id, a.id AS subject, b.id AS object FROM mentions a JOIN mentions b ON a.run_id = b.run_id AND a.local_ref < b.local_ref
WHERE a.entity_type = 'person' AND b.entity_type = 'person' AND a.role_in_source IN ('attendee', 'speaker') AND b.role_in_source IN ('attendee', 'speaker')""")
def led12_co_attendance(spark, d):
    return ledger.co_attendance(table(spark, d, "mentions").select("id", "run_id", "local_ref", "entity_type", "role_in_source"))


@query("led13_join15_awareness", """SELECT a.run_id, a.id AS subject, b.id AS object FROM mentions a JOIN mentions b ON a.run_id = b.run_id
WHERE a.entity_type = 'person' AND b.entity_type = 'person' AND a.role_in_source IN ('attendee', 'speaker') AND coalesce(b.role_in_source NOT IN ('attendee', 'speaker'), true)""")
def led13_awareness(spark, d):
    return ledger.awareness(table(spark, d, "mentions").select("id", "run_id", "entity_type", "role_in_source"))


@query("join16_range", """WITH b AS (SELECT event_id AS id, (event_id * 37 % 1000)::DOUBLE AS x, (event_id * 91 % 600)::DOUBLE AS y FROM events), a AS (SELECT i AS position, i * 100.0 AS x0, i * 100.0 + 150 AS x1, 0.0 AS y0, 400.0 AS y1 FROM range(10) t(i))
SELECT id, min(position)::INT AS area FROM b JOIN a ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY id""")
def join16_range(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 37 % 1000).cast("double").alias("x"), (F.col("event_id") * 91 % 600).cast("double").alias("y"))
    a = spark.range(10).select(F.col("id").cast("int").alias("position"), F.col("id").cast("int").alias("area"), (F.col("id") * 100.0).alias("x0"), (F.col("id") * 100.0 + 150).alias("x1"), F.lit(0.0).alias("y0"), F.lit(400.0).alias("y1"))
    return boards.boxes_in(e, F.broadcast(a))  # ten areas


@query("join17_either_way", f"""WITH {_EDGES}, p AS (SELECT src AS x, dst AS y FROM edges WHERE relationship_type = 'works_at') SELECT DISTINCT e.src, e.dst, e.relationship_type FROM edges e JOIN p ON (e.src = p.x AND e.dst = p.y) OR (e.src = p.y AND e.dst = p.x)""")
def join17_either_way(spark, d):
    e = written(edges(spark, d).select("src", "dst", "relationship_type"), "edges")
    p = e.where("relationship_type = 'works_at'").select("src", "dst").distinct()
    both = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return e.join(both, ["src", "dst"], "left_semi").distinct()  # the disjunction as one equi-join on both orientations


@query("join18_box_overlap", "SELECT event_id FROM events WHERE (event_id * 37 % 1000) < 500 AND (event_id * 37 % 1000) + 40 > 200 AND (event_id * 91 % 600) < 300 AND (event_id * 91 % 600) + 20 > 100")
def join18_box_overlap(spark, d):
    b = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 1000).alias("x"), (F.col("event_id") * 91 % 600).alias("y"), F.lit(40).alias("w"), F.lit(20).alias("h"))
    return boards.overlapping(b, 200, 100, 500, 300).select("event_id")


# --- aggregates, windows, top-k, sets, filters --------------------------------------------------------------------


@query("agg08_degrees", f"WITH {_EDGES}, {_ADJ} SELECT workspace_id, a AS node, count(*) AS degree, round(sum(strength), 5) AS weighted_degree FROM adj GROUP BY ALL")
def agg08_degrees(spark, d):
    return graph.degrees(edges(spark, d)).select("workspace_id", "node", "degree", _r("weighted_degree", 5).alias("weighted_degree"))


@query("agg10_filtered_array", "SELECT run_id, array_to_string(list_sort(list_distinct(list(surface_form) FILTER (entity_type = 'topic'))), '|') AS topics FROM mentions GROUP BY run_id HAVING count(*) FILTER (entity_type = 'topic') > 0")
def agg10_filtered_array(spark, d):
    t = F.when(F.col("entity_type") == "topic", F.col("surface_form"))
    return table(spark, d, "mentions").groupBy("run_id").agg(F.array_sort(F.collect_set(t)).alias("t"), F.count(t).alias("n")).where("n > 0").select("run_id", F.array_join("t", "|").alias("topics"))


@query("agg11_having", "SELECT workspace_id, normalized, count(*) AS n FROM entities WHERE entity_type <> 'person' AND status NOT IN ('merged', 'deleted') GROUP BY ALL HAVING count(*) > 1")
def agg11_having(spark, d):
    e = table(spark, d, "entities").where("entity_type <> 'person' AND status NOT IN ('merged', 'deleted')")
    return e.groupBy("workspace_id", "normalized").agg(F.count("*").alias("n")).where("n > 1")


@query("agg12_dashboard", "SELECT workspace_id, count(*) FILTER (status NOT IN ('merged', 'deleted')) AS live, count(*) FILTER (status = 'needs_review') AS to_review, count(*) FILTER (entity_type = 'person' AND status = 'active') AS people, count(DISTINCT entity_type) AS kinds FROM entities GROUP BY workspace_id")
def agg12_dashboard(spark, d):
    c = lambda cond: F.count(F.when(F.expr(cond), 1))
    return table(spark, d, "entities").groupBy("workspace_id").agg(c("status NOT IN ('merged', 'deleted')").alias("live"), c("status = 'needs_review'").alias("to_review"), c("entity_type = 'person' AND status = 'active'").alias("people"), F.countDistinct("entity_type").alias("kinds"))


@query("agg13_best", "SELECT workspace_id, arg_max(id, (degree, id)) AS id FROM graph_nodes GROUP BY workspace_id")
def agg13_best(spark, d):
    return table(spark, d, "graph_nodes").groupBy("workspace_id").agg(F.max_by("id", F.struct("degree", "id")).alias("id"))


@query("agg14_neighbour_lists", f"WITH {_EDGES}, {_ADJ} SELECT workspace_id, a AS node, array_to_string(list_sort(list_distinct(list(b))), '|') AS neighbours FROM adj GROUP BY ALL")
def agg14_neighbour_lists(spark, d):
    return graph.adjacency(edges(spark, d)).groupBy("workspace_id", F.col("a").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("b")), "|").alias("neighbours"))


@query("agg15_conditional_sums", "SELECT run_id, count(*) AS mentions, sum(CASE WHEN is_first_name_only THEN 1 ELSE 0 END)::BIGINT AS bare, sum(CASE WHEN entity_type = 'person' THEN 1 ELSE 0 END)::BIGINT AS people FROM mentions GROUP BY run_id")
def agg15_conditional_sums(spark, d):
    s = lambda cond: F.sum(F.when(F.expr(cond), 1).otherwise(0))
    return table(spark, d, "mentions").groupBy("run_id").agg(F.count("*").alias("mentions"), s("is_first_name_only").alias("bare"), s("entity_type = 'person'").alias("people"))


@query("agg20_bounds", "SELECT min(x) AS x0, min(y) AS y0, max(x + 10) AS x1, max(y + 5) AS y1 FROM (SELECT event_id % 977 AS x, event_id % 499 AS y FROM events)")
def agg20_bounds(spark, d):
    return boards.bounds(table(spark, d, "events").select((F.col("event_id") % 977).alias("x"), (F.col("event_id") % 499).alias("y"), F.lit(10).alias("w"), F.lit(5).alias("h")))


@query("agg21_unique_tags", """WITH t AS (SELECT id, unnest(['Warm', lower(entity_type), 'WARM ', entity_type, upper(status)]) AS tag, generate_subscripts(['Warm', lower(entity_type), 'WARM ', entity_type, upper(status)], 1) AS pos FROM entities),
f AS (SELECT id, lower(trim(tag)) AS k, min(pos) AS p, arg_min(trim(tag), pos) AS tag FROM t WHERE trim(tag) <> '' GROUP BY ALL) SELECT id, string_agg(tag, '|' ORDER BY p) AS tags FROM f GROUP BY id""")
def agg21_unique_tags(spark, d):
    tags = F.array(F.lit("Warm"), F.lower("entity_type"), F.lit("WARM "), F.col("entity_type"), F.upper("status"))
    return table(spark, d, "entities").select("id", F.array_join(resolve.unique_tags(tags), "|").alias("tags"))


@query("win06_first_per_external_id", "WITH r AS (SELECT source_seq, row_number() OVER (PARTITION BY workspace_id, external_id ORDER BY source_seq) AS n FROM sources WHERE external_id IS NOT NULL) SELECT source_seq FROM r WHERE n = 1")
def win06_src20_first_per_external_id(spark, d):
    s = table(spark, d, "sources").where(F.col("external_id").isNotNull())
    return store.sources_by_external_ids(s.select("source_seq", "workspace_id", "external_id"), s.select("external_id")).select("source_seq")


@query("win08_running_offsets", "SELECT row_id, coalesce(sum(10 + length(coalesce(title, '')) % 7) OVER (PARTITION BY workspace_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS top FROM granola_notes")
def win08_running_offsets(spark, d):
    n = table(spark, d, "granola_notes").select(F.col("workspace_id").alias("unit"), F.col("row_id").alias("position"), (F.length(F.coalesce("title", F.lit(""))) % 7).alias("height"))
    return boards.lanes(n, 10).select(F.col("position").alias("row_id"), F.col("top").cast("double").alias("top"))


@query("win05_fold_older", "WITH r AS (SELECT row_id, row_number() OVER (PARTITION BY workspace_id ORDER BY exported_at DESC, row_id) AS n FROM granola_notes) SELECT row_id FROM r WHERE n > 3")
def win05_fold_older(spark, d):
    return table(spark, d, "granola_notes").withColumn("n", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("exported_at"), "row_id"))).where("n > 3").select("row_id")


@query("top06_entities", "SELECT id, workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY mention_count DESC, canonical_name, id) AS rank FROM entities WHERE status NOT IN ('merged', 'deleted')")
def top06_entities(spark, d):
    e = table(spark, d, "entities").where("status NOT IN ('merged', 'deleted')")
    return e.select("id", "workspace_id", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("mention_count"), "canonical_name", "id")).alias("rank"))


@query("top07_strongest_edges", f"WITH {_EDGES}, r AS (SELECT workspace_id, src, dst, relationship_type, row_number() OVER (PARTITION BY workspace_id ORDER BY round(strength, 6) DESC, src, dst, relationship_type) AS rank FROM edges) SELECT * FROM r WHERE rank <= 10")
def top07_strongest_edges(spark, d):
    w = W.partitionBy("workspace_id").orderBy(F.desc(_r("strength")), "src", "dst", "relationship_type")
    return edges(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("workspace_id", "src", "dst", "relationship_type", "rank")


@query("top08_sources_by_date", "SELECT source_seq, row_number() OVER (PARTITION BY workspace_id ORDER BY coalesce(occurred_at, ingested_at) DESC, source_seq) AS rank FROM sources")
def top08_sources_by_date(spark, d):
    return table(spark, d, "sources").select("source_seq", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc(F.coalesce("occurred_at", "ingested_at")), "source_seq")).alias("rank"))


@query("top10_type_rank", "SELECT id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN entity_type IN ('organization', 'fund') THEN 0 WHEN entity_type = 'person' THEN 1 ELSE 2 END, local_ref) AS rank FROM mentions")
def top10_type_rank(spark, d):
    r = F.when(F.col("entity_type").isin("organization", "fund"), 0).when(F.col("entity_type") == "person", 1).otherwise(2)
    return table(spark, d, "mentions").select("id", F.row_number().over(W.partitionBy("run_id").orderBy(r, "local_ref")).alias("rank"))


@query("top13_distinct_tags", "SELECT DISTINCT unnest(from_json(attributes->'expertise', '[\"VARCHAR\"]')) AS tag FROM entities WHERE (attributes->'expertise') IS NOT NULL ORDER BY 1")
def top13_distinct_tags(spark, d):
    return table(spark, d, "entities").select(F.explode(jsonx.strings(jsonx.text_at(F.col("attributes"), "expertise"))).alias("tag")).distinct().orderBy("tag")


@query("set03_set07_array_sets", """WITH e AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(strip_accents(canonical_name)), '[^a-z0-9]+'), lambda t: length(t) > 2)) AS a, list_distinct(list_filter(string_split_regex(lower(strip_accents(coalesce(dossier, ''))), '[^a-z0-9]+'), lambda t: length(t) > 2)) AS b FROM entities)
SELECT id, len(list_intersect(a, b))::INT AS common, len(list_distinct(list_concat(a, b)))::INT AS every, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM e""")
def set03_set07_array_sets(spark, d):
    e = table(spark, d, "entities").select("id", text.token_set(F.col("canonical_name")).alias("a"), text.token_set(F.coalesce("dossier", F.lit(""))).alias("b"))
    return e.select("id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("every"), _r(text.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query("set06_distinct_entities", f"WITH {_LINKS} SELECT DISTINCT source_id, entity_id FROM links")
def set06_join02_distinct_entities(spark, d):
    return links(spark, d).select("source_id", "entity_id").distinct()


@query("fil01_02_live_of_type", "SELECT id FROM entities WHERE status NOT IN ('merged', 'deleted') AND entity_type IN ('person', 'fund')")
def fil01_02_live(spark, d):
    return table(spark, d, "entities").where(~F.col("status").isin("merged", "deleted") & F.col("entity_type").isin("person", "fund")).select("id")


@query("fil03_directory", "SELECT id FROM entities WHERE entity_type = 'person' AND contains(lower(concat_ws(' ', canonical_name, attributes->>'title', attributes->>'org')), 'capital')")
def fil03_directory(spark, d):
    hay = F.lower(F.concat_ws(" ", "canonical_name", jsonx.text_at(F.col("attributes"), "title"), jsonx.text_at(F.col("attributes"), "org")))
    return table(spark, d, "entities").where((F.col("entity_type") == "person") & F.contains(hay, F.lit("capital"))).select("id")


@query("fil04_canvas_edges", f"WITH {_EDGES} SELECT src, dst, relationship_type FROM edges WHERE relationship_type <> 'mentioned' AND strength >= 0.3")
def fil04_fil08_canvas_edges(spark, d):
    return edges(spark, d).where("relationship_type <> 'mentioned' AND strength >= 0.3").select("src", "dst", "relationship_type")


@query("fil09_ilike", "SELECT id FROM entities WHERE canonical_name ILIKE '%son%' OR lower(normalized) = lower('UNKNOWN')")
def fil09_ilike(spark, d):
    return table(spark, d, "entities").where(F.col("canonical_name").ilike("%son%") | (F.lower("normalized") == F.lower(F.lit("UNKNOWN")))).select("id")


@query("fil13_typeahead", "SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY workspace_id ORDER BY canonical_name, id) AS rank FROM entities e WHERE contains(lower(canonical_name), 'an') AND entity_type = 'person' AND id NOT IN (SELECT self_entity_id FROM workspaces WHERE self_entity_id IS NOT NULL)) WHERE rank <= 6")
def fil13_typeahead(spark, d):
    own = table(spark, d, "workspaces").select(F.col("self_entity_id").alias("id")).where("id IS NOT NULL")
    e = table(spark, d, "entities").where(F.contains(F.lower("canonical_name"), F.lit("an")) & (F.col("entity_type") == "person")).join(own, "id", "left_anti")
    return e.withColumn("rank", F.row_number().over(W.partitionBy("workspace_id").orderBy("canonical_name", "id"))).where("rank <= 6").select("id", "rank")


@query("fil14_cited_sources", f"WITH {_EC} SELECT source_seq FROM sources s WHERE EXISTS (SELECT 1 FROM ec WHERE ec.source_id = s.id)")
def fil14_cited_sources(spark, d):
    c = project.edge_claims(joined(spark, d)).select(F.col("source_id").alias("id")).distinct()
    return table(spark, d, "sources").select("id", "source_seq").join(c, "id", "left_semi").select("source_seq")


@query("prj01_roles", """SELECT id, CASE WHEN entity_type = 'person' THEN coalesce(nullif(concat_ws(' · ', nullif(trim(attributes->>'title'), ''), nullif(trim(attributes->>'org'), '')), ''), nullif(replace(attributes->>'seniority', '_', ' '), ''), 'Person')
  ELSE concat_ws(' · ', upper(left(entity_type, 1)) || substr(entity_type, 2), nullif(array_to_string(from_json(attributes->'sector', '["VARCHAR"]'), ', '), '')) END AS role FROM entities""")
def prj01_roles(spark, d):
    a = lambda k: jsonx.text_at(F.col("attributes"), k)
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    person = F.concat_ws(" · ", full(a("title")), full(a("org")))
    sector = F.array_join(jsonx.strings(a("sector")), ", ")
    other = F.concat_ws(" · ", F.concat(F.upper(F.left("entity_type", F.lit(1))), F.substring("entity_type", 2, 99)), F.when(sector != "", sector))
    spaced = text.spaced(a("seniority"))
    return table(spark, d, "entities").select("id", F.when(F.col("entity_type") == "person", F.coalesce(F.when(person != "", person), F.when(spaced != "", spaced), F.lit("Person"))).otherwise(other).alias("role"))


@query("prj02_tags", """WITH t AS (SELECT id, list_concat(coalesce(from_json(attributes->'expertise', '["VARCHAR"]'), []), coalesce(from_json(attributes->'sector', '["VARCHAR"]'), [])) AS l FROM entities) SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM t""")
def prj02_tags(spark, d):
    a = lambda k: jsonx.strings(jsonx.text_at(F.col("attributes"), k))
    tags = F.array_distinct(F.filter(F.transform(F.concat(a("expertise"), a("sector")), lambda t: F.trim(t)), lambda x: x != ""))
    return table(spark, d, "entities").select("id", F.array_join(F.array_sort(tags), "|").alias("tags"))


@query("prj03_entity_view", "SELECT id, CASE WHEN entity_type = 'person' THEN 'person' ELSE 'organization' END AS kind, status = 'needs_review' AS pending, coalesce(id = (SELECT self_entity_id FROM workspaces w WHERE w.id = e.workspace_id), false) AS is_self, coalesce(mention_count, 0) AS mentions FROM entities e WHERE status NOT IN ('merged', 'deleted')")
def prj03_entity_view(spark, d):
    w = table(spark, d, "workspaces").select(F.col("id").alias("workspace_id"), "self_entity_id")
    e = table(spark, d, "entities").where("status NOT IN ('merged', 'deleted')").join(w, "workspace_id", "left")
    return e.select("id", F.when(F.col("entity_type") == "person", "person").otherwise("organization").alias("kind"), (F.col("status") == "needs_review").alias("pending"), F.coalesce(F.col("id") == F.col("self_entity_id"), F.lit(False)).alias("is_self"), F.coalesce("mention_count", F.lit(0)).alias("mentions"))


@query("prj05_meetings", "SELECT source_seq, title, count(c.claim_no) > 0 AS extracted FROM sources s LEFT JOIN claims c ON c.source_id = s.id GROUP BY ALL")
def prj05_meetings(spark, d):
    c = table(spark, d, "claims").select("source_id").distinct().withColumn("extracted", F.lit(True))
    return table(spark, d, "sources").select(F.col("id").alias("source_id"), "source_seq", "title").join(c, "source_id", "left").select("source_seq", "title", F.coalesce("extracted", F.lit(False)).alias("extracted"))


# --- scalars ------------------------------------------------------------------------------------------------------

_NAME = "array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(strip_accents({c})), '[''’]', '', 'g'), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{w}'" for w in dims.HONORIFICS + dims.SUFFIXES) + ")), ' ')"
_ORG = "coalesce(nullif(array_to_string(list_filter(string_split_regex(regexp_replace(lower(strip_accents({c})), '[^a-z0-9\\s&-]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{w}'" for w in dims.ORG_NOISE) + ")), ' '), ''), trim(lower(strip_accents({c}))))"


@query("str01_02_person_names", f"SELECT id, {_NAME.format(c='surface_form')} AS normal FROM mentions WHERE entity_type = 'person'")
def str01_02_person_names(spark, d):
    return table(spark, d, "mentions").where("entity_type = 'person'").select("id", text.normalize_name(F.col("surface_form")).alias("normal"))


@query("str03_org_names", f"SELECT id, {_ORG.format(c='surface_form')} AS normal FROM mentions WHERE entity_type <> 'person'")
def str03_org_names(spark, d):
    return table(spark, d, "mentions").where("entity_type <> 'person'").select("id", text.normalize_org(F.col("surface_form")).alias("normal"))


@query("str04_name_parts", f"WITH n AS (SELECT id, string_split({_NAME.format(c='surface_form')}, ' ') AS t FROM mentions WHERE entity_type = 'person') SELECT id, t[1] AS first, CASE WHEN len(t) > 1 THEN t[-1] ELSE '' END AS last FROM n")
def str04_name_parts(spark, d):
    return table(spark, d, "mentions").where("entity_type = 'person'").select("id", text.name_parts(F.col("surface_form")).alias("p")).select("id", "p.first", "p.last")


@query("str05_blocking_keys", f"""WITH n AS (SELECT id, {_NAME.format(c='surface_form')} AS n, attributes->>'email' AS e, attributes->>'org' AS o FROM mentions WHERE entity_type = 'person'), p AS (SELECT *, string_split(n, ' ') AS t FROM n WHERE n <> ''),
k AS (SELECT id, 'n:' || n AS key FROM p UNION SELECT id, 'l:' || t[-1] FROM p WHERE len(t) > 1 UNION SELECT id, 'fl:' || left(t[1], 1) || ':' || t[-1] FROM p WHERE len(t) > 1 UNION SELECT id, 'f:' || t[1] FROM p WHERE len(t) = 1
  UNION SELECT id, 'e:' || lower(trim(e)) FROM p WHERE e <> '' UNION SELECT id, 'd:' || lower(string_split(e, '@')[2]) FROM p WHERE contains(e, '@') UNION SELECT id, 'o:' || {_ORG.format(c='o')} FROM p WHERE o <> '') SELECT id, key FROM k""")
def str05_blocking_keys(spark, d):
    a = lambda k: jsonx.text_at(F.col("attributes"), k)
    return table(spark, d, "mentions").where("entity_type = 'person'").select("id", F.explode(text.blocking_keys(F.col("surface_form"), a("email"), a("org"))).alias("key"))


@query("str06_07_name_similarity")
def str06_07_name_similarity(spark, d):
    c = table(spark, d, "entity_candidates").where("entity_type = 'person'").select("id", "canonical_name", F.explode("aliases").alias("alias"))
    return c.select("id", "alias", _r(text.jaro_winkler(text.normalize_name(F.col("canonical_name")), text.normalize_name(F.col("alias")))).alias("jaro_winkler"), _r(text.name_similarity(F.col("canonical_name"), F.col("alias"))).alias("similarity"))


@query("str08_09_token_sets", "SELECT id, len(list_distinct(list_filter(string_split_regex(lower(strip_accents(dossier)), '[^a-z0-9]+'), lambda t: length(t) > 2)))::INT AS n FROM entities WHERE dossier IS NOT NULL")
def str08_09_token_sets(spark, d):
    return table(spark, d, "entities").where("dossier IS NOT NULL").select("id", F.size(text.token_set(F.col("dossier"))).alias("n"))


@query("str10_truncate", "SELECT id, CASE WHEN length(dossier) <= 60 THEN dossier ELSE rtrim(left(dossier, 59)) || '…' END AS short FROM entities WHERE dossier IS NOT NULL")
def str10_truncate(spark, d):
    return table(spark, d, "entities").where("dossier IS NOT NULL").select("id", text.truncate(F.col("dossier"), 60).alias("short"))


@query("str11_12_resolution_text", "SELECT id, concat_ws(' | ', nullif(surface_form, ''), nullif(attributes->>'title', ''), nullif(attributes->>'org', ''), nullif(attributes->>'location', ''), nullif(disambiguation_context, '')) AS t FROM mentions")
def str11_12_resolution_text(spark, d):
    a = lambda k: jsonx.text_at(F.col("attributes"), k)
    return table(spark, d, "mentions").select("id", text.join_present(" | ", F.col("surface_form"), a("title"), a("org"), a("location"), F.col("disambiguation_context")).alias("t"))


@query("str13_14_keywords", "SELECT row_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in dims.QUERY_STOP_WORDS) + "))[1:8], ' ') AS keywords, regexp_matches(lower(title), '\\b(access|reach|intro|introduc|connect|get to|warm|path)\\b') AS wants_path FROM granola_notes WHERE title IS NOT NULL")
def str13_14_sea01_keywords(spark, d):
    return table(spark, d, "granola_notes").where("title IS NOT NULL").select("row_id", F.array_join(text.keywords(F.col("title")), " ").alias("keywords"), text.wants_path(F.col("title")).alias("wants_path"))


@query("str15_16_contains_spaced", "SELECT claim_no, replace(predicate, '_', ' ') AS words, contains(lower(quote), 'board') AS board FROM claims WHERE quote IS NOT NULL")
def str15_16_contains_spaced(spark, d):
    return table(spark, d, "claims").where("quote IS NOT NULL").select("claim_no", text.spaced(F.col("predicate")).alias("words"), F.contains(F.lower("quote"), F.lit("board")).alias("board"))


_CLEAN = "trim(regexp_replace(regexp_replace(lower(canonical_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("vec01_hash_embedding", f"""WITH w AS (SELECT id, unnest(list_filter(string_split({_CLEAN}, ' '), lambda x: length(x) >= 2)) AS w FROM entities),
t AS (SELECT id, 'w:' || w AS token, 1.0::DOUBLE AS weight FROM w UNION ALL SELECT id, 't:' || substr(w, i, 3), 0.4 FROM (SELECT id, w, unnest(generate_series(1, length(w) - 2)) AS i FROM w WHERE length(w) >= 3)),
h AS (SELECT id, weight, md5(token) AS m FROM t),
b AS (SELECT id, ('0x' || substr(m, 1, 2))::INT + 256 * (('0x' || substr(m, 3, 2))::INT % 2) AS idx, CASE WHEN ('0x' || substr(m, 9, 2))::INT % 2 = 1 THEN weight ELSE -weight END AS v FROM h),
s AS (SELECT id, idx, round(sum(v), 6) AS v FROM b GROUP BY ALL HAVING round(sum(v), 6) <> 0), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM s GROUP BY id)
SELECT id, idx, round(v / norm, 6) AS value FROM s JOIN n USING (id)""")
def vec01_hash_embedding(spark, d):
    return vectors.hash_embedding(table(spark, d, "entities").select("id", "canonical_name"), "id", "canonical_name")


@query("vec02_cosine", """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 5) AS cosine FROM embeddings, q""")
def vec02_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", _r(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


@query("mat07_overlap", f"""WITH {_EDGES}, {_ADJ}, p AS (SELECT DISTINCT workspace_id, a, b FROM adj), c AS (SELECT x.workspace_id, x.a AS a, y.a AS b, count(*) AS shared FROM p x JOIN p y ON x.workspace_id = y.workspace_id AND x.b = y.b AND x.a < y.a GROUP BY ALL) SELECT a, b, round(1 - exp(-shared / 1.5), 6) AS overlap FROM c WHERE shared > 1""")
def mat07_overlap(spark, d):
    p = written(graph.adjacency(edges(spark, d)).select("workspace_id", "a", "b").distinct(), "pairs")
    c = p.join(p.select("workspace_id", F.col("a").alias("z"), "b"), ["workspace_id", "b"]).where("a < z").groupBy("workspace_id", "a", "z").agg(F.count("*").alias("shared"))
    return c.where("shared > 1").select("a", F.col("z").alias("b"), _r(1 - F.exp(-F.col("shared") / 1.5)).alias("overlap"))


@query("mat08_finite", "SELECT claim_no, coalesce(try_cast(value->>'strength_signal' AS DOUBLE), 0.7) AS signal FROM claims")
def mat08_finite(spark, d):
    return table(spark, d, "claims").select("claim_no", scoring.finite(jsonx.text_at(F.col("value"), "strength_signal"), 0.7).alias("signal"))


@query("mat05_clamps", "SELECT o_orderkey, least(1.0, greatest(0.02, o_totalprice / 300000)) AS relevance, least(4, greatest(1, (o_orderkey % 9)))::INT AS hops FROM orders")
def mat05_clamps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scoring.relevance(F.col("o_totalprice") / 300000).alias("relevance"), scoring.hop_limit(F.col("o_orderkey") % 9).alias("hops"))


@query("dat01_months", "SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS i, strftime(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH, '%Y-%m') AS later, strftime(o_orderdate, '%b %Y') AS label FROM orders")
def dat01_months(spark, d):
    m = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, d, "orders").select("o_orderkey", months.month_index(m).alias("i"), months.add_months(m, F.lit(5)).alias("later"), months.month_label(m).alias("label"))


@query("dat02_month_x", "SELECT o_orderkey, round(((year(o_orderdate) * 12 + month(o_orderdate) - 1) - (1992 * 12) + (day(o_orderdate) - 1) / day(last_day(o_orderdate))::DOUBLE) * 80, 6) AS x FROM orders")
def dat02_month_x(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _r(months.day_x(F.col("o_orderdate"), F.lit("1992-01"), 80.0)).alias("x"))


@query("dat03_led14_event_time", "SELECT claim_no, epoch_us(coalesce(c.observed_at, s.occurred_at, s.ingested_at)) AS us FROM claims c JOIN sources s ON s.id = c.source_id")
def dat03_event_time(spark, d):
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "occurred_at", "ingested_at")
    return table(spark, d, "claims").join(s, "source_id").select("claim_no", F.unix_micros(F.coalesce("observed_at", "occurred_at", "ingested_at")).alias("us"))


@query("jsn01_access", "SELECT id, attributes->>'title' AS title, coalesce(list_contains(json_keys(attributes), 'manual_profile'), false) AS manual FROM entities")
def jsn01_access(spark, d):
    return table(spark, d, "entities").select("id", jsonx.text_at(F.col("attributes"), "title").alias("title"), jsonx.has_key(F.col("attributes"), "manual_profile").alias("manual"))


@query("jsn02_merge", "SELECT id, coalesce(attributes->'manual_profile'->>'title', attributes->>'title') AS title, coalesce(attributes->'manual_profile'->>'location', attributes->>'location') AS location FROM entities")
def jsn02_jsn03_jsn04_merge(spark, d):
    base = jsonx.as_map(F.col("attributes"))
    merged = jsonx.strip_empty(jsonx.merge(base, jsonx.as_map(F.get_json_object("attributes", "$.manual_profile"))))
    return table(spark, d, "entities").select("id", F.element_at(merged, "title").alias("title"), F.element_at(merged, "location").alias("location"))


@query("jsn05_strings", "SELECT id, coalesce(array_to_string(from_json(attributes->'expertise', '[\"VARCHAR\"]'), '|'), '') AS expertise FROM entities")
def jsn05_strings(spark, d):
    return table(spark, d, "entities").select("id", F.array_join(jsonx.strings(jsonx.text_at(F.col("attributes"), "expertise")), "|").alias("expertise"))


@query("map01_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def map01_lookup(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.element_at(F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("done")), s), s).alias("status"))


# --- sources ------------------------------------------------------------------------------------------------------

_FLAT = """CASE WHEN regexp_matches(ltrim(transcript), '^\\[\\s*(\\{|\\])') THEN coalesce(array_to_string(list_filter(list_transform(from_json(try_cast(transcript AS JSON), '[{"speaker":"VARCHAR","text":"VARCHAR"}]'),
  lambda s: trim(CASE WHEN coalesce(s.speaker, '') <> '' THEN s.speaker || ': ' ELSE '' END || coalesce(s.text, ''))), lambda x: x <> ''), chr(10)), '') ELSE coalesce(trim(transcript), '') END"""


@query("src06_flat_transcripts", f"SELECT row_id, md5({_FLAT}) AS flat FROM granola_notes")
def src06_flat_transcripts(spark, d):
    return table(spark, d, "granola_notes").select("row_id", F.md5(note_sources.flat_transcript(F.col("transcript"))).alias("flat"))


_PEOPLE = """WITH a AS (SELECT row_id, unnest(from_json(coalesce(attendees, participants)::JSON, '["JSON"]')) AS x, generate_subscripts(from_json(coalesce(attendees, participants)::JSON, '["JSON"]'), 1) AS pos FROM granola_notes),
t AS (SELECT row_id, pos, x, x->>'$' AS s, json_type(x) = 'OBJECT' AS o FROM a),
m AS (SELECT *, CASE WHEN o THEN x->>'email' ELSE coalesce(nullif(regexp_extract(s, '<([^>]+)>', 1), ''), nullif(regexp_extract(s, '([\\w.+-]+@[\\w.-]+\\.\\w+)', 1), '')) END AS email,
  string_split_regex(regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '[\\w.+-]+@[\\w.-]+\\.\\w+', '', 'g'), '\\s+[—–-]\\s+') AS parts FROM t),
q AS (SELECT row_id, pos, CASE WHEN o THEN coalesce(x->>'name', x->>'email') ELSE coalesce(nullif(regexp_replace(trim(parts[1]), '[,;]$', ''), ''), email) END AS name, email, CASE WHEN o THEN x->>'company' ELSE nullif(trim(parts[2]), '') END AS company FROM m)"""


@query("src07_attendees", """WITH a AS (SELECT row_id, unnest(from_json(coalesce(attendees, participants)::JSON, '["JSON"]')) AS x, generate_subscripts(from_json(coalesce(attendees, participants)::JSON, '["JSON"]'), 1) AS pos FROM granola_notes),
t AS (SELECT row_id, pos, x, x->>'$' AS s, json_type(x) = 'OBJECT' AS o FROM a),
m AS (SELECT *, CASE WHEN o THEN x->>'email' ELSE coalesce(nullif(regexp_extract(s, '<([^>]+)>', 1), ''), nullif(regexp_extract(s, '([\\w.+-]+@[\\w.-]+\\.\\w+)', 1), '')) END AS email,
  string_split_regex(regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '[\\w.+-]+@[\\w.-]+\\.\\w+', '', 'g'), '\\s+[—–-]\\s+') AS parts FROM t)
SELECT row_id, CASE WHEN o THEN coalesce(x->>'name', x->>'email') ELSE coalesce(nullif(regexp_replace(trim(parts[1]), '[,;]$', ''), ''), email) END AS name, email, CASE WHEN o THEN x->>'company' ELSE nullif(trim(parts[2]), '') END AS company FROM m
WHERE coalesce(CASE WHEN o THEN coalesce(x->>'name', x->>'email') ELSE coalesce(nullif(regexp_replace(trim(parts[1]), '[,;]$', ''), ''), email) END, '') <> ''""")
def src07_attendees(spark, d):
    n = table(spark, d, "granola_notes").select("row_id", note_sources.attendees(F.coalesce("attendees", "participants")).alias("a"))
    return n.select("row_id", F.inline("a"))


@query("src02_03_08_json_notes", f"""{_PEOPLE}, l AS (SELECT row_id, count(*) AS attendees, string_agg('- ' || name || coalesce(' <' || email || '>', '') || coalesce(' — ' || company, ''), chr(10) ORDER BY pos) AS people FROM q WHERE coalesce(name, '') <> '' GROUP BY row_id),
n AS (SELECT g.row_id, trim(coalesce(g.title, 'Untitled meeting')) AS title, g.id AS external_id, coalesce(attendees, 0) AS attendees, people, trim(coalesce(ai_summary, summary, '')) AS s, trim(coalesce(notes_markdown, notes, '')) AS d, {_FLAT} AS t FROM granola_notes g LEFT JOIN l USING (row_id)),
b AS (SELECT *, concat_ws(chr(10) || chr(10), '[ATTENDEES]' || chr(10) || people, CASE WHEN s <> '' THEN '[SUMMARY]' || chr(10) || s END, CASE WHEN d <> '' THEN '[NOTES]' || chr(10) || d END, CASE WHEN t <> '' THEN '[TRANSCRIPT]' || chr(10) || t END) AS body FROM n)
SELECT row_id, title, external_id, attendees::INT AS attendees, sha256(title || chr(10) || body) AS content_hash, ceil(length(body) / 3.8::DOUBLE)::INT AS token_estimate FROM b""".replace("coalesce(attendees, 0) AS attendees", "coalesce(l.attendees, 0) AS attendees"))
def src03_json_notes(spark, d):
    n = note_sources.read_json_notes(table(spark, d, "granola_notes"))
    return n.select("row_id", "title", "external_id", F.size("attendee_hints").alias("attendees"), "content_hash", "token_estimate")


@query("src09_10_first_date", r"SELECT * FROM (SELECT row_id, epoch_us(try_cast(regexp_extract(created_at, '^\s*(\d{4}-\d{2}-\d{2})\s*$', 1) AS TIMESTAMP)) AS us FROM granola_notes WHERE regexp_matches(created_at, '^\s*\d{4}-\d{2}-\d{2}\s*$')) WHERE us IS NOT NULL")
def src09_10_first_date(spark, d):
    n = table(spark, d, "granola_notes").where(F.col("created_at").rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"))
    return n.select("row_id", F.unix_micros(note_sources.first_date(note_sources.date_line(F.col("created_at")))).alias("us")).where("us IS NOT NULL")


@query("src11_hash", "SELECT source_seq, sha256(concat_ws(chr(10), title, body)) AS h FROM sources")
def src11_hash(spark, d):
    return table(spark, d, "sources").select("source_seq", note_sources.content_hash(F.col("title"), F.col("body")).alias("h"))


@query("src12_token_estimate", "SELECT source_seq, ceil(length(body) / 3.8::DOUBLE)::INT AS tokens FROM sources")
def src12_token_estimate(spark, d):
    return table(spark, d, "sources").select("source_seq", note_sources.token_estimate(F.col("body")).alias("tokens"))


@query("src13_display_transcript", "SELECT source_seq, md5(CASE WHEN trim(raw->>'transcript') <> '' THEN raw->>'transcript' ELSE body END) AS t FROM sources")
def src13_display_transcript(spark, d):
    return table(spark, d, "sources").select("source_seq", F.md5(note_sources.display_transcript(F.col("raw"), F.col("body"))).alias("t"))


@query("src04_05_10_markdown")
def src04_markdown(spark, d):
    docs = table(spark, d, "granola_notes").select("row_id", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))), F.lit("## Overview"), F.coalesce("summary", F.lit("")), F.lit("## Discussion"), F.coalesce("notes", F.lit("")), F.lit("### Transcript"), F.coalesce("transcript", F.lit(""))).alias("text"))
    m = note_sources.read_markdown(docs, "row_id", "text")
    return m.select("row_id", "title", "content_hash", "token_estimate")


@query("src14_15_16_18_responses")
def src14_responses(spark, d):
    r = table(spark, d, "granola_notes").select("row_id", F.to_json(F.struct(F.array(F.struct("id", "title", F.col("note_date").alias("date"))).alias("meetings"), "transcript")).alias("t"))
    return r.select("row_id", responses.meetings("t").alias("m"), responses.transcript("t").alias("said"), responses.response_shape("t").alias("shape")).select("row_id", F.size("m.meetings").alias("n"), "m.recognized", F.length("said").alias("chars"), "shape")


@query("src17_entities", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS t FROM documents WHERE text IS NOT NULL")
def src17_entities(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(responses.decoded(F.col("text"))).alias("t"))


_ROUND = """f{n} AS (SELECT * FROM l{n} QUALIFY (external_id IS NULL OR row_number() OVER (PARTITION BY workspace_id, external_id ORDER BY source_seq) = 1) AND (content_hash IS NULL OR row_number() OVER (PARTITION BY workspace_id, content_hash ORDER BY source_seq) = 1)),
l{m} AS (SELECT * FROM l{n} WHERE source_seq NOT IN (SELECT source_seq FROM f{n}) AND NOT EXISTS (SELECT 1 FROM f{n} f WHERE f.workspace_id = l{n}.workspace_id AND f.external_id = l{n}.external_id) AND NOT EXISTS (SELECT 1 FROM f{n} f WHERE f.workspace_id = l{n}.workspace_id AND f.content_hash = l{n}.content_hash))"""
_ROUNDS = 6  # the last list is empty on the tables, which the query reports if not


@query("src19_new_sources", """WITH s AS (SELECT * FROM sources WHERE batch_id = 0), l0 AS (SELECT source_seq, workspace_id, external_id, content_hash FROM sources n WHERE batch_id > 0
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.workspace_id = n.workspace_id AND s.external_id = n.external_id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.workspace_id = n.workspace_id AND s.content_hash = n.content_hash)),
""" + ",\n".join(_ROUND.format(n=n, m=n + 1) for n in range(_ROUNDS)) + " " + " UNION ALL ".join(f"SELECT source_seq FROM f{n}" for n in range(_ROUNDS)) + f" UNION ALL SELECT -source_seq FROM l{_ROUNDS}")
def src19_new_sources(spark, d):
    s = table(spark, d, "sources").select("source_seq", "batch_id", "workspace_id", "external_id", "content_hash")
    return store.new_sources(s.where("batch_id > 0"), s.where("batch_id = 0")).select("source_seq")


@query("src21_not_extracted", "SELECT source_seq FROM sources s WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source_id = s.id)")
def src21_not_extracted(spark, d):
    runs = table(spark, d, "mentions").select("source_id").distinct().withColumn("status", F.lit("succeeded"))
    return store.not_extracted(table(spark, d, "sources").select("id", "source_seq"), runs).select("source_seq")


@query("src31_led16_runs", "SELECT run_id, source_id, count(*) AS mentions, count(*) FILTER (entity_type = 'person') AS people, row_number() OVER (PARTITION BY source_id ORDER BY max(created_at) DESC, run_id) AS newest FROM mentions GROUP BY run_id, source_id")
def src31_led16_runs(spark, d):
    r = table(spark, d, "mentions").groupBy("run_id", "source_id").agg(F.count("*").alias("mentions"), F.count(F.when(F.col("entity_type") == "person", 1)).alias("people"), F.max("created_at").alias("started_at"))
    return r.select("run_id", "source_id", "mentions", "people", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("started_at"), "run_id")).alias("newest"))


@query("src32_workspace", "SELECT id, slug FROM workspaces WHERE slug = (SELECT min(slug) FROM workspaces)")
def src32_workspace(spark, d):
    w = table(spark, d, "workspaces").select("id", "slug")
    return store.workspace(w, w.agg(F.min("slug")).first()[0])


@query("led15_backfill", "SELECT source_seq, epoch_us(coalesce(occurred_at, (SELECT min(observed_at) FROM claims c WHERE c.source_id = s.id))) AS us FROM sources s")
def led15_backfill(spark, d):
    seen = table(spark, d, "claims").groupBy(F.col("source_id").alias("id")).agg(F.min("observed_at").alias("seen_at"))
    return store.backfill_dates(table(spark, d, "sources").select("id", "source_seq", "occurred_at"), seen).select("source_seq", F.unix_micros("occurred_at").alias("us"))


def extractions(spark, d):
    """Nested extractions rebuilt from the mention rows, as a model would have delivered them."""
    a = lambda k: jsonx.text_at(F.col("attributes"), k)
    m = table(spark, d, "mentions")
    person = F.struct(F.col("local_ref").alias("ref"), F.col("surface_form").alias("name"), "is_first_name_only", F.col("role_in_source").alias("role_in_meeting"), a("title").alias("title"), a("org").alias("organization_name"), a("email").alias("email"), a("location").alias("location"), "quote", F.col("confidence").cast("double").alias("confidence"))
    org = F.struct(F.col("local_ref").alias("ref"), F.col("surface_form").alias("name"), F.when(F.col("entity_type") == "fund", "vc_fund").otherwise("startup").alias("org_type"), a("location").alias("location"), F.col("confidence").cast("double").alias("confidence"))
    topic = F.struct(F.col("local_ref").alias("ref"), F.col("surface_form").alias("name"))
    of = lambda kinds, s: F.array_sort(F.collect_list(F.when(F.col("entity_type").isin(*kinds), s)))
    here = F.array_sort(F.collect_list(F.when((F.col("entity_type") == "person") & F.col("role_in_source").isin("attendee", "speaker"), F.col("local_ref"))))
    g = m.groupBy("run_id", "source_id").agg(of(["person"], person).alias("people"), of(["organization", "fund"], org).alias("organizations"), of(["topic"], topic).alias("topics"), F.struct(here.alias("attendee_refs")).alias("meeting"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "occurred_at")
    raw = F.to_json(F.struct("meeting", "people", "organizations", "topics"))
    return g.join(s, "source_id").select("run_id", "source_id", "occurred_at", F.lit("succeeded").alias("status"), raw.alias("raw_output"))


@query("led01_04_mentions", """SELECT run_id, local_ref, CASE WHEN entity_type IN ('organization', 'fund') THEN entity_type ELSE entity_type END AS entity_type, surface_form FROM mentions""")
def led01_04_mentions(spark, d):
    runs = ledger.sanitize(ledger.read_extractions(extractions(spark, d)))
    return ledger.mentions(runs).select("run_id", "local_ref", "entity_type", "surface_form")


@query("led05_11_set02_claims", """WITH p AS (SELECT run_id, attributes AS a, coalesce(role_in_source IN ('attendee', 'speaker'), false) AS here FROM mentions WHERE entity_type = 'person'), o AS (SELECT attributes AS a FROM mentions WHERE entity_type IN ('organization', 'fund')),
r AS (SELECT run_id, count(*) FILTER (here) AS k, count(*) FILTER (NOT here) AS m FROM p GROUP BY run_id),
n AS (SELECT 'attribute' AS claim_type, 'title' AS predicate, count(*) AS n FROM p WHERE a->>'title' <> '' UNION ALL SELECT 'attribute', 'email', count(*) FROM p WHERE a->>'email' <> ''
  UNION ALL SELECT 'attribute', 'location', (SELECT count(*) FROM p WHERE a->>'location' <> '') + (SELECT count(*) FROM o WHERE a->>'location' <> '') UNION ALL SELECT 'relationship', 'met_with', sum(k * (k - 1) // 2)::BIGINT FROM r UNION ALL SELECT 'relationship', 'mentioned', sum(k * m)::BIGINT FROM r)
SELECT * FROM n WHERE n > 0""")
def led05_11_claims(spark, d):
    runs = ledger.sanitize(ledger.read_extractions(extractions(spark, d)))
    return ledger.claims(runs).groupBy("claim_type", "predicate").agg(F.count("*").alias("n"))


# --- resolution ---------------------------------------------------------------------------------------------------


def _resolvable(spark, d):
    a = lambda k: jsonx.text_at(F.col("attributes"), k)
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "workspace_id")
    seq = F.row_number().over(W.partitionBy("run_id").orderBy("local_ref"))
    m = table(spark, d, "mentions").join(s, "source_id").select("id", "run_id", "workspace_id", "entity_type", "surface_form", "is_first_name_only", F.col("disambiguation_context").alias("context"), a("email").alias("email"), a("org").alias("org"), a("title").alias("title"), seq.alias("mention_seq"))
    e = table(spark, d, "entity_candidates").select("id", "workspace_id", "entity_type", "canonical_name", "email", "org", "title", "dossier", "aliases")
    return m, e


def _key_sql(table: str, name: str, ident: str, extra: str, email: str, org: str) -> str:
    n = _NAME.format(c=name)
    return f"""(WITH a AS (SELECT {ident} AS id, {extra}, {n} AS n, {email} AS e, {org} AS o FROM {table}), p AS (SELECT *, string_split(n, ' ') AS t FROM a WHERE n <> '')
  SELECT id, ws, kind, 'n:' || n AS key FROM p UNION SELECT id, ws, kind, 'l:' || t[-1] FROM p WHERE len(t) > 1 UNION SELECT id, ws, kind, 'fl:' || left(t[1], 1) || ':' || t[-1] FROM p WHERE len(t) > 1 UNION SELECT id, ws, kind, 'f:' || t[1] FROM p WHERE len(t) = 1
  UNION SELECT id, ws, kind, 'e:' || lower(trim(e)) FROM p WHERE e <> '' UNION SELECT id, ws, kind, 'd:' || lower(string_split(e, '@')[2]) FROM p WHERE contains(e, '@') UNION SELECT id, ws, kind, 'o:' || {_ORG.format(c='o')} FROM p WHERE o <> '')"""


_MENTION_KEYS = _key_sql("mentions m JOIN sources s ON s.id = m.source_id", "m.surface_form", "m.id", "s.workspace_id AS ws, CASE m.entity_type WHEN 'fund' THEN 'organization' ELSE m.entity_type END AS kind", "m.attributes->>'email'", "m.attributes->>'org'")
_FAMILY = "CASE {c} WHEN 'fund' THEN 'organization' ELSE {c} END AS kind"
_ALL_NAMES = "(SELECT id, workspace_id, entity_type, email, org, unnest(list_distinct(list_concat([canonical_name], list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL AND trim(a) <> '' AND NOT contains(a, '@'))))) AS name FROM entity_candidates)"
_CANDIDATE_KEYS = _key_sql(_ALL_NAMES, "name", "id", "workspace_id AS ws, " + _FAMILY.format(c="entity_type"), "email", "org")


@query("join01_res_candidates", f"""WITH k AS {_MENTION_KEYS}, c AS {_CANDIDATE_KEYS}, j AS (SELECT k.id AS mention_id, c.id AS entity_id, count(*) AS shared FROM k JOIN c USING (ws, kind, key) GROUP BY ALL)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY shared DESC, entity_id) <= 40""")
def join01_candidates(spark, d):
    return resolve.candidates(*_resolvable(spark, d))


@query("res01_02_scores")
def res01_02_scores(spark, d):
    p = resolve.scored_pairs(*_resolvable(spark, d))
    return p.select("mention_id", "entity_id", _r("total").alias("total"), "blocked", "verdict")


@query("res04_05_decisions")
def res04_05_decisions(spark, d):
    m, e = _resolvable(spark, d)
    return resolve.decide(m, written(resolve.scored_pairs(m, e), "pairs")).select("mention_id", "run_id", "action", "entity_id", "method", _r("score").alias("score"), "status")


@query("res03_local_matches", f"""WITH n AS (SELECT id, run_id, is_first_name_only AS bare, string_split({_NAME.format(c='surface_form')}, ' ') AS t FROM mentions WHERE entity_type = 'person'),
f AS (SELECT run_id, t[1] AS first, count(*) AS n, min(id) AS full_mention_id FROM n WHERE len(t) > 1 GROUP BY ALL)
SELECT n.id AS mention_id, f.full_mention_id FROM n JOIN f ON f.run_id = n.run_id AND f.first = n.t[1] WHERE bare AND f.n = 1""")
def res03_local_matches(spark, d):
    return resolve.local_matches(table(spark, d, "mentions").select("id", "run_id", "entity_type", "surface_form", "is_first_name_only"))


@query("res13_merge_chains", "WITH RECURSIVE up AS (SELECT id, merged_into AS winner FROM entities WHERE merged_into IS NOT NULL UNION ALL SELECT up.id, e.merged_into FROM up JOIN entities e ON e.id = up.winner WHERE e.merged_into IS NOT NULL) SELECT up.id AS loser, up.winner FROM up JOIN entities e ON e.id = up.winner WHERE e.merged_into IS NULL")
def res10_13_merge_chains(spark, d):
    m = table(spark, d, "entities").where("merged_into IS NOT NULL").select(F.col("id").alias("loser"), F.col("merged_into").alias("winner"))
    return resolve.apply_merges(m)


@query("res08_longest_form", f"WITH {_LINKS} SELECT entity_id, arg_max(surface_form, (length(surface_form), surface_form)) AS longest FROM links l JOIN mentions m ON m.id = l.mention_id GROUP BY entity_id")
def res08_longest_form(spark, d):
    m = table(spark, d, "mentions").select(F.col("id").alias("mention_id"), "surface_form")
    return links(spark, d).join(m, "mention_id").groupBy("entity_id").agg(F.max_by("surface_form", F.struct(F.length("surface_form"), "surface_form")).alias("longest"))


@query("res06_aliases", f"WITH c AS {_CANDIDATE_KEYS} SELECT DISTINCT id AS entity_id, key FROM c JOIN entity_candidates e USING (id) WHERE e.entity_type = 'person'")
def res06_aliases(spark, d):
    _, e = _resolvable(spark, d)
    return resolve.aliases(e.where("entity_type = 'person'")).select("entity_id", "key")


# --- graph --------------------------------------------------------------------------------------------------------

_PAIRS = "p AS (SELECT DISTINCT workspace_id, a, b FROM adj)"


@query("gra06_reach", f"""WITH {_EDGES}, {_ADJ}, {_PAIRS}, r1 AS (SELECT DISTINCT workspace_id, a AS s, b AS n FROM p), r2 AS (SELECT DISTINCT r1.workspace_id, s, p.b AS n FROM r1 JOIN p ON p.workspace_id = r1.workspace_id AND p.a = r1.n), r3 AS (SELECT DISTINCT r2.workspace_id, s, p.b AS n FROM r2 JOIN p ON p.workspace_id = r2.workspace_id AND p.a = r2.n),
hop AS (SELECT * FROM r1 UNION SELECT * FROM r2 UNION SELECT * FROM r3) SELECT workspace_id, s AS node, count(*) AS reach FROM hop WHERE s <> n GROUP BY ALL""")
def gra06_reach(spark, d):
    return graph.reach_counts(written(edges(spark, d).select("workspace_id", "src", "dst"), "edges"), 3)


@query("gra07_brokerage", f"""WITH {_EDGES}, {_ADJ}, {_PAIRS}, r1 AS (SELECT DISTINCT workspace_id, a AS s, b AS n FROM p), r2 AS (SELECT DISTINCT r1.workspace_id, s, p.b AS n FROM r1 JOIN p ON p.workspace_id = r1.workspace_id AND p.a = r1.n), r3 AS (SELECT DISTINCT r2.workspace_id, s, p.b AS n FROM r2 JOIN p ON p.workspace_id = r2.workspace_id AND p.a = r2.n),
hop AS (SELECT * FROM r1 UNION SELECT * FROM r2 UNION SELECT * FROM r3), reach AS (SELECT workspace_id, s AS node, count(*) AS reach FROM hop WHERE s <> n GROUP BY ALL),
x AS (SELECT p.workspace_id, p.a AS me, p.b AS n, q.b AS x FROM p JOIN p q ON q.workspace_id = p.workspace_id AND q.a = p.b WHERE q.b <> p.a), y AS (SELECT x.workspace_id, me, n, q.b AS x FROM x JOIN p q ON q.workspace_id = x.workspace_id AND q.a = x.x WHERE q.b <> me),
k AS (SELECT workspace_id, me, n, count(*) AS k FROM (SELECT * FROM x WHERE x <> n UNION SELECT * FROM y WHERE x <> n) GROUP BY ALL), b AS (SELECT workspace_id, me AS node, max(k) AS w FROM k GROUP BY ALL)
SELECT reach.node, reach, round(greatest(0.0, (reach - coalesce(w, 0)) / reach::DOUBLE), 6) AS brokerage FROM reach LEFT JOIN b USING (workspace_id, node)""")
def gra07_brokerage(spark, d):
    return graph.brokerage(written(edges(spark, d).select("workspace_id", "src", "dst"), "edges")).select("node", "reach", _r("brokerage").alias("brokerage"))


def _selves(e: DataFrame) -> DataFrame:
    """The best connected node of each workspace stands for the user."""
    d = graph.degrees(e)
    return d.groupBy("workspace_id").agg(F.max_by("node", F.struct("degree", "node")).alias("start"))


@query("gra02_03_05_paths")
def gra02_paths(spark, d):
    e = written(edges(spark, d), "edges")
    p = graph.shortest_paths(e, _selves(e)).where("hops > 0")
    return p.select("workspace_id", "start", "node", _r("cost").alias("cost"), "hops", F.array_join("path", " > ").alias("path"), _r(F.exp(-F.col("cost"))).alias("probability"))


@query("gra02_bounded_paths", f"""WITH RECURSIVE {_EDGES}, adjc AS (SELECT workspace_id, src AS a, dst AS b, -ln(probability) AS c FROM edges UNION ALL SELECT workspace_id, dst, src, -ln(probability) FROM edges), st AS (SELECT workspace_id, a, b, min(c) AS c FROM adjc GROUP BY ALL),
dg AS (SELECT workspace_id, a AS node, count(*) AS degree FROM adjc GROUP BY ALL), sv AS (SELECT workspace_id, arg_max(node, (degree, node)) AS s FROM dg GROUP BY workspace_id),
r1 AS (SELECT st.workspace_id, s, b AS n, c FROM sv JOIN st ON st.workspace_id = sv.workspace_id AND st.a = sv.s), r2 AS (SELECT r1.workspace_id, s, st.b AS n, min(r1.c + st.c) AS c FROM r1 JOIN st ON st.workspace_id = r1.workspace_id AND st.a = r1.n GROUP BY ALL), r3 AS (SELECT r2.workspace_id, s, st.b AS n, min(r2.c + st.c) AS c FROM r2 JOIN st ON st.workspace_id = r2.workspace_id AND st.a = r2.n GROUP BY ALL)
SELECT workspace_id, s AS start, n AS node, round(min(c), 6) AS cost FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE n <> s GROUP BY ALL""")
def gra02_bounded_paths(spark, d):
    e = written(edges(spark, d), "edges")
    return graph.bounded_paths(e, _selves(e), 3).select("workspace_id", "start", "node", _r("cost").alias("cost"))


@query("gra04_top05_alternatives")
def gra04_alternatives(spark, d):
    e = written(edges(spark, d), "edges")
    far = graph.shortest_paths(e, _selves(e)).where("hops >= 2")
    pair = far.groupBy("workspace_id", "start").agg(F.min_by("node", F.struct("cost", "node")).alias("target"))
    return graph.alternatives(e, written(pair, "pairs")).select("workspace_id", "start", "node", "ban", _r("cost").alias("cost"), "hops", F.array_join("path", " > ").alias("path"))


@query("agg09_top04_connectors")
def agg09_connectors(spark, d):
    e = written(edges(spark, d), "edges")
    c = graph.connectors(graph.shortest_paths(e, _selves(e)))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("score"), "connector"))).where("rank <= 6").select("workspace_id", "connector", "unlocks", _r("score").alias("score"), "rank")


@query("gra12_components", f"""WITH RECURSIVE {_EDGES}, {_ADJ}, {_PAIRS}, r AS (SELECT a AS node, a AS other FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node""")
def gra12_components(spark, d):
    e = written(edges(spark, d).select("src", "dst"), "edges")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return graph.components(nodes, e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _tasks(spark, d):
    """A dependency graph on the parts: each needs the part of half its key."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("task"), F.expr("p_partkey div 2").alias("needs")).where("needs > 0")
    return table(spark, d, "part").select(F.col("p_partkey").alias("node")), p


@query("gra08_13_levels", "SELECT p_partkey AS node, floor(log2(greatest(p_partkey, 1)))::INT AS level FROM part")
def gra08_13_levels(spark, d):
    return graph.levels(*_tasks(spark, d))


@query("gra10_agg18_downstream", "WITH RECURSIVE r AS (SELECT p_partkey AS node, p_partkey // 2 AS source FROM part WHERE p_partkey > 1 UNION ALL SELECT node, source // 2 FROM r WHERE source > 1) SELECT source, count(*) AS n FROM r GROUP BY source")
def gra10_downstream(spark, d):
    nodes, p = _tasks(spark, d)
    return graph.downstream(p, nodes).groupBy("source").agg(F.count("*").alias("n"))


@query("gra09_blockers", "SELECT p_partkey AS id, p_partkey // 2 AS blocker FROM part WHERE p_partkey > 1 AND (p_partkey // 2) % 3 <> 0")
def gra09_brd10_blockers(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("resolved"), F.when(F.col("p_partkey") > 1, F.array(F.expr("p_partkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("depends_on"))
    return boards.blockers(items)


@query("gra11_connect", "SELECT * FROM (VALUES ('1', '1', 'self'), ('1', '999999999', 'missing'), ('2', '4', 'duplicate'), ('4', '2', 'cycle'), ('3', '4', 'ok')) t(source, target, answer)")
def gra11_connect(spark, d):
    """Whether one task may wait for another, on the tasks of `_tasks`: each waits for the one of half its key."""
    k = F.col("p_partkey")
    items = written(table(spark, d, "part").select(k.cast("string").alias("id"), F.when(k > 1, F.array(F.expr("CAST(p_partkey div 2 AS STRING)"))).otherwise(F.array().cast("array<string>")).alias("depends_on")), "items")
    asked = [("1", "1"), ("1", "999999999"), ("2", "4"), ("4", "2"), ("3", "4")]
    return spark.createDataFrame([(s, t, boards.connect(items, s, t) or "ok") for s, t in asked], "source string, target string, answer string")


@query("brd06_gra08_errors", "SELECT 'missing target' AS error, p_partkey AS id FROM part WHERE p_partkey % 10 = 1 AND p_partkey > 1")
def brd06_errors(spark, d):
    need = F.when((F.col("p_partkey") % 10 == 1) & (F.col("p_partkey") > 1), F.array(-F.col("p_partkey"))).otherwise(F.array(F.col("p_partkey")))
    return boards.board_errors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), need.alias("depends_on")))


@query("set04_clean_dependencies", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def set04_set05_clean_dependencies(spark, d):
    need = F.array(F.when(F.col("p_partkey") % 2 == 0, F.expr("p_partkey div 2")).otherwise(-F.col("p_partkey")))
    c = boards.clean_dependencies(table(spark, d, "part").select(F.col("p_partkey").alias("id"), need.alias("depends_on")))
    return c.select("id", F.size("depends_on").alias("n"))


def _boards(spark, d):
    """Task boards on the notes: one task a note, its sentences the steps."""
    sent = F.filter(F.split(F.coalesce("notes", F.lit("")), r"(?<=[.?!]) "), lambda s: F.trim(s) != "")
    steps = F.transform(sent, lambda s, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), s.alias("text"), (i % 2 == 0).alias("done"), F.lit(None).cast("string").alias("completedAt")))
    return table(spark, d, "granola_notes").select("row_id", "workspace_id", steps.alias("steps"), (F.col("row_id") % 3 == 0).alias("resolved"))


@query("brd02_04_agg22_steps")
def brd02_04_steps(spark, d):
    b = _boards(spark, d)
    none = F.array().cast(boards.HISTORY)
    return b.select("row_id", F.size(F.filter(boards.complete_next(F.col("steps"), F.lit("2024-01-01")), lambda s: s["done"])).alias("after"), boards.progress(F.col("steps"), none, F.lit("call")).alias("p"), F.size(boards.trail(F.array().cast("array<string>"), F.col("steps"), F.lit("call"))).alias("trail")).select("row_id", "after", "p.done", "p.total", "trail")


@query("fil10_11_agg17_tasks", "SELECT workspace_id, count(*) FILTER (row_id % 3 <> 0) AS open, count(*) FILTER (row_id % 3 <> 0 AND (row_id % 2 = 0 OR exported_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00')) AS mine FROM granola_notes GROUP BY workspace_id")
def fil10_agg17_tasks(spark, d):
    n = table(spark, d, "granola_notes")
    move = boards.needs_my_move(F.col("row_id") % 3 == 0, F.col("row_id") % 2 == 0, F.col("exported_at"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return n.groupBy("workspace_id").agg(F.count(F.when(F.col("row_id") % 3 != 0, 1)).alias("open"), F.count(F.when(move, 1)).alias("mine"))


@query("fil12_tag_groups", "SELECT id FROM entities WHERE entity_type IN ('person', 'fund') AND status IN ('active')")
def fil12_tag_groups(spark, d):
    tags = F.array("entity_type", "status")
    return table(spark, d, "entities").where(boards.tag_match(tags, {"kind": ["person", "fund"], "status": ["active"]})).select("id")


@query("agg19_agg23_lanes", "SELECT workspace_id, count(*) AS members, count(DISTINCT entity_type) AS lanes, min(id) AS first_member FROM entities GROUP BY workspace_id")
def agg19_lanes(spark, d):
    return table(spark, d, "entities").groupBy("workspace_id").agg(F.count("*").alias("members"), F.countDistinct("entity_type").alias("lanes"), F.min("id").alias("first_member"))


# --- search -------------------------------------------------------------------------------------------------------


def _questions(spark, d):
    """One question a workspace: its first note's title, asked with the vector of its best connected node."""
    n = table(spark, d, "granola_notes").where("title IS NOT NULL").groupBy("workspace_id").agg(F.min_by("title", "row_id").alias("question"))
    g = table(spark, d, "graph_nodes").where(F.size("embedding") == 64).groupBy("workspace_id").agg(F.max_by(F.struct("id", "embedding", "name"), F.struct("degree", "id")).alias("b"))
    none = F.array().cast("array<string>")
    q = n.join(g, "workspace_id").select(F.col("workspace_id").alias("question_id"), "workspace_id", "question", F.col("b.embedding").alias("query_vector"), F.array("b.id").alias("exclude_ids"), F.lit("capital").alias("org_match"), F.array(F.lit("cold chain")).alias("sectors"), F.array(F.lit("person"), F.lit("organization"), F.lit("fund")).alias("entity_types"))
    return search.heuristic_plan(q)


@query("sea03_top01_fil07_retrieval")
def sea03_retrieval(spark, d):
    r = search.retrieve(table(spark, d, "graph_nodes"), _questions(spark, d))
    return r.select("question_id", "id", _r("score").alias("score"), F.array_join("reasons", "; ").alias("reasons"), "rank")


@query("sea03_lexical_score", """SELECT id, round(least(0.35, 0.12 * (contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'board')::INT + contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'forecast')::INT))
  + CASE WHEN contains(lower(name), 'capital') THEN 0.45 WHEN contains(lower(coalesce(attributes->>'org', '')), 'capital') THEN 0.4 WHEN contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'capital') THEN 0.15 ELSE 0 END + least(0.08, coalesce(source_count, 0) * 0.02), 6) AS score FROM graph_nodes
WHERE least(0.35, 0.12 * (contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'board')::INT + contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'forecast')::INT))
  + CASE WHEN contains(lower(name), 'capital') THEN 0.45 WHEN contains(lower(coalesce(attributes->>'org', '')), 'capital') THEN 0.4 WHEN contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(dossier, ''))), 'capital') THEN 0.15 ELSE 0 END + least(0.08, coalesce(source_count, 0) * 0.02) > 0.05""")
def sea03_lexical_score(spark, d):
    s = search.hybrid_score(table(spark, d, "graph_nodes"), F.lit(0.0), F.array(F.lit("board"), F.lit("forecast")), F.lit("capital"), F.array().cast("array<string>"))
    return s.select("id", _r("score").alias("score"))


@query("sea04_top03_search")
def sea04_search(spark, d):
    """Retrieval by text over the ledger's own entities, routed through the projected edges."""
    led = written(joined(spark, d), "ledger")
    e = written(project.edges(led, _as_of()), "edges")
    counts = project.entity_counters(links(spark, d), table(spark, d, "sources").select("id", "occurred_at", "ingested_at"))
    n = links(spark, d).select("workspace_id", F.col("entity_id").alias("id"), F.col("entity_type").alias("node_type")).distinct().join(counts.select(F.col("entity_id").alias("id"), "source_count"), "id")
    n = n.select("*", F.split_part("id", F.lit(":"), F.lit(3)).alias("name"), F.lit(None).cast("string").alias("dossier"), F.lit("{}").alias("attributes"), F.lit(None).cast("array<float>").alias("embedding"))
    q = _questions(spark, d).drop("query_vector").withColumn("query_vector", F.lit(None).cast("array<float>"))
    found = search.retrieve(n, q)
    paths = graph.shortest_paths(e, _selves(e)).where("hops > 0")
    return search.routes(found, paths).select("question_id", "id", _r("value").alias("value"), "rn", "hops")


# --- views of edges and routes, manual curation, board details ----------------------------------------------------


@query("prj04_edge_view", f"""WITH {_EDGES} SELECT src, dst, relationship_type, ended, round(probability, 6) AS probability, CASE WHEN probability >= 0.75 THEN 'very strong' WHEN probability >= 0.55 THEN 'strong' WHEN probability >= 0.35 THEN 'moderate' WHEN probability >= 0.18 THEN 'weak' ELSE 'faint' END AS label,
  replace(relationship_type, '_', ' ') AS words, evidence_count FROM edges""")
def prj04_edge_view(spark, d):
    p = F.col("probability")
    return edges(spark, d).select("src", "dst", "relationship_type", "ended", _r(p).alias("probability"), scoring.strength_label(p).alias("label"), text.spaced(F.col("relationship_type")).alias("words"), "evidence_count")


@query("prj06_serialised")
def prj06_serialised(spark, d):
    e = written(edges(spark, d), "edges")
    p = graph.shortest_paths(e, _selves(e)).where("hops > 0")
    return p.select("workspace_id", "node", F.to_json(F.struct("start", "node", "hops", _r("cost").alias("cost"), _r(F.exp(-F.col("cost"))).alias("probability"), "path")).alias("route"))


@query("prj07_sea05_context")
def prj07_context(spark, d):
    g = table(spark, d, "graph_nodes")
    found = search.retrieve(g, _questions(spark, d))
    near = found.withColumn("path", F.array("question_id", "id")).withColumn("rn", F.col("rank"))
    return search.prompt_context(found, near)


@query("prj08_route_cards")
def prj08_route_cards(spark, d):
    """Each hop of each route with the best quoted evidence of its edge."""
    led = written(joined(spark, d), "ledger")
    e = written(project.edges(led, _as_of()), "edges")
    p = graph.shortest_paths(e, _selves(e)).where("hops > 0")
    hops = p.select("workspace_id", "node", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("hop", "h")).select("workspace_id", "node", "hop", "h.a", "h.b")
    c = project.edge_claims(led).where("quote IS NOT NULL").select("workspace_id", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.col("confidence").alias("w"), "claim_no", "quote")
    best = c.groupBy("workspace_id", "x", "y").agg(F.max_by("quote", F.struct("w", -F.col("claim_no"))).alias("quote"))
    return hops.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(best, ["workspace_id", "x", "y"], "left").select("workspace_id", "node", "hop", "a", "b", "quote")


@query("top02_best_paths")
def top02_best_paths(spark, d):
    e = written(edges(spark, d), "edges")
    p = graph.shortest_paths(e, _selves(e)).where("hops > 0")
    return p.withColumn("rank", F.row_number().over(W.partitionBy("workspace_id", "start").orderBy("cost", "node"))).where("rank <= 8").select("workspace_id", "node", _r("cost").alias("cost"), "rank")


@query("top09_gra15_selection", f"""WITH {_EDGES}, sel AS (SELECT min(src) AS n FROM edges), x AS (SELECT CASE WHEN src = n THEN dst ELSE src END AS other, relationship_type, round(strength, 6) AS strength FROM edges, sel WHERE src = n OR dst = n)
SELECT other, relationship_type, strength FROM x ORDER BY strength DESC, other, relationship_type LIMIT 4""")
def top09_gra15_selection(spark, d):
    e = written(edges(spark, d).select("src", "dst", "relationship_type", _r("strength").alias("strength")), "edges")
    n = e.agg(F.min("src").alias("n"))
    x = e.crossJoin(F.broadcast(n)).where("src = n OR dst = n")  # one selected node
    return x.select(F.when(F.col("src") == F.col("n"), F.col("dst")).otherwise(F.col("src")).alias("other"), "relationship_type", "strength").orderBy(F.desc("strength"), "other", "relationship_type").limit(4)


@query("top12_completed", "SELECT id, row_number() OVER (PARTITION BY workspace_id ORDER BY updated_at DESC NULLS LAST, id) AS rank FROM entities WHERE status = 'merged'")
def top12_completed(spark, d):
    """What is settled, the last one first, by workspace."""
    e = table(spark, d, "entities").where("status = 'merged'")
    return e.select("id", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc_nulls_last("updated_at"), "id")).alias("rank"))


@query("win09_brd01_resolved_at", "SELECT row_id, 't' || row_id % 5 AS at FROM granola_notes")
def win09_brd01_resolved_at(spark, d):
    c = lambda v: F.lit(v)
    none = F.lit(None).cast(boards.HISTORY)
    first = boards.recorded(none, c("h1"), c("t9"), c("resolved"), c("x"))
    h = boards.recorded(boards.recorded(first, c("h2"), F.concat(c("t"), (F.col("row_id") % 5).cast("string")), c("resolved"), c("y")), c("h3"), c("t0"), c("moved"), c("z"))
    return table(spark, d, "granola_notes").select("row_id", boards.resolved_at(h).alias("at"))


@query("brd03_lines", "SELECT row_id, len(list_filter(list_transform(string_split(notes, chr(10)), lambda l: trim(regexp_replace(l, '^\\\\s*(?:[-*•]|\\\\d+[.)])\\\\s*', ''))), lambda l: l <> ''))::INT AS n FROM granola_notes WHERE notes IS NOT NULL".replace("\\\\", "\\"))
def brd03_lines(spark, d):
    return table(spark, d, "granola_notes").where("notes IS NOT NULL").select("row_id", F.size(boards.plan_lines(F.col("notes"))).alias("n"))


@query("brd05_moved", "SELECT id, row_number() OVER (PARTITION BY list ORDER BY k, id) - 1 AS pos FROM (SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 0 ELSE p_partkey % 4 END AS list, CASE WHEN p_partkey = 7 THEN 7.5 ELSE p_partkey END AS k FROM part)")
def brd05_moved(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 4).cast("string").alias("list"), F.col("p_partkey").alias("pos"))
    m = boards.move_item(items.withColumn("id", F.lpad("id", 9, "0")), "000000007", "0", "000000008")
    return m.select(F.col("id").cast("long").alias("id"), "pos")


@query("brd07_join16_lanes", "SELECT row_id, coalesce(sum(25) OVER (PARTITION BY workspace_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS top FROM granola_notes")
def brd07_lanes(spark, d):
    n = table(spark, d, "granola_notes").select(F.col("workspace_id").alias("unit"), F.col("row_id").alias("position"), F.lit(20).alias("height"))
    return boards.lanes(n, 5).select(F.col("position").alias("row_id"), F.col("top").cast("double").alias("top"))


@query("res07_link_upsert", "SELECT id AS mention_id, max(claim_no) AS written_at FROM claims GROUP BY id")
def res07_link_upsert(spark, d):
    c = table(spark, d, "claims").select(F.col("id").alias("mention_id"), F.col("claim_no").alias("written_at"), F.col("source_id").alias("entity_id"), F.lit("exact").alias("method"), F.col("confidence").alias("score"))
    return resolve.latest_links(c).select("mention_id", "written_at")


@query("res09_review_queue")
def res09_review_queue(spark, d):
    return resolve.review_queue(resolve.scored_pairs(*_resolvable(spark, d))).select("mention_id", "candidate_id", _r("score").alias("score"))


@query("res11_manual_upsert", "SELECT id, CASE WHEN mention_count > 5 THEN upper(canonical_name) ELSE canonical_name END AS canonical_name FROM entities UNION ALL SELECT 'new', 'New Person'")
def res11_manual_upsert(spark, d):
    e = table(spark, d, "entities").select("id", "canonical_name", "mention_count")
    changes = e.where("mention_count > 5").select("id", F.upper("canonical_name").alias("canonical_name")).unionByName(spark.createDataFrame([("new", "New Person")], "id string, canonical_name string"))
    return resolve.upsert_entities(e, changes).select("id", "canonical_name")


@query("res12_soft_delete", "SELECT id, CASE WHEN mention_count = 0 THEN 'deleted' ELSE status END AS status FROM entities")
def res12_soft_delete(spark, d):
    e = table(spark, d, "entities").select("id", "status", "mention_count")
    return resolve.delete_entities(e, e.where("mention_count = 0")).select("id", "status")


@query("res15_self", "SELECT w.id, (SELECT max(e.id) FROM entities e WHERE e.id = w.self_entity_id AND e.workspace_id = w.id AND e.entity_type = 'person' AND e.status NOT IN ('merged', 'deleted')) AS self_entity_id FROM workspaces w")
def res15_self(spark, d):
    return resolve.valid_self(table(spark, d, "workspaces").select("id", "self_entity_id"), table(spark, d, "entities").select("id", "workspace_id", "entity_type", "status")).select("id", "self_entity_id")


@query("src30_boards", "SELECT id AS workspace_id, CASE WHEN length(slug) % 2 = 0 THEN 4 ELSE 3 END AS revision FROM workspaces")
def src30_boards(spark, d):
    w = table(spark, d, "workspaces").select(F.col("id").alias("workspace_id"), F.lit(3).alias("revision"), F.lit("old").alias("document"), "slug")
    changes = w.select("workspace_id", F.when(F.length("slug") % 2 == 0, 3).otherwise(2).alias("revision"), F.lit("new").alias("document"))
    return store.replace_board(w.drop("slug"), changes)[0].select("workspace_id", "revision")


@query("src_stream_windows", "SELECT epoch_us(date_trunc('day', exported_at)) AS start_us, count(*) AS notes FROM granola_notes WHERE exported_at IS NOT NULL GROUP BY ALL")
def src_stream_windows(spark, d):
    """The windowed counts of the stream, over the table as a batch: the same plan without its watermark."""
    from kithgraph.streaming.ingest import arrivals_per_window

    return arrivals_per_window(table(spark, d, "granola_notes")).select(F.unix_micros("start").alias("start_us"), "notes")


# --- operators that also appear inside others ---------------------------------------------------------------------


@query("src20_by_external_ids", "SELECT min(source_seq) AS source_seq FROM sources WHERE external_id IN (SELECT external_id FROM sources WHERE batch_id > 0 AND external_id IS NOT NULL) GROUP BY workspace_id, external_id")
def src20_by_external_ids(spark, d):
    s = table(spark, d, "sources").select("source_seq", "workspace_id", "external_id", "batch_id")
    return store.sources_by_external_ids(s, s.where("batch_id > 0 AND external_id IS NOT NULL")).select("source_seq")


@query("src27_seed_workspaces", "SELECT id, slug FROM workspaces UNION ALL SELECT 'new', 'new-slug'")
def src27_seed_workspaces(spark, d):
    from kithgraph.schemas import seed_workspace

    w = table(spark, d, "workspaces").select("id", "slug")
    again = w.orderBy("slug").limit(1).withColumn("id", F.lit("other"))  # a slug that is there
    new = spark.createDataFrame([("new", "new-slug")], "id string, slug string")
    return seed_workspace(seed_workspace(w, again), new)


@query("fil08_path_filters", f"WITH {_EDGES} SELECT workspace_id, src, dst, relationship_type FROM edges WHERE strength >= 0.2 AND relationship_type NOT IN ('mentioned', 'met_with') AND NOT starts_with(dst, 't')")
def fil08_path_filters(spark, d):
    return edges(spark, d).where((F.col("strength") >= 0.2) & ~F.col("relationship_type").isin("mentioned", "met_with") & ~F.col("dst").startswith("t")).select("workspace_id", "src", "dst", "relationship_type")


@query("win07_forward_fill", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS since FROM events")
def win07_forward_fill(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("since"))


@query("top11_candidate_cap", f"""WITH k AS {_MENTION_KEYS}, c AS {_CANDIDATE_KEYS}, j AS (SELECT k.id AS mention_id, c.id AS entity_id, count(*) AS shared FROM k JOIN c USING (ws, kind, key) GROUP BY ALL)
SELECT mention_id, entity_id FROM j QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY shared DESC, entity_id) <= 3""")
def top11_candidate_cap(spark, d):
    return resolve.candidates(*_resolvable(spark, d), cap=3).select("mention_id", "entity_id")


@query("set05_restore", "SELECT p_partkey AS id, list_sort(list_distinct(list_concat([p_partkey % 3], list_filter([p_partkey % 5, p_partkey % 7], lambda x: x IN (1, 2, 6)))))[1] AS low, len(list_distinct(list_concat([p_partkey % 3], list_filter([p_partkey % 5, p_partkey % 7], lambda x: x IN (1, 2, 6)))))::INT AS n FROM part")
def set05_restore(spark, d):
    k = F.col("p_partkey")
    r = boards.restore_dependencies(F.array(k % 3), F.array(k % 5, k % 7), F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 6)]))
    return table(spark, d, "part").select(k.alias("id"), F.array_min(r).alias("low"), F.size(r).alias("n"))


@query("jsn03_set_key", "SELECT id, 'x' AS title, attributes->>'location' AS location FROM entities")
def jsn03_set_key(spark, d):
    m = jsonx.set_key(jsonx.as_map(F.col("attributes")), "title", F.lit("x"))
    return table(spark, d, "entities").select("id", F.element_at(m, "title").alias("title"), F.element_at(m, "location").alias("location"))


@query("jsn04_strip_empty", "SELECT id, len(list_filter(json_keys(attributes), lambda k: json_extract_string(attributes, '$.' || k) IS NOT NULL AND json_extract_string(attributes, '$.' || k) <> '[]'))::INT AS n FROM entities")
def jsn04_strip_empty(spark, d):
    return table(spark, d, "entities").select("id", F.size(jsonx.strip_empty(jsonx.as_map(F.col("attributes")))).alias("n"))


@query("res10_verdicts", "SELECT id AS loser, (SELECT min(e.id) FROM entities e WHERE e.workspace_id = r.workspace_id AND e.entity_type = r.entity_type AND e.status = 'active') AS winner FROM entities r WHERE status = 'needs_review' AND mention_count % 2 = 0 AND id <> (SELECT min(e.id) FROM entities e WHERE e.workspace_id = r.workspace_id AND e.entity_type = r.entity_type AND e.status = 'active')")
def res10_verdicts(spark, d):
    e = table(spark, d, "entities").select("id", "workspace_id", "entity_type", "status", "mention_count")
    best = e.where("status = 'active'").groupBy("workspace_id", "entity_type").agg(F.min("id").alias("candidate_id"))
    reviews = e.where("status = 'needs_review'").join(best, ["workspace_id", "entity_type"]).select(F.col("id").alias("review_id"), F.col("id").alias("entity_id"), "candidate_id", "mention_count", F.lit(None).cast("string").alias("verdict"))
    verdicts = reviews.select("review_id", F.when(F.col("mention_count") % 2 == 0, "same").otherwise("different").alias("verdict"))
    return resolve.review_verdicts(reviews, verdicts)[1]


@query("gra01_loaded_graph", f"WITH {_EDGES}, {_ADJ}, n AS (SELECT workspace_id, count(DISTINCT a) AS nodes, count(*) AS steps FROM adj GROUP BY workspace_id) SELECT * FROM n")
def gra01_loaded_graph(spark, d):
    a = graph.adjacency(edges(spark, d))
    return a.groupBy("workspace_id").agg(F.countDistinct("a").alias("nodes"), F.count("*").alias("steps"))


@query("sea01_02_plans", """WITH t AS (SELECT row_id, title, regexp_matches(lower(title), '\\b(access|reach|intro|introduc|connect|get to|warm|path)\\b') AS p, regexp_matches(lower(title), '\\bhow do i know\\b|\\bconnection to\\b|\\brelationship with\\b') AS x FROM granola_notes WHERE title IS NOT NULL)
SELECT row_id, CASE WHEN x THEN 'explain_link' WHEN p THEN 'find_path' ELSE 'find_people' END AS intent, CASE WHEN p THEN 3 ELSE 4 END AS max_hops, CASE WHEN p THEN 0.25 ELSE 0 END::DOUBLE AS min_strength FROM t""")
def sea01_02_plans(spark, d):
    n = table(spark, d, "granola_notes").where("title IS NOT NULL").select("row_id", F.col("title").alias("question"))
    return search.heuristic_plan(n).select("row_id", "intent", "max_hops", "min_strength")


@query("brd09_trail", "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'old > a > call > b' ELSE 'old > a > b > call' END AS trail FROM granola_notes")
def brd09_trail(spark, d):
    step = lambda i, t, done: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"), done.alias("done"))
    steps = F.array(step("1", "a", F.lit(True)), step("2", "b", F.col("row_id") % 2 == 1))
    return table(spark, d, "granola_notes").select("row_id", F.array_join(boards.trail(F.array(F.lit("old")), steps, F.lit("call")), " > ").alias("trail"))


@query("brd10_resolvable", "SELECT p_partkey AS id FROM part WHERE NOT (p_partkey > 1 AND (p_partkey // 2) % 3 <> 0)")
def brd10_resolvable(spark, d):
    """Tasks that may be resolved: no blocker is open."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("resolved"), F.when(F.col("p_partkey") > 1, F.array(F.expr("p_partkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("depends_on"))
    return items.select("id").join(boards.blockers(items).select("id"), "id", "left_anti")
