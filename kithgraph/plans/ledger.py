"""From nested extractions to flat mentions and claims, and the joined ledger every projection starts from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph import dims
from kithgraph.functions import text

PEOPLE = "array<struct<ref:string,name:string,is_first_name_only:boolean,aliases:array<string>,role_in_meeting:string,title:string,organization_ref:string,organization_name:string,seniority:string,email:string,location:string,expertise:array<string>,interests:array<string>,disambiguation_context:string,quote:string,confidence:double>>"
ORGANIZATIONS = "array<struct<ref:string,name:string,aliases:array<string>,org_type:string,sector:array<string>,stage:string,location:string,description:string,notable_facts:array<string>,confidence:double>>"
TOPICS = "array<struct<ref:string,name:string,kind:string,discussed_by_refs:array<string>,summary:string>>"
RELATIONS = "array<struct<src_ref:string,dst_ref:string,type:string,explicitness:string,polarity:string,strength_signal:string,warmth_signal:string,since:string,until:string,context:string,quote:string,confidence:double>>"
INTROS = "array<struct<connector_ref:string,target_ref:string,basis:string,offered:boolean,quote:string,confidence:double>>"
ASKS = "array<struct<actor_ref:string,kind:string,what:string,urgency:string,quote:string>>"
COMMITMENTS = "array<struct<actor_ref:string,action:string,due_hint:string,quote:string>>"
HOOKS = "array<struct<person_ref:string,hook:string,kind:string,quote:string>>"
MEETING = "struct<summary:string,meeting_type:string,occurred_at_hint:string,attendee_refs:array<string>>"
#: Schema of one extraction as JSON.
EXTRACTION = f"struct<meeting:{MEETING},people:{PEOPLE},organizations:{ORGANIZATIONS},topics:{TOPICS},relationships:{RELATIONS},intro_opportunities:{INTROS},asks_and_offers:{ASKS},commitments:{COMMITMENTS},outreach_hooks:{HOOKS}>"


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def read_extractions(runs: DataFrame) -> DataFrame:
    """(run_id, source_id, occurred_at, e): `raw_output` of succeeded runs parsed; malformed JSON gives empty lists."""
    return runs.where(F.col("status") == "succeeded").select("run_id", "source_id", "occurred_at", F.from_json("raw_output", EXTRACTION).alias("e"))


def sanitize(runs: DataFrame) -> DataFrame:
    """Drop rows with undefined refs and self relationships, null dangling employers, derive first-name-only."""
    people, orgs, topics = _or_empty(F.col("e.people"), PEOPLE), _or_empty(F.col("e.organizations"), ORGANIZATIONS), _or_empty(F.col("e.topics"), TOPICS)
    refs = F.concat(*[F.transform(x, lambda y: y["ref"]) for x in (people, orgs, topics)])
    known = lambda r: F.array_contains(refs, r)
    org_refs = F.transform(orgs, lambda o: o["ref"])

    def person(p: Column) -> Column:
        employer = F.when(F.array_contains(org_refs, p["organization_ref"]), p["organization_ref"])
        alone = F.coalesce(p["is_first_name_only"], F.lit(False)) | (F.size(F.split(F.trim(p["name"]), r"\s+")) == 1)
        return p.withField("organization_ref", employer).withField("is_first_name_only", alone)

    pick = lambda name, kind, keep: F.filter(_or_empty(F.col(f"e.{name}"), kind), keep)
    return runs.withColumn(
        "e",
        F.struct(
            F.col("e.meeting").withField("attendee_refs", F.filter(_or_empty(F.col("e.meeting.attendee_refs"), "array<string>"), known)).alias("meeting"),
            F.transform(people, person).alias("people"),
            orgs.alias("organizations"),
            F.transform(topics, lambda t: t.withField("discussed_by_refs", F.filter(_or_empty(t["discussed_by_refs"], "array<string>"), known))).alias("topics"),
            pick("relationships", RELATIONS, lambda r: known(r["src_ref"]) & known(r["dst_ref"]) & (r["src_ref"] != r["dst_ref"])).alias("relationships"),
            pick("intro_opportunities", INTROS, lambda r: known(r["connector_ref"]) & known(r["target_ref"])).alias("intro_opportunities"),
            pick("asks_and_offers", ASKS, lambda r: known(r["actor_ref"])).alias("asks_and_offers"),
            pick("commitments", COMMITMENTS, lambda r: known(r["actor_ref"])).alias("commitments"),
            pick("outreach_hooks", HOOKS, lambda r: known(r["person_ref"])).alias("outreach_hooks"),
        ),
    )


def mentions(runs: DataFrame) -> DataFrame:
    """Organisations, people, topics of each run as mention rows, in that order (`mention_seq`)."""
    org_name = lambda ref: F.get(F.transform(F.filter("e.organizations", lambda o: o["ref"] == ref), lambda o: o["name"]), F.lit(0))

    def rows(array: str, offset: Column, kind: Column, norm, alone: Column, role: Column, org: Column, email: Column, title: Column, quote: Column, confidence: Column) -> DataFrame:
        x = runs.select("run_id", "source_id", "e", F.posexplode(array).alias("pos", "x"))
        return x.select(
            F.sha2(F.concat_ws("|", "run_id", "x.ref"), 256).alias("id"), "run_id", "source_id", (offset + F.col("pos")).alias("mention_seq"), F.col("x.ref").alias("local_ref"), kind.alias("entity_type"), F.col("x.name").alias("surface_form"),
            norm(F.col("x.name")).alias("normalized"), alone.alias("is_first_name_only"), role.alias("role_in_source"), org.alias("org"), email.alias("email"), title.alias("title"), quote.alias("quote"), confidence.alias("confidence"),
        )

    none = F.lit(None).cast("string")
    no = F.lit(False)
    orgs = rows("e.organizations", F.lit(0), F.when(F.col("x.org_type").isin(*dims.FUND_ORG_TYPES), "fund").otherwise("organization"), text.normalize_org, no, none, none, none, none, none, F.coalesce("x.confidence", F.lit(0.6)))
    people = rows("e.people", F.size("e.organizations"), F.lit("person"), text.normalize_name, F.col("x.is_first_name_only"), F.col("x.role_in_meeting"), F.coalesce("x.organization_name", org_name(F.col("x.organization_ref"))), F.col("x.email"), F.col("x.title"), F.col("x.quote"), F.coalesce("x.confidence", F.lit(0.6)))
    topics = rows("e.topics", F.size("e.organizations") + F.size("e.people"), F.lit("topic"), text.normalize_name, no, none, none, none, none, none, F.lit(0.7))
    return orgs.unionByName(people).unionByName(topics)


#: Claims of one run before their refs are resolved.
_CLAIMS = "array<struct<claim_type:string,src_ref:string,dst_ref:string,predicate:string,value:map<string,string>,quote:string,explicitness:string,polarity:smallint,warmth:double,confidence:double>>"


def _claim(kind: str, src: Column, dst: Column, predicate: Column, value: dict[str, Column], quote: Column | None = None, explicitness: Column | None = None, polarity: Column | None = None, warmth: Column | None = None, confidence: Column | None = None) -> Column:
    filled = F.map_filter(F.create_map(*[x for k, v in value.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()) if value else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(kind).alias("claim_type"), src.alias("src_ref"), (dst if dst is not None else F.lit(None)).cast("string").alias("dst_ref"), predicate.alias("predicate"), filled.alias("value"),
        (quote if quote is not None else F.lit(None)).cast("string").alias("quote"), F.coalesce(explicitness if explicitness is not None else F.lit(None).cast("string"), F.lit("stated")).alias("explicitness"),
        F.coalesce(polarity if polarity is not None else F.lit(None), F.lit(1)).cast("smallint").alias("polarity"), (warmth if warmth is not None else F.lit(None)).cast("double").alias("warmth"), F.coalesce(confidence if confidence is not None else F.lit(None).cast("double"), F.lit(0.6)).alias("confidence"),
    )


def claims(runs: DataFrame) -> DataFrame:
    """All claims of sanitised runs as one array per run, exploded: attributes, employers, relationships, capabilities,
    hooks, asks, commitments, co-attendance and awareness; then resolved against the run's refs."""
    lit = F.lit
    kind = _CLAIMS
    each = lambda array, f: F.flatten(F.transform(array, f)).cast(kind)
    scalar = lambda ref, v, predicate, key, c: F.filter(F.array(_claim("attribute", ref, None, lit(predicate), {key: v}, confidence=lit(c))), lambda _: v.isNotNull() & (v != ""))
    many = lambda ref, vs, predicate, c: F.transform(_or_empty(vs, "array<string>"), lambda v: _claim("attribute", ref, None, lit(predicate), {"value": v}, confidence=lit(c)))
    people = each("e.people", lambda p: F.concat(
        scalar(p["ref"], p["title"], "title", "title", 0.6), scalar(p["ref"], p["email"], "email", "email", 0.9), scalar(p["ref"], p["location"], "location", "location", 0.6),
        scalar(p["ref"], F.when(p["seniority"] != "unknown", p["seniority"]), "seniority", "seniority", 0.6), many(p["ref"], p["expertise"], "expertise", 0.6), many(p["ref"], p["interests"], "interest", 0.5),
        F.filter(F.array(_claim("relationship", p["ref"], p["organization_ref"], lit("works_at"), {"strength_signal": lit(1)}, p["quote"], warmth=lit(0.6), confidence=F.coalesce(p["confidence"], lit(0.6)))), lambda _: p["organization_ref"].isNotNull()),
    ))
    orgs = each("e.organizations", lambda o: F.concat(scalar(o["ref"], o["stage"], "stage", "stage", 0.6), scalar(o["ref"], o["location"], "location", "location", 0.6), many(o["ref"], o["sector"], "sector", 0.7), many(o["ref"], o["notable_facts"], "notable_fact", 0.6)))
    relations = F.transform("e.relationships", lambda r: _claim("relationship", r["src_ref"], r["dst_ref"], r["type"], {"strength_signal": dims.lookup(r["strength_signal"], dims.STRENGTH_SIGNAL, 0.7), "context": r["context"], "since": r["since"], "until": r["until"]}, r["quote"], r["explicitness"], F.when(r["polarity"] == "negated", -1).otherwise(1), dims.lookup(r["warmth_signal"], dims.WARMTH_SIGNAL, 0.5), r["confidence"])).cast(kind)
    offers = F.transform("e.intro_opportunities", lambda r: _claim("capability", r["connector_ref"], r["target_ref"], lit("can_intro_to"), {"strength_signal": F.when(r["offered"], 1.0).otherwise(0.8), "basis": r["basis"], "offered": r["offered"]}, r["quote"], F.when(r["offered"], "stated").otherwise("inferred"), confidence=F.coalesce(r["confidence"], F.when(r["offered"], 0.9).otherwise(0.65)))).cast(kind)
    hooks = F.transform("e.outreach_hooks", lambda r: _claim("hook", r["person_ref"], None, lit("outreach_hook"), {"hook": r["hook"], "kind": r["kind"]}, r["quote"], confidence=lit(0.7))).cast(kind)
    asks = F.transform("e.asks_and_offers", lambda r: _claim("ask_offer", r["actor_ref"], None, r["kind"], {"what": r["what"], "urgency": r["urgency"]}, r["quote"], confidence=lit(0.7))).cast(kind)
    commitments = F.transform("e.commitments", lambda r: _claim("commitment", r["actor_ref"], None, lit("commitment"), {"action": r["action"], "due_hint": r["due_hint"]}, r["quote"], confidence=lit(0.7))).cast(kind)
    attendees = F.col("e.meeting.attendee_refs")
    others = F.transform(F.filter("e.people", lambda p: ~F.array_contains(attendees, p["ref"]) & ~F.coalesce(p["role_in_meeting"].isin("attendee", "speaker"), lit(False))), lambda p: p["ref"])
    met = F.flatten(F.transform(attendees, lambda a, i: F.transform(F.slice(attendees, i + 2, F.greatest(F.size(attendees) - i - 1, lit(0))), lambda b: _claim("relationship", a, b, lit("met_with"), {"strength_signal": lit(0.6)}, None, lit("inferred"), warmth=lit(0.55), confidence=lit(0.9))))).cast(kind)
    aware = F.flatten(F.transform(attendees, lambda a: F.transform(others, lambda b: _claim("relationship", a, b, lit("mentioned"), {"strength_signal": lit(0.4)}, None, lit("inferred"), warmth=lit(0.5), confidence=lit(0.5))))).cast(kind)
    every = F.concat(people, orgs, relations, offers, hooks, asks, commitments, met, aware)
    observed = F.coalesce(F.try_to_timestamp(F.col("e.meeting.occurred_at_hint")), F.col("occurred_at"))
    known = F.concat(*[F.transform(f"e.{x}", lambda y: y["ref"]) for x in ("organizations", "people", "topics")])
    x = runs.select("run_id", "source_id", observed.alias("observed_at"), known.alias("_refs"), F.posexplode(every).alias("claim_seq", "c")).select("run_id", "source_id", "observed_at", "_refs", "claim_seq", "c.*")
    ok = F.array_contains("_refs", F.col("src_ref")) & (F.col("dst_ref").isNull() | F.array_contains("_refs", F.col("dst_ref")))
    ident = lambda ref: F.when(F.col(ref).isNotNull(), F.sha2(F.concat_ws("|", "run_id", ref), 256))
    return x.where(ok).withColumn("subject_mention_id", ident("src_ref")).withColumn("object_mention_id", ident("dst_ref")).withColumn("id", F.sha2(F.concat_ws("|", "run_id", F.col("claim_seq").cast("string")), 256)).drop("_refs", "src_ref", "dst_ref")


def co_attendance(mention_rows: DataFrame, roles: tuple[str, ...] = ("attendee", "speaker")) -> DataFrame:
    """(run_id, subject, object): every unordered pair of people present in a run; a theta self-join on the run."""
    present = mention_rows.where((F.col("entity_type") == "person") & F.col("role_in_source").isin(*roles)).select("run_id", "local_ref", "id")
    a, b = present.withColumnsRenamed({"local_ref": "_ra", "id": "subject"}), present.withColumnsRenamed({"local_ref": "_rb", "id": "object"})
    return a.join(b, "run_id").where("_ra < _rb").select("run_id", "subject", "object")


def awareness(mention_rows: DataFrame, roles: tuple[str, ...] = ("attendee", "speaker")) -> DataFrame:
    """(run_id, subject, object): everyone present with every person of the run who is only talked about."""
    people = mention_rows.where(F.col("entity_type") == "person")
    here = F.coalesce(F.col("role_in_source").isin(*roles), F.lit(False))
    return people.where(here).select("run_id", F.col("id").alias("subject")).join(people.where(~here).select("run_id", F.col("id").alias("object")), "run_id")


def entity_of(entity_type: Column, workspace: Column, normalized: Column, surface: Column) -> Column:
    """Identity of a mention by exact normal form: one entity per workspace, type and name."""
    name = F.when(F.trim(normalized) != "", F.trim(F.lower(normalized))).otherwise(F.trim(F.lower(surface)))
    return F.concat_ws(":", F.left(entity_type, F.lit(1)), workspace, name)


def exact_links(mention_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(mention_id, workspace_id, entity_id, entity_type, source_id) of every mention, by exact normal form."""
    ws = sources.select(F.col("id").alias("source_id"), "workspace_id")
    return mention_rows.join(ws, "source_id").select(F.col("id").alias("mention_id"), "workspace_id", entity_of(F.col("entity_type"), F.col("workspace_id"), F.col("normalized"), F.col("surface_form")).alias("entity_id"), "entity_type", "source_id")


def joined(claim_rows: DataFrame, links: DataFrame, sources: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Claims with their source, subject and object entity; once per claim id (the first delivery), nothing about dead entities.

    Two left joins on the mention and one on the source; AQE splits the hot source. The dead are removed by two anti
    joins, one per endpoint, instead of a disjunction that would need a nested loop.
    """
    delivery = F.row_number().over(W.partitionBy("id").orderBy("claim_no"))  # limited to one row an id before the shuffle
    first = claim_rows.withColumn("_delivery", delivery).where("_delivery = 1").drop("_delivery")
    s = sources.select(F.col("id").alias("source_id"), "workspace_id", F.col("title").alias("source_title"), "occurred_at", "ingested_at")
    l = lambda side: links.select(F.col("mention_id").alias(f"{side}_mention_id"), F.col("entity_id").alias(f"{side}_entity"))  # noqa: E731, E741
    out = first.join(s, "source_id").join(l("subject"), "subject_mention_id", "left").join(l("object"), "object_mention_id", "left")
    if dead is not None:
        for side in ("subject", "object"):
            out = out.join(dead.select(F.col("id").alias(f"{side}_entity")), f"{side}_entity", "left_anti")
    return out.withColumn("observed_at", F.coalesce("observed_at", "occurred_at", "ingested_at")).drop("occurred_at", "ingested_at")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
