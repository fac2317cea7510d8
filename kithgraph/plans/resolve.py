"""Record linkage: blocking, pair scoring, verdicts, the ordered resolution of a run, reviews and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph import dims
from kithgraph.functions import jsonx, scoring, text, vectors
from kithgraph.operators.skew import salted_join
from kithgraph.session import written


def names_of(entities: DataFrame) -> Column:
    """The canonical name of an entity and its other names (`aliases`, if there is such a column), once each."""
    if "aliases" not in entities.columns:
        return F.array("canonical_name")
    more = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != "") & ~a.contains("@"))
    return F.array_distinct(F.concat(F.array("canonical_name"), more))


def aliases(entities: DataFrame) -> DataFrame:
    """(entity_id, workspace_id, entity_type, key): the blocking keys of every name, once each."""
    named = entities.select("*", F.explode(names_of(entities)).alias("_name"))
    keys = text.blocking_keys(F.col("_name"), F.col("email"), F.col("org"))
    return named.select(F.col("id").alias("entity_id"), "workspace_id", "entity_type", F.explode(keys).alias("key")).distinct()


def candidates(mentions: DataFrame, entities: DataFrame, cap: int | None = dims.CANDIDATE_CAP) -> DataFrame:
    """(mention_id, entity_id, shared): entities of the workspace and type sharing a blocking key.

    A cap keeps those with the most shared keys, as the reference does; None keeps all. Hot keys (a common surname or
    mail domain) are salted. Every pair is counted once by a partial aggregation.
    """
    keys = text.blocking_keys(F.col("surface_form"), F.col("email"), F.col("org"))
    family = F.when(F.col("entity_type") == "fund", "organization").otherwise(F.col("entity_type"))  # a fund may be an organisation and the reverse
    block = lambda df: df.withColumn("block", F.xxhash64("workspace_id", family, "key"))
    m = block(mentions.select(F.col("id").alias("mention_id"), "workspace_id", "entity_type", F.explode(keys).alias("key"))).select("mention_id", "block")
    e = block(aliases(entities)).select("entity_id", "block")
    pairs = salted_join(m, e, "block").groupBy("mention_id", "entity_id").agg(F.count("*").alias("shared"))
    if cap is None:
        return pairs
    order = W.partitionBy("mention_id").orderBy(F.desc("shared"), "entity_id")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).drop("rn")


def features(name: Column, org: Column, title: Column) -> Column:
    """What scoring needs of one side, computed once per mention or entity and not once per pair."""
    return F.struct(text.name_features(name).alias("person"), text.normalize_org(name).alias("other"), text.normalize_org(org).alias("org"), text.token_set(org).alias("org_tokens"), text.token_set(title).alias("title_tokens"))


def name_scores(pairs: DataFrame) -> DataFrame:
    """(person, typed, known, similar, same) of the distinct (person, typed, known) names of pairs, each compared once."""
    d = pairs.select("person", "typed", "known").distinct()
    d = d.withColumn("a", text.name_features(F.col("typed"))).withColumn("b", text.name_features(F.col("known"))).withColumn("x", text.normalize_org(F.col("typed"))).withColumn("y", text.normalize_org(F.col("known")))
    people, others = d.where("person"), d.where("NOT person")
    people = people.select("person", "typed", "known", text.feature_similarity(F.col("a"), F.col("b")).alias("similar"), ((F.col("a.norm") == F.col("b.norm")) & (F.col("a.norm") != "")).alias("same"))
    others = others.select("person", "typed", "known", text.jaro_winkler(F.col("x"), F.col("y")).alias("similar"), ((F.col("x") == F.col("y")) & (F.col("x") != "")).alias("same"))
    return people.unionByName(others)


def score(person: Column, m: Column, e: Column, alone: Column, email: Column, known_email: Column, context: Column, overlap: Column, similar: Column | None = None, same: Column | None = None) -> Column:
    """struct(total, blocked, name, email, org) of a mention's `features` against an entity's; `similar` and `same` are the
    best similarity and the equality of the mention's name with any of the entity's, if they are known already."""
    if similar is None:
        similar = F.when(person, text.feature_similarity(m["person"], e["person"])).otherwise(text.jaro_winkler(m["other"], e["other"]))
    both = (m["person"]["last"] != "") & (e["person"]["last"] != "")
    blocked = F.when(person, both & (similar < 0.6)).otherwise(similar < 0.72)
    present = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    mail = F.when(present(email, known_email), F.when(F.lower(email) == F.lower(known_email), 1.0).otherwise(-1.0)).otherwise(0.0)
    employer = F.when(present(m["org"], e["org"]), F.when(m["org"] == e["org"], 1.0).when(text.jaccard(m["org_tokens"], e["org_tokens"]) > 0.5, 0.6).otherwise(-0.3)).otherwise(0.0)
    titles = F.coalesce(text.jaccard(m["title_tokens"], e["title_tokens"]), F.lit(0.0))
    # The weights of the features, and the largest sum they can reach
    raw = (0.3 * similar + 0.45 * mail + 0.2 * employer + 0.2 * context + 0.15 * overlap + 0.05 * titles) / 1.35 + 0.35 * similar
    total = scoring.clamp01(raw) + F.when(alone, -0.35).otherwise(0.0)
    total = F.when(mail == 1, F.greatest(total, F.lit(0.95))).otherwise(total)
    if same is None:
        same = F.when(person, m["person"]["norm"] == e["person"]["norm"]).otherwise(m["other"] == e["other"]) & (F.when(person, m["person"]["norm"]).otherwise(m["other"]) != "")
    exact = same & (mail >= 0) & (employer >= 0) & ~alone
    floor = F.when(exact & ~person, 0.93).when(exact & both, 0.88).otherwise(0.0)
    total = F.when(blocked, 0.0).otherwise(scoring.clamp01(F.greatest(total, floor)))
    return F.struct(total.alias("total"), blocked.alias("blocked"), similar.alias("name"), mail.alias("email"), employer.alias("org"))


def verdict(total: Column, blocked: Column) -> Column:
    return F.when(blocked, "reject").when(total >= dims.MERGE_AT, "merge").when(total <= dims.REJECT_AT, "reject").otherwise("review")


def scored_pairs(mentions: DataFrame, entities: DataFrame, cap: int | None = dims.CANDIDATE_CAP) -> DataFrame:
    """(mention_id, entity_id, total, blocked, verdict) of all blocked pairs.

    Names, mail, employer and title decide, and where both sides have them: what is said about the mention (`context`)
    against the entity's `dossier`, vectors (`embedding`), and shared `neighbours` (entity ids). Every distinct pair of
    names is compared once, whatever the number of mentions that share it.
    """
    f = lambda name: features(F.col(name), F.col("org"), F.col("title"))
    has = lambda d, c, kind: F.col(c) if c in d.columns else F.lit(None).cast(kind)
    side = lambda d, words: (text.token_set(has(d, words, "string")).alias("words"), has(d, "embedding", "array<float>").alias("vector"), has(d, "neighbours", "array<string>").alias("neighbours"))
    m = mentions.select(F.col("id").alias("mention_id"), (F.col("entity_type") == "person").alias("person"), F.col("surface_form").alias("typed"), F.coalesce("is_first_name_only", F.lit(False)).alias("alone"), F.col("email").alias("m_email"), f("surface_form").alias("m"), F.struct(*side(mentions, "context")).alias("m_more"))
    e = entities.select(F.col("id").alias("entity_id"), F.col("email").alias("e_email"), names_of(entities).alias("names"), f("canonical_name").alias("e"), F.struct(*side(entities, "dossier")).alias("e_more"))
    block = written(candidates(mentions, entities, cap), "candidates")
    named = block.join(m.select("mention_id", "person", "typed"), "mention_id").join(e.select("entity_id", "names"), "entity_id").select("mention_id", "entity_id", "person", "typed", F.explode("names").alias("known"))
    named = written(named, "named")
    best = named.join(name_scores(named), ["person", "typed", "known"]).groupBy("mention_id", "entity_id").agg(F.max("similar").alias("similar"), F.max("same").alias("same"))
    p = block.join(best, ["mention_id", "entity_id"]).join(m, "mention_id").join(e, "entity_id")
    a, b = F.col("m_more.vector"), F.col("e_more.vector")
    alike = F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), vectors.cosine(a, b)).otherwise(text.jaccard(F.col("m_more.words"), F.col("e_more.words")))
    near = scoring.neighbour_overlap(F.col("m_more.neighbours"), F.col("e_more.neighbours"))
    s = score(F.col("person"), F.col("m"), F.col("e"), F.col("alone"), F.col("m_email"), F.col("e_email"), F.coalesce(alike, F.lit(0.0)), F.coalesce(near, F.lit(0.0)), F.col("similar"), F.col("same"))
    return p.withColumn("s", s).select("mention_id", "entity_id", "shared", "s.*").withColumn("verdict", verdict(F.col("total"), F.col("blocked")))


def best_candidate(pairs: DataFrame) -> DataFrame:
    """The best unblocked candidate of each mention; ties to the smaller id."""
    best = F.max_by(F.struct("entity_id", "total", "verdict"), F.struct("total", (-F.xxhash64("entity_id")).alias("t")))
    return pairs.where(~F.col("blocked")).groupBy("mention_id").agg(best.alias("b")).select("mention_id", "b.*")


def local_matches(mentions: DataFrame) -> DataFrame:
    """(mention_id, full_mention_id): bare given names that fit exactly one full-named person of their run."""
    people = mentions.where(F.col("entity_type") == "person").withColumn("p", text.name_parts(F.col("surface_form")))
    bare = people.where("is_first_name_only").select("run_id", F.col("id").alias("mention_id"), F.col("p.first").alias("first"))
    full = people.where("p.last <> ''").groupBy("run_id", F.col("p.first").alias("first")).agg(F.count("*").alias("n"), F.min("id").alias("full_mention_id"))
    return bare.join(full.where("n = 1").drop("n"), ["run_id", "first"]).select("mention_id", "full_mention_id")


RANK = {"organization": 0, "fund": 0, "person": 1}
DECISION = "mention_id string, run_id string, action string, entity_id string, method string, score double, status string"


def decide(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ordered finish of each run over scored pairs: (mention_id, run_id, action, entity_id, method, score, status).

    Organisations first, then people, then the rest, in mention order; an entity taken in the run is blocked for the
    next mention. Actions: link, defer, create (needs_review inside the review band). Grouped by run, whose size is
    that of one document.
    """
    local = local_matches(mentions)
    offers = pairs.where(~F.col("blocked")).groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "entity_id"))).alias("offers"))
    rank = F.when(F.col("entity_type").isin("organization", "fund"), 0).when(F.col("entity_type") == "person", 1).otherwise(2)
    m = mentions.select(F.col("id").alias("mention_id"), "run_id", rank.alias("rank"), F.col("mention_seq").cast("long").alias("seq"), F.coalesce("is_first_name_only", F.lit(False)).alias("alone"), ((F.coalesce("org", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != "")).alias("detail"))
    rows = m.join(offers, "mention_id", "left").join(local, "mention_id", "left").withColumn("offers", F.coalesce("offers", F.array().cast("array<struct<t:double,entity_id:string>>")))

    def finish(run: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        given: dict[str, str] = {}
        out = []
        later = []
        for r in run.sort_values(["rank", "seq", "mention_id"]).itertuples():
            if isinstance(r.full_mention_id, str):
                later.append(r)
                continue
            free = [(-o["t"], o["entity_id"]) for o in r.offers if o["entity_id"] not in taken]
            top, entity = free[0] if free else (0.0, None)
            if entity is not None and top >= dims.MERGE_AT:
                row = (r.mention_id, r.run_id, "link", entity, "blocked_score", top, "active")
            elif r.alone and not r.detail:
                row = (r.mention_id, r.run_id, "defer", None, None, top, "review" if dims.REJECT_AT < top < dims.MERGE_AT else None)
            else:
                review = r.alone or dims.REJECT_AT < top < dims.MERGE_AT
                row = (r.mention_id, r.run_id, "create", f"new:{r.mention_id}", "created", 0.5 if r.alone else 1.0, "needs_review" if review else "active")
            if row[3]:
                taken.add(row[3])
                given[r.mention_id] = row[3]
            out.append(row)
        for r in later:
            out.append((r.mention_id, r.run_id, "link", given.get(r.full_mention_id), "exact", 0.95, "active"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    return rows.groupBy("run_id").applyInPandas(finish, DECISION)


def replay(runs: list[DataFrame], entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, entities) after resolving run after run in time order; entities made by a run are seen by the next.

    The order is the semantics: this loop is for one workspace's documents as they arrive (or a foreachBatch), each
    step itself being distributed joins.
    """
    links = None
    for run in runs:
        d = written(decide(run, scored_pairs(run, entities)), "decisions")
        links = d if links is None else links.unionByName(d)
        made = d.where("action = 'create'").join(run.withColumnRenamed("id", "mention_id"), ["mention_id", "run_id"])
        entities = written(entities.unionByName(made.select(F.col("entity_id").alias("id"), "workspace_id", "entity_type", F.col("surface_form").alias("canonical_name"), "email", "org", "title")), "entities")
    return links, entities


def absorb_attributes(links: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, attributes): attributes (maps) of linked mentions laid over the entity's in mention order, nulls and empty
    lists left out, the `manual_profile` of the entity (a JSON text under that key) last."""
    m = mentions.select(F.col("id").alias("mention_id"), F.col("mention_seq").alias("seq"), "attributes")
    kept = links.select("mention_id", F.col("entity_id").alias("id")).join(m, "mention_id").select("id", "seq", F.explode(jsonx.strip_empty(F.col("attributes"))).alias("k", "v"))
    latest = kept.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))  # one value a key, whatever the number of mentions
    over = latest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("over"))
    none = F.create_map().cast("map<string,string>")
    manual = F.coalesce(jsonx.as_map(F.element_at("attributes", "manual_profile")), none)
    merged = jsonx.merge(jsonx.merge(F.col("attributes"), F.coalesce("over", none)), manual)
    return entities.select("id", F.coalesce("attributes", none).alias("attributes")).join(over, "id", "left").select("id", merged.alias("attributes"))


def absorb(links: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, canonical_name): the longest linked surface form becomes canonical, the first of equal ones."""
    m = mentions.select(F.col("id").alias("mention_id"), "surface_form", F.col("mention_seq").alias("seq"))
    longest = links.join(m, "mention_id").groupBy(F.col("entity_id").alias("id")).agg(F.max_by("surface_form", F.struct(F.length("surface_form"), -F.col("seq"))).alias("longest"))
    return entities.join(longest, "id", "left").select("id", F.when(F.length("longest") > F.length("canonical_name"), F.col("longest")).otherwise(F.col("canonical_name")).alias("canonical_name"))


def latest_links(links: DataFrame) -> DataFrame:
    """Upsert by mention: the last written link wins (`written_at`, then entity)."""
    return links.groupBy("mention_id").agg(F.max(F.struct("written_at", "entity_id", "method", "score")).alias("l")).select("mention_id", "l.*")


def apply_merges(merges: DataFrame) -> DataFrame:
    """(loser, winner) with chains compressed: pointer doubling until every winner is final; cycles are refused.

    Each round at least doubles the reach of every row, so the rows still under way become fewer unless they go round.
    """
    step, left = written(merges.groupBy("loser").agg(F.min("winner").alias("winner")), "merges"), None
    while True:
        up = step.select(F.col("loser").alias("winner"), F.col("winner").alias("higher"))
        new = written(step.join(up, "winner", "left").select("loser", F.coalesce("higher", "winner").alias("winner"), F.col("higher").isNotNull().alias("moved")), "merges")
        step = new.select("loser", "winner")
        before, left = left, new.where("moved").count()
        if not left:
            return step
        if left == before or not new.where("loser = winner").isEmpty():
            raise ValueError("a merge cycle")


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after manual merges: losers get status merged and their final winner; kinds of person must agree."""
    final = apply_merges(merges)
    kind = entities.select("id", (F.col("entity_type") == "person").alias("person"))
    wrong = final.join(kind.select(F.col("id").alias("loser"), F.col("person").alias("a")), "loser").join(kind.select(F.col("id").alias("winner"), F.col("person").alias("b")), "winner").where("a <> b")
    if not wrong.isEmpty():
        raise ValueError("a person can only be merged with a person")
    m = final.select(F.col("loser").alias("id"), F.col("winner").alias("_winner"))
    return entities.join(m, "id", "left").withColumn("status", F.when(F.col("_winner").isNotNull(), "merged").otherwise(F.col("status"))).withColumn("merged_into", F.coalesce("_winner", "merged_into")).drop("_winner")


def relink(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links moved from losers to winners."""
    m = apply_merges(merges).select(F.col("loser").alias("entity_id"), F.col("winner").alias("_w"))
    return links.join(m, "entity_id", "left").withColumn("entity_id", F.coalesce("_w", "entity_id")).drop("_w")


def delete_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: status deleted; evidence stays."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return entities.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def review_verdicts(reviews: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews closed with their verdict, merges that follow from `same`)."""
    v = verdicts.select("review_id", F.col("verdict").alias("_v"))
    closed = reviews.join(v, "review_id", "left").withColumn("verdict", F.coalesce("verdict", "_v")).drop("_v")
    return closed, closed.where("verdict = 'same' AND candidate_id <> entity_id").select(F.col("entity_id").alias("loser"), F.col("candidate_id").alias("winner"))


def unique_tags(tags: Column) -> Column:
    """Trimmed tags, unique without regard to case, the first spelling kept."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def review_queue(pairs: DataFrame) -> DataFrame:
    """(mention_id, candidate_id, score): the best candidate of mentions whose best score lies in the review band."""
    return best_candidate(pairs).where(F.col("verdict") == "review").select("mention_id", F.col("entity_id").alias("candidate_id"), F.col("total").alias("score"))


def upsert_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual creation and update: `changes` (id and any of the entity columns) win where not null; unknown ids are added."""
    cols = [c for c in entities.columns if c != "id"]
    given = [c for c in cols if c in changes.columns]
    renamed = changes.select("id", *[F.col(c).alias(f"_{c}") for c in given])
    j = entities.join(renamed, "id", "full")
    return j.select("id", *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in cols])


def valid_self(workspaces: DataFrame, entities: DataFrame) -> DataFrame:
    """Workspaces with their own node only if it is a live person of theirs, else null."""
    live = entities.where((F.col("entity_type") == "person") & ~F.col("status").isin("merged", "deleted")).select(F.col("id").alias("self_entity_id"), F.col("workspace_id").alias("id"), F.lit(True).alias("_ok"))
    return workspaces.join(live, ["id", "self_entity_id"], "left").withColumn("self_entity_id", F.when(F.col("_ok"), F.col("self_entity_id"))).drop("_ok")
