"""Projection of the ledger: edges with evidence, node metrics, attribute folds and dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph import dims
from kithgraph.functions import scoring, text
from kithgraph.functions.jsonx import text_at


def edge_claims(ledger: DataFrame) -> DataFrame:
    """Relationship and capability claims with both ends, folded onto their edge; self loops and unknown types dropped."""
    ok = ledger.where(
        F.col("claim_type").isin("relationship", "capability") & F.col("predicate").isin(*dims.TYPES) & F.col("subject_entity").isNotNull() & F.col("object_entity").isNotNull() & (F.col("subject_entity") != F.col("object_entity"))
    )
    sym = F.col("predicate").isin(*dims.SYMMETRIC)
    return ok.select(
        "*",
        F.when(sym, F.least("subject_entity", "object_entity")).otherwise(F.col("subject_entity")).alias("src"),
        F.when(sym, F.greatest("subject_entity", "object_entity")).otherwise(F.col("object_entity")).alias("dst"),
        (~sym).alias("directed"),
    )


def edges(ledger: DataFrame, as_of: Column) -> DataFrame:
    """One row per (workspace, src, dst, type): the core query, a single aggregation with conditional aggregates.

    Negated claims count as evidence but support nothing; the last claim in (time, number) order decides whether
    the tie has ended, and an ended tie keeps half its strength.
    """
    c = edge_claims(ledger)
    yes = F.col("polarity") == 1
    signal = scoring.finite(text_at(F.col("value"), "strength_signal"), 0.7)
    weight = dims.lookup(F.col("explicitness"), dims.EXPLICITNESS, 0.5)
    at = F.struct("observed_at", "claim_no")
    when_set = lambda key: F.min_by(text_at(F.col("value"), key), F.when(F.coalesce(text_at(F.col("value"), key), F.lit("")) != "", at))
    grouped = c.groupBy("workspace_id", "src", "dst", F.col("predicate").alias("relationship_type"), "directed").agg(
        F.count(F.when(yes, 1)).alias("supporting"),
        F.count("*").alias("evidence_count"),
        F.countDistinct("source_id").alias("source_diversity"),
        F.max(F.when(yes, weight)).alias("w_yes"), F.max(weight).alias("w_all"),
        F.max(F.when(yes, signal)).alias("s_yes"), F.max(signal).alias("s_all"),
        F.avg(F.when(yes, F.col("confidence").cast("double"))).alias("c_yes"), F.avg(F.col("confidence").cast("double")).alias("c_all"),
        F.coalesce(F.avg(F.col("warmth").cast("double")), F.lit(0.5)).alias("warmth"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
        (F.max_by("polarity", at) == -1).alias("ended"),
        when_set("since").alias("since"), when_set("until").alias("until"),
    )
    kept = grouped.where((F.col("supporting") > 0) | F.col("ended"))
    some = F.col("supporting") > 0
    pick = lambda a, b: F.when(some, F.col(a)).otherwise(F.col(b))
    scored = kept.withColumn("confidence", pick("c_yes", "c_all")).withColumn(
        "terms", scoring.strength_terms(pick("w_yes", "w_all"), pick("s_yes", "s_all"), F.col("confidence"), F.col("evidence_count"), F.col("source_diversity"), F.col("last_seen"), as_of)
    )
    strength = F.col("terms.strength") * F.when(F.col("ended"), 0.5).otherwise(1.0)
    p = scoring.traversal_probability(F.col("relationship_type"), strength, F.col("warmth"), F.col("ended"))
    return scored.select(
        "workspace_id", "src", "dst", "relationship_type", "directed", strength.alias("strength"), "warmth", "confidence", "evidence_count", "source_diversity", "first_seen", "last_seen", "ended", "since", "until", "terms", p.alias("probability")
    )


def edge_key(*prefix: str) -> Column:
    return F.sha2(F.concat_ws("|", "workspace_id", "src", "dst", "relationship_type"), 256)


def evidence(ledger: DataFrame) -> DataFrame:
    """One row per (edge, claim): source, quote, weight."""
    c = edge_claims(ledger).withColumn("relationship_type", F.col("predicate"))
    return c.select(edge_key().alias("edge_id"), F.col("id").alias("claim_id"), "claim_no", "source_id", "quote", F.col("confidence").cast("double").alias("weight"), "observed_at")


def top_evidence(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n quoted pieces of evidence of each edge with the highest weight."""
    order = W.partitionBy("edge_id").orderBy(F.desc("weight"), F.desc("observed_at"), "claim_no")
    return rows.where(F.col("quote").isNotNull()).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def context_cards(ledger: DataFrame) -> DataFrame:
    """(workspace, src, dst, type, context_card): the first two distinct contexts, then bases; else label and sources."""
    c = edge_claims(ledger).withColumn("relationship_type", F.col("predicate"))
    edge = ["workspace_id", "src", "dst", "relationship_type"]
    # distinct texts with their first time by a partial aggregation, then two of each kind an edge: no list grows with it
    texts = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in ((0, text_at(F.col("value"), "context")), (1, text_at(F.col("value"), "basis")), (2, F.col("source_title")))])
    seen = c.select(*edge, F.struct("observed_at", "claim_no").alias("at"), F.explode(texts).alias("x")).groupBy(*edge, "x.kind", "x.v").agg(F.min("at").alias("at"))
    rank = F.row_number().over(W.partitionBy(*edge, F.col("kind"), (F.coalesce("v", F.lit("")) != "")).orderBy("at"))
    few = seen.withColumn("rn", rank).where("rn <= 2")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.coalesce("v", F.lit("")) != ""), F.struct("at", "v")))), lambda x: x["v"])
    g = few.groupBy(*edge).agg(of(0).alias("contexts"), of(1).alias("bases"), of(2).alias("titles"))
    said = F.array_distinct(F.concat("contexts", "bases"))
    where = F.array_join(F.slice("titles", 1, 2), ", ")
    fallback = F.concat(dims.label(F.col("relationship_type")), F.when(where != "", F.concat(F.lit(" — established in "), where)).otherwise(""), F.lit("."))
    return g.select("workspace_id", "src", "dst", "relationship_type", F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 2), " ")).otherwise(fallback).alias("context_card"))


def entity_counters(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions, distinct sources, first and last time of each entity."""
    s = sources.select(F.col("id").alias("source_id"), F.coalesce("occurred_at", "ingested_at").alias("seen"))
    return links.join(s, "source_id").groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.countDistinct("source_id").alias("source_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


#: Latest value wins: predicate and the key of its value.
SCALARS = {"title": "title", "email": "email", "location": "location", "seniority": "seniority", "stage": "stage"}
#: Values accumulate: predicate and attribute.
LISTS = {"expertise": "expertise", "interest": "interests", "sector": "sector", "notable_fact": "notable_facts"}
HOOKS_KEPT = 12


def fold_attributes(ledger: DataFrame) -> DataFrame:
    """Per subject: the latest scalars, the union of list values, the newest hooks; negated claims are skipped."""
    c = ledger.where((F.col("polarity") == 1) & F.col("subject_entity").isNotNull())
    at = F.struct("observed_at", "claim_no")
    value = lambda k: text_at(F.col("value"), k)
    of = lambda p, v: F.when((F.col("predicate") == p) & v.isNotNull(), v)
    latest = lambda p, k: F.max_by(value(k), F.when(of(p, value(k)).isNotNull(), at))
    hook = F.when(F.col("predicate") == "outreach_hook", F.coalesce(value("hook"), value("what"))).when(F.col("predicate").isin("ask", "offer"), value("what"))
    hook_kind = F.when(F.col("predicate") == "outreach_hook", F.coalesce(value("kind"), F.lit("professional"))).otherwise(F.col("predicate"))
    one = F.struct("rn", hook.alias("hook"), hook_kind.alias("kind"), F.col("quote").alias("quote"), F.col("source_id").alias("source_id"))
    last = W.partitionBy("workspace_id", "subject_entity").orderBy(F.desc("observed_at"), F.desc("claim_no"))
    newest = c.where(F.coalesce(hook, F.lit("")) != "").withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= HOOKS_KEPT)  # limited before the shuffle
    hooks = newest.groupBy("workspace_id", F.col("subject_entity").alias("entity_id")).agg(F.array_sort(F.collect_list(one)).alias("hooks"))
    g = c.groupBy("workspace_id", F.col("subject_entity").alias("entity_id")).agg(
        *[latest(p, k).alias(p) for p, k in SCALARS.items()],
        *[F.array_sort(F.collect_set(of(p, value("value")))).alias(a) for p, a in LISTS.items()],
    )
    g = g.join(hooks, ["workspace_id", "entity_id"], "left")
    none = F.array().cast("array<struct<rn:int,hook:string,kind:string,quote:string,source_id:string>>")
    return g.withColumn("hooks", F.transform(F.coalesce("hooks", none), lambda h: F.struct(h["hook"].alias("hook"), h["kind"].alias("kind"), h["quote"].alias("quote"), h["source_id"].alias("source_id"))))


def relationship_contexts(ledger: DataFrame, n: int = 6) -> DataFrame:
    """The last n relationship contexts of each subject, oldest first."""
    c = ledger.withColumn("context", text_at(F.col("value"), "context")).where((F.col("claim_type") == "relationship") & F.col("context").isNotNull() & F.col("subject_entity").isNotNull())
    last = W.partitionBy("subject_entity").orderBy(F.desc("observed_at"), F.desc("claim_no"))
    kept = c.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n)
    return kept.groupBy(F.col("subject_entity").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("k"), "context"))), lambda x: x["context"]).alias("contexts"))


def dossier(name: Column, kind: Column, title: Column, org: Column, location: Column, expertise: Column, sectors: Column, interests: Column, notable: Column, hooks: Column, contexts: Column) -> Column:
    """The profile text: head line, list lines, up to six hooks, connections, type."""
    head = text.join_present(" — ", name, title, F.concat(F.lit("at "), org), location)
    lists = text.join_present("\n", text.list_line("Expertise", expertise), text.list_line("Sectors", sectors), text.list_line("Interests", interests), text.list_line("Notable", notable))
    bullets = lambda title_, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"{title_}:\n"), F.array_join(rows, "\n"))).otherwise("")
    hook_lines = F.transform(F.slice(hooks, 1, 6), lambda h: F.concat(F.lit("- ["), h["kind"], F.lit("] "), h["hook"]))
    lines = F.transform(contexts, lambda x: F.concat(F.lit("- "), x))
    return F.trim(text.join_present("\n", head, lists, bullets("Hooks", hook_lines), bullets("Connections", lines), F.when(kind != "person", F.concat(F.lit("Type: "), kind))))
