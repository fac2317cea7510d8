"""Search: a heuristic plan from the question, hybrid lexical and vector scoring, routes to what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions import scoring, text, vectors
from kithgraph.functions.jsonx import strings, text_at
from kithgraph.operators import graph


def heuristic_plan(questions: DataFrame, question: str = "question") -> DataFrame:
    """The question with intent, keywords, hop limit, least strength and whether awareness is excluded."""
    q = F.col(question)
    path = text.wants_path(q)
    return questions.select(
        "*",
        F.when(text.wants_explanation(q), "explain_link").when(path, "find_path").otherwise("find_people").alias("intent"),
        text.keywords(q).alias("keywords"),
        F.when(path, 3).otherwise(4).alias("max_hops"),
        F.when(path, 0.25).otherwise(0.0).alias("min_strength"),
        path.alias("exclude_weak_awareness"),
    )


def hybrid_score(nodes: DataFrame, semantic: Column, keywords: Column, org: Column, sectors: Column) -> DataFrame:
    """`nodes` (name, dossier, attributes, source_count) with `score` and `reasons`; scores up to 0.05 are dropped.

    One projection: 0.6 x cosine, at most 0.35 for keyword hits, 0.45 / 0.40 / 0.15 for the organisation in the name,
    employer or dossier, 0.2 for a sector, at most 0.08 for corroborating sources.
    """
    # Fixed values below: the weights, the bounds and the wording of the reasons
    hay = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("dossier", F.lit(""))))
    hits = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (k != "") & F.contains(hay, F.lower(k)))
    n = F.size(hits)
    wanted, employer = F.lower(org), F.lower(F.coalesce(text_at(F.col("attributes"), "org"), F.lit("")))
    in_name, at_org, in_text = F.contains(F.lower("name"), wanted), F.contains(employer, wanted), F.contains(hay, wanted)
    asked = F.coalesce(org != "", F.lit(False))
    org_score = F.when(~asked, 0.0).when(in_name, 0.45).when(at_org, 0.40).when(in_text, 0.15).otherwise(0.0)
    own = F.transform(strings(text_at(F.col("attributes"), "sector")), F.lower)
    sector = F.exists(own, lambda s: F.exists(F.coalesce(sectors, F.array().cast("array<string>")), lambda q: F.contains(s, F.lower(q)) | F.contains(F.lower(q), s)))
    score = semantic * 0.6 + F.when(n > 0, F.least(F.lit(0.35), n * 0.12)).otherwise(0.0) + org_score + F.when(sector, 0.2).otherwise(0.0) + F.least(F.lit(0.08), F.coalesce("source_count", F.lit(0)) * 0.02)
    reasons = F.array_compact(F.array(
        F.when(semantic > 0.35, "semantically close to the query"),
        F.when(n > 0, F.concat(F.lit("mentions "), F.array_join(F.slice(hits, 1, 3), ", "))),
        F.when(asked & in_name, "name matches the organisation").when(asked & at_org, F.concat(F.lit("works at "), text_at(F.col("attributes"), "org"))).when(asked & in_text, "organisation referenced in their dossier"),
        F.when(sector, "sector match"),
    ))
    return nodes.withColumn("score", score).withColumn("reasons", reasons).where("score > 0.05")


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group, best first by (score, id); `rank` from 1."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def retrieve(nodes: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Top k live nodes of the question's workspace for each planned question (question_id, workspace_id, keywords,
    org_match, sectors, entity_types, query_vector, exclude_ids). Types and exclusions filter before scoring."""
    pairs = nodes.join(questions, "workspace_id").where((F.size("entity_types") == 0) | F.array_contains("entity_types", F.col("node_type"))).where(~F.array_contains("exclude_ids", F.col("id")))
    scored = hybrid_score(pairs, vectors.cosine(F.col("query_vector"), F.col("embedding")), F.col("keywords"), F.col("org_match"), F.col("sectors"))
    return top_k(scored, k, "question_id")


def routes(found: DataFrame, paths: DataFrame, most: int = 8) -> DataFrame:
    """The best routes by relevance x probability of each question, from the paths of its workspace's own node."""
    r = found.join(paths.select("workspace_id", F.col("node").alias("id"), "cost", "hops", "path"), ["workspace_id", "id"])
    value = scoring.relevance(F.col("score")) * F.exp(-F.col("cost"))
    return r.withColumn("value", value).withColumn("rn", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("value"), "id"))).where(F.col("rn") <= most)


def search(nodes: DataFrame, edges: DataFrame, questions: DataFrame, selves: DataFrame, most: int = 8) -> DataFrame:
    """Plan, retrieve, route, rank; a workspace without an own node has no routes. `selves` has workspace_id, start."""
    planned = heuristic_plan(questions)
    found = retrieve(nodes, planned)
    paths = graph.shortest_paths(edges, selves).where("hops > 0")
    return routes(found, paths, most)


def prompt_context(found: DataFrame, best: DataFrame) -> DataFrame:
    """(question_id, context): the ten best candidates and six best routes as text for an external answer writer."""
    line = F.concat_ws(" — ", F.concat(F.lit("- "), F.col("name")), F.col("node_type"), text.truncate(F.coalesce("dossier", F.lit("")), 200))
    a = found.where("rank <= 10").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("candidates"))
    b = best.where("rn <= 6").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.array_join("path", " > ").alias("l")))), lambda x: x["l"]), "\n").alias("routes"))
    return a.join(b, "question_id", "full").select("question_id", F.concat_ws("\n\n", "candidates", "routes").alias("context"))
