"""Schemas of the data model's tables, and their creation as Parquet folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "workspaces": "id string, slug string, name string, self_entity_id string, settings string, created_at timestamp",
    "sources": "source_seq bigint, id string, workspace_id string, kind string, external_id string, title string, occurred_at timestamp, body string, raw string, content_hash string, attendee_hints string, token_estimate int, ingested_at timestamp",
    "extraction_runs": "run_id string, source_id string, extractor_version string, model string, prompt_hash string, status string, usage string, raw_output string, started_at timestamp",
    "mentions": "id string, run_id string, source_id string, mention_seq int, local_ref string, entity_type string, surface_form string, normalized string, is_first_name_only boolean, role_in_source string, attributes string, quote string, confidence double, created_at timestamp",
    "claims": "claim_no bigint, id string, run_id string, source_id string, claim_type string, subject_mention_id string, object_mention_id string, predicate string, value string, quote string, explicitness string, polarity smallint, warmth double, confidence double, observed_at timestamp, created_at timestamp",
    "entities": "id string, workspace_id string, entity_type string, canonical_name string, normalized string, attributes string, dossier string, embedding array<float>, mention_count int, source_count int, first_seen timestamp, last_seen timestamp, status string, merged_into string, created_at timestamp, updated_at timestamp",
    "entity_aliases": "entity_id string, alias string, normalized string, kind string",
    "mention_links": "mention_id string, entity_id string, method string, score double, features map<string,double>, written_at bigint",
    "entity_merges": "id string, winner string, loser string, score double, method string, evidence string",
    "resolution_reviews": "review_id string, mention_id string, entity_id string, candidate_id string, score double, features map<string,double>, verdict string",
    "edges": "workspace_id string, src string, dst string, relationship_type string, directed boolean, strength double, warmth double, confidence double, evidence_count bigint, source_diversity bigint, first_seen timestamp, last_seen timestamp, context_card string, ended boolean",
    "edge_evidence": "edge_id string, claim_id string, source_id string, quote string, weight double, observed_at timestamp",
    "entity_metrics": "workspace_id string, entity_id string, degree bigint, weighted_degree double, reach bigint, brokerage double",
    "search_queries": "id string, workspace_id string, query_text string, plan string, candidates string, paths string, answer string, latency_ms bigint, outcome string",
    "boards": "workspace_id string, kind string, revision int, document string",
}


def create(spark: SparkSession, root: str, reset: bool = False) -> None:
    """An empty Parquet folder for every table; existing ones are left alone unless `reset`."""
    for name, ddl in TABLES.items():
        df = spark.createDataFrame([], ddl)
        df.write.mode("overwrite" if reset else "ignore").parquet(os.path.join(root, name))


def seed_workspace(workspaces: DataFrame, row: DataFrame) -> DataFrame:
    """Workspaces with a new one; a slug that exists already changes nothing."""
    return workspaces.unionByName(row.join(workspaces.select("slug"), "slug", "left_anti").select(*workspaces.columns))
