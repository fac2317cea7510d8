"""Idempotent stores on Parquet tables: sources, runs, logs, revisioned boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.session import written

#: What an arrival is known by.
KEYS = ("external_id", "content_hash")


def new_sources(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrivals to insert, as if taken one by one by source_seq: those whose external id and hash are neither stored nor
    inserted before them. Null ids and hashes match nothing.

    All at once, round by round: what is first by both its id and its hash goes in, what shares one with it goes out.
    """
    without = lambda d, taken: reduce(lambda x, k: x.join(taken.where(F.col(k).isNotNull()).select("workspace_id", k).distinct(), ["workspace_id", k], "left_anti"), KEYS, d)
    left = written(without(arrivals.select("source_seq", "workspace_id", *KEYS), stored), "arrivals")
    chosen = None
    while not left.isEmpty():
        firsts = left
        for k in KEYS:
            first = W.partitionBy("workspace_id", F.coalesce(k, F.concat(F.lit("row "), F.col("source_seq").cast("string")))).orderBy("source_seq")
            firsts = firsts.withColumn(f"_{k}", F.row_number().over(first))
        taken = written(firsts.where(" AND ".join(f"_{k} = 1" for k in KEYS)).select(left.columns), "inserted")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = written(without(left.join(taken.select("source_seq"), "source_seq", "left_anti"), taken), "arrivals")
    return arrivals.limit(0) if chosen is None else arrivals.join(chosen.select("source_seq"), "source_seq", "left_semi").dropDuplicates(["source_seq"])


def sources_by_external_ids(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """The first source (by source_seq) of each wanted external id."""
    first = W.partitionBy("workspace_id", "external_id").orderBy("source_seq")
    return sources.join(ids.select("external_id").distinct(), "external_id", "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def not_extracted(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources without a succeeded run."""
    return sources.join(runs.where(F.col("status") == "succeeded").select(F.col("source_id").alias("id")), "id", "left_anti")


def runs_newest_first(runs: DataFrame, source_id: str) -> DataFrame:
    return runs.where(F.col("source_id") == source_id).orderBy(F.desc("started_at"), "run_id")


def backfill_dates(sources: DataFrame, dates: DataFrame) -> DataFrame:
    """Fill occurred_at from (id, seen_at) only where it is null."""
    return sources.join(dates.select("id", "seen_at"), "id", "left").withColumn("occurred_at", F.coalesce("occurred_at", "seen_at")).drop("seen_at")


def workspace(workspaces: DataFrame, slug: str) -> DataFrame:
    """The workspace of a slug; an unknown one is an error."""
    found = workspaces.where(F.col("slug") == slug)
    if found.isEmpty():
        raise LookupError(f"no workspace {slug!r}")
    return found


def append_log(entries: DataFrame, path: str) -> bool:
    """Append to a log; a failure is reported, never raised, so that answering goes on."""
    try:
        entries.write.mode("append").parquet(path)
        return True
    except Exception:
        return False


def replace_board(boards: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boards after, conflicts): a change (workspace_id, revision, document) is applied only at the stored revision."""
    c = changes.select("workspace_id", F.col("revision").alias("_seen"), F.col("document").alias("_new"))
    j = boards.join(c, "workspace_id", "left")
    ok = F.col("_seen") == F.col("revision")
    after = j.select("workspace_id", F.when(ok, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(ok, F.col("_new")).otherwise(F.col("document")).alias("document"))
    return after, j.where(F.col("_seen").isNotNull() & ~ok).select("workspace_id", "revision", F.col("_seen").alias("seen_revision"))
