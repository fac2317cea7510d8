"""Incremental ingest of notes with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kithgraph.operators.timestamps import normalise_notes
from kithgraph.sources.notes import read_json_notes
from kithgraph.sources.store import new_sources


def note_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Raw notes as they land in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(notes: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each delivery of a note once, as long as its repeats come within the delay of its export."""
    return notes.withWatermark("exported_at", delay).dropDuplicatesWithinWatermark(["workspace_id", "id", "title", "transcript"])


def arrivals_per_window(notes: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Notes and workspaces per window of export time; late rows are counted until the watermark passes."""
    from pyspark.sql import functions as F

    w = F.window("exported_at", width)
    return notes.withWatermark("exported_at", delay).groupBy(w).agg(F.count("*").alias("notes"), F.approx_count_distinct("workspace_id").alias("workspaces")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "notes", "workspaces")


def ingest(notes: DataFrame, workspaces: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append normalised sources to `target`, once per workspace and content, micro-batch by micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        from pyspark.sql import functions as F

        spark = batch.sparkSession
        sources = read_json_notes(batch).withColumnRenamed("row_id", "source_seq")
        at = normalise_notes(batch.select("row_id", "workspace_id", "created_at", "createdat", "note_date"), workspaces).select(F.col("row_id").alias("source_seq"), F.timestamp_micros("utc_us").alias("_at"))
        sources = sources.join(at, "source_seq", "left").withColumn("occurred_at", F.coalesce("_at", "occurred_at")).drop("_at")
        place = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)  # any other failure to read is one
        columns = ["workspace_id", "external_id", "content_hash"]
        stored = spark.read.schema(sources.schema).parquet(target).select(columns) if there else sources.select(columns).limit(0)
        new_sources(sources, stored).write.mode("append").parquet(target)

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
