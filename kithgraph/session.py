"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kithgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster may use --py-files instead)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table; zone-less Parquet timestamps are taken as UTC instants."""
    importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Only a local master (tests) may leave it unset; then it is
    a folder of this machine, which on a cluster would be refused."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder all executors of {master} share")
    path = os.path.join(tempfile.gettempdir(), f"kithgraph-{uuid.uuid4().hex[:8]}")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


_WRITTEN: list[str] = []
#: Lets a query that is over delete its shuffle files, which otherwise stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Queries that end inside leave no shuffle files; for tables written, whose results need no shuffle any more."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write `df` once as Parquet to the shared folder and read it back: a columnar, prunable cut of the lineage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    with _shuffles_end(df.sparkSession):
        df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables of these frames, as `written` returned them, once nothing will read them again."""
    for df in frames:
        path = vars(df).get("_written")
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


_TABLES: list[str] = []


def append_bucketed(df: DataFrame, name: str, key: str, buckets: int, *partitions: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Append `df` to the table `name` in the shared folder, bucketed and sorted by `key`: a join on `key` with the table
    this returns reads what is stored without shuffling it. One file a bucket and append. `plain`: Parquet columns whose
    values hardly repeat; no dictionary is tried for them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    if name not in _TABLES:
        _TABLES.append(name)
        _WRITTEN.append(path)
    out = df.repartition(buckets, key).write.mode("append").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    out = out.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain})
    with _shuffles_end(df.sparkSession):
        (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)
    return df.sparkSession.table(name)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables this process has written to the shared folder; call it when their results have been stored."""
    n = 0
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{_TABLES.pop()}`")
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n
