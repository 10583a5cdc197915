"""Tables in the folder that all machines share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a plan's shuffle files at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when the JVM ends. Where that isn't set, a local
    session gets a temporary folder; on a cluster that would be one folder a machine, so it is an error there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", where)
    where = f"{where.rstrip('/')}/larkspur-{spark.sparkContext.applicationId}"
    if where not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(where)
    return where


def spread(df: DataFrame, *by: str, mb: int = 16) -> DataFrame:
    """A table of under mb MB a core, which may be one file of one row group and so one task, dealt to all cores by some
    columns; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *by) if size < cores * mb * 1_000_000 else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, lost executors cost no rerun. So the
    shuffles of its plan, which no other plan reads, are deleted as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that saved has made and that no plan reads any more."""
    for df in tables:
        if files := df.inputFiles():
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that are no longer held; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    time.sleep(1.5)  # the JVM's side of a dropped object is let go by a thread that looks once a second
    spark._jvm.System.gc()
