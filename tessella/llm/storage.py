"""Tables that cut lineage, written to the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Where it is unset a local session gets a temporary folder;
    on a cluster that is an error, as executors share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later stages then depend on shared files only, so a lost executor costs no more than its own tasks,
    and joins see plain scans, which adaptive execution can split when a key is hot. The shuffle files of
    the written query are dropped when it ends. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stashed tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stashed_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
