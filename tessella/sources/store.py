"""Tables of stages on disk: skipped where they exist, written once, partitioned by dataset and subfolder."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see. Where it is unset a local session gets a temporary folder;
    on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"


#: With it Spark deletes what a write has shuffled as soon as it is over, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and so do differences between evaluations. Nothing reads
    again what was shuffled on the way, so it goes at once."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def shuffled(df: DataFrame, name: str) -> DataFrame:
    """As ``settled``, and joins with it shuffle: a table of an image's pixels or parts is never sent to the driver to be
    broadcast, however small its files are."""
    out = settled(df, name)
    hinted = out.hint("merge")
    hinted.settled_at = out.settled_at
    return hinted


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), guard: bool = True) -> None:
    """Writes a new table; with ``guard`` a folder that is there already is an error, else it is replaced."""
    writer = df.write.mode("errorifexists" if guard else "overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def increment(wanted: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], key: str = "image_id") -> DataFrame:
    """Runs a stage on the keys that the stored table lacks, appends the result and returns the whole table."""
    spark = wanted.sparkSession
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    stage(wanted).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored_until(stages: tuple[str, ...], given: Mapping[str, str]) -> int:
    """How many leading stages can be read instead of computed: a stored stage counts only if all before it are given."""
    n = 0
    while n < len(stages) and given.get(stages[n]):
        n += 1
    return n


def masks(labels: DataFrame) -> DataFrame:
    """Label maps as 8-bit masks: values wrap at 256."""
    return labels.withColumn("label", F.pmod("label", F.lit(256)).cast("int"))


def png(values: np.ndarray) -> bytes:
    """An 8-bit grey image file of a matrix."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = values.shape
    lines = np.zeros((height, width + 1), np.uint8)  # the first byte of a line says that it is not filtered
    lines[:, 1:] = values
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(pixels: DataFrame, folder: str) -> DataFrame:
    """image_id, file: grey images (image_id, y, x, val from 0 to 255), each written as a file of its own; what is missing is
    0. A task that runs again writes the same files. One image is one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        values = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.uint8)
        values[rows["y"], rows["x"]] = rows["val"]
        url = f"{folder}/{key[0]}.png"
        files, path = fs.FileSystem.from_uri(url if "://" in url else f"file://{url.removeprefix('file:')}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(png(values))
        return pd.DataFrame({"image_id": [key[0]], "file": [url]})

    kind = dict(pixels.dtypes)["image_id"]
    return settled(pixels.select("image_id", "y", "x", "val").groupBy("image_id").applyInPandas(run, f"image_id {kind}, file string"), "files")


def log_metrics(df: DataFrame, path: str, run: str) -> None:
    """Puts a run's metrics into the table of all runs; a run that is logged again replaces itself, the others stay."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
