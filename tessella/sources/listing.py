"""Listings of files: images, label maps, frames. Names are data; contents are read by Spark's sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def folder(spark: SparkSession, path: str, recursive: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """image_id, file: files of a folder in order of name; a file counts if its name holds one of the extensions."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("file"))
    return filtered(rows, extensions)


def filtered(files: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """image_id, file of the distinct files, in order."""
    if extensions:
        keep = F.lit(False)
        for e in extensions:
            keep = keep | F.contains(F.lower(F.substring_index("file", "/", -1)), F.lit(e))
        files = files.where(keep)
    return files.select(stem(F.col("file")).alias("image_id"), "file").dropDuplicates(["file"]).orderBy("file")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file, place: the lines of a list file, or of a folder of them by name, numbered in order; empty lines count
    but are left out. Long files are read in blocks: lines are numbered within their block, after those of the blocks before."""
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
    size = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = size.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))  # a row a block
    place = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("at")) - 1
    numbered = rows.join(before, "block").select("file", place.cast("int").alias("place"))
    return numbered.where("file <> ''").select(stem(F.col("file")).alias("image_id"), "file", "place")


def images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, y, x, c, val of the images in a folder, channels in red, green, blue order. An image is cut into its
    lines before they are opened into numbers, so no row holds more than a line."""
    rows = spark.read.format("image").load(path).select(stem(F.col("image.origin")).alias("image_id"), "image.*")
    line = F.col("width") * F.col("nChannels")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.struct(y.alias("y"), F.substring("data", y * line + 1, line).alias("line")))
    cut = rows.where("height > 0").select("image_id", "nChannels", F.explode(lines).alias("l")).select("image_id", "nChannels", "l.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                image, channels, y, line = (batch.column(c)[n].as_py() for c in range(4))
                values = np.frombuffer(line, np.uint8).reshape(-1, channels)
                values = values[:, 2::-1] if channels >= 3 else values[:, :1]
                x, c = (np.broadcast_to(a, values.shape).ravel() for a in (np.arange(len(values))[:, None], np.arange(values.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array([image] * values.size, pa.string()), pa.array([y] * values.size, pa.int32()), pa.array(x, pa.int32()), pa.array(c, pa.int32()), pa.array(values.ravel(), pa.int32())], ["image_id", "y", "x", "c", "val"])

    return cut.mapInArrow(run, "image_id string, y int, x int, c int, val int")


def labelled_folders(files: DataFrame) -> DataFrame:
    """files with ``label``: the number of their folder among all folders, in order."""
    from pyspark.sql.window import Window as W

    parent = F.element_at(F.split("file", "/"), -2)
    names = files.select(parent.alias("folder")).distinct().withColumn("label", F.row_number().over(W.orderBy("folder")) - 1)
    return files.withColumn("folder", parent).join(names, "folder").select(*files.columns, "label")


def split(files: DataFrame, held: DataFrame, train: bool) -> DataFrame:
    """The files whose image_id the held-out list lacks, or those that it has."""
    return files.join(held.select("image_id").distinct(), "image_id", "left_anti" if train else "left_semi")
