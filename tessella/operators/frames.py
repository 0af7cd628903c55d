"""Ordered frames: shot detection, attention masses, rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def histogram_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def shot_changes(frames: DataFrame, threshold: int) -> DataFrame:
    """frames (seq, frame, hist) with diff (0 for the first) and changed: diff above the threshold, and the
    first frame of each sequence. Sequences are independent; one is ordered in one task."""
    before = F.lag("hist").over(W.partitionBy("seq").orderBy("frame"))
    diff = F.coalesce(histogram_difference(F.col("hist"), before), F.lit(0))
    return frames.withColumn("first", before.isNull()).withColumn("diff", diff).select("seq", "frame", "diff", (F.col("first") | (F.col("diff") > threshold)).alias("changed"))


def shots(frames: DataFrame, threshold: int) -> DataFrame:
    """frames with the number of changes so far, from 0."""
    upto = W.partitionBy("seq").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return shot_changes(frames, threshold).withColumn("shot", (F.sum(F.col("changed").cast("int")).over(upto) - 1).cast("int"))


def shot_times(frames: DataFrame, threshold: int, fps: float) -> DataFrame:
    """seq, frame, time of each change."""
    return shot_changes(frames, threshold).where("changed").select("seq", "frame", (F.col("frame") / fps).alias("time"))


def attention_mass(attention: DataFrame, threshold: float = 0.4, keys: Sequence[str] = ("image_id", "head")) -> DataFrame:
    """attention (v) with ``keep``: whether the cumulative share of v, in ascending order, is above the threshold."""
    upto = W.partitionBy(*keys).orderBy("v", "p").rowsBetween(W.unboundedPreceding, 0)
    share = F.try_divide(F.sum("v").over(upto), F.sum("v").over(W.partitionBy(*keys)))
    return attention.withColumn("keep", F.coalesce(share > threshold, F.lit(False)))


def head_mean(attention: DataFrame) -> DataFrame:
    return attention.groupBy("image_id", "p").agg(F.avg("v").alias("v"))


def rescaled(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values to 0..1 between their group's least and largest, null where these are equal."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return values.join(ends, list(keys)).withColumn(value, F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))).drop("low", "high")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows by a seeded hash of their key: the same on every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string"))), key).limit(n)
