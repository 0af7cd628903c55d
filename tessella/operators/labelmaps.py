"""Label maps (image_id, y, x, label): relabelling, resizing, masks, boundaries and morphology."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def dense(labels: DataFrame) -> DataFrame:
    """Labels of each image numbered 0, 1, ... in ascending order. Only the distinct labels are ranked."""
    names = labels.select("image_id", "label").distinct()
    names = names.withColumn("dense", (F.dense_rank().over(W.partitionBy("image_id").orderBy("label")) - 1).cast("int"))
    return labels.join(names, ["image_id", "label"]).select("image_id", "y", "x", F.col("dense").alias("label"))


def dense_names(labels: DataFrame) -> DataFrame:
    """image_id, dense, label: what ``dense`` calls each label."""
    names = labels.select("image_id", "label").distinct()
    return names.select("image_id", (F.row_number().over(W.partitionBy("image_id").orderBy("label")) - 1).cast("int").alias("dense"), "label")


def matching(option: str) -> dict[int, int]:
    """The label map of an option's text, such as "{0: 2, 1: 0}" or "[(0, 2), (1, 0)]": read as a literal, never run."""
    out = dict(ast.literal_eval(option))
    if not all(isinstance(x, int) for pair in out.items() for x in pair):
        raise ValueError(f"no map of labels: {option!r}")
    return out


def remap_strict(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced by ``mapping`` (old, new); a label that the mapping lacks fails the job."""
    out = labels.join(mapping, labels["label"] == mapping["old"], "left")
    missing = F.raise_error(F.concat(F.lit("no mapping for label "), F.col("label").cast("string")))
    return out.select("image_id", "y", "x", F.when(F.col("old").isNull(), missing.cast("int")).otherwise(F.col("new")).alias("label"))


def remap(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced by ``mapping`` (image_id, position, old, new): of several entries of a label the last counts; labels
    without an entry become 0."""
    last = mapping.groupBy("image_id", "old").agg(F.max_by("new", "position").alias("new"))
    return labels.join(last.withColumnRenamed("old", "label"), ["image_id", "label"], "left").select("image_id", "y", "x", F.coalesce("new", F.lit(0)).alias("label"))


def binary_fix(labels: DataFrame, exact: bool = False) -> DataFrame:
    """Maps that hold 255 as foreground get 1 instead: those of 0 and 255 only or, if ``exact``, of both."""
    every = W.partitionBy("image_id")
    others = F.max(F.when(F.col("label").isin(0, 255), 0).otherwise(1)).over(every) == 0
    both = (F.min("label").over(every) == 0) & (F.max("label").over(every) == 255)
    binary = others & both if exact else others
    return labels.select("image_id", "y", "x", F.when(binary & (F.col("label") == 255), 1).otherwise(F.col("label")).alias("label"))


def resize_nearest(labels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest-neighbour resize: the target's (y, x) takes the label at floor of the scaled place. Each source
    pixel is expanded to its targets, so nothing is joined."""
    down = lambda v, old, new: F.sequence(F.expr(f"cast(ceil({v} * {new} / {old}) as int)"), F.expr(f"cast(ceil(({v} + 1) * {new} / {old}) as int) - 1"))
    some = lambda v, old, new: F.expr(f"ceil({v} * {new} / {old}) < ceil(({v} + 1) * {new} / {old})")
    rows = labels.where(some("y", height, new_height) & some("x", width, new_width))
    rows = rows.select("image_id", F.explode(down("y", height, new_height)).alias("y"), "x", "label")
    return rows.select("image_id", "y", F.explode(down("x", width, new_width)).alias("x"), "label")


def neighbours(rows: DataFrame, offsets: tuple[tuple[int, int], ...]) -> DataFrame:
    """Every row once for each offset (y, x), as (y + dy, x + dx, dy, dx): the scatter half of a stencil."""
    o = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    return rows.withColumn("o", F.explode(o)).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx"), "dy": F.col("o.dy"), "dx": F.col("o.dx")}).drop("o")


def inside(height: int, width: int) -> Column:
    return F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)


def dilate(mask: DataFrame, height: int, width: int, times: int = 1, offsets: tuple[tuple[int, int], ...] = CROSS, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Masks (keys, y, x: set pixels only) grown by the offsets; outside the image counts as unset."""
    for _ in range(times):
        mask = neighbours(mask, offsets).where(inside(height, width)).select(*keys, "y", "x").distinct()
    return mask


def erode(mask: DataFrame, height: int, width: int, times: int = 1, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Masks shrunk by the cross; outside the image counts as set. A step that would empty a mask leaves it."""
    for _ in range(times):
        near = neighbours(mask, CROSS).groupBy(*keys, "y", "x").agg(F.count("*").alias("n"), F.max((F.col("dy") == 0) & (F.col("dx") == 0)).alias("own"))
        beyond = sum((c.cast("int") for c in (F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1)), F.lit(0))
        marked = near.where("own").withColumn("stays", F.col("n") + beyond == 5)
        some = F.max("stays").over(W.partitionBy(*keys))
        mask = marked.withColumn("some", some).where("stays or not some").select(*keys, "y", "x")
    return mask


def boundary(labels: DataFrame) -> DataFrame:
    """image_id, y, x of boundary pixels: where two neighbours differ the iso-contour runs half way between
    them, and rounding half to even marks the one of even coordinate."""
    ends = []
    for along in ("y", "x"):
        by = W.partitionBy("image_id", "x" if along == "y" else "y").orderBy(along)
        step = labels.withColumn("next", F.lead("label").over(by)).where(F.col("next") != F.col("label"))
        even = F.when(F.col(along) % 2 == 0, F.col(along)).otherwise(F.col(along) + 1)
        ends.append(step.withColumn(along, even).select("image_id", "y", "x"))
    return ends[0].unionByName(ends[1]).distinct()


def background_first(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Swaps with 0, in each image, the label that most of the border has (corners count twice, the lower of
    equals wins)."""
    sides = F.array_compact(F.array(*[F.when(c, F.lit(1)) for c in (F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1)]))
    border = labels.withColumn("n", F.size(sides)).where("n > 0").groupBy("image_id", "label").agg(F.sum("n").alias("n"))
    most = border.groupBy("image_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("bg"))
    swapped = F.when(F.col("label") == F.col("bg"), 0).when(F.col("label") == 0, F.col("bg")).otherwise(F.col("label"))
    return labels.join(most, "image_id").select("image_id", "y", "x", swapped.alias("label"))


def border_fractions(labels: DataFrame, height: int, width: int) -> DataFrame:
    """image_id, label, fraction of the border (2 * (height + width) places, corners twice)."""
    sides = sum((c.cast("int") for c in (F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1)), F.lit(0))
    return labels.groupBy("image_id", "label").agg((F.sum(sides) / F.lit(2.0 * (height + width))).alias("fraction"))


def threshold(values: DataFrame, t: float, value: str = "v") -> DataFrame:
    """Label 1 where the value is above t."""
    return values.withColumn("label", (F.col(value) > t).cast("int")).drop(value)
