"""Evaluation metrics from counts of (pred, gt)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W



def confusion(counts: DataFrame, classes: Sequence[int], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, class, tp, fp, fn, tn for each class, also one that an image lacks. One row a label of a pair is summed by
    class, so any number of classes will do."""
    zero, same = F.lit(0).cast("long"), F.col("pred") == F.col("gt")
    ends = F.array(
        F.struct(F.col("pred").alias("class"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), F.col("n").alias("p"), zero.alias("g")),
        F.struct(F.col("gt").alias("class"), zero.alias("tp"), zero.alias("p"), F.col("n").alias("g")),
    )
    sums = counts.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "p", "g")])
    grid = counts.groupBy(*keys).agg(F.sum("n").alias("total")).select(*keys, "total", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    rows = grid.join(sums, [*keys, "class"], "left").select(*keys, "class", "total", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "p", "g")])
    return rows.select(*keys, "class", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("total") - F.col("p") - F.col("g") + F.col("tp")).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where both are."""
    return a / F.greatest(b.cast("double"), F.lit(1e-8))


def scores(c: DataFrame) -> DataFrame:
    """c with jaccard, accuracy, dice, precision and recall of each row's tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"jaccard": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "dice": ratio(2 * tp, 2 * tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


METRICS = ("jaccard", "accuracy", "dice", "precision", "recall")


def macro(per_class: DataFrame, n_classes: int) -> DataFrame:
    """image_id and the mean of each metric over class slots: classes 1 to n_classes - 1, void 0 left out."""
    return per_class.where(F.col("class").between(1, n_classes - 1)).groupBy("image_id").agg(*[(F.sum(m) / (n_classes - 1)).alias(m) for m in METRICS])


def dataset(per_image: DataFrame) -> DataFrame:
    """One row: mean and population deviation over images of each metric."""
    return per_image.agg(*[f(m).alias(f"{m}_{name}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def per_class_means(per_class: DataFrame) -> DataFrame:
    return per_class.groupBy("class").agg(*[F.avg(m).alias(m) for m in METRICS])


def undersegmentation(counts: DataFrame, classes: Sequence[int]) -> DataFrame:
    """image_id, gt, error: for the preds that touch a gt, the smaller of their parts in and out of it, over
    the gt's size; NaN for a gt that an image lacks."""
    all_pred = F.sum("n").over(W.partitionBy("image_id", "pred"))
    part = counts.withColumn("spill", F.least(F.col("n"), all_pred - F.col("n")))
    have = part.groupBy("image_id", "gt").agg((F.sum("spill") / F.sum("n")).alias("error"))
    grid = counts.select("image_id").distinct().select("image_id", F.explode(F.array(*map(F.lit, classes))).alias("gt"))
    return grid.join(have, ["image_id", "gt"], "left").select("image_id", "gt", F.coalesce("error", F.lit(float("nan"))).alias("error"))


def square(d: int) -> tuple[tuple[int, int], ...]:
    return tuple((a, b) for a in range(-d, d + 1) for b in range(-d, d + 1))


def near_along(axis: str, across: str, on: str, d: int) -> Column:
    """Whether a row with ``on`` lies within d along an axis, from the last one before and the next one after."""
    line = W.partitionBy("image_id", across)
    place = F.when(F.col(on), F.col(axis))
    before = F.last(place, ignorenulls=True).over(line.orderBy(axis).rowsBetween(W.unboundedPreceding, 0))
    after = F.last(place, ignorenulls=True).over(line.orderBy(F.desc(axis)).rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(F.col(axis) - before <= d, F.lit(False)) | F.coalesce(after - F.col(axis) <= d, F.lit(False))


def within(points: DataFrame, d: int, height: int, width: int, images: DataFrame) -> DataFrame:
    """image_id, y, x of the pixels of images within distance d (a square) of points: along rows, then along columns, in a time
    that does not depend on d."""
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    rows = grid.join(points.select("image_id", "y", "x").distinct().withColumn("on", F.lit(True)), ["image_id", "y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    rows = rows.withColumn("row", near_along("x", "y", "on", d))
    return rows.withColumn("hit", near_along("y", "x", "row", d)).where("hit").select("image_id", "y", "x")


def boundary_hits(edges: DataFrame, other: DataFrame, d: int, height: int, width: int, images: DataFrame) -> DataFrame:
    """image_id and the share of ``edges`` within distance d (a square) of ``other``; 0 without edges. The
    recall of a true boundary against a predicted one, or the precision the other way round."""
    grown = within(other, d, height, width, images) if d else other
    hit = edges.join(grown.withColumn("hit", F.lit(1)), ["image_id", "y", "x"], "left")
    rate = hit.groupBy("image_id").agg((F.count("hit") / F.count("*")).alias("rate"))
    return images.join(rate, "image_id", "left").select("image_id", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def top_k_accuracy(rows: DataFrame, ks: Sequence[int], scores_col: str = "scores", target_col: str = "target") -> DataFrame:
    """One row: the percentage of rows whose target is among the k classes of highest score, for each k; ties
    go to the lower class."""
    better = F.size(F.filter(F.transform(F.col(scores_col), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (x["s"] > F.element_at(F.col(scores_col), F.col(target_col) + 1)) | ((x["s"] == F.element_at(F.col(scores_col), F.col(target_col) + 1)) & (x["i"] < F.col(target_col)))))
    return rows.select(better.alias("better")).agg(*[(F.avg((F.col("better") < k).cast("double")) * 100).alias(f"top{k}") for k in ks])


def smoothed(values: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 20) -> DataFrame:
    """values with the median (the lower of two), mean and maximum of the last ``window`` rows, and the mean
    of all so far."""
    last = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)
    sofar = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    some = F.array_sort(F.collect_list(value).over(last))
    middle = F.element_at(some, F.floor((F.size(some) + 1) / 2).cast("int"))
    return values.withColumns({"median": middle, "avg": F.avg(value).over(last), "max": F.max(value).over(last), "global_avg": F.avg(value).over(sofar)})


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """keys, hist (array of bins counts of the values 0 to bins - 1)."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    counts = n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(value), F.col("n")))).alias("m"))
    return counts.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0).cast("long"))).alias("hist"))


def rollup(results: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """kind, score: mean of the subfolders' scores (kind, subfolder, miou); null for a kind without results."""
    spark = results.sparkSession
    return spark.createDataFrame([(k,) for k in kinds], "kind string").join(results.groupBy("kind").agg(F.avg("miou").alias("score")), "kind", "left")


