"""Predicted against true labels: contingency, IoU and matchings.

All of it derives from one count of (image, pred, gt); pixels are read once whatever the number of labels.
Matches are image_id, gt, pred, with -1 for a gt that no pred is matched to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """image_id, pred, gt of each pixel that both maps have."""
    return pred.withColumnRenamed("label", "pred").join(gt.withColumnRenamed("label", "gt"), ["image_id", "y", "x"]).select("image_id", "pred", "gt")


def contingency(both: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, pred, gt, n: partial counts are combined before the shuffle."""
    return both.groupBy(*keys, "pred", "gt").agg(F.count("*").alias("n"))


def iou(counts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """image_id, pred, gt, n, iou of all label pairs of each image, those that never meet too. Values under
    ``threshold`` become 0."""
    p = counts.groupBy("image_id", "pred").agg(F.sum("n").alias("n_pred"))
    g = counts.groupBy("image_id", "gt").agg(F.sum("n").alias("n_gt"))
    grid = p.join(g, "image_id").join(counts, ["image_id", "pred", "gt"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.col("n") / F.greatest((F.col("n_pred") + F.col("n_gt") - F.col("n")).cast("double"), F.lit(1e-8))
    return grid.select("image_id", "pred", "gt", "n", "n_pred", "n_gt", F.when(value < threshold, 0.0).otherwise(value).alias("iou"))


def majority(scores: DataFrame) -> DataFrame:
    """Each pred takes its gt of highest IoU, the lower of equals; a gt may be taken more than once."""
    return scores.groupBy("image_id", "pred").agg(F.min_by("gt", F.struct(-F.col("iou"), F.col("gt"))).alias("gt"))


def majority_unique(scores: DataFrame) -> DataFrame:
    """Each gt takes its pred of highest IoU; gts numbered from the count of preds on are left out. Labels are
    numbered densely (``labelmaps.dense``)."""
    best = scores.groupBy("image_id", "gt").agg(F.min_by("pred", F.struct(-F.col("iou"), F.col("pred"))).alias("pred"), F.count("*").alias("n_preds"))
    return best.where("gt < n_preds").select("image_id", "gt", "pred")


def majority_exclusive(scores: DataFrame) -> DataFrame:
    """Each gt asks for its pred of highest IoU; a pred goes to the asker of highest IoU, the lower of equals,
    and the others get -1."""
    best = scores.groupBy("image_id", "gt").agg(F.min(F.struct((-F.col("iou")).alias("cost"), F.col("pred"))).alias("b"))
    first = F.row_number().over(W.partitionBy("image_id", "b.pred").orderBy("b.cost", "gt")) == 1
    return best.select("image_id", "gt", F.when(first, F.col("b.pred")).otherwise(-1).alias("pred"))


def assignment(value: np.ndarray) -> np.ndarray:
    """Columns of the rows of a square matrix in the assignment of greatest sum (shortest augmenting paths)."""
    cost = value.max() - value if value.size else value
    n = len(cost)
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[at] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[owner[at] - 1, free - 1] - u[owner[at]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], at
            to = free[np.argmin(least[free])]
            step = least[to]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def hungarian(scores: DataFrame) -> DataFrame:
    """The one-to-one match of greatest total IoU in each image of as many preds as gts: image_id, gt, pred,
    iou. A group is one image's label grid."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot(index="pred", columns="gt", values="iou").sort_index().sort_index(axis=1)
        to = assignment(grid.to_numpy())
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "gt": grid.columns[to], "pred": grid.index, "iou": grid.to_numpy()[np.arange(len(to)), to]})

    kind = dict(scores.dtypes)
    return scores.select("image_id", "pred", "gt", "iou").groupBy("image_id").applyInPandas(solve, f"image_id {kind['image_id']}, gt int, pred int, iou double")


def match(scores: DataFrame) -> DataFrame:
    """Hungarian where an image has as many preds as gts, else the exclusive majority vote."""
    per = scores.groupBy("image_id").agg(F.count_distinct("pred").alias("a"), F.count_distinct("gt").alias("b"))
    equal, other = per.where("a = b").select("image_id"), per.where("a <> b").select("image_id")
    return hungarian(scores.join(equal, "image_id", "left_semi")).select("image_id", "gt", "pred").unionByName(majority_exclusive(scores.join(other, "image_id", "left_semi")))


def named(found: DataFrame, gt_names: DataFrame, pred_names: DataFrame) -> DataFrame:
    """A match of dense labels in their own names (image_id, dense, label); -1 stays."""
    g = gt_names.select("image_id", F.col("dense").alias("gt"), F.col("label").alias("gt_label"))
    p = pred_names.select("image_id", F.col("dense").alias("pred"), F.col("label").alias("pred_label"))
    return found.join(g, ["image_id", "gt"], "left").join(p, ["image_id", "pred"], "left").select("image_id", F.coalesce("gt_label", "gt").alias("gt"), F.coalesce("pred_label", "pred").alias("pred"))


def mapping(found: DataFrame) -> DataFrame:
    """A match as a relabelling (image_id, position, old, new) of preds; gts come in order."""
    return found.select("image_id", F.col("gt").alias("position"), F.col("pred").alias("old"), F.col("gt").alias("new"))


def relabelled(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts (image_id, pred, gt, n) as they are once preds are replaced as ``labelmaps.remap`` does, without a look at
    pixels again."""
    last = mapping.groupBy("image_id", "old").agg(F.max_by("new", "position").alias("new")).withColumnRenamed("old", "pred")
    return counts.join(last, ["image_id", "pred"], "left").groupBy("image_id", F.coalesce("new", F.lit(0)).alias("pred"), "gt").agg(F.sum("n").alias("n"))


def consistency(found: DataFrame) -> DataFrame:
    """gt, pred, percent: which pred each gt has most often over images, and how often. -1 gives way to the
    runner-up if there is one; of equals the first seen, by image."""
    total = found.groupBy("gt").agg(F.count("*").alias("total"))
    n = found.groupBy("gt", "pred").agg(F.count("*").alias("n"), F.min("image_id").alias("seen"))
    ranked = n.withColumn("r", F.row_number().over(W.partitionBy("gt").orderBy(F.desc("n"), "seen")))
    use = ranked.groupBy("gt").agg(F.min_by(F.struct("pred", "n"), F.when((F.col("r") == 1) & (F.col("pred") == -1), 1000000000).otherwise(F.col("r"))).alias("b"))
    return use.join(total, "gt").select("gt", "b.pred", (F.col("b.n") * 100.0 / F.col("total")).alias("percent"))
