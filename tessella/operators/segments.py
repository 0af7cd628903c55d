"""Segments of label maps: boxes, components, clusters and semantic maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.labelmaps import dilate, erode
from tessella.operators.patches import normalised
from tessella.sources.store import dropped, settled, shuffled


def boxes(labels: DataFrame, height: int, width: int, patch: int = 1, erosions: int = 0, dilations: int = 0, skip_background: bool = True) -> DataFrame:
    """image_id, segment, xmin, ymin, xmax, ymax (ends exclusive, in pixels of ``patch``) after morphology."""
    mask = labels.where("label <> 0") if skip_background else labels
    keys = ("image_id", "segment")
    mask = mask.select("image_id", F.col("label").alias("segment"), "y", "x")
    mask = dilate(erode(mask, height, width, erosions, keys), height, width, dilations, keys=keys)
    return mask.groupBy(*keys).agg(*[(f(c) * patch if f is F.min else (f(c) + 1) * patch).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]).select(*keys, "xmin", "ymin", "xmax", "ymax")


#: Rows of an image that a task labels together.
STRIP = 128


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n items that pairs (a, b) lead to from each."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        for at in (a, b):
            np.minimum.at(root, root[at], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def touching(row: np.ndarray, first: np.ndarray, last: np.ndarray, label: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (sorted by row and first column) of one label in neighbouring rows whose columns meet, or are up to
    ``reach`` apart."""
    width = int(last.max(initial=0)) + 3
    begin, end = row * width + first + 1, row * width + last + 1
    lo, hi = np.searchsorted(end, begin + width - reach), np.searchsorted(begin, end + width + reach, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = label[a] == label[b]
    return a[same], b[same]


def linked(edges: DataFrame) -> DataFrame:
    """image_id, part, component: the smallest part that edges (image_id, a, b) lead to.

    In a round each part joins the one of least hash among itself and its neighbours, whose choice is followed three times;
    then edges within what has joined go and the rest are between fewer parts, a third on a long path. Hashes are new
    in every round. Lineage ends with each round's tables.
    """
    left = shuffled(edges.select("image_id", "a", "b"), "links")
    names = shuffled(left.select("image_id", F.explode(F.array("a", "b")).alias("part")).distinct().withColumn("component", F.col("part")), "parts")
    number = 0
    while left.limit(1).count():
        number += 1
        both = left.select("image_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("image_id", "e.a", "e.b")
        place = lambda c: F.struct(F.xxhash64("image_id", c, F.lit(number)), c)  # noqa: B023, E731
        best = both.groupBy("image_id", "a").agg(F.min_by("b", place("b")).alias("b"))
        to = shuffled(best.select("image_id", "a", F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "joined")
        for _ in range(3):
            before = to
            to = shuffled(to.join(before.select("image_id", F.col("a").alias("to"), F.col("to").alias("further")), ["image_id", "to"]).select("image_id", "a", F.col("further").alias("to")), "joined")
            dropped(before)
        used = left, names, to
        ends = left.join(to, ["image_id", "a"]).select("image_id", F.col("to").alias("c"), F.col("b").alias("a")).join(to, ["image_id", "a"])
        left = shuffled(ends.select("image_id", F.col("c").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(), "links")
        names = shuffled(names.join(to.select("image_id", F.col("a").alias("component"), "to"), ["image_id", "component"], "left").select("image_id", "part", F.coalesce("to", "component").alias("component")), "parts")
        dropped(*used)
    least = names.groupBy("image_id", "component").agg(F.min("part").alias("least"))
    return names.join(least, ["image_id", "component"]).select("image_id", "part", F.col("least").alias("component"))


def runs(mask: DataFrame, diagonals: bool = True, strip: int = STRIP) -> DataFrame:
    """image_id, label, y, x, last, component (y, x): the runs of pixels (from column x to ``last``) of a map (image_id, y, x, label) with
    the first pixel of their connected part of one label; diagonals count unless told otherwise.

    Strips of rows are labelled where they are, each with the first row of the next one; what two strips call the runs
    of that row links their parts, so that only parts that cross strips are ever joined.
    """
    kind = dict(mask.dtypes)["image_id"]
    own = F.floor(F.col("y") / strip).cast("int")
    strips = F.when((F.col("y") % strip == 0) & (F.col("y") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = mask.select("image_id", F.explode(strips).alias("strip"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("long").alias("label"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y, x, label = (np.asarray(table[c]) for c in ("y", "x", "label"))
        order = np.lexsort((x, y))
        y, x, label = y[order], x[order], label[order]
        new = np.r_[True, (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1) | (label[1:] != label[:-1])]
        at = np.flatnonzero(new)
        row, first, name = y[at], x[at], label[at]
        last = x[np.r_[at[1:], len(x)] - 1]
        root = rooted(len(at), *touching(row, first, last, name, int(diagonals)))
        out = [name, row, first, last, row[root], first[root]]
        return pa.table({"image_id": pa.array([key[0].as_py()] * len(at), table.schema.field("image_id").type), "strip": pa.array(np.full(len(at), key[1].as_py()), pa.int32()), **{c: pa.array(v.astype(np.int32)) for c, v in zip(("label", "y", "x", "last", "py", "px"), out, strict=True)}})

    found = rows.groupBy("image_id", "strip").applyInArrow(run, f"image_id {kind}, strip int, label int, y int, x int, last int, py int, px int")
    found = shuffled(found.select("image_id", "strip", "label", "y", "x", "last", F.struct(F.col("py").alias("y"), F.col("px").alias("x")).alias("part")), "runs")
    below = found.where(F.col("strip") == own).select("image_id", "y", "x", F.col("part").alias("a"))
    above = found.where(F.col("strip") < own).select("image_id", "y", "x", F.col("part").alias("b"))
    names = linked(below.join(above, ["image_id", "y", "x"]).where("a <> b").select("image_id", "a", "b").distinct())
    mine = found.where(F.col("strip") == own).join(names, ["image_id", "part"], "left")
    return mine.select("image_id", "label", "y", "x", "last", F.coalesce("component", "part").alias("component"))


def filled(rows: DataFrame, *columns: str) -> DataFrame:
    """image_id, y, x and ``columns`` of each pixel of runs."""
    return rows.select("image_id", "y", F.explode(F.sequence("x", "last")).alias("x"), *columns)


def components(mask: DataFrame) -> DataFrame:
    """image_id, y, x, component: connected parts (diagonals count) of a mask, named by their first pixel."""
    return filled(runs(mask.withColumn("label", F.lit(1))), "component")


def largest_component(mask: DataFrame) -> DataFrame:
    """image_id, y, x of each mask's largest connected part, the first of equals."""
    parts = runs(mask.withColumn("label", F.lit(1)))
    size = F.sum(F.col("last") - F.col("x") + 1)
    best = parts.groupBy("image_id", "component").agg(size.alias("n")).groupBy("image_id").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    return filled(parts.join(best, ["image_id", "component"], "left_semi"))


def census(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))


def clustered(features: DataFrame, k: int, seed: int = 1, iterations: int = 50) -> DataFrame:
    """features (image_id, segment, features) with ``cluster``: k-means over the unit vectors of all segments,
    with fewer clusters where there are fewer segments."""
    rows = settled(features, "features").withColumn("unit", array_to_vector(normalised(F.col("features"))))
    k = min(k, rows.limit(k).count())
    if k < 2:
        out = rows.withColumn("cluster", F.lit(0))
    else:
        out = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="unit", predictionCol="cluster").fit(rows).transform(rows)
    return out.select("image_id", "segment", "features", "cluster")


def semantic(labels: DataFrame, clusters: DataFrame, shift: int = 0) -> DataFrame:
    """Segments of a label map replaced by their cluster plus ``shift``; 0 stays 0, and a cluster of -1 is stored
    as 255. Without a shift, cluster 0 is the background's 0. A segment without a cluster fails the job."""
    c = clusters.select("image_id", F.col("segment").alias("label"), F.col("cluster"))
    new = F.when(F.col("label") == 0, 0).when(F.col("cluster").isNull(), F.raise_error(F.lit("a segment has no cluster")).cast("int")).otherwise(F.pmod(F.col("cluster") + shift, F.lit(256)))
    return labels.join(c, ["image_id", "label"], "left").select("image_id", "y", "x", new.cast("int").alias("label"))
