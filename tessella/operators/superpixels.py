"""Superpixels: k-means of value and place from a grid of centres, each superpixel one connected part.

A centre is a candidate for the pixels within a grid step of it, so a pixel meets the few centres that reach its cell of
the grid and never all of them; an image's pixels spread over as many tasks as they take. Parts of a superpixel that lie
apart from its largest one are then adopted by the neighbour they share the longest border with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.segments import filled, runs
from tessella.sources.store import dropped, shuffled


def grid(pixels: DataFrame, n_segments: int) -> DataFrame:
    """image_id, step, label, cy, cx, cv: centres on a grid of about ``n_segments``, with the values of the pixels there."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    size = size.withColumn("step", F.greatest(F.sqrt(F.col("h") * F.col("w") / n_segments), F.lit(1.0)))
    along = lambda side: F.transform(F.sequence(F.lit(0), F.ceil(F.col(side) / F.col("step") - 0.5).cast("int") - 1), lambda i: F.floor((i + 0.5) * F.col("step")).cast("int"))
    at = size.select("image_id", "step", along("w").alias("xs"), F.posexplode(along("h")).alias("row", "y"))
    at = at.select("image_id", "step", "row", "y", F.size("xs").alias("across"), F.posexplode("xs").alias("column", "x"))
    return at.join(pixels, ["image_id", "y", "x"]).select("image_id", "step", (F.col("row") * F.col("across") + F.col("column")).alias("label"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx"), F.col("val").cast("double").alias("cv"))


def assigned(rows: DataFrame, centres: DataFrame, compactness: float) -> DataFrame:
    """rows (image_id, y, x, val, label) with the label of the nearest candidate of centres, the lower of equals; without one the
    label stays."""
    step = F.col("step")
    cell = lambda c: F.floor(c / step).cast("int")
    reach = lambda c: F.sequence(cell(F.col(c) - step), cell(F.col(c) + step))
    reached = centres.select("image_id", "step", F.struct("label", "cy", "cx", "cv").alias("c"), F.explode(reach("cy")).alias("row"), reach("cx").alias("columns"))
    reached = reached.select("image_id", "step", "c", "row", F.explode("columns").alias("column")).groupBy("image_id", "row", "column").agg(F.collect_list("c").alias("near"))
    steps = centres.select("image_id", "step").distinct()
    placed = rows.join(steps, "image_id").withColumns({"row": cell(F.col("y")), "column": cell(F.col("x"))})

    def distance(c):
        dy, dx, dv = F.col("y") - c["cy"], F.col("x") - c["cx"], (F.col("val") - c["cv"]) / 255
        d = dv * dv + (dy * dy + dx * dx) * (compactness * compactness) / (step * step)
        return F.struct(F.when((F.abs(dy) <= step) & (F.abs(dx) <= step), F.round(d, 12)).otherwise(float("inf")).alias("d"), c["label"].alias("label"))

    best = F.array_min(F.transform("near", distance))
    found = placed.join(reached, ["image_id", "row", "column"], "left").withColumn("best", best)
    return found.select("image_id", "y", "x", "val", F.when(F.col("best.d") < float("inf"), F.col("best.label")).otherwise(F.col("label")).alias("label"))


def moved(centres: DataFrame, rows: DataFrame) -> DataFrame:
    """Centres at the means of their pixels; those without any stay."""
    means = rows.groupBy("image_id", "label").agg(*[F.avg(c).alias(f"m{c}") for c in ("y", "x", "val")])
    return centres.join(means, ["image_id", "label"], "left").select("image_id", "step", "label", *[F.coalesce(m, c).alias(c) for m, c in (("my", "cy"), ("mx", "cx"), ("mval", "cv"))])


def whole(labels: DataFrame) -> DataFrame:
    """A label map in which every label is one connected part (by sides): of each label the largest part stays, the first of
    equals; others take, round by round, the label that they share the longest border with, the lower of equals. What
    touches nothing stays."""
    parts = shuffled(runs(labels, diagonals=False), "parts")
    size = parts.groupBy("image_id", "label", "component").agg(F.sum(F.col("last") - F.col("x") + 1).alias("n"))
    main = size.groupBy("image_id", "label").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("main"))
    names = size.join(main, ["image_id", "label"]).select("image_id", "component", "label", (F.col("component") == F.col("main")).alias("done"))
    names = shuffled(names, "names")
    pixels = filled(parts, "component")
    offset = F.explode(F.array(F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx")), F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx"))))
    sent = pixels.withColumn("o", offset).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("component").alias("b"))
    border = pixels.withColumnRenamed("component", "a").join(sent, ["image_id", "y", "x"]).where("a <> b").groupBy("image_id", "a", "b").agg(F.count("*").alias("n"))
    both = border.unionByName(border.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    loose = names.where("not done").select("image_id", F.col("component").alias("a"))
    border = shuffled(both.join(loose, ["image_id", "a"], "left_semi"), "border")
    while names.where("not done").limit(1).count():
        near = border.join(names.where("done").select("image_id", F.col("component").alias("b"), "label"), ["image_id", "b"]).groupBy("image_id", "a", "label").agg(F.sum("n").alias("n"))
        adopted = near.groupBy("image_id", F.col("a").alias("component")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("by"))
        new = shuffled(names.join(adopted, ["image_id", "component"], "left").select("image_id", "component", F.when(~F.col("done") & F.col("by").isNotNull(), F.col("by")).otherwise(F.col("label")).alias("label"), F.col("done").alias("was"), (F.col("done") | F.col("by").isNotNull()).alias("done")), "names")
        dropped(names)
        names = new
        if not new.where("done and not was").limit(1).count():
            break
    return filled(parts.drop("label").join(names.select("image_id", "component", "label"), ["image_id", "component"]), "label")


def superpixels(pixels: DataFrame, n_segments: int = 15, compactness: float = 0.1, iterations: int = 10) -> DataFrame:
    """Label map (image_id, y, x, label) of superpixels of images (image_id, y, x, val from 0 to 255): see the module."""
    rows = shuffled(pixels.select("image_id", "y", "x", "val"), "pixels")
    centres = shuffled(grid(rows, n_segments), "centres")
    rows = rows.withColumn("label", F.lit(0))
    for i in range(iterations):
        new = shuffled(assigned(rows, centres, compactness), "assigned")
        if i:
            dropped(rows)
        rows, before = new, centres
        centres = shuffled(moved(centres, rows), "centres")
        dropped(before)
    return whole(rows.select("image_id", "y", "x", "label"))
