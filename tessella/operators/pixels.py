"""Pixel-level transforms of images in long form (image_id, y, x, val)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The usual channel means and deviations for natural images.
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def geometry(images: DataFrame, patch: int) -> DataFrame:
    """images (height, width) with height_patch, width_patch, height_pad, width_pad of whole patches."""
    h, w = F.expr(f"height div {patch}").cast("int"), F.expr(f"width div {patch}").cast("int")
    return images.withColumns({"height_patch": h, "width_patch": w, "height_pad": h * patch, "width_pad": w * patch})


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def crop_to_grid(pixels: DataFrame, patch: int, size: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of whole patches only, in images of the given height and width, or of the size that their pixels take up."""
    if size:
        return pixels.where((F.col("y") < size[0] // patch * patch) & (F.col("x") < size[1] // patch * patch))
    g = geometry(sizes(pixels), patch).select("image_id", "height_pad", "width_pad")
    return pixels.join(g, "image_id").where("y < height_pad and x < width_pad").select(*pixels.columns)


def tile(pixels: DataFrame, patch: int, width: int) -> DataFrame:
    """image_id, p, v: tiles in row-major order with their values in row-major order, for images ``width`` wide."""
    p = F.floor(F.col("y") / patch) * (width // patch) + F.floor(F.col("x") / patch)
    cell = F.struct(((F.col("y") % patch) * patch + F.col("x") % patch).alias("o"), F.col("val").alias("v"))
    return pixels.where(F.col("x") < width // patch * patch).groupBy("image_id", p.cast("int").alias("p")).agg(F.array_sort(F.collect_list(cell)).alias("c")).select("image_id", "p", F.col("c.v").alias("v"))


def scale(pixels: DataFrame, by: float = 255.0) -> DataFrame:
    return pixels.withColumn("val", F.col("val") / by)


def normalise(pixels: DataFrame, mean: float, std: float) -> DataFrame:
    return pixels.withColumn("val", (F.col("val") - mean) / std)


def denormalise(pixels: DataFrame, mean: float, std: float, eps: float = 0.0) -> DataFrame:
    return pixels.withColumn("val", F.col("val") * (std + eps) + mean)


def stretch_to_max(pixels: DataFrame) -> DataFrame:
    """Values over their image's maximum, to 0..255, rounded half to even. The maximum is a small aggregate."""
    top = pixels.groupBy("image_id").agg(F.max("val").alias("top"))
    return pixels.join(top, "image_id").select("image_id", "y", "x", F.coalesce(F.rint(F.try_divide("val", "top") * 255), F.lit(0.0)).cast("int").alias("val"))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("val", 1 - F.col("val"))


def blur_kernel(height: int, theta: float) -> list[float]:
    """Gaussian weights: size int(height * theta) made odd by one less, deviation a sixth of size - 1."""
    k = int(height * theta)
    k -= 1 - k % 2
    return gaussian(k, (k - 1) / 6)


def gaussian(size: int, sigma: float) -> list[float]:
    """Gaussian weights of an odd number of places."""
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) if sigma else 1.0 for i in range(size)]
    return [x / sum(w) for x in w]


def blur(pixels: DataFrame, kernel: Sequence[float], height: int, width: int, passes: str = "yx") -> DataFrame:
    """Separable blur in two passes, in the given order; the border reflects without repeating the edge. Pixels that an image lacks have no part in
    it and get no value."""
    half = len(kernel) // 2
    offsets = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)])
    for along, n in sorted((("y", height), ("x", width)), key=lambda p: passes.index(p[0])):
        # where a value lands: directly, and mirrored over either edge
        t = F.col(along) + F.col("o.d")
        lands = F.array(t, F.lit(0) - F.col(along) + F.col("o.d"), F.lit(2 * n - 2) - F.col(along) + F.col("o.d"))
        own = F.col(along)
        keep = F.filter(F.transform(lands, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: (s["v"] >= 0) & (s["v"] < n) & ((s["i"] == 0) | ((s["i"] == 1) & (own > 0)) | ((s["i"] == 2) & (own < n - 1))))
        rows = pixels.withColumn("o", F.explode(offsets)).withColumn("t", F.explode(keep))
        rest = "x" if along == "y" else "y"
        own = (F.col("o.d") == 0) & (F.col("t.i") == 0)  # sent by the pixel itself, so it is there
        sums = rows.groupBy("image_id", rest, F.col("t.v").alias(along)).agg(F.sum(F.col("val") * F.col("o.w")).alias("val"), F.max(own).alias("own"))
        pixels = sums.where("own").select("image_id", "y", "x", "val")
    return pixels


def equalise_local(pixels: DataFrame, height: int, width: int, clip: float = 40.0, grid: int = 2, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive equalisation: a clipped cumulative histogram for each of grid x grid tiles,
    and each pixel's value interpolated between the tables of the four nearest tiles."""
    th, tw = height / grid, width / grid
    area = th * tw
    limit = max(1, int(clip * area / bins))
    at = pixels.withColumns({"ty": F.floor(F.col("y") / th).cast("int"), "tx": F.floor(F.col("x") / tw).cast("int")})
    n = at.groupBy("image_id", "ty", "tx", "val").agg(F.count("*").alias("n"))
    capped = n.withColumn("over", F.greatest(F.col("n") - limit, F.lit(0)))
    spread = F.sum("over").over(W.partitionBy("image_id", "ty", "tx")) / bins
    upto = F.sum(F.col("n") - F.col("over")).over(W.partitionBy("image_id", "ty", "tx").orderBy("val"))
    table = capped.select("image_id", "ty", "tx", F.col("val"), upto.alias("own"), spread.alias("spread"))
    tables = table.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("val", "own"))).alias("steps"), F.first("spread").alias("spread"))
    fy, fx = (F.col("y") + 0.5) / th - 0.5, (F.col("x") + 0.5) / tw - 0.5
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(grid - 1)).cast("int")
    wy, wx = fy - F.floor(fy), fx - F.floor(fx)
    corner = F.array(*[F.struct(clamp(F.floor(fy) + a).alias("ty"), clamp(F.floor(fx) + b).alias("tx"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    spots = pixels.withColumn("c", F.explode(corner)).select("image_id", "y", "x", "val", "c.*")
    joined = spots.join(tables, ["image_id", "ty", "tx"])
    below = F.filter("steps", lambda s: s["val"] <= F.col("val"))
    own = F.coalesce(F.try_element_at(below, F.lit(-1))["own"], F.lit(0))
    value = F.least((own + F.col("spread") * (F.col("val") + 1)) * (bins - 1) / area, F.lit(float(bins - 1)))
    return joined.groupBy("image_id", "y", "x").agg(F.rint(F.round(F.sum(value * F.col("w")), 9)).cast("int").alias("val"))


def equalise(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Histogram normalisation: values become the cumulative histogram, scaled to 0..255 and interpolated over
    the bins' left edges; fractions are cut off. Histograms are small; pixels are joined to them once."""
    ends = pixels.groupBy("image_id").agg(F.min("val").alias("low"), F.max("val").alias("high"))
    step = F.greatest((F.col("high") - F.col("low")) / F.lit(float(bins)), F.lit(1e-12))
    place = F.least(F.floor((F.col("val") - F.col("low")) / step), F.lit(bins - 1)).cast("int")
    at = pixels.join(ends, "image_id").withColumns({"bin": place, "step": step})
    n = at.groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    grid = n.groupBy("image_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0)))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    cumulative = F.aggregate(counts, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a")), lambda acc: acc["a"])
    tables = grid.select("image_id", "total", cumulative.alias("cum"))
    c = lambda i: F.element_at("cum", i + 1) * 255.0 / F.col("total")
    share = (F.col("val") - F.col("low") - F.col("bin") * F.col("step")) / F.col("step")
    nxt = F.least(F.col("bin") + 1, F.lit(bins - 1))
    value = c(F.col("bin")) + (c(nxt) - c(F.col("bin"))) * F.least(share, F.lit(1.0))
    return at.join(tables, "image_id").select("image_id", "y", "x", F.floor(F.round(value, 9)).cast("int").alias("val"))


def offline(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """The fixed chain that whole datasets are prepared with: blur over 3 x 3 with deviation 5, then local equalisation
    over 2 x 2 tiles."""
    return equalise_local(smooth(pixels, height, width), height, width, grid=2)


def smooth(pixels: DataFrame, height: int, width: int, size: int = 3, sigma: float = 5.0) -> DataFrame:
    """Whole values blurred by a kernel of the given size and deviation, rows first."""
    return blur(pixels, gaussian(size, sigma), height, width, "xy").select("image_id", "y", "x", F.rint(F.round("val", 9)).cast("int").alias("val"))


def preprocess(pixels: DataFrame, height: int, width: int, theta: float | None = None, clahe: bool = False, inverted: bool = False, norm: str = "none", moments: tuple[float, float] | None = None) -> DataFrame:
    """The chain in its fixed order: scale, blur, local equalisation, invert, normalise ("imagenet", "custom"
    per image, "custom_global", "none")."""
    if norm not in ("imagenet", "custom", "custom_global", "none"):
        raise ValueError(f"unknown normalisation {norm!r}")
    out = scale(pixels)
    if theta:
        out = blur(out, blur_kernel(height, theta), height, width)
    if clahe:
        out = scale(equalise_local(out.withColumn("val", F.rint(F.col("val") * 255).cast("int")), height, width))
    if inverted:
        out = invert(out)
    if norm == "imagenet":
        out = normalise(out, sum(IMAGENET_MEAN) / 3, sum(IMAGENET_STD) / 3)
    elif norm == "custom":
        m = out.groupBy("image_id").agg(F.avg("val").alias("m"), F.stddev_samp("val").alias("s"))
        out = out.join(m, "image_id").select("image_id", "y", "x", F.try_divide(F.col("val") - F.col("m"), F.col("s")).alias("val"))
    elif norm == "custom_global":
        if moments is None:
            m = out.agg(F.avg("val").alias("m"), F.stddev_pop("val").alias("s")).first()
            moments = (m["m"], m["s"])
        out = normalise(out, *moments)
    return out


def resize_bilinear(values: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """image_id, y, x, val at the new size, between the four nearest values, pixel centres aligned."""
    for along, n, m in (("y", height, new_height), ("x", width, new_width)):
        rest = "x" if along == "y" else "y"
        src = f"greatest(0D, least({n - 1}D, (t + 0.5D) * {n} / {m} - 0.5D))"
        weights = F.expr(f"flatten(transform(sequence(cast(greatest(0, floor(({along} - 1) * {m} / {n}) - 1) as int), cast(least({m - 1}, ceil(({along} + 2) * {m} / {n}) + 1) as int)), t -> array(struct(t as t, cast(floor({src}) as int) as s, 1 - ({src} - floor({src})) as w), struct(t as t, cast(least({n - 1}, floor({src}) + 1) as int) as s, {src} - floor({src}) as w))))")
        own = F.col(along)
        spread = values.withColumn("u", F.explode(F.filter(weights, lambda u: (u["s"] == own) & (u["w"] > 0))))
        values = spread.groupBy("image_id", rest, F.col("u.t").alias(along)).agg(F.sum(F.col("val") * F.col("u.w")).alias("val")).select("image_id", "y", "x", "val")
    return values


def pad(pixels: DataFrame, below: int, right: int, height: int, width: int) -> DataFrame:
    """Zeros put ``below`` and ``right`` of images of the given size, always by that much."""
    images = pixels.select("image_id").distinct()
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height + below - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width + right - 1))).alias("x"))
    zeros = grid.where((F.col("y") >= height) | (F.col("x") >= width)).withColumn("val", F.lit(0))
    return pixels.unionByName(zeros)


def positions(height: int, width: int) -> dict[str, Column]:
    """pos_x and pos_y in 0..1; pos_x follows y, as callers of this encoding expect."""
    return {"pos_x": F.col("y") / F.lit(float(max(height - 1, 1))), "pos_y": F.col("x") / F.lit(float(max(width - 1, 1)))}


def sincos(position: Column, d: int, low: float = 1e-4) -> Column:
    """Sinusoidal encoding in d dimensions: even ones cosines, odd ones sines, frequency low^(2 (i div 2) / d)."""
    angle = lambda i: position * F.pow(F.lit(low), (F.floor(i / 2) * 2) / F.lit(float(d)))
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(i % 2 == 0, F.cos(angle(i))).otherwise(F.sin(angle(i))))


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels in boxes (image_id, segment, xmin, ymin, xmax, ymax; ends exclusive), with their segment."""
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax"))
    return pixels.join(boxes, "image_id").where(inside).select("image_id", "segment", "y", "x", "val")


def masked(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels outside the mask (image_id, y, x) become 0."""
    m = mask.select("image_id", "y", "x", F.lit(True).alias("inside"))
    return pixels.join(m, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("inside"), F.col("val")).otherwise(0).alias("val"))


def crop_borders(pixels: DataFrame, sequence: Column, size: tuple[int, int] | None = None, dark: bool = True) -> DataFrame:
    """Black borders cut alike from all images of a sequence: the least margin on each side of any of them. An
    image without light pixels has margins of 0; without ``dark`` it has no say, and a sequence of such leaves nothing.
    Images are of the given height and width, or of the size that their pixels take up. Adds ``seq``."""
    lit = F.col("val") > 0
    ends = pixels.groupBy("image_id").agg(*[(F.lit(size[i] - 1) if size else F.max(c)).alias(f"{c}e") for i, c in enumerate("yx")], *[f(F.when(lit, F.col(c))).alias(f"{c}{n}") for c in ("y", "x") for n, f in ((0, F.min), (1, F.max))])
    margin = lambda c: F.coalesce(c, F.lit(0)) if dark else c
    margins = ends.select("image_id", sequence.alias("seq"), margin(F.col("y0")).alias("top"), margin(F.col("ye") - F.col("y1")).alias("bottom"), margin(F.col("x0")).alias("left"), margin(F.col("xe") - F.col("x1")).alias("right"), "ye", "xe")
    least = margins.groupBy("seq").agg(*[F.min(c).alias(c) for c in ("top", "bottom", "left", "right")])
    both = margins.select("image_id", "seq", "ye", "xe").join(least, "seq")
    return pixels.join(both, "image_id").where("y >= top and y <= ye - bottom and x >= left and x <= xe - right").select("image_id", "seq", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), "val")


def sequence_key(name: Column) -> Column:
    """The part of a file name before its first underscore."""
    return F.substring_index(name, "_", 1)


def other_sizes(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return sizes(pixels).where((F.col("height") != height) | (F.col("width") != width))


def to_bytes(x: Column) -> Column:
    """Values from -1..1 as 0..255."""
    return F.least(F.greatest(F.floor(255 * (x * 0.5 + 0.5) + 0.5), F.lit(0)), F.lit(255)).cast("int")
