"""Dense conditional random fields over label maps, with messages by way of lattices.

Every pixel agrees with every other, the more the nearer and the more alike they are. Sums over all pairs are taken on two
lattices of an image: rows, columns and values in units of the kernel's widths, and rows and columns alone. What pixels
send is added to the lattice points around them (splat), spread along each axis (blur) and read back at the
pixels (slice), so a message costs a pixel some dozen rows of a sum by lattice key, however many pixels there are. Nothing
is spread to where no pixel of the image can read it: a lattice is as large as the image's rows, columns and values. Between
points it is interpolated linearly, which widens a Gaussian by a third of a unit's square; what is spread is narrower by
as much.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.store import dropped, shuffled

#: A lattice's unit, as a share of its kernel's standard deviation, and how many deviations the kernel reaches.
UNIT, REACH = 0.6, 3.5
#: Pixels of a side of the squares in which an image's pixels are stored, so that a task adds up most of what a lattice point gets.
SQUARE = 64
#: Columns of ``spanned``.
SPAN = [f"{c}{end}" for c in ("y", "x", "val") for end in (0, 1)]


class Kernel(NamedTuple):
    """A weight, and the standard deviations over rows and columns and over values (None: of no account)."""

    weight: float
    space: float
    value: float | None


def taps() -> list[float]:
    """Weights of lattice points 0, 1, ... units away along an axis, for a kernel of height 1."""
    narrow = 1 - UNIT**2 / 3
    n = math.ceil(REACH / UNIT)
    raw = [math.exp(-((i * UNIT) ** 2) / (2 * narrow)) for i in range(n + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [math.sqrt(2 * math.pi) / UNIT * x / total for x in raw]


def axes(kernel: Kernel) -> list[Column]:
    """A pixel's place on each axis of a kernel's lattice, in units."""
    at = [F.col(c) / (kernel.space * UNIT) for c in ("y", "x")]
    return at + [F.col("val") / (kernel.value * UNIT) if kernel.value else F.lit(0.0)]


def corners(kernel: Kernel, kind: int) -> Column:
    """The lattice points around a pixel: kind, a, b, c and the share of each."""
    points = [(F.lit(1.0), [])]
    for at, flat in zip(axes(kernel), (False, False, kernel.value is None), strict=True):
        low = F.floor(at)
        sides = [(F.lit(1.0), low)] if flat else [(1 - (at - low), low), (at - low, low + 1)]
        points = [(share * s, [*place, p]) for share, place in points for s, p in sides]
    return F.array(*[F.struct(F.lit(kind).alias("kind"), *[p.cast("int").alias(c) for c, p in zip("abc", place, strict=True)], share.alias("share")) for share, place in points])


def own_share(kernel: Kernel) -> Column:
    """What a pixel gets back of what it sends."""
    t = taps()
    out = F.lit(kernel.weight)
    for at, flat in zip(axes(kernel), (False, False, kernel.value is None), strict=True):
        if not flat:
            f = at - F.floor(at)
            out = out * (t[0] * ((1 - f) * (1 - f) + f * f) + 2 * t[1] * f * (1 - f))
    return out


def spanned(pixels: DataFrame) -> DataFrame:
    """pixels with the first and last of their image's rows, columns and values (y0, y1, x0, x1, val0, val1)."""
    finite = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in ("y", "x", "val")}
    ends = pixels.groupBy("image_id").agg(*[f(v).alias(f"{c}{i}") for c, v in finite.items() for i, f in enumerate((F.min, F.max))])
    return pixels.join(ends.hint("merge"), "image_id").hint("merge")


def reach(kernels: tuple[Kernel, ...]) -> list[Column]:
    """The first and last lattice points that pixels of the image read, along each axis (a0, a1, b0, b1, c0, c1), by kind."""
    out = []
    for axis, c in zip("abc", ("y", "x", "val"), strict=True):
        for end in (0, 1):
            at = [F.lit(0) if c == "val" and k.value is None else (F.floor(F.col(f"{c}{end}") / ((k.value if c == "val" else k.space) * UNIT)) + end).cast("int") for k in kernels]
            out.append(F.element_at(F.array(*at), F.col("kind") + 1).alias(f"{axis}{end}"))
    return out


def spread(cells: DataFrame, axis: str, kernels: tuple[Kernel, ...], width: int) -> DataFrame:
    """Cells (image_id, kind, a, b, c, m, and the first and last points of this axis and those to come) blurred along an axis, from
    its first point to its last; an axis that a kernel does not have stays as it is."""
    t = taps()
    sent = cells.withColumn("to", F.explode(F.sequence(F.greatest(F.col(axis) - len(t) + 1, F.col(f"{axis}0")), F.least(F.col(axis) + len(t) - 1, F.col(f"{axis}1")))))
    tap = F.element_at(F.array(*[F.lit(x) for x in t]), F.abs(F.col("to") - F.col(axis)) + 1)
    flat = [i for i, k in enumerate(kernels) if k.value is None] if axis == "c" else []
    sent = sent.withColumn("tap", F.when(F.col("kind").isin(flat), 1.0).otherwise(tap) if flat else tap)
    places = [F.col("to").alias(c) if c == axis else F.col(c) for c in "abc"]
    later = [f"{c}{end}" for c in "abc" if c > axis for end in (0, 1)]
    return sent.groupBy("image_id", "kind", *places, *later).agg(F.array(*[F.sum(F.col("m")[i] * F.col("tap")) for i in range(width)]).alias("m"))


def messages(pixels: DataFrame, kernels: tuple[Kernel, ...], width: int) -> DataFrame:
    """image_id, y, x, got: for each pixel (image_id, y, x, val, m: array; ``spanned`` or not) the sum of the others' m, weighted by
    the kernels."""
    pixels = pixels if "val1" in pixels.columns else spanned(pixels)
    near = F.explode(F.concat(*[corners(k, i) for i, k in enumerate(kernels)]))
    at = pixels.select("*", near.alias("p")).select("image_id", "y", "x", "m", *SPAN, "p.*")
    cells = at.groupBy("image_id", "kind", "a", "b", "c", *SPAN).agg(F.array(*[F.sum(F.col("m")[i] * F.col("share")) for i in range(width)]).alias("m"))
    cells = cells.select("image_id", "kind", "a", "b", "c", "m", *reach(kernels))
    for axis in "abc":
        cells = spread(cells, axis, kernels, width)
    weight = F.element_at(F.array(*[F.lit(k.weight) for k in kernels]), F.col("kind") + 1)
    read = at.drop("m", *SPAN).join(cells, ["image_id", "kind", "a", "b", "c"])
    got = read.groupBy("image_id", "y", "x").agg(F.array(*[F.sum(weight * F.col("share") * F.col("m")[i]) for i in range(width)]).alias("all"))
    own = sum((own_share(k) for k in kernels[1:]), own_share(kernels[0]))
    return pixels.select("image_id", "y", "x", "m", own.alias("own")).join(got, ["image_id", "y", "x"]).select("image_id", "y", "x", F.transform(F.arrays_zip("all", "m"), lambda z: z["all"] - F.col("own") * z["m"]).alias("got"))


def softmax(scores: Column) -> Column:
    """exp(scores) over their sum."""
    high = F.transform(F.array(F.array_max(scores)), lambda top: F.transform(scores, lambda s: F.exp(s - top)))[0]
    return F.transform(F.array(F.struct(high.alias("e"), F.aggregate(high, F.lit(0.0), lambda a, x: a + x).alias("t"))), lambda z: F.transform(z["e"], lambda e: e / z["t"]))[0]


def refined(labels: DataFrame, pixels: DataFrame, n_labels: int, kernels: tuple[Kernel, ...] = (Kernel(6.0, 40.0, 13.0), Kernel(3.0, 3.0, None)), iterations: int = 5, certain: float = 0.7) -> DataFrame:
    """Label map (image_id, y, x, label) sharpened by mean-field inference over images (image_id, y, x, val from 0 to 255).

    A pixel holds its label for ``certain`` at first. Messages are divided by the roots of what both pixels get from all
    others. Of equal labels the lower one wins. One label leaves the map as it is.
    """
    keys = ["image_id", "y", "x"]
    total = sum(k.weight for k in kernels)
    doubt = math.log(certain) - math.log((1 - certain) / max(n_labels - 1, 1))
    unary = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda n: F.when(n == F.col("label"), doubt).otherwise(0.0))
    square = [F.floor(F.col(c) / SQUARE) for c in ("y", "x")]
    kept = [*keys, "val", *SPAN, "unary"]
    first = labels.hint("merge").join(pixels, keys).select(*keys, F.col("val").cast("double").alias("val"), unary.alias("unary"))
    first = shuffled(first.repartition("image_id", *square), "field")
    rows = spanned(first)
    norm = messages(rows.withColumn("m", F.array(F.lit(1.0))), kernels, 1)
    rows = shuffled(rows.join(norm, keys).select(*kept, F.sqrt(F.greatest(F.col("got")[0], F.lit(1e-20))).alias("root"), softmax(F.col("unary")).alias("q")).repartition("image_id", *square), "field")
    dropped(first)
    for _ in range(iterations):
        sent = rows.withColumn("m", F.transform("q", lambda q: q / F.col("root")))
        got = messages(sent, kernels, n_labels)
        scores = F.transform(F.arrays_zip("unary", "got"), lambda z: z["unary"] + total * z["got"] / F.col("root"))
        before, rows = rows, shuffled(rows.join(got, keys).withColumn("scores", scores).select(*kept, "root", softmax(F.col("scores")).alias("q")).repartition("image_id", *square), "field")
        dropped(before)
    return rows.select(*keys, (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("label"))
