"""Random views of images for self-supervised training: crops resized by inverse mapping, flips, colour jitter, grey, blur and
solarisation.

What happens to a view is drawn from hashes of image and view, so every run gives the same; a row per view says it all. The
pixels of a view then look their source pixels up, one join for all views, and colours change row by row; only the
contrast needs a mean over the view.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.pixels import blur, gaussian
from tessella.operators.sampling import draw

#: Weights of red, green and blue in grey, and the range of a crop's aspect ratio.
GREY, RATIO = (0.299, 0.587, 0.114), (3 / 4, 4 / 3)
CHANNELS = ("r", "g", "b")


@dataclass(frozen=True)
class Views:
    """How many global and local views, their sides in pixels, the shares of an image's area that they show, and chances in
    tenths: of a flip, of jitter, of grey, of blur (first view, other global ones, local ones), and of solarisation (of the
    second view). Jitter is up to these strengths, hue in turns of the colour wheel; sigma is the
    blur's deviation in pixels."""

    n_global: int = 2
    n_local: int = 6
    side_global: int = 224
    side_local: int = 96
    area_global: tuple[float, float] = (0.4, 1.0)
    area_local: tuple[float, float] = (0.05, 0.4)
    flip: int = 5
    jitter: int = 8
    grey: int = 2
    blur: tuple[int, int, int] = (10, 1, 5)
    solarise: int = 2
    brightness: float = 0.4
    contrast: float = 0.4
    saturation: float = 0.2
    hue: float = 0.1
    sigma: float = 1.0
    seed: int = 1


def plans(images: DataFrame, v: Views) -> DataFrame:
    """image_id, view, side, top, left, height, width, flip, fb, fc, fs, fh, grey, blur, solarise: what each view of images
    (image_id, height, width) is to be; factors of brightness, contrast and saturation, shift of hue."""
    rows = images.select("image_id", F.col("height").alias("ih"), F.col("width").alias("iw"), F.explode(F.sequence(F.lit(0), F.lit(v.n_global + v.n_local - 1))).alias("view"))
    pick = lambda n, what: draw(n, what, F.col("image_id"), F.col("view"), v.seed)
    wide = F.col("view") < v.n_global
    chance = lambda tenths, what: pick(10, what) < tenths
    part = lambda what: pick(1001, what) / 1000.0
    around = lambda most, what: F.when(F.col("jitter"), (pick(2001, what) - 1000) / 1000.0 * most).otherwise(0.0)
    low, high = (F.when(wide, v.area_global[i]).otherwise(v.area_local[i]) for i in (0, 1))
    rows = rows.withColumns({"area": (low + part("area") * (high - low)) * F.col("ih") * F.col("iw"), "ratio": F.exp(math.log(RATIO[0]) + part("ratio") * (math.log(RATIO[1]) - math.log(RATIO[0]))), "jitter": chance(v.jitter, "jitter")})
    length = lambda x, most: F.greatest(F.least(F.floor(F.sqrt(F.round(x, 6)) + 0.5), F.col(most)), F.lit(1)).cast("int")
    rows = rows.withColumns({"height": length(F.col("area") / F.col("ratio"), "ih"), "width": length(F.col("area") * F.col("ratio"), "iw")})
    blur = F.when(F.col("view") == 0, chance(v.blur[0], "blur")).when(wide, chance(v.blur[1], "blur")).otherwise(chance(v.blur[2], "blur"))
    return rows.select(
        "image_id", "view", F.when(wide, v.side_global).otherwise(v.side_local).alias("side"), pick(F.col("ih") - F.col("height") + 1, "top").alias("top"), pick(F.col("iw") - F.col("width") + 1, "left").alias("left"), "height", "width",
        chance(v.flip, "flip").alias("flip"), (1 + around(v.brightness, "brightness")).alias("fb"), (1 + around(v.contrast, "contrast")).alias("fc"), (1 + around(v.saturation, "saturation")).alias("fs"), around(v.hue, "hue").alias("fh"),
        chance(v.grey, "grey").alias("grey"), blur.alias("blur"), ((F.col("view") == 1) & (F.lit(v.n_global) > 1) & chance(v.solarise, "solarise")).alias("solarise"),
    )


def grey_of(r: Column, g: Column, b: Column) -> Column:
    return r * GREY[0] + g * GREY[1] + b * GREY[2]


def clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def turned(rows: DataFrame) -> DataFrame:
    """Colours with their hue shifted by fh."""
    r, g, b = (F.col(c) for c in CHANNELS)
    rows = rows.withColumns({"high": F.greatest(r, g, b), "low": F.least(r, g, b)})
    span = F.col("high") - F.col("low")
    hue = F.when(span == 0, 0.0).when(F.col("high") == r, (g - b) / span).when(F.col("high") == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    rows = rows.withColumn("hue", hue + 6 * F.col("fh"))
    at = lambda n: F.pmod(n + F.col("hue"), F.lit(6.0))
    value = lambda n: F.when(F.col("fh") == 0, F.col({5: "r", 3: "g", 1: "b"}[n])).otherwise(F.col("high") - span * F.greatest(F.least(at(n), 4 - at(n), F.lit(1.0)), F.lit(0.0)))
    return rows.withColumns({"r2": value(5), "g2": value(3), "b2": value(1)}).drop("r", "g", "b", "high", "low", "hue").withColumnsRenamed({"r2": "r", "g2": "g", "b2": "b"})


def soft(rows: DataFrame, v: Views) -> DataFrame:
    """rows with the views blurred that are to be: each channel of a view is an image to the blur."""
    marks = ["image_id", "view", "y", "x", *CHANNELS, "solarise"]
    out = rows.where(~F.col("blur")).select(*marks)
    half = math.ceil(3 * v.sigma)
    for which, side in ((F.col("view") < v.n_global, v.side_global), (F.col("view") >= v.n_global, v.side_local)):
        some = rows.where(F.col("blur") & which)
        channel = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("val")) for c in CHANNELS])).alias("p")
        long = some.select(F.struct("image_id", "view", "solarise").alias("of"), "y", "x", channel).select(F.struct("of", "p.c").alias("image_id"), "y", "x", "p.val")
        done = blur(long, gaussian(2 * half + 1, v.sigma), side, side)
        wide = done.groupBy("image_id.of", "y", "x").agg(*[F.max(F.when(F.col("image_id.c") == c, F.col("val"))).alias(c) for c in CHANNELS])
        out = out.unionByName(wide.select("of.image_id", "of.view", "y", "x", *CHANNELS, "of.solarise"))
    return out


def augmented(pixels: DataFrame, v: Views = Views(), blurred: bool = True, size: tuple[int, int] | None = None) -> DataFrame:
    """image_id, view, y, x, r, g, b (0 to 1) of all views of images (image_id, y, x, r, g, b from 0 to 255) of the given height
    and width, or of the size that their pixels take up. Where an image has no pixel its views have none."""
    images = pixels.groupBy("image_id").agg(*[(F.lit(size[i]) if size else F.max(c) + 1).alias(name) for i, (c, name) in enumerate((("y", "height"), ("x", "width")))])
    plan = plans(images, v)
    along = lambda name: F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias(name)
    out = plan.select("*", along("oy")).select("*", along("ox"))
    source = lambda start, o, size: (F.col(start) + F.floor((o + 0.5) * F.col(size) / F.col("side"))).cast("int")
    out = out.withColumns({"y": source("top", F.col("oy"), "height"), "x": source("left", F.when(F.col("flip"), F.col("side") - 1 - F.col("ox")).otherwise(F.col("ox")), "width")})
    rows = out.join(pixels.select("image_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in CHANNELS]), ["image_id", "y", "x"])
    rows = rows.select("image_id", "view", F.col("oy").alias("y"), F.col("ox").alias("x"), *CHANNELS, "fb", "fc", "fs", "fh", "grey", "blur", "solarise")
    rows = rows.withColumns({c: clipped(F.col(c) * F.col("fb")) for c in CHANNELS})
    mean = rows.groupBy("image_id", "view").agg(F.avg(grey_of(*map(F.col, CHANNELS))).alias("mean"))
    rows = rows.join(mean, ["image_id", "view"]).withColumns({c: F.when(F.col("fc") == 1, F.col(c)).otherwise(clipped(F.col(c) * F.col("fc") + F.col("mean") * (1 - F.col("fc")))) for c in CHANNELS})
    own = grey_of(*map(F.col, CHANNELS))
    rows = turned(rows.withColumns({c: clipped(F.col(c) * F.col("fs") + own * (1 - F.col("fs"))) for c in CHANNELS}))
    rows = rows.withColumns({c: F.when(F.col("grey"), own).otherwise(F.col(c)) for c in CHANNELS})
    if blurred:
        rows = soft(rows, v)
    return rows.select("image_id", "view", "y", "x", *[F.when(F.col("solarise") & (F.col(c) >= 0.5), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in CHANNELS])
