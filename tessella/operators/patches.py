"""Patch vectors (image_id, p, py, px, k): normalisation, tokens and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import norm


def normalised(k: Column, eps: float | None = 1e-12) -> Column:
    """k over its length, at least eps; without eps a zero vector becomes NaN."""
    n = norm(k)
    if eps is None:
        return F.transform(k, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / F.nullif(n, F.lit(0.0))))
    return F.transform(k, lambda x: x / F.greatest(n, F.lit(eps)))


def drop_tokens(tokens: DataFrame, registers: int = 0) -> DataFrame:
    """Tokens (image_id, t, k) without the class token and the register tokens; t becomes the patch number p."""
    return tokens.where(F.col("t") > registers).select("image_id", (F.col("t") - registers - 1).alias("p"), "k")


def keys_of(qkv: Column, d: int) -> Column:
    """The key third of a token's joined query, key and value vector."""
    return F.slice(qkv, d + 1, d)


def fused(how: str, *parts: tuple[Column, float]) -> Column:
    """Vectors and weights as one: their weighted "sum", or weighted and put side by side ("concat")."""
    times = lambda k, w: F.transform(k, lambda x: x * w)
    weighted = [times(k, w) for k, w in parts]
    if how == "concat":
        return F.concat(*weighted)
    if how != "sum":
        raise ValueError(f"unknown fusion {how!r}")
    out = weighted[0]
    for w in weighted[1:]:
        out = F.zip_with(out, w, lambda x, y: x + y)
    return out


def pooled(patches: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, segment, features: the mean patch vector of each segment of the label map."""
    at = patches.join(labels.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), F.col("label").alias("segment")), ["image_id", "py", "px"])
    mean = at.select("image_id", "segment", F.posexplode("k").alias("i", "v")).groupBy("image_id", "segment", "i").agg(F.avg("v").alias("v"))
    return mean.groupBy("image_id", "segment").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("f")).select("image_id", "segment", F.col("f.v").alias("features"))
