"""Queries of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans import pipeline as P
from tessella.plans.registry import query, rounded
from tessella.sources import tables as T


@query()
def h1_segmentation_pipeline(spark, sf_dir):
    """Per-image metrics of the segments that the pipeline finds, before clusters of segments."""
    p = T.patches(spark, sf_dir)
    return rounded(P.evaluate(P.run(p, P.Settings(), "segments")["segments"], T.truth(p), 10))


@query()
def h2_parameter_sweep(spark, sf_dir):
    p = T.patches(spark, sf_dir)
    return rounded(P.sweep(spark, p, T.truth(p), {"segments": [3, 6]}))


@query()
def h1_semantic_label_maps(spark, sf_dir):
    """Label maps of the whole pipeline."""
    return P.run(T.patches(spark, sf_dir), P.Settings())["semantic"]


@query("SELECT DISTINCT image_id, n::INT AS segment FROM patches, range(1, 4) r(n)")
def h3_pipeline_semantic_segments(spark, sf_dir):
    """The segments of each image besides the background: k-means of four gives three."""
    out = P.run(T.patches(spark, sf_dir), P.Settings(), "segments")
    return out["segments"].where("label > 0").select("image_id", F.col("label").alias("segment")).distinct()
