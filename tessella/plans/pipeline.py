"""The segmentation pipeline: features -> eigenvectors -> segments -> boxes -> clusters -> label maps -> metrics.

Stages are functions of tables. A stored stage is read instead of computed where all stages before it are
stored too; each can be written as it is computed. Images of all subfolders go through one plan: the
subfolder is part of the image's name, not a loop.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import affinity as A
from tessella.operators import labelmaps as L
from tessella.operators import matching as M
from tessella.operators import metrics as E
from tessella.operators import patches as K
from tessella.operators import segments as S
from tessella.operators import spectral as C
from tessella.operators.joins import parameter_grid
from tessella.sources import store

STAGES = ("eigs", "segments", "boxes", "clusters", "semantic")
#: The settings that each stage reads itself; those of the stages before it reach it as well.
READS = {
    "eigs": ("vectors", "cosine", "ssd", "beta"),
    "segments": ("height", "width", "segments", "adaptive"),
    "boxes": ("erosions", "dilations"),
    "clusters": ("clusters", "seed"),
    "semantic": ("shift",),
}
#: Trials of a sweep that run at a time.
AT_ONCE = 4


@dataclass(frozen=True)
class Settings:
    height: int = 10
    width: int = 10
    segments: int = 4
    clusters: int = 5
    vectors: int = 5
    cosine: float = 1.0
    ssd: float = 0.0
    beta: float = 1.0
    adaptive: bool = False
    erosions: int = 0
    dilations: int = 0
    shift: int = 0
    n_classes: int = 10
    seed: int = 1
    stored: Mapping[str, str] = field(default_factory=dict)


def graph(patches: DataFrame, s: Settings) -> DataFrame:
    """The weighted graph; measures of weight zero are not planned at all."""
    parts = []
    if s.cosine:
        parts.append((A.cosine_graph(patches), s.cosine))
    if s.ssd:
        parts.append((A.measured(patches, V.ssd, s.beta), s.ssd))
    return A.fused(parts)


def segmented(patches: DataFrame, eigen: DataFrame, s: Settings) -> DataFrame:
    """Label map of k-means over the eigenvectors (as many as the eigengap says, if ``adaptive``), background first."""
    rows = eigen.withColumn("vec", C.signed(F.col("vec")))
    if s.adaptive:
        rows = rows.join(C.eigengap(eigen), "image_id").where("k < n").drop("n")
    labels = C.kmeans_patches(C.spectral_patches(rows), s.segments)
    return L.background_first(C.label_map(labels, s.width), s.height, s.width)


def fingerprint(s: Settings, stage: str) -> tuple:
    """All settings that a stage's table depends on: trials that agree in it share the table."""
    return stage, *[getattr(s, name) for earlier in STAGES[: STAGES.index(stage) + 1] for name in READS[earlier]]


def run(patches: DataFrame, s: Settings, until: str = STAGES[-1], made: Mapping[tuple, DataFrame] = MappingProxyType({})) -> dict[str, DataFrame]:
    """Tables of the stages up to ``until`` by name, stored ones read from ``s.stored``, and those that are ``made`` already, by
    their fingerprint, from there."""
    spark = patches.sparkSession
    n = store.stored_until(STAGES, s.stored)
    out: dict[str, DataFrame] = {name: spark.read.parquet(s.stored[name]) for name in STAGES[:n]}

    build = {
        "eigs": lambda: C.eigenvectors(graph(patches, s), s.vectors),
        "segments": lambda: segmented(patches, out["eigs"], s),
        "boxes": lambda: S.boxes(out["segments"], s.height, s.width, erosions=s.erosions, dilations=s.dilations),
        "clusters": lambda: S.clustered(K.pooled(patches, out["segments"]).where("segment > 0"), s.clusters, s.seed),
        "semantic": lambda: S.semantic(out["segments"], out["clusters"], s.shift),
    }
    for name in STAGES[n : STAGES.index(until) + 1]:
        if fingerprint(s, name) in made:
            out[name] = made[fingerprint(s, name)]
            continue
        out[name] = build[name]()
        if name in ("eigs", "segments"):  # several later stages read these
            out[name] = store.settled(out[name], name)
    return out


def evaluate(pred: DataFrame, gt: DataFrame, n_classes: int) -> DataFrame:
    """Per-image macro metrics after matching labels image by image."""
    p, g = L.dense(pred), L.dense(gt)
    counts = store.settled(M.contingency(M.pairs(p, g)), "counts")  # one row a label pair; every matching reads it
    found = M.named(M.match(M.iou(counts)), L.dense_names(gt), L.dense_names(pred))
    final = L.remap(pred, M.mapping(found))
    return E.macro(E.scores(E.confusion(M.contingency(M.pairs(final, gt)), range(n_classes))), n_classes)


def sweep(spark: SparkSession, patches: DataFrame, gt: DataFrame, values: Mapping[str, list], base: Settings = Settings()) -> DataFrame:
    """One row a trial: its parameters and the mean IoU of its segments. A stage's table is made once for all trials whose
    settings up to it are the same; ``AT_ONCE`` tables or trials run at a time, each over all its images."""
    rows = [r.asDict() for r in parameter_grid(spark.range(1).select(), values).collect()]  # the parameter grid
    trials = [replace(base, **r) for r in rows]
    made: dict[tuple, DataFrame] = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for stage in ("eigs", "segments"):
            wanted = {fingerprint(s, stage): s for s in trials}
            made |= dict(zip(wanted, pool.map(lambda s, stage=stage: run(patches, s, stage, made)[stage], wanted.values()), strict=True))

        def score(trial: tuple[dict, Settings]) -> DataFrame:
            row, s = trial
            found = evaluate(made[fingerprint(s, "segments")], gt, s.n_classes).agg(F.avg("jaccard").alias("miou"))
            return store.settled(found.select(*[F.lit(v).alias(k) for k, v in row.items()], "miou"), "trial")

        out = list(pool.map(score, zip(rows, trials, strict=True)))
    store.dropped(*[t for t in made.values() if hasattr(t, "settled_at")])
    return reduce(DataFrame.unionByName, out)
