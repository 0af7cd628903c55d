"""Spectral segmentation: eigenvectors of image graphs, clusters of patches, refinement.

Matrices of images of up to ``DENSE`` patches are decomposed in grouped pandas functions, one image a group; those of
larger images, and kernels over the segments of all images, by block Lanczos over tables (``eigen``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import eigen as E
from tessella.sources.store import settled

#: Patches of an image up to which its matrix is decomposed in one task (32 MB).
DENSE = 2048

KINDS = ("laplacian", "laplacian_normalised", "affinity", "affinity_svd")


def eigenvectors(edges: DataFrame, n_vectors: int, kind: str = "laplacian_normalised", dense: int = DENSE) -> DataFrame:
    """image_id, k, eigenvalue, vec (in order of patch): smallest of (D - W) v = lambda D v or of D - W; for "affinity" the largest
    of W, for "affinity_svd" its left singular vectors. Images of more than ``dense`` patches go through tables."""
    if kind not in KINDS:
        raise ValueError(f"unknown matrix {kind!r}")
    edges = settled(edges.select("image_id", "i", "j", F.col("w").cast("double").alias("w")), "edges")
    large = settled(edges.groupBy("image_id").agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n")).where(F.col("n") > dense), "large")
    if large.limit(1).count():
        within, beyond = edges.join(large, "image_id", "left_anti"), edges.join(large, "image_id", "left_semi")
        return dense_eigenvectors(within, n_vectors, kind).unionByName(large_eigenvectors(beyond, large, n_vectors, kind))
    return dense_eigenvectors(edges, n_vectors, kind)


def large_eigenvectors(edges: DataFrame, sizes: DataFrame, n_vectors: int, kind: str) -> DataFrame:
    """As ``eigenvectors``, without a matrix in any task: see ``eigen``."""
    graph = edges.withColumnRenamed("image_id", "g")
    if kind == "laplacian_normalised":
        values, vectors = E.normalised_laplacian(graph, n_vectors)
    else:
        # all matrices over the largest degree, so that their norms are about 1
        degree = graph.groupBy("g", "i").agg(F.sum("w").alias("d"), F.sum(F.abs("w")).alias("a"))
        top = settled(degree.groupBy("g").agg(F.max("a").alias("top")), "degrees")
        parts = graph.select("g", "i", "j", "w")
        if kind == "laplacian":  # 2 top - (D - W)
            own = degree.join(top, "g").select("g", "i", F.col("i").alias("j"), (2 * F.col("top") - F.when(F.col("d") < 1e-12, 1.0).otherwise(F.col("d"))).alias("w"))
            parts = parts.unionByName(own)
        scaled = settled(parts.join(top, "g").select("g", "i", "j", (F.col("w") / F.col("top")).alias("w")), "scaled")
        once = lambda b: E.edge_product(scaled, b)
        twice = lambda b: lambda v: once(b)(once(b)(v).withColumnRenamed("u", "v"))
        values, vectors = E.largest(degree.select("g", "i"), twice if kind == "affinity_svd" else once, n_vectors)
        back = {"laplacian": lambda x, t: 2 * t - x * t, "affinity": lambda x, t: x * t, "affinity_svd": lambda x, t: F.sqrt(F.greatest(x, F.lit(0.0))) * t}[kind]
        values = values.join(top, "g").select("g", F.transform("values", lambda x: back(x, F.col("top"))).alias("values"))
    entries = vectors.select("g", "i", F.posexplode("v").alias("k", "x"))
    listed = entries.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("g", "k", F.col("c.x").alias("vec"))
    rows = values.select("g", F.posexplode("values").alias("k", "eigenvalue")).join(listed, ["g", "k"])
    return rows.join(sizes.select(F.col("image_id").alias("g"), "n"), "g").where("k < n").select(F.col("g").alias("image_id"), "k", "eigenvalue", "vec")


def dense_eigenvectors(edges: DataFrame, n_vectors: int, kind: str) -> DataFrame:
    """As ``eigenvectors``, from a matrix for each image in one task."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(max(rows["i"].max(), rows["j"].max())) + 1
        w = np.zeros((n, n))
        np.add.at(w, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["w"].to_numpy())
        if kind == "affinity":
            values, vectors = np.linalg.eigh((w + w.T) / 2)
            values, vectors = values[::-1], vectors[:, ::-1]
        elif kind == "affinity_svd":
            vectors, values, _ = np.linalg.svd(w)
        else:
            d = w.sum(1)
            d[d < 1e-12] = 1
            half = 1 / np.sqrt(d) if kind == "laplacian_normalised" else np.ones(n)
            m = (np.diag(d) - w) * half[:, None] * half[None, :]
            values, vectors = np.linalg.eigh((m + m.T) / 2)
            vectors = vectors * half[:, None]
        k = min(n_vectors, n)
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "k": np.arange(k, dtype=np.int32), "eigenvalue": values[:k], "vec": list(vectors.T[:k])})

    kind_of = dict(edges.dtypes)["image_id"]
    return edges.groupBy("image_id").applyInPandas(solve, f"image_id {kind_of}, k int, eigenvalue double, vec array<double>")


def residuals(edges: DataFrame, eigen: DataFrame) -> DataFrame:
    """image_id, off: the largest entry of |(D - W) v - lambda D v| over an image's eigenpairs, where a degree of 0 counts as 1. An
    image of up to ``DENSE`` patches is a group, with its matrix; its edges are never rows beside each of its vectors."""

    def solve(image: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(image) or not len(pairs):
            return pd.DataFrame({"image_id": [], "off": []})
        v = np.stack(pairs["vec"].to_numpy(), axis=1)
        w = np.zeros((len(v), len(v)))
        np.add.at(w, (image["i"].to_numpy(), image["j"].to_numpy()), image["w"].to_numpy())
        d = w.sum(1)
        d[d < 1e-12] = 1
        off = np.abs(d[:, None] * v - w @ v - d[:, None] * v * pairs["eigenvalue"].to_numpy())
        return pd.DataFrame({"image_id": image["image_id"].iloc[:1], "off": [off.max()]})

    kind = dict(edges.dtypes)["image_id"]
    both = edges.select("image_id", "i", "j", "w").groupBy("image_id").cogroup(eigen.select("image_id", "eigenvalue", "vec").groupBy("image_id"))
    return both.applyInPandas(solve, f"image_id {kind}, off double")


def signed(vec: Column) -> Column:
    """A vector turned over if more than half, but not all, of it is positive."""
    share = F.size(F.filter(vec, lambda x: x > 0)) / F.size(vec)
    return F.when((share > 0.5) & (share < 1.0), F.transform(vec, lambda x: -x)).otherwise(vec)


def eigengap(eigen: DataFrame) -> DataFrame:
    """image_id, n: the number of clusters before the largest gap, the first gap left out."""
    gap = F.lead("eigenvalue").over(W.partitionBy("image_id").orderBy("k")) - F.col("eigenvalue")
    gaps = eigen.withColumn("gap", gap).where("gap is not null and k > 0")
    return gaps.groupBy("image_id").agg((F.min_by("k", F.struct(-F.col("gap"), F.col("k"))) + 1).alias("n"))


def lloyd(x: np.ndarray, k: int, iterations: int = 100) -> np.ndarray:
    """k-means of few rows: centres start at the first row and then at the row farthest from all before."""
    k = min(k, len(x))
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    for _ in range(1, k):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres, label = x[chosen].astype(float), None
    for _ in range(iterations):
        new = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = x[label == c].mean(0)
    return label


def kmeans_patches(patches: DataFrame, k: int) -> DataFrame:
    """image_id, p, label: k-means of the patch vectors (p, k) of each image."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        return pd.DataFrame({"image_id": rows["image_id"], "p": rows["p"], "label": lloyd(np.stack(rows["k"].to_numpy()), k).astype(np.int32)})

    kinds = dict(patches.dtypes)
    return patches.select("image_id", "p", "k").groupBy("image_id").applyInPandas(solve, f"image_id {kinds['image_id']}, p int, label int")


def spectral_patches(eigen: DataFrame, skip_first: bool = True) -> DataFrame:
    """image_id, p, k: each patch's coordinates in the eigenvectors, the first one left out."""
    rows = eigen.where("k > 0") if skip_first else eigen
    cells = rows.select("image_id", "k", F.posexplode("vec").alias("p", "v"))
    return cells.groupBy("image_id", "p").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).select("image_id", "p", F.col("c.v").alias("k"))


def label_map(labels: DataFrame, width: int) -> DataFrame:
    return labels.select("image_id", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), "label")


def single_region(eigen: DataFrame, width: int, threshold: float = 0.0) -> DataFrame:
    """Label map of the second eigenvector above a threshold."""
    cells = eigen.where("k = 1").select("image_id", F.posexplode("vec").alias("p", "v"))
    return label_map(cells.select("image_id", "p", (F.col("v") > threshold).cast("int").alias("label")), width)


def power_clusters(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """id, cluster of a whole graph (i, j, w): spectral clustering by power iteration."""
    pic = PowerIterationClustering(k=k, maxIter=iterations, srcCol="i", dstCol="j", weightCol="w")
    return pic.assignClusters(edges.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("double")))


def principal(features: DataFrame, k: int, column: str = "features") -> DataFrame:
    """features reduced to their first k principal components."""
    rows = features.withColumn("v", array_to_vector(column))
    model = PCA(k=k, inputCol="v", outputCol="reduced").fit(rows)
    return model.transform(rows).withColumn(column, vector_to_array("reduced")).drop("v", "reduced")


def density_clusters(features: DataFrame, min_samples: int, xi: float = 0.05, key: str = "image_id") -> DataFrame:
    """key, p, cluster: OPTICS by cosine distance within each group; clusters end where reachability rises
    steeply above its median, and -1 is noise. A group is one image's segments."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        x = np.stack(rows["k"].to_numpy())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = np.maximum(1 - x @ x.T, 0)
        n = len(x)
        core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
        reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
        for _ in range(n):
            at = int(np.argmin(np.where(done, np.inf, np.where(np.isinf(reach), 1e18, reach))))
            done[at] = True
            order.append(at)
            reach = np.where(done, reach, np.minimum(reach, np.maximum(core[at], d[at])))
        r = reach[order]
        bound = np.median(r[np.isfinite(r)]) * (1 + xi) if np.isfinite(r).any() else 0
        label, c = np.full(n, -1), -1
        for place, at in enumerate(order):
            if r[place] > bound:
                c += core[at] <= bound
                label[at] = c if core[at] <= bound else -1
            else:
                label[at] = c
        return pd.DataFrame({key: rows[key], "p": rows["p"], "cluster": label.astype(np.int32)})

    return features.select(key, "p", "k").groupBy(key).applyInPandas(solve, f"{key} {dict(features.dtypes)[key]}, p int, cluster int")
