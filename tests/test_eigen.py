"""Eigenpairs over tables against dense ones, and clusters of a kernel against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import eigen as E
from tessella.operators import spectral as S
from tessella.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def graphs():
    rng = np.random.default_rng(7)
    out = {}
    for name, n in (("a", 40), ("b", 23), ("c", 3)):
        x = rng.normal(size=(n, 3)) + 4 * (np.arange(n) % 3)[:, None]
        out[name] = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    return out


@pytest.fixture(scope="module")
def edges(spark, graphs):
    return spark.createDataFrame([(g, i, j, float(w[i, j])) for g, w in graphs.items() for i in range(len(w)) for j in range(len(w))], "image_id string, i int, j int, w double").persist()


@pytest.mark.parametrize("kind", ["laplacian", "laplacian_normalised", "affinity_svd"])
def test_eigenpairs_over_tables_are_the_dense_ones(graphs, edges, kind, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    # with a bound between the sizes both ways are taken
    found = {(r.image_id, r.k): r for r in S.eigenvectors(edges, 4, kind, dense=30 if kind == "affinity_svd" else 0).collect()}
    dense = {(r.image_id, r.k): r for r in S.dense_eigenvectors(edges, 4, kind).collect()}
    assert found.keys() == dense.keys() and len(found) == 11
    for (g, k), r in found.items():
        w, v = graphs[g], np.array(r.vec)
        assert abs(r.eigenvalue - dense[g, k].eigenvalue) < 1e-8
        d = np.diag(w.sum(1))
        left, right = {"laplacian": (d - w, np.eye(len(w))), "laplacian_normalised": (d - w, d), "affinity": (w, np.eye(len(w))), "affinity_svd": (w @ w, np.eye(len(w)))}[kind]
        value = r.eigenvalue**2 if kind == "affinity_svd" else r.eigenvalue
        assert len(v) == len(w) and abs(v @ right @ v - 1) < 1e-8 and np.abs(left @ v - value * right @ v).max() < 1e-6


def clusters(x, k, gamma):
    w = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    root = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(w / root[:, None] / root[None])
    v = vectors[:, -k:] / root[:, None]
    rows, rest = [], v.copy()
    for _ in range(k):
        at = int((rest**2).sum(1).argmax())
        rows.append(at)
        u = rest[at] / np.linalg.norm(rest[at])
        rest = rest - np.outer(rest @ u, u)
    a, _, b = np.linalg.svd(v[rows].T)
    return np.abs(v @ (a @ b)).argmax(1)


def test_clusters_of_a_kernel(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (n, 2)) for c, n in ((0, 30), (4, 20), (9, 11))])
    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "g int, i long, x array<double>")
    whole = E.kernel_product(rows, 0.5, 2, 8)(rows.select("g", "i", F.array(F.lit(1.0), F.col("x")[0]).alias("v")))
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    got = np.array([r.u for r in whole.orderBy("i").collect()])
    assert np.allclose(got, np.stack([kernel.sum(1), kernel @ x[:, 0]], 1), atol=1e-12)
    label = [r.cluster for r in E.rbf_clusters(rows, 3, 0.5).orderBy("i").collect()]
    expected = clusters(x, 3, 0.5).tolist()
    assert len(set(zip(label, expected))) == len(set(label)) == 3


def test_residuals_take_an_image_at_a_time(spark, sf_dir, graphs, edges):
    eigen = S.dense_eigenvectors(edges, 4, "laplacian_normalised")
    moved = eigen.withColumn("eigenvalue", F.col("eigenvalue") + F.when(F.col("image_id") == "b", 0.25).otherwise(0.0))
    found = {r.image_id: r.off for r in S.residuals(edges, moved).collect()}
    pairs = [r for r in moved.collect() if r.image_id == "b"]
    expected = max(0.25 * np.abs(graphs["b"].sum(1) * np.array(r.vec)).max() for r in pairs)
    assert found.keys() == graphs.keys() and max(found["a"], found["c"]) < 1e-10 and abs(found["b"] - expected) < 1e-9
    plan = QUERIES["c1_generalised_eigenproblem"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(vec" not in plan  # entries of vectors are never rows, to be joined with edges
