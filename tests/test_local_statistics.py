"""Local statistics of patch pairs against loops over windows, and over all pairs of the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import local_statistics as L
from tessella.plans.catalog import QUERIES


def r(u, v):
    u, v = u - u.mean(), v - v.mean()
    spread = np.sqrt((u * u).sum() * (v * v).sum())
    return (u * v).sum() / spread if spread > 1e-9 else 0.0


def lncc(a, b, d):
    n = len(a)
    spots = [r(a[y - d : y + d + 1, x - d : x + d + 1], b[y - d : y + d + 1, x - d : x + d + 1]) for y in range(d, n - d - 1) for x in range(d, n - d - 1)]
    return 1 - sum(spots) / n**2


def similarity(a, b, span, side):
    c1, c2, out = (0.01 * span) ** 2, (0.03 * span) ** 2, []
    for y in range(len(a) - side + 1):
        for x in range(len(a) - side + 1):
            u, v = a[y : y + side, x : x + side].ravel(), b[y : y + side, x : x + side].ravel()
            c = np.cov(u, v)
            out.append((2 * u.mean() * v.mean() + c1) * (2 * c[0, 1] + c2) / ((u.mean() ** 2 + v.mean() ** 2 + c1) * (c[0, 0] + c[1, 1] + c2)))
    return np.mean(out)


def sharp(a):
    return np.array([[9 * a[y, x] - a[y - 1 : y + 2, x - 1 : x + 2].sum() for x in range(1, len(a) - 1)] for y in range(1, len(a) - 1)])


def half(a):
    return np.array([[a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(len(a) // 2)] for y in range(len(a) // 2)])


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (7, 9, 9)).astype(float)
    x[1] = 17  # constant
    x[2, :5] = 3  # constant windows
    x[3] = 255 - x[4]
    x[5] = np.add.outer(np.arange(9), 2 * np.arange(9))  # nothing is left of it when sharpened
    return x


@pytest.mark.parametrize("d", [1, 2, 3])
def test_lncc(some, d):
    got = L.lncc(L.Patches(some[:4]), L.Patches(some), d)
    assert np.allclose(got, [[lncc(a, b, d) for b in some] for a in some[:4]], atol=1e-12)
    assert got[1].tolist() == [1.0] * 7


def test_similarity_over_scales(some):
    got = L.ssim(L.Patches(some), L.Patches(some), 255.0)
    assert np.allclose(got, [[1 - similarity(a, b, 255, 7) for b in some] for a in some], atol=1e-12)
    got = L.ms_ssim(L.Patches(some), L.Patches(some), 255.0)
    expected = [[1 - np.sqrt(max(similarity(a, b, 255, 7), 0) * max(similarity(half(a), half(b), 255, 3), 0)) for b in some] for a in some]
    assert np.allclose(got, expected, atol=1e-12)


def test_sharpness(some):
    got = L.scc(L.Patches(some), L.Patches(some))
    assert np.allclose(got, [[1 - r(sharp(a), sharp(b)) for b in some] for a in some], atol=1e-9)
    assert got[5].tolist() == [1.0] * 7


def test_shapes():
    with pytest.raises(ValueError, match="12"):
        L.Patches.flat(np.zeros((2, 12)))


def test_blocks_change_nothing(spark, some, monkeypatch):
    rows = [(f"i{n % 2}", n, [float(v) for v in p.ravel()]) for n, p in enumerate(some)]
    patches = spark.createDataFrame(rows, "image_id string, p int, k array<double>")
    expected = {(i, a, b): L.lncc(L.Patches(some[a : a + 1]), L.Patches(some[b : b + 1]))[0, 0] for i in ("i0", "i1") for a in range(7) for b in range(7) if (a % 2, b % 2) == (int(i[1]),) * 2}
    for block, matrix in ((4096, 1 << 20), (2, 100)):
        monkeypatch.setattr(L, "MATRIX", matrix)
        monkeypatch.setattr(L, "blocked", lambda p, c, k, b=block: _blocked(p, c, k, b))
        got = {(x.image_id, x.i, x.j): x.w for x in L.pairwise(patches, L.lncc).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert L.pairwise(patches.limit(0), L.lncc).count() == 0


_blocked = L.blocked


@pytest.mark.parametrize("name", ["g5_lncc_distance", "g6_ssim_distance", "g18_scc_and_ms_ssim"])
def test_measures_of_all_pairs(spark, name):
    sf = "/root/testdata/sf0.01"
    pairs = QUERIES["j5_all_pairs"](spark, sf)
    both = pairs.union(pairs.select("image_id", "j", "i")).distinct()
    out = QUERIES[name](spark, sf).persist()
    assert out.count() == both.count() and both.exceptAll(out.select("image_id", "i", "j")).count() == 0
    for w in (c for c in out.columns if c not in ("image_id", "i", "j")):
        turned = out.select("image_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col(w).alias("turned"))
        same = out.join(turned, ["image_id", "i", "j"])
        assert same.where(F.abs(F.col(w) - F.col("turned")) <= 1e-6).count() == out.count()
        assert out.select(w).distinct().count() > 1000 and out.where(F.col(w).isNull() | (F.abs(w) > 2)).count() == 0
    out.unpersist()
