"""The neighbour index against all distances."""

from collections import Counter

import numpy as np
import pytest

from tessella.operators import affinity as A


def brute(a, b, k):
    d = A.squares(a, b)
    return {(i, int(j), r) for i in range(len(a)) for r, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:k])}


@pytest.mark.parametrize("k", [1, 5, 40, 500])
def test_neighbours_are_those_of_all_distances(k):
    rng = np.random.default_rng(k)
    for x in (rng.normal(size=(300, 3)), rng.integers(0, 4, (300, 2)).astype(float), np.zeros((60, 2)), rng.normal(size=(130, 64)), rng.normal(size=(1, 2))):
        a = x[: max(1, len(x) // 2)]
        got = [(int(i), int(j), int(r)) for rows, at, rank, _ in A.closest(a, x, k) for i, j, r in zip(rows, at, rank, strict=True)]
        assert len(got) == len(set(got)) and set(got) == brute(a, x, min(k, len(x)))


def test_few_distances_are_taken():
    rng = np.random.default_rng(0)
    y, x = (v.ravel() for v in np.mgrid[:80, :80])
    n = len(y)
    for weight, k in ((0.01, 6), (0.03, 3)):  # grey values and weighted places of an image's pixels
        pixels = np.stack([rng.integers(0, 256, n) / 255, x * weight, y * weight], 1)
        assert sum(c for *_, c in A.closest(pixels, pixels, k)) < n * n / 20


def test_an_image_is_compared_once_for_all_scales(spark):
    rows = [(g, p, p % 4, p // 4, [float(p * 7 % 5)]) for g, n in ((0, 12), (1, 5)) for p in range(n)]
    patches = spark.createDataFrame(rows, "image_id int, p int, px int, py int, k array<double>")
    scales = ((4, 0.5), (2, 0.1))
    found = A.neighbour_counts(patches, A.appearance, scales)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    expected = Counter()
    for g in (0, 1):
        for k, w in scales:
            x = np.array([[*v, px * w, py * w] for image, _, px, py, v in rows if image == g])
            for i, j, _ in brute(x, x, min(k, len(x))):
                expected.update([(g, i, j), (g, j, i)])
    assert {(r.image_id, r.i, r.j): r.w for r in found.collect()} == expected
