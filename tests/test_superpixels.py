"""Superpixels against a plain version on whole arrays."""

import numpy as np
import pytest

from tessella.operators import superpixels as X
from tests.test_components import flood


def plain(val, n, compactness, iterations):
    h, w = val.shape
    step = max(np.sqrt(h * w / n), 1)
    ys, xs = (np.floor((np.arange(np.ceil(s / step - 0.5)) + 0.5) * step).astype(int) for s in (h, w))
    centres = np.array([(y, x, val[y, x]) for y in ys for x in xs], float)
    y, x = np.mgrid[:h, :w]
    label = np.zeros((h, w), int)
    for _ in range(iterations):
        d = np.full((len(centres), h, w), np.inf)
        for i, (cy, cx, cv) in enumerate(centres):
            near = (abs(y - cy) <= step) & (abs(x - cx) <= step)
            d[i][near] = np.round(((val - cv) / 255) ** 2 + ((y - cy) ** 2 + (x - cx) ** 2) * compactness**2 / step**2, 12)[near]
        label = np.where(np.isinf(d.min(0)), label, d.argmin(0))
        for i in range(len(centres)):
            on = label == i
            if on.any():
                centres[i] = y[on].mean(), x[on].mean(), val[on].mean()
    return label


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:30, :41]
    return {"noise": rng.integers(0, 256, (30, 41)), "disc": np.where((y - 15) ** 2 + (x - 20) ** 2 < 90, 220, 30), "flat": np.full((7, 9), 5)}


def test_superpixels(spark, images, monkeypatch):
    rows = spark.createDataFrame([(n, y, x, int(v[y, x])) for n, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])], "image_id string, y int, x int, val int").repartition(5)
    before = {}
    whole = X.whole
    monkeypatch.setattr(X, "whole", lambda labels: before.update({(r.image_id, r.y, r.x): r.label for r in labels.collect()}) or whole(labels))
    after = {(r.image_id, r.y, r.x): r.label for r in X.superpixels(rows, 12, 0.5, 4).collect()}
    assert len(after) == sum(v.size for v in images.values())
    for n, v in images.items():
        expected = plain(v.astype(float), 12, 0.5, 4)
        assert all(before[n, y, x] == expected[y, x] for y in range(v.shape[0]) for x in range(v.shape[1]))
        own = {(y, x): after[n, y, x] for y in range(v.shape[0]) for x in range(v.shape[1])}
        parts = flood(own, False)
        assert len(set(parts.values())) == len(set(own.values())) == len(set(expected.ravel()))
        # the largest part of each label has kept it
        old = flood({p: before[(n, *p)] for p in own}, False)
        for label in set(expected.ravel()):
            sizes = {}
            for p, root in old.items():
                if before[(n, *p)] == label:
                    sizes.setdefault(root, []).append(p)
            main = min(sizes.values(), key=lambda ps: (-len(ps), min(ps)))
            assert all(own[p] == label for p in main)
    assert sum(before[k] != after[k] for k in after) > 20


def test_what_touches_nothing_stays(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 5, 5, 1), ("a", 0, 2, 2)], "image_id string, y int, x int, label int")
    assert {(r.y, r.x): r.label for r in X.whole(rows).collect()} == {(0, 0): 1, (0, 1): 1, (5, 5): 1, (0, 2): 2}
    assert X.whole(rows.limit(0)).count() == 0
