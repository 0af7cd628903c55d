"""Graph segmentation against its edges taken one after the other."""

import numpy as np
import pytest

from tessella.operators import graphsegments as G


def plain(val, order, scale, min_size):
    h, w = val.shape
    parent, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edges = [((y, x), (y + a, x + b)) for y in range(h) for x in range(w) for a, b in ((0, 1), (1, 0)) if y + a < h and x + b < w]
    cost = lambda e: abs(val[e[0]] / 255.0 - val[e[1]] / 255.0)
    edges.sort(key=lambda e: (cost(e), order[e]))
    for small in (False, True):
        for e in edges:
            i, j = (root(y * w + x) for y, x in e)
            if i != j and (min(size[i], size[j]) < min_size if small else cost(e) <= min(inner[i] + scale / size[i], inner[j] + scale / size[j])):
                i, j = min(i, j), max(i, j)
                parent[j], size[i], inner[i] = i, size[i] + size[j], cost(e)
    roots = [root(i) for i in range(h * w)]
    number = {r: n for n, r in enumerate(sorted(set(roots)))}
    return {(i // w, i % w): number[r] for i, r in enumerate(roots)}


@pytest.mark.parametrize("few", [0, 100])
def test_rounds_are_one_edge_after_the_other(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:11, :13]
    images = {"noise": rng.integers(0, 256, (11, 13)), "disc": np.clip(np.where((y - 5) ** 2 + (x - 6) ** 2 < 15, 200, 40) + rng.integers(-6, 7, (11, 13)), 0, 255), "flat": np.full((9, 5), 7), "slope": 3 * x + y}
    rows = spark.createDataFrame([(n, a, b, int(v[a, b])) for n, v in images.items() for a in range(v.shape[0]) for b in range(v.shape[1])], "image_id string, y int, x int, val int").repartition(5)
    steps = [((a, b), (a + c, b + d)) for a in range(11) for b in range(13) for c, d in ((0, 1), (1, 0))]
    hashed = spark.createDataFrame(steps, "a struct<y: int, x: int>, b struct<y: int, x: int>").select("a", "b", G.F.xxhash64("a", "b").alias("h")).collect()
    order = {(tuple(r.a), tuple(r.b)): r.h for r in hashed}
    for scale, least in ((1.0, 9),):
        got = {n: {} for n in images}
        for r in G.graph_segments(rows, scale, least).collect():
            got[r.image_id][r.y, r.x] = r.label
        assert got == {n: plain(v, order, scale, least) for n, v in images.items()}
        assert len(set(got["disc"].values())) > 1 and set(got["flat"].values()) == {0}
    assert G.graph_segments(rows.limit(0)).count() == 0


def test_tiles_are_one_edge_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(G, "FEW", 300)
    monkeypatch.setattr(G, "SIDE", 4)
    monkeypatch.setattr(G, "by_rounds", lambda *a: pytest.fail("no tile holds many edges"))
    rng = np.random.default_rng(4)
    images = {n: rng.integers(0, 256, (21, 18)) // k * k for n, k in (("fine", 1), ("coarse", 60))}
    rows = spark.createDataFrame([(n, a, b, int(v[a, b])) for n, v in images.items() for a in range(21) for b in range(18)], "image_id string, y int, x int, val int").repartition(5)
    steps = [((a, b), (a + c, b + d)) for a in range(21) for b in range(18) for c, d in ((0, 1), (1, 0))]
    hashed = spark.createDataFrame(steps, "a struct<y: int, x: int>, b struct<y: int, x: int>").select("a", "b", G.F.xxhash64("a", "b").alias("h")).collect()
    order = {(tuple(r.a), tuple(r.b)): r.h for r in hashed}
    got = {n: {} for n in images}
    for r in G.graph_segments(rows, 0.5, 9).collect():
        got[r.image_id][r.y, r.x] = r.label
    assert got == {n: plain(v, order, 0.5, 9) for n, v in images.items()}
