"""Messages over lattices against all pairs of pixels."""

import numpy as np
import pytest

from tessella.operators import randomfield as R

KERNELS = (R.Kernel(6.0, 40.0, 13.0), R.Kernel(3.0, 3.0, None))


def pairs(at, val):
    k = sum(w * np.exp(-((at[:, None] - at[None]) ** 2).sum(2) / (2 * s**2) - (0 if v is None else (val[:, None] - val[None]) ** 2 / (2 * v**2))) for w, s, v in KERNELS)
    np.fill_diagonal(k, 0)
    return k


def refined(at, val, label, n, iterations=5, certain=0.7):
    k = pairs(at, val)
    k /= np.sqrt(np.outer(k.sum(1), k.sum(1))) + 1e-20
    unary = np.full((len(val), n), np.log((1 - certain) / max(n - 1, 1)))
    unary[np.arange(len(val)), label] = np.log(certain)
    q = np.exp(unary)
    q /= q.sum(1, keepdims=True)
    for _ in range(iterations):
        e = unary + 9.0 * (k @ q)
        q = np.exp(e - e.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    return q.argmax(1)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    y, x = (a.ravel() for a in np.mgrid[:20, :20])
    out = {}
    for name in ("a", "b", "c"):
        shape = (y - 10) ** 2 + (x - 8) ** 2 < 40 if name == "a" else (x > 10) ^ (y > 12) if name == "b" else x // 7 == 1
        val = np.clip(60 + 120 * shape + rng.normal(0, 12, 400), 0, 255).astype(int)
        label = np.where(rng.random(400) < 0.25, rng.integers(0, 4, 400), shape * 1 + (name == "c"))
        out[name] = np.stack([y, x], 1), val, label
    return out


def table(spark, images, what):
    return spark.createDataFrame([(n, int(y), int(x), int(v)) for n, (at, val, label) in images.items() for (y, x), v in zip(at, val if what == "val" else label)], f"image_id string, y int, x int, {what} int")


def test_messages_are_near_those_of_all_pairs(spark, images):
    one = R.F.array(R.F.lit(1.0), R.F.col("val") / 255)
    got = {(r.image_id, r.y, r.x): r.got for r in R.messages(table(spark, images, "val").withColumn("m", one), KERNELS, 2).collect()}
    assert len(got) == 1200
    for n, (at, val, _) in images.items():
        exact = pairs(at.astype(float), val.astype(float)) @ np.stack([np.ones(400), val / 255], 1)
        mine = np.array([got[n, y, x] for y, x in at.tolist()])
        assert np.abs(mine / exact - 1).mean() < 0.03 and np.abs(mine / exact - 1).max() < 0.15


def test_labels_are_those_of_all_pairs(spark, images):
    got = {(r.image_id, r.y, r.x): r.label for r in R.refined(table(spark, images, "label"), table(spark, images, "val"), 4).collect()}
    same = [got[n, y, x] == e for n, (at, val, label) in images.items() for (y, x), e in zip(at.tolist(), refined(at.astype(float), val.astype(float), label, 4))]
    assert len(same) == 1200 and np.mean(same) >= 0.99
    changed = [got[n, y, x] != v for n, (at, _, label) in images.items() for (y, x), v in zip(at.tolist(), label)]
    assert 0.05 < np.mean(changed) < 0.4


def test_one_label_stays(spark, images):
    rows = table(spark, images, "label").withColumn("label", R.F.lit(0))
    assert {r.label for r in R.refined(rows, table(spark, images, "val"), 1, iterations=1).collect()} == {0}
    assert R.refined(rows.limit(0), table(spark, images, "val"), 3, iterations=1).count() == 0


def test_nothing_is_spread_beyond_what_pixels_read(spark, images):
    rows = R.spanned(table(spark, images, "val").withColumn("m", R.F.array(R.F.lit(1.0))))
    at = R.F.explode(R.F.concat(*[R.corners(k, i) for i, k in enumerate(KERNELS)])).alias("p")
    cells = rows.select("image_id", *R.SPAN, at, "m").select("image_id", *R.SPAN, "p.*", "m").select("image_id", "kind", "a", "b", "c", "m", *R.reach(KERNELS))
    ends = ["image_id", "kind", *[f(c) for c in "abc" for f in (R.F.min, R.F.max)]]
    read = {tuple(r) for r in cells.groupBy(*ends[:2]).agg(*ends[2:]).collect()}
    for axis in "abc":
        cells = R.spread(cells, axis, KERNELS, 1)
    assert {tuple(r) for r in cells.groupBy(*ends[:2]).agg(*ends[2:]).collect()} == read


def test_what_rounds_have_shuffled_is_deleted(spark, images):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.sparkContext._jvm.System.gc()
    before = tracker.shuffleStatuses().size()
    found = R.refined(table(spark, images, "label"), table(spark, images, "val"), 4, iterations=1)
    assert tracker.shuffleStatuses().size() <= before + 2  # of the first tables, made here
    assert found.count() == 1200
