"""Views of images: what the plan says is what the pixels show."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import augment as U

CALM = {"jitter": 0, "grey": 0, "blur": (0, 0, 0), "solarise": 0}


@pytest.fixture(scope="module")
def image(spark):
    v = np.random.default_rng(1).integers(0, 256, (40, 50, 3))
    rows = spark.createDataFrame([("i", y, x, *map(int, v[y, x])) for y in range(40) for x in range(50)], "image_id string, y int, x int, r int, g int, b int")
    return v / 255, rows.persist()


def views(rows, v, blurred=True):
    out = {}
    for r in U.augmented(rows, v, blurred).collect():
        out.setdefault(r.view, {})[r.y, r.x] = (r.r, r.g, r.b)
    return out


@pytest.mark.parametrize("flip", [0, 10])
def test_crops_are_resized_by_inverse_mapping(image, flip):
    pixels, rows = image
    v = U.Views(side_global=20, side_local=7, flip=flip, **CALM)
    plan = {r.view: r for r in U.plans(rows.groupBy("image_id").agg(F.lit(40).alias("height"), F.lit(50).alias("width")), v).collect()}
    got = views(rows, v)
    assert set(got) == set(range(8)) and {n: len(p) for n, p in got.items()} == {n: 400 if n < 2 else 49 for n in range(8)}
    for n, p in plan.items():
        assert 0 <= p.top <= 40 - p.height and 0 <= p.left <= 50 - p.width and p.flip == bool(flip)
        share = p.height * p.width / 2000
        assert 0.25 < share <= 1 if n < 2 else 0.03 < share < 0.45
        for (y, x), c in got[n].items():
            at = p.side - 1 - x if flip else x
            assert np.allclose(c, pixels[p.top + int((y + 0.5) * p.height / p.side), p.left + int((at + 0.5) * p.width / p.side)])


def test_hue_turns_and_keeps_the_rest(spark, image):
    pixels, _ = image
    some = pixels.reshape(-1, 3)[:200].tolist() + [[0.5, 0.5, 0.5], [1.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(some)], "i int, r double, g double, b double").withColumn("fh", F.lit(0.1))
    for r in U.turned(rows).collect():
        h, s, v = colorsys.rgb_to_hsv(*some[r.i])
        assert np.allclose((r.r, r.g, r.b), colorsys.hsv_to_rgb((h + 0.1) % 1, s, v), atol=1e-9)


def test_blur_grey_and_solarisation(image):
    _, rows = image
    plain = views(rows, U.Views(side_global=20, side_local=9, flip=0, **CALM))
    soft = views(rows, U.Views(side_global=20, side_local=9, flip=0, **CALM | {"blur": (10, 0, 10)}))
    assert soft[1] == plain[1]
    for n in (0, 2, 7):
        a, b = (np.array([p[n][k] for k in sorted(p[n])]) for p in (plain, soft))
        assert b.std() < 0.8 * a.std() and abs(a.mean() - b.mean()) < 0.1
    other = views(rows, U.Views(side_global=20, side_local=9, flip=0, **CALM | {"grey": 10, "solarise": 10}))
    for n in range(8):
        for k, c in plain[n].items():
            grey = float(np.dot(c, U.GREY))
            assert np.allclose(other[n][k], 1 - grey if n == 1 and grey >= 0.5 else grey)


def test_jitter_stays_within_bounds(image):
    _, rows = image
    values = np.array([c for p in views(rows, U.Views(side_global=20, side_local=9)).values() for c in p.values()])
    assert values.min() >= 0 and values.max() <= 1 and len(values) == 2 * 400 + 6 * 81
    assert views(rows.limit(0), U.Views(side_global=4, side_local=2)) == {}
