"""Hand-sized cases for the semantics that are easily got wrong, and properties of what SQL has no form for."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import affinity as A
from tessella.operators import frames as R
from tessella.operators import joins as J
from tessella.operators import labelmaps as L
from tessella.operators import matching as M
from tessella.operators import metrics as E
from tessella.operators import pixels as P
from tessella.operators import randomfield
from tessella.operators import sampling as Z
from tessella.operators import segments as S
from tessella.operators import spectral as C
from tessella.operators.graphsegments import graph_segments
from tessella.sources import listing, store

GT = ["0011", "0011", "0221", "0221"]
PRED = ["5577", "5577", "5577", "9997"]


def label_map(spark, rows, image="a"):
    return spark.createDataFrame([(image, y, x, int(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "image_id string, y int, x int, label int")


def drawn(df, h=4, w=4):
    grid = [[" "] * w for _ in range(h)]
    for r in df.collect():
        grid[r["y"]][r["x"]] = str(r["label"] if "label" in r else "#")
    return ["".join(g) for g in grid]


def ious(spark, pred=PRED, gt=GT):
    return M.iou(M.contingency(M.pairs(L.dense(label_map(spark, pred)), L.dense(label_map(spark, gt)))))


def test_equal_numbers_of_labels(spark):
    scores = ious(spark)
    values = {(r.pred, r.gt): round(r.iou, 6) for r in scores.collect()}
    assert [[values[p, g] for g in range(3)] for p in range(3)] == [[0.714286, 0, 0.111111], [0, 0.857143, 0.1], [0.125, 0, 0.4]]
    for found in (M.hungarian(scores), M.majority_exclusive(scores), M.match(scores)):
        assert {(r.gt, r.pred) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)}
    final = L.remap(L.dense(label_map(spark, PRED)), M.mapping(M.majority_exclusive(scores)))
    assert drawn(final) == ["0011", "0011", "0011", "2221"]
    c = E.scores(E.confusion(M.contingency(M.pairs(final, label_map(spark, GT))), range(3)))
    got = {r["class"]: r for r in c.collect()}
    assert [got[1][k] for k in ("tp", "fp", "fn", "tn")] == [6, 1, 0, 9]
    assert [round(got[2][k], 6) for k in E.METRICS] == [0.4, 0.8125, 0.571429, 0.666667, 0.5]
    assert round(E.macro(c, 3).first().jaccard, 6) == 0.628571
    error = {r.gt: r.error for r in E.undersegmentation(M.contingency(M.pairs(label_map(spark, PRED), label_map(spark, GT))), (1, 2, 3)).collect()}
    assert round(error[1], 6) == 0.166667 and error[2] == 0.75 and math.isnan(error[3])
    gt, pred = L.boundary(label_map(spark, GT)), L.boundary(final)
    assert {(r.y, r.x) for r in gt.collect()} == {(y, x) for y, r in enumerate(["0010", "0010", "1110", "1010"]) for x, v in enumerate(r) if v == "1"}
    images = gt.select("image_id").distinct()
    assert round(E.boundary_hits(gt, pred, 0, 4, 4, images).first().rate, 6) == 0.857143
    assert E.boundary_hits(pred, gt, 0, 4, 4, images).first().rate == 1.0


def test_fewer_predictions_than_classes(spark):
    scores = ious(spark, ["0011"] * 4)
    assert {(r.gt, r.pred) for r in M.majority_exclusive(scores).collect()} == {(0, 0), (1, 1), (2, -1)}
    assert {(r.pred, r.gt) for r in M.majority(scores).collect()} == {(0, 0), (1, 1)}
    assert {(r.gt, r.pred) for r in M.majority_unique(scores).collect()} == {(0, 0), (1, 1)}
    assert {(r.gt, r.pred) for r in M.match(scores).collect()} == {(0, 0), (1, 1), (2, -1)}


def test_background_swap_counts_corners_twice(spark):
    m = label_map(spark, ["222", "012", "001"])
    assert {r.label: round(r.fraction, 6) for r in L.border_fractions(m, 3, 3).collect()} == {0: 0.333333, 1: 0.166667, 2: 0.5}
    assert drawn(L.background_first(m, 3, 3), 3, 3) == ["000", "210", "221"]


def test_morphology_never_empties(spark):
    m = label_map(spark, ["000000"] + ["011110"] * 3 + ["000000"] * 2)
    mask = m.where("label = 1").select("image_id", "y", "x")
    assert {(r.y, r.x) for r in L.erode(mask, 6, 6).collect()} == {(2, 2), (2, 3)}
    assert {(r.y, r.x) for r in L.erode(mask, 6, 6, 2).collect()} == {(2, 2), (2, 3)}
    box = S.boxes(m, 6, 6, 8, 2, 3).first()
    assert (box.xmin, box.ymin, box.xmax, box.ymax) == (0, 0, 48, 48)


def test_shots_need_more_than_the_threshold(spark):
    rows = [(1, i, h) for i, h in enumerate([[10, 0, 0], [9, 1, 0], [0, 0, 10], [0, 1, 9]])]
    frames = spark.createDataFrame(rows, "seq int, frame int, hist array<bigint>")
    assert [(r["diff"], r.shot) for r in R.shots(frames, 5).orderBy("frame").collect()] == [(0, 0), (2, 0), (20, 1), (2, 1)]
    assert [r.shot for r in R.shots(frames, 20).orderBy("frame").collect()] == [0, 0, 0, 0]


def test_attention_mass(spark):
    a = spark.createDataFrame([("a", 0, i, v) for i, v in enumerate([0.1, 0.4, 0.2, 0.3])], "image_id string, head int, p int, v double")
    assert [r.keep for r in R.attention_mass(a).orderBy("p").collect()] == [False, True, False, True]


def test_neighbour_counts_sum_over_scales(spark):
    p = spark.createDataFrame([("a", i, 0, i, [float(v)]) for i, v in enumerate([0, 1, 3, 7])], "image_id string, p int, py int, px int, k array<double>")
    w = {(r.i, r.j): r.w for r in A.neighbour_counts(p, lambda _: F.col("k"), ((2, 0), (1, 0))).collect()}
    assert [[w.get((i, j), 0) for j in range(4)] for i in range(4)] == [[4, 2, 0, 0], [2, 4, 1, 0], [0, 1, 4, 1], [0, 0, 1, 4]]


def test_eigengap_leaves_the_first_out(spark):
    e = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.1, 0.15, 0.6, 0.65])], "image_id string, k int, eigenvalue double")
    assert C.eigengap(e).first().n == 3


def test_match_consistency_demotes_unmatched(spark):
    found = [[(1, 1), (2, 2)], [(1, -1), (2, 2)], [(1, 1), (2, 3)], [(1, -1), (2, 3)], [(1, -1), (2, 3)]]
    df = spark.createDataFrame([(i, g, p) for i, m in enumerate(found) for g, p in m], "image_id int, gt int, pred int")
    assert {(r.gt, r.pred, r.percent) for r in M.consistency(df).collect()} == {(1, 1, 40.0), (2, 3, 60.0)}


def test_constant_patches(spark):
    row = spark.range(1).select(F.array(*[F.lit(1.0)] * 4).alias("a"), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))).alias("b"))
    got = row.select(V.ncc_distance(F.col("a"), F.col("b")), V.cc_distance(F.col("a"), F.col("b")), V.ncc_distance(F.col("b"), F.col("b"))).first()
    assert math.isnan(got[0]) and got[1] == 1 and abs(got[2]) < 1e-12
    p = spark.createDataFrame([("a", 0, [1] * 4), ("a", 1, [1, 2, 3, 4])], "image_id string, p int, k array<int>")
    assert {(r.i, r.j): round(r.w, 9) for r in A.information(p).collect()} == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 0.0}


def test_semantic_map_collision_and_wrap(spark):
    m = label_map(spark, ["0123"])
    c = spark.createDataFrame([("a", 1, 0), ("a", 2, 4), ("a", 3, -1)], "image_id string, segment int, cluster int")
    assert [r.label for r in S.semantic(m, c).orderBy("x").collect()] == [0, 0, 4, 255]
    assert [r.label for r in S.semantic(m, c, 1).orderBy("x").collect()] == [0, 1, 5, 0]
    with pytest.raises(Exception, match="no cluster"):
        S.semantic(m, c.where("segment < 3")).collect()


def test_moments_and_binary_maps(spark):
    v = spark.createDataFrame([("a", 0.0), ("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.4), ("b", 0.5), ("b", 0.6), ("b", 0.7)], "image_id string, val double")
    assert round(v.agg(F.stddev_pop("val")).first()[0], 6) == 0.229129
    assert round(v.groupBy("image_id").agg(F.stddev_samp("val").alias("s")).agg(F.avg("s")).first()[0], 6) == 0.129099
    full = spark.createDataFrame([("a", 0, 0, 255)], "image_id string, y int, x int, label int")
    assert L.binary_fix(full).first().label == 1 and L.binary_fix(full, exact=True).first().label == 255


def permutations_best(value):
    """The greatest sum of an assignment by trying all; for tests of small grids."""
    from itertools import permutations

    grid = np.asarray(value)
    return max(sum(grid[i, j] for i, j in enumerate(p)) for p in permutations(range(len(grid))))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.floats(0, 1), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_the_best(grid):
    grid = np.array(grid)
    to = M.assignment(grid)
    assert sorted(to) == list(range(len(grid)))
    assert abs(grid[np.arange(len(grid)), to].sum() - permutations_best(grid)) < 1e-9


def test_blur_keeps_constants_and_sums(spark):
    flat = spark.createDataFrame([("a", y, x, 3.0) for y in range(6) for x in range(6)], "image_id string, y int, x int, val double")
    assert {round(r.val, 9) for r in P.blur(flat, P.blur_kernel(50, 0.1), 6, 6).collect()} == {3.0}
    assert {round(r.val, 9) for r in P.resize_bilinear(flat, 6, 6, 4, 9).collect()} == {3.0}
    assert P.resize_bilinear(flat, 6, 6, 4, 9).count() == 36


def test_local_equalisation_range(spark):
    ramp = spark.createDataFrame([("a", y, x, (y * 16 + x)) for y in range(16) for x in range(16)], "image_id string, y int, x int, val int")
    got = [r.val for r in P.equalise_local(ramp, 16, 16).orderBy("y", "x").collect()]
    assert len(got) == 256 and min(got) >= 0 and max(got) <= 255 and got[-1] > got[0]


def test_strict_operators_fail(spark):
    m = label_map(spark, ["01"])
    with pytest.raises(Exception, match="no mapping"):
        L.remap_strict(m, spark.createDataFrame([(0, 5)], "old int, new int")).collect()
    with pytest.raises(Exception, match="no partner"):
        J.by_key(spark.range(3).withColumnRenamed("id", "image_id"), spark.range(2).withColumnRenamed("id", "image_id")).collect()
    with pytest.raises(ValueError):
        J.positional((spark.range(3), spark.range(2)), ("id", "id"), ("a", "b"))
    with pytest.raises(ValueError):
        P.preprocess(m.withColumnRenamed("label", "val"), 1, 2, norm="other")


def test_increment_adds_only_what_is_missing(spark, tmp_path):
    seen = []

    def stage(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("image_id") * 2)

    ids = spark.range(4).withColumnRenamed("id", "image_id")
    assert store.increment(ids.where("image_id < 2"), str(tmp_path / "t"), stage).count() == 2
    assert store.increment(ids, str(tmp_path / "t"), stage).count() == 4
    assert seen == [2, 2]
    assert store.stored_until(("features", "eigs", "segments"), {"features": "a", "segments": "c"}) == 1


def test_large_images_are_compared_by_blocks(spark):
    """Cut into blocks or not: neighbours and histograms are the same."""
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([("a", i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(57)] + [("b", 0, [1.0, 2.0, 3.0])], "image_id string, p int, k array<double>")
    rows = {(r.image_id, r.p): r.k for r in p.collect()}
    found = {}
    for r in A.nearest(p, F.col("k"), 4).collect():
        found.setdefault((r.image_id, r.i), set()).add(r.j)
    for (image, i), k in rows.items():
        mine = sorted((sum((x - y) ** 2 for x, y in zip(k, o)), j) for (m, j), o in rows.items() if m == image)
        assert found[image, i] == {j for _, j in mine[:4]}
    whole = sorted(map(str, A.information(p).collect()))
    block, A.BLOCK = A.BLOCK, 10
    try:
        cut = A.blocked.__defaults__
        A.blocked.__defaults__ = (10,)
        assert sorted(map(str, A.information(p).collect())) == whole
        parts = {}
        for r in A.nearest(p, F.col("k"), 4).collect():
            parts.setdefault((r.image_id, r.i), set()).add(r.j)
        assert parts == found
    finally:
        A.BLOCK, A.blocked.__defaults__ = block, cut


def test_ranks_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = sorted((r.place, r.v) for r in J.ranked(rows, ["v"]).collect())
    assert got == list(enumerate(sorted(r.v for r in rows.collect())))


def test_long_parts_are_followed_to_their_end(spark):
    """A snake of 40 rows that touch at their ends only."""
    width, mask = 12, []
    for y in range(0, 80, 2):
        mask += [("a", y, x) for x in range(width)] + [("a", y + 1, width - 1 if y % 4 == 0 else 0)]
    parts = S.components(spark.createDataFrame(mask, "image_id string, y int, x int")).select("component").distinct().collect()
    assert [tuple(r.component) for r in parts] == [(0, 0)]


def test_label_map_options():
    assert L.matching("{0: 2, 1: 0}") == L.matching("[(0, 2), (1, 0)]") == {0: 2, 1: 0}
    for bad in ("__import__('os').getcwd()", "{0: 'a'}"):
        with pytest.raises(ValueError):
            L.matching(bad)


def test_stores_are_guarded(spark, tmp_path):
    rows = spark.range(3)
    store.write(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.write(rows, str(tmp_path / "t"))
    store.write(rows.limit(1), str(tmp_path / "t"), guard=False)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_listings(spark, tmp_path):
    for n in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "list.lst").write_text("z.png\ny.png\n")
    assert [r.image_id for r in listing.folder(spark, str(tmp_path), extensions=(".png", ".jpg")).collect()] == ["a", "b"]
    assert [r.file for r in listing.listed(spark, str(tmp_path / "list.lst")).orderBy("place").collect()] == ["z.png", "y.png"]


def test_long_lists_are_read_in_blocks(spark, tmp_path):
    lines = [f"f{(7 * i) % 5000}.png" if i % 50 else "" for i in range(5000)]
    for n in range(3):
        (tmp_path / f"part-{n}.txt").write_text("\r\n".join(lines[n * 2000 : n * 2000 + 2000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = listing.listed(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert [(r.place, r.file) for r in rows.orderBy("place").collect()] == [(i, f) for i, f in enumerate(lines) if f]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("d", [0, 1, 2, 7])
def test_boundaries_within_a_distance(spark, d):
    rng = np.random.default_rng(d)
    points = {n: {(int(y), int(x)) for y, x in rng.integers(0, 15, (k, 2))} for n, k in (("a", 9), ("b", 2), ("c", 0))}
    edges = {n: {(int(y), int(x)) for y, x in rng.integers(0, 15, (30, 2))} for n in points}
    table = lambda m: spark.createDataFrame([(n, y, x) for n, ps in m.items() for y, x in ps], "image_id string, y int, x int")
    images = spark.createDataFrame([(n,) for n in points], "image_id string")
    got = {r.image_id: r.rate for r in E.boundary_hits(table(edges), table(points), d, 15, 15, images).collect()}
    for n, ps in edges.items():
        hit = sum(any(max(abs(y - a), abs(x - b)) <= d for a, b in points[n]) for y, x in ps)
        assert abs(got[n] - hit / len(ps)) < 1e-12


def test_a_run_that_is_logged_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3).withColumnRenamed("id", "m")
    for run, df in (("a", rows), ("b", rows.limit(1)), ("a", rows.where("m > 1"))):
        store.log_metrics(df, path, run)
    assert sorted((r.run, r.m) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 0)]


def test_triplets_differ(spark):
    rows = Z.random_triplets(spark.range(50).withColumnRenamed("id", "i"), 50).collect()
    assert len(rows) == 50 and all(len({r.anchor, r.positive, r.negative}) == 3 for r in rows)
    labels = {i: i % 3 if i < 30 else 9 for i in range(31)}
    made = Z.class_triplets(spark.createDataFrame(list(labels.items()), "id long, label int"), "id", "label").collect()
    assert len(made) == 31
    for r in made:
        assert labels[r.anchor] == labels[r.positive] != labels[r.negative]
        assert (r.anchor == r.positive) == (labels[r.anchor] == 9)


def test_connected_parts_join_diagonals(spark):
    m = label_map(spark, ["1100", "0010", "0000", "1101"]).where("label = 1").select("image_id", "y", "x")
    assert {(r.y, r.x) for r in S.largest_component(m).collect()} == {(0, 0), (0, 1), (1, 2)}


def test_clusters_and_refinement(spark):
    p = spark.createDataFrame([("a", i, [float(i // 5 * 10 + i % 5), 1.0]) for i in range(10)], "image_id string, p int, k array<double>")
    got = [r.label for r in C.kmeans_patches(p, 2).orderBy("p").collect()]
    assert got[:5] == [got[0]] * 5 and got[5:] == [got[5]] * 5 and got[0] != got[5]
    m = label_map(spark, ["0000", "0100", "0000", "0000"])
    flat = m.select("image_id", "y", "x", F.lit(5.0).alias("val"))
    assert {r.label for r in randomfield.refined(m, flat, 2).collect()} == {0}
    halves = m.select("image_id", "y", "x", F.when(F.col("x") < 2, 0).otherwise(255).alias("val"))
    assert graph_segments(halves, 0.1, 2).select("label").distinct().count() == 2


def test_sweep_reads_all_images(spark, monkeypatch):
    from tessella.plans import pipeline, pipelines
    from tessella.sources import tables

    seen = []
    monkeypatch.setattr(pipeline, "sweep", lambda spark, p, gt, values: seen.extend([p, gt]) or p.limit(1))
    pipelines.h2_parameter_sweep(spark, "/root/testdata/sf0.01")
    images = tables.patches(spark, "/root/testdata/sf0.01").select("image_id").distinct().count()
    assert images > 2 and [d.select("image_id").distinct().count() for d in seen] == [images] * 2


def test_a_sweep_makes_shared_stages_once(spark, monkeypatch):
    from tessella.operators import spectral
    from tessella.plans import pipeline
    from tessella.sources import tables

    made = []
    eigenvectors = spectral.eigenvectors
    monkeypatch.setattr(spectral, "eigenvectors", lambda *a: made.append(a[1]) or eigenvectors(*a))
    p = tables.patches(spark, "/root/testdata/sf0.001").where("image_id < 2")
    gt = tables.truth(p)
    got = {(r["vectors"], r["segments"]): r["miou"] for r in pipeline.sweep(spark, p, gt, {"vectors": [3, 5], "segments": [3, 6]}).collect()}
    assert sorted(made) == [3, 5] and len(got) == 4
    for (v, n), miou in got.items():
        alone = pipeline.evaluate(pipeline.run(p, pipeline.Settings(vectors=v, segments=n), "segments")["segments"], gt, 10)
        assert abs(alone.agg({"jaccard": "avg"}).first()[0] - miou) < 1e-9
