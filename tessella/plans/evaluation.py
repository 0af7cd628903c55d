"""Queries of evaluation, matching and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import labelmaps as L
from tessella.operators import matching as M
from tessella.operators import metrics as E
from tessella.plans.registry import query, rounded
from tessella.sources import store
from tessella.sources import tables as T

CLASSES = tuple(range(10))

PAIRS = """,
pairs AS (SELECT g.image_id, p.label AS pred, g.label AS gt FROM {pred} p JOIN gt_map g ON p.image_id = g.image_id AND p.y = g.y AND p.x = g.x)
"""
IOU = """,
counts AS (SELECT image_id, pred, gt, count(*) AS n FROM pairs GROUP BY image_id, pred, gt),
np AS (SELECT image_id, pred, sum(n)::BIGINT AS n_pred FROM counts GROUP BY image_id, pred),
ng AS (SELECT image_id, gt, sum(n)::BIGINT AS n_gt FROM counts GROUP BY image_id, gt),
iou AS (
  SELECT image_id, pred, gt, coalesce(n, 0)::BIGINT AS n, n_pred, n_gt,
    coalesce(n, 0) / greatest((n_pred + n_gt - coalesce(n, 0))::DOUBLE, 1e-8) AS iou
  FROM np JOIN ng USING (image_id) LEFT JOIN counts USING (image_id, pred, gt))
"""
IOU10, IOU7 = PAIRS.format(pred="pred10") + IOU, PAIRS.format(pred="pred7") + IOU
EXCLUSIVE = """,
asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt ORDER BY iou DESC, pred) AS r FROM iou) WHERE r = 1),
won AS (
  SELECT image_id, gt, CASE WHEN row_number() OVER (PARTITION BY image_id, pred ORDER BY iou DESC, gt) = 1 THEN pred ELSE -1 END AS pred FROM asked)
"""
APPLIED = """,
final AS (
  SELECT p.image_id, p.y, p.x, coalesce(w.gt, 0)::INT AS label FROM {pred} p LEFT JOIN won w ON p.image_id = w.image_id AND p.label = w.pred),
fc AS (SELECT f.image_id, f.label AS pred, g.label AS gt, count(*) AS n FROM final f JOIN gt_map g USING (image_id, y, x) GROUP BY ALL),
classes AS (SELECT unnest(range(10))::INT AS class),
conf AS (
  SELECT image_id, class, sum(CASE WHEN pred = class AND gt = class THEN n ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN pred = class AND gt <> class THEN n ELSE 0 END)::BIGINT AS fp,
    sum(CASE WHEN pred <> class AND gt = class THEN n ELSE 0 END)::BIGINT AS fn,
    sum(CASE WHEN pred <> class AND gt <> class THEN n ELSE 0 END)::BIGINT AS tn
  FROM fc, classes GROUP BY image_id, class),
sc AS (
  SELECT *, tp / greatest((tp + fp + fn)::DOUBLE, 1e-8) AS jaccard, (tp + tn) / greatest((tp + fp + fn + tn)::DOUBLE, 1e-8) AS accuracy,
    2 * tp / greatest((2 * tp + fp + fn)::DOUBLE, 1e-8) AS dice, tp / greatest((tp + fp)::DOUBLE, 1e-8) AS precision, tp / greatest((tp + fn)::DOUBLE, 1e-8) AS recall
  FROM conf)
"""
APPLIED7, APPLIED10 = APPLIED.format(pred="pred7"), APPLIED.format(pred="pred10")
METRIC_MEANS = ", ".join(f"round(sum({m}) / 9, 6) AS {m}" for m in E.METRICS)
METRIC_AVERAGES = ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.METRICS)


def maps(spark: SparkSession, sf_dir: str, anchors: int) -> tuple[DataFrame, DataFrame]:
    p = T.patches(spark, sf_dir)
    return T.nearest_anchor(p, anchors), T.truth(p)


def ious(spark: SparkSession, sf_dir: str, anchors: int) -> DataFrame:
    return M.iou(M.contingency(M.pairs(*maps(spark, sf_dir, anchors))))


def matched(spark: SparkSession, sf_dir: str, anchors: int = 7) -> tuple[DataFrame, DataFrame]:
    """Predictions relabelled by the exclusive vote, and the truth."""
    pred, gt = maps(spark, sf_dir, anchors)
    found = M.majority_exclusive(M.iou(M.contingency(M.pairs(pred, gt))))
    return L.remap(pred, M.mapping(found)), gt


def class_scores(spark: SparkSession, sf_dir: str, anchors: int = 7) -> DataFrame:
    """From counts of label pairs alone: pixels are read once."""
    counts = store.settled(M.contingency(M.pairs(*maps(spark, sf_dir, anchors))), "counts")
    found = M.majority_exclusive(M.iou(counts))
    return E.scores(E.confusion(M.relabelled(counts, M.mapping(found)), CLASSES))


@query(IOU10 + "SELECT image_id, pred, gt, n FROM counts")
def a6_contingency(spark, sf_dir):
    return M.contingency(M.pairs(*maps(spark, sf_dir, 10)))


@query(IOU10 + "SELECT image_id, pred, gt, n, n_pred, n_gt, round(iou, 6) AS iou FROM iou")
def a5_iou_matrix(spark, sf_dir):
    return rounded(ious(spark, sf_dir, 10))


@query(IOU10 + "SELECT image_id, pred, gt, round(CASE WHEN iou < 0.1 THEN 0 ELSE iou END, 6) AS iou FROM iou")
def a5_iou_with_threshold(spark, sf_dir):
    return rounded(M.iou(M.contingency(M.pairs(*maps(spark, sf_dir, 10))), 0.1).select("image_id", "pred", "gt", "iou"))


@query(IOU10 + "SELECT image_id, pred, gt FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pred ORDER BY iou DESC, gt) AS r FROM iou) WHERE r = 1")
def m2_majority_vote(spark, sf_dir):
    return M.majority(ious(spark, sf_dir, 10))


@query(IOU7 + "SELECT image_id, gt, pred FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt ORDER BY iou DESC, pred) AS r, count(*) OVER (PARTITION BY image_id, gt) AS k FROM iou) WHERE r = 1 AND gt < k")
def m3_majority_vote_unique(spark, sf_dir):
    return M.majority_unique(ious(spark, sf_dir, 7))


@query(IOU7 + EXCLUSIVE + "SELECT * FROM won")
def m4_majority_vote_exclusive(spark, sf_dir):
    return M.majority_exclusive(ious(spark, sf_dir, 7))


@query(IOU7 + EXCLUSIVE + "SELECT image_id, gt, pred FROM won")
def m5_match_dispatcher(spark, sf_dir):
    return M.match(ious(spark, sf_dir, 7))


@query()
def m1_hungarian_match(spark, sf_dir):
    return rounded(M.hungarian(ious(spark, sf_dir, 10)))


#: The best sum of an assignment in SQL: truth labels one by one, for each set of labels taken (as bits) the best so far.
BEST = ", p0 AS (SELECT DISTINCT image_id, 0::BIGINT AS taken, 0.0::DOUBLE AS best FROM iou)" + "".join(
    f", p{g + 1} AS (SELECT image_id, taken, max(best) AS best FROM (SELECT * FROM p{g} UNION ALL SELECT p.image_id, p.taken | (1 << pred), p.best + iou FROM p{g} p JOIN iou i ON i.image_id = p.image_id AND i.gt = {g} AND p.taken & (1 << pred) = 0) GROUP BY ALL)" for g in range(10)
)


@query(IOU10 + BEST + "SELECT image_id, round(max(best), 6) AS total FROM p10 GROUP BY image_id")
def m1_hungarian_total(spark, sf_dir):
    """What the matched pairs of each image overlap in sum: no other assignment has more."""
    scores = ious(spark, sf_dir, 10)
    found = M.hungarian(scores).select("image_id", "gt", "pred")
    return scores.join(found, ["image_id", "gt", "pred"]).groupBy("image_id").agg(F.round(F.sum("iou"), 6).alias("total"))


NAMES = """,
gn AS (SELECT image_id, label, (row_number() OVER (PARTITION BY image_id ORDER BY label) - 1)::INT AS dense FROM (SELECT DISTINCT image_id, label * 3 + 1 AS label FROM gt_map)),
pn AS (SELECT image_id, label, (row_number() OVER (PARTITION BY image_id ORDER BY label) - 1)::INT AS dense FROM (SELECT DISTINCT image_id, label * 2 + 5 AS label FROM pred7))
"""


@query(IOU7 + EXCLUSIVE + NAMES + "SELECT w.image_id, gn.label AS gt, coalesce(pn.label, w.pred) AS pred FROM won w LEFT JOIN gn ON w.image_id = gn.image_id AND w.gt = gn.dense LEFT JOIN pn ON w.image_id = pn.image_id AND w.pred = pn.dense")
def m6_undensify_match(spark, sf_dir):
    pred, gt = maps(spark, sf_dir, 7)
    pred, gt = pred.withColumn("label", F.col("label") * 2 + 5), gt.withColumn("label", F.col("label") * 3 + 1)
    found = M.majority_exclusive(M.iou(M.contingency(M.pairs(L.dense(pred), L.dense(gt)))))
    return M.named(found, L.dense_names(gt), L.dense_names(pred))


@query(IOU7 + EXCLUSIVE + APPLIED7 + "SELECT * FROM final")
def m7_apply_match(spark, sf_dir):
    return matched(spark, sf_dir)[0]


@query(IOU7 + EXCLUSIVE + APPLIED7 + "SELECT * FROM conf")
def a4_confusion_counts(spark, sf_dir):
    return E.confusion(M.contingency(M.pairs(*matched(spark, sf_dir))), CLASSES)


@query(IOU7 + EXCLUSIVE + APPLIED7 + f"SELECT image_id, class, tp, fp, fn, tn, {', '.join(f'round({m}, 6) AS {m}' for m in E.METRICS)} FROM sc")
def a7_class_metrics(spark, sf_dir):
    return rounded(class_scores(spark, sf_dir))


@query(IOU10 + EXCLUSIVE + APPLIED10 + f"SELECT image_id, {METRIC_MEANS} FROM sc WHERE class BETWEEN 1 AND 9 GROUP BY image_id")
def a8_macro_metrics(spark, sf_dir):
    return rounded(E.macro(class_scores(spark, sf_dir, 10), len(CLASSES)))


@query(IOU7 + EXCLUSIVE + APPLIED7 + ", im AS (SELECT image_id, " + ", ".join(f"sum({m}) / 9 AS {m}" for m in E.METRICS) + " FROM sc WHERE class BETWEEN 1 AND 9 GROUP BY image_id) SELECT " + ", ".join(f"round({f}({m}), 6) AS {m}_{n}" for m in E.METRICS for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM im")
def a8_dataset_metrics(spark, sf_dir):
    return rounded(E.dataset(E.macro(class_scores(spark, sf_dir), len(CLASSES))))


@query(IOU7 + EXCLUSIVE + APPLIED7 + f"SELECT class, {METRIC_AVERAGES} FROM sc GROUP BY class")
def a9_class_means(spark, sf_dir):
    return rounded(E.per_class_means(class_scores(spark, sf_dir)))


MICRO = """,
c AS (SELECT pred, gt, count(*) AS n FROM pairs WHERE gt <> 255 GROUP BY pred, gt),
np2 AS (SELECT pred, sum(n) AS n_pred FROM c GROUP BY pred), ng2 AS (SELECT gt, sum(n) AS n_gt FROM c GROUP BY gt),
i2 AS (SELECT pred, gt, coalesce(n, 0) / greatest((n_pred + n_gt - coalesce(n, 0))::DOUBLE, 1e-8) AS iou FROM np2 CROSS JOIN ng2 LEFT JOIN c USING (pred, gt)),
a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS r FROM i2) WHERE r = 1),
w2 AS (SELECT gt, CASE WHEN row_number() OVER (PARTITION BY pred ORDER BY iou DESC, gt) = 1 THEN pred ELSE -1 END AS pred FROM a2),
f2 AS (SELECT coalesce(w2.gt, 0) AS pred, c.gt, n FROM c LEFT JOIN w2 ON c.pred = w2.pred),
classes AS (SELECT unnest(range(10))::INT AS class),
conf AS (
  SELECT class, sum(CASE WHEN pred = class AND gt = class THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN pred = class AND gt <> class THEN n ELSE 0 END)::BIGINT AS fp,
    sum(CASE WHEN pred <> class AND gt = class THEN n ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN pred <> class AND gt <> class THEN n ELSE 0 END)::BIGINT AS tn
  FROM f2, classes GROUP BY class)
SELECT class, tp, fp, fn, tn, round(tp / greatest((tp + fp + fn)::DOUBLE, 1e-8), 6) AS jaccard, round((tp + tn) / greatest((tp + fp + fn + tn)::DOUBLE, 1e-8), 6) AS accuracy,
  round(2 * tp / greatest((2 * tp + fp + fn)::DOUBLE, 1e-8), 6) AS dice, round(tp / greatest((tp + fp)::DOUBLE, 1e-8), 6) AS precision, round(tp / greatest((tp + fn)::DOUBLE, 1e-8), 6) AS recall FROM conf
"""


def micro(both: DataFrame) -> DataFrame:
    """Class metrics of all pixels of a dataset under one matching; gt 255 is ignored."""
    counts = M.contingency(both.where("gt <> 255").select(F.lit(0).alias("image_id"), "pred", "gt"))
    found = M.majority_exclusive(M.iou(counts)).where("pred >= 0").select("pred", F.col("gt").alias("new"))
    merged = counts.join(found, "pred", "left").select("image_id", F.coalesce("new", F.lit(0)).alias("pred"), "gt", "n")
    return E.scores(E.confusion(merged, CLASSES)).drop("image_id")


@query(IOU7 + MICRO)
def a10_dataset_micro(spark, sf_dir):
    return rounded(micro(M.pairs(*maps(spark, sf_dir, 7))))


LINES = """pairs AS (
  SELECT l_suppkey AS image_id, (l_linenumber - 1)::INT AS pred, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END)::INT AS gt
  FROM lineitem)"""


@query(MICRO, LINES)
def a10_order_lines_micro(spark, sf_dir):
    return rounded(micro(T.order_pairs(spark, sf_dir)))


@query(IOU + "SELECT image_id, pred, gt, round(iou, 6) AS iou FROM iou", LINES)
def a6_order_lines_iou(spark, sf_dir):
    return rounded(M.iou(M.contingency(T.order_pairs(spark, sf_dir))).select("image_id", "pred", "gt", "iou"))


@query(IOU7 + """,
spill AS (SELECT image_id, gt, n, least(n, sum(n) OVER (PARTITION BY image_id, pred) - n) AS s FROM counts)
SELECT image_id, gt, round(sum(s) / sum(n), 6) AS error FROM spill GROUP BY image_id, gt""")
def a14_undersegmentation(spark, sf_dir):
    error = E.undersegmentation(M.contingency(M.pairs(*maps(spark, sf_dir, 7))), CLASSES)
    return rounded(error.where(~F.isnan("error")))


@query(IOU7 + EXCLUSIVE + """,
n AS (SELECT gt, pred, count(*) AS n, min(image_id) AS seen FROM won GROUP BY gt, pred),
r AS (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY n DESC, seen) AS r, sum(n) OVER (PARTITION BY gt) AS total FROM n)
SELECT gt, pred, round(n * 100.0 / total, 6) AS percent FROM (
  SELECT *, row_number() OVER (PARTITION BY gt ORDER BY CASE WHEN r = 1 AND pred = -1 THEN 1000000000 ELSE r END) AS q FROM r) WHERE q = 1""")
def a15_match_consistency(spark, sf_dir):
    return rounded(M.consistency(M.majority_exclusive(ious(spark, sf_dir, 7))))


EDGES = """,
steps AS (
  SELECT image_id, y, x, label, lead(label) OVER (PARTITION BY image_id, x ORDER BY y) AS down, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS across, m
  FROM (SELECT *, 0 AS m FROM gt_map UNION ALL SELECT *, 1 AS m FROM pred7) WHERE m = {m}),
edge AS (
  SELECT image_id, y + y % 2 AS y, x FROM steps WHERE down <> label UNION SELECT image_id, y, x + x % 2 AS x FROM steps WHERE across <> label)
"""


@query(EDGES.format(m=1) + "SELECT * FROM edge")
def a13_boundaries(spark, sf_dir):
    return L.boundary(maps(spark, sf_dir, 7)[0])


HITS = EDGES.format(m=0).replace("steps", "s0").replace("edge", "e0") + EDGES.format(m=1).replace("steps", "s1").replace("edge", "e1") + """
SELECT image_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM {b} b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1) THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM {a} a GROUP BY image_id
"""


@query(HITS.format(a="e0", b="e1"))
def a11_boundary_recall(spark, sf_dir):
    pred, gt = maps(spark, sf_dir, 7)
    return rounded(E.boundary_hits(L.boundary(gt), L.boundary(pred), 1, 10, 10, gt.select("image_id").distinct()))


@query(HITS.format(a="e1", b="e0"))
def a12_boundary_precision(spark, sf_dir):
    pred, gt = maps(spark, sf_dir, 7)
    return rounded(E.boundary_hits(L.boundary(pred), L.boundary(gt), 1, 10, 10, gt.select("image_id").distinct()))


@query(", t AS (SELECT p, gt, k[1:10] AS s FROM patches), r AS (SELECT (SELECT count(*) FROM range(1, 11) i(i) WHERE s[i] > s[gt + 1] OR (s[i] = s[gt + 1] AND i < gt + 1)) AS better FROM t) SELECT round(avg(CASE WHEN better < 1 THEN 100.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN better < 5 THEN 100.0 ELSE 0 END), 6) AS top5 FROM r")
def a16_topk_accuracy(spark, sf_dir):
    rows = T.patches(spark, sf_dir).select(F.slice("k", 1, 10).alias("scores"), F.col("gt").alias("target"))
    return rounded(E.top_k_accuracy(rows, (1, 5)))


@query("""SELECT event_id, v[((len(v) + 1) // 2)::INT] AS median, round(avg, 9) AS avg, max, round(global_avg, 9) AS global_avg FROM (
  SELECT event_id, list_sort(list(value) OVER w) AS v, avg(value) OVER w AS avg, max(value) OVER w AS max, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS global_avg
  FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""", "")
def a17_smoothed_values(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").select("event_id", "user_id", "value")
    return rounded(E.smoothed(events, ("user_id",), "event_id", "value").select("event_id", "median", "avg", "max", "global_avg"), 9)


@query(""",
h AS (SELECT image_id, val, count(*) AS n FROM pixels GROUP BY image_id, val),
g AS (SELECT image_id, b FROM (SELECT DISTINCT image_id FROM pixels), (SELECT unnest(range(256)) AS b))
SELECT g.image_id, list(coalesce(n, 0) ORDER BY b) AS hist FROM g LEFT JOIN h ON h.image_id = g.image_id AND h.val = g.b GROUP BY g.image_id""")
def a18_histogram(spark, sf_dir):
    return E.histogram(T.pixels(T.patches(spark, sf_dir)), ("image_id",), "val")


@query(IOU7 + EXCLUSIVE + APPLIED7 + ", im AS (SELECT image_id, sum(jaccard) / 9 AS miou FROM sc WHERE class BETWEEN 1 AND 9 GROUP BY image_id) SELECT k.kind, round(CASE WHEN k.kind = 'segments' THEN (SELECT avg(miou) FROM im) END, 6) AS score FROM (VALUES ('segments'), ('crf')) k(kind)")
def a19_subfolder_rollup(spark, sf_dir):
    per_image = E.macro(class_scores(spark, sf_dir), len(CLASSES))
    results = per_image.select(F.lit("segments").alias("kind"), F.col("image_id").alias("subfolder"), F.col("jaccard").alias("miou"))
    return rounded(E.rollup(results, ("segments", "crf")))


@query("SELECT image_id, label, count(*) AS n FROM gt_map GROUP BY image_id, label")
def a3_class_counts(spark, sf_dir):
    return T.truth(T.patches(spark, sf_dir)).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query(" SELECT DISTINCT label FROM gt_map")
def a21_distinct_labels(spark, sf_dir):
    return T.truth(T.patches(spark, sf_dir)).select("label").distinct()


@query("SELECT round(avg(val / 255.0), 6) AS mean, round(stddev_pop(val / 255.0), 6) AS std FROM pixels")
def a1_mean_std_strong(spark, sf_dir):
    v = F.col("val") / 255.0
    return rounded(T.pixels(T.patches(spark, sf_dir)).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")))


@query("SELECT round(avg(m), 6) AS mean, round(avg(s), 6) AS std FROM (SELECT avg(val / 255.0) AS m, stddev_samp(val / 255.0) AS s FROM pixels GROUP BY image_id)")
def a2_mean_std_weak(spark, sf_dir):
    v = F.col("val") / 255.0
    each = T.pixels(T.patches(spark, sf_dir)).groupBy("image_id").agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    return rounded(each.agg(F.avg("m").alias("mean"), F.avg("s").alias("std")))
