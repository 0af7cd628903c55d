"""Queries of joins, affinity graphs, spectral and clustering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import affinity as A
from tessella.operators import eigen as E
from tessella.operators import joins as J
from tessella.operators import local_statistics as L
from tessella.operators import patches as K
from tessella.operators import randomfield as R
from tessella.operators import spectral as S
from tessella.operators.graphsegments import graph_segments
from tessella.operators.superpixels import superpixels
from tessella.plans.registry import query, rounded
from tessella.sources import store
from tessella.sources import tables as T


def patches(spark, sf_dir) -> DataFrame:
    return T.patches(spark, sf_dir)


def grey(spark, sf_dir) -> DataFrame:
    """Patches of grey values in 0..1."""
    value = F.transform("k", lambda e: F.floor(F.least(F.greatest(e + 0.5, F.lit(0.0)), F.lit(1.0)) * 255) / 255.0)
    return patches(spark, sf_dir).withColumn("k", value)


GREY = ", grey AS (SELECT image_id, p, py, px, list_transform(k, lambda e: floor(least(greatest(e + 0.5, 0.0), 1.0) * 255) / 255.0::DOUBLE) AS k FROM patches)"
PAIRS = ", q AS (SELECT a.image_id, a.p AS i, b.p AS j, a.k AS a, b.k AS b FROM {t} a JOIN {t} b ON a.image_id = b.image_id)"
PP, GP = PAIRS.format(t="patches"), GREY + PAIRS.format(t="grey")
MOMENTS = ", c AS (SELECT image_id, i, j, list_transform(a, lambda v: v - list_avg(a)) AS x, list_transform(b, lambda v: v - list_avg(b)) AS y FROM q), r AS (SELECT image_id, i, j, CASE WHEN list_dot_product(x, x) > 1e-18 AND list_dot_product(y, y) > 1e-18 THEN list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) END AS r FROM c)"


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY -vec_id) AS r FROM embeddings) b USING (r)", "")
def j1_positional_pairs(spark, sf_dir):
    e = T.embeddings(spark, sf_dir).select("vec_id")
    out = J.positional((e, e.select((-F.col("vec_id")).alias("vec_id"))), ("vec_id", "vec_id"), ("a", "b"))
    return out.select(F.col("a.vec_id").alias("a"), (-F.col("b.vec_id")).alias("b"))


@query("SELECT n_nationkey AS a, r AS b, c AS c FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) JOIN (SELECT n_name AS r, row_number() OVER (ORDER BY n_name) AS k FROM nation) USING (k) JOIN (SELECT n_regionkey AS c, row_number() OVER (ORDER BY n_regionkey) AS k FROM nation) USING (k)", "")
def j2_positional_triples(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = J.positional((n.select("n_nationkey"), n.select("n_name"), n.select("n_regionkey")), ("n_nationkey", "n_name", "n_regionkey"), ("a", "b", "c"))
    return out.select("a.n_nationkey", "b.n_name", "c.n_regionkey").toDF("a", "b", "c")


@query("SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d USING (doc_id)", "")
def j3_key_lookup(spark, sf_dir):
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return J.by_key(labels.select("doc_id", "quality"), docs.select("doc_id", "n_chars"), "doc_id")


@query("SELECT o_orderkey AS id, coalesce(l.v, o.v) AS v, l.n FROM (SELECT o_orderkey, o_totalprice AS v FROM orders) o LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey", "")
def j4_update_join(spark, sf_dir):
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    right = lines.where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"), F.count("*").alias("n"))
    return J.updated(orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), right, "id")


@query(PP + "SELECT image_id, i, j FROM q WHERE i <= j")
def j5_all_pairs(spark, sf_dir):
    return A.all_pairs(patches(spark, sf_dir)).select("image_id", "i", "j")


KNN = ", knn{n} AS (SELECT image_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS r FROM (SELECT image_id, i, j, {d} AS d FROM {q})) WHERE r <= {k})"
SQUARES = "list_sum(list_transform(range(1, len(a) + 1), lambda t: (a[t] - b[t]) * (a[t] - b[t])))"
EXACT = f"round({SQUARES}, 9)"


@query(PP + KNN.format(n="", d=EXACT, q="q", k=5) + "SELECT * FROM knn")
def j6_knn_join(spark, sf_dir):
    return A.nearest(patches(spark, sf_dir), F.col("k"), 5)


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)", "")
def j8_anti_join(spark, sf_dir):
    e = T.embeddings(spark, sf_dir)
    return J.missing(e.select("vec_id"), e.where("label = 3"), "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)", "")
def j9_semi_join(spark, sf_dir):
    e = T.embeddings(spark, sf_dir)
    return J.present(e.select("vec_id"), e.where("label = 3"), "vec_id")


@query(" SELECT g.image_id, g.y, g.x, count(*) AS n FROM gt_map g JOIN gt_map o ON o.image_id = g.image_id AND abs(o.y - g.y) <= 1 AND abs(o.x - g.x) <= 1 AND o.label = g.label GROUP BY ALL")
def j11_stencil_join(spark, sf_dir):
    from tessella.operators.labelmaps import neighbours
    from tessella.operators.metrics import square

    gt = T.truth(patches(spark, sf_dir))
    sent = neighbours(gt, square(1)).select("image_id", "y", "x", F.col("label"))
    return gt.join(sent, ["image_id", "y", "x", "label"]).groupBy("image_id", "y", "x").agg(F.count("*").alias("n"))


@query("SELECT image_id, label, k::INT AS k, b::DOUBLE AS beta, n AS norm FROM (SELECT DISTINCT image_id, label FROM gt_map), (VALUES (5), (10), (15)) a(k), (VALUES (0.5), (1.0)) b(b), (VALUES ('none'), ('custom')) c(n)")
def j12_parameter_grid(spark, sf_dir):
    """A trial for each segment of each image and each setting."""
    over = T.truth(patches(spark, sf_dir)).select("image_id", "label").distinct()
    return J.parameter_grid(over, {"k": [5, 10, 15], "beta": [0.5, 1.0], "norm": ["none", "custom"]})


@query(PP + ", e AS (SELECT image_id, i, j, list_dot_product(a, b) AS w FROM q) SELECT image_id, i, j, round(w / max(w) OVER (PARTITION BY image_id), 6) AS w FROM e QUALIFY w > 0")
def g1_cosine_affinity(spark, sf_dir):
    return rounded(A.cosine_graph(patches(spark, sf_dir)))


def upper(spark, sf_dir, measure, beta=None, source=grey) -> DataFrame:
    return rounded(A.measured(source(spark, sf_dir), measure, beta))


@query(GP + f"SELECT image_id, i, j, round(exp(-0.5 * {SQUARES}), 6) AS w FROM q")
def g2_ssd_affinity(spark, sf_dir):
    return upper(spark, sf_dir, V.ssd, 0.5)


@query(GP + MOMENTS + "SELECT image_id, i, j, round(1 - r, 6) AS w FROM r")
def g3_ncc_distance(spark, sf_dir):
    return upper(spark, sf_dir, V.ncc_distance)


@query(GP + MOMENTS + "SELECT image_id, i, j, round(exp(-1.0 * (1 - coalesce(r, 0))), 6) AS w FROM r")
def g4_cc_affinity(spark, sf_dir):
    return upper(spark, sf_dir, V.cc_distance, 1.0)


#: Whole grey levels.
LEVELS = ", levels AS (SELECT image_id, p, list_transform(k, lambda v: floor(v * 255 + 0.5)) AS k FROM grey)"


def windows_sql(name: str, table: str, size: int, side: int, first: int, last: int) -> str:
    """Windows whose upper left corners lie in rows and columns ``first`` to ``last`` - 1, and pairs of them."""
    rows = ", ".join(f"k[(y + {r}) * {size} + x + 1:(y + {r}) * {size} + x + {side}]" for r in range(side))
    n = side * side
    return f""", {name}w AS (SELECT image_id, p, y, x, w, list_sum(w) AS s, {n} * list_dot_product(w, w) - list_sum(w) * list_sum(w) AS v FROM (SELECT image_id, p, y, x, flatten([{rows}]) AS w FROM {table}, range({first}, {last}) a(y), range({first}, {last}) b(x))),
{name} AS (SELECT a.image_id, a.p AS i, b.p AS j, a.s AS sa, b.s AS sb, a.v AS va, b.v AS vb, {n} * list_dot_product(a.w, b.w) - a.s * b.s AS c FROM {name}w a JOIN {name}w b USING (image_id, y, x))"""


def ssim_sql(name: str, windows: str, side: int) -> str:
    n, c1, c2 = side * side, (L.LUMINANCE * 255) ** 2, (L.CONTRAST * 255) ** 2
    return f", {name} AS (SELECT image_id, i, j, avg((2 * (sa / {n}) * (sb / {n}) + {c1}::DOUBLE) * (2 * c / {n * (n - 1)} + {c2}::DOUBLE) / (((sa / {n}) * (sa / {n}) + (sb / {n}) * (sb / {n}) + {c1}::DOUBLE) * ((va + vb) / {n * (n - 1)} + {c2}::DOUBLE))) AS s FROM {windows} GROUP BY ALL)"


def measured_levels(spark, sf_dir, distance: L.Distance) -> DataFrame:
    return L.pairwise(levels(spark, sf_dir, 1), distance)


@query(GREY + LEVELS + windows_sql("c", "levels", T.PATCH, 3, 0, T.PATCH - 3) + f"SELECT image_id, i, j, round(1 - sum(CASE WHEN va > 0 AND vb > 0 THEN c / sqrt(va * vb) ELSE 0 END) / {T.PATCH**2}, 6) AS w FROM c GROUP BY ALL")
def g5_lncc_distance(spark, sf_dir):
    return rounded(measured_levels(spark, sf_dir, L.lncc))


@query(GREY + LEVELS + windows_sql("c", "levels", T.PATCH, 7, 0, T.PATCH - 6) + ssim_sql("m", "c", 7) + "SELECT image_id, i, j, round(1 - s, 6) AS w FROM m")
def g6_ssim_distance(spark, sf_dir):
    return rounded(measured_levels(spark, sf_dir, lambda a, b: L.ssim(a, b, 255.0)))


@query(GP + "SELECT image_id, i, j, round(acos(least(greatest(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), -1), 1)), 4) AS w FROM q WHERE i <> j")
def g7_sam_distance(spark, sf_dir):
    return rounded(A.measured(grey(spark, sf_dir), V.sam_distance).where("i <> j"), 4)


MI = """, c AS (SELECT image_id, p, floor((e * 255 + 0.5) / {bin})::INT AS v, o FROM (SELECT image_id, p, unnest(k) AS e, generate_subscripts(k, 1) AS o FROM grey)),
s AS (SELECT image_id, p, -sum(n / 64.0::DOUBLE * {log}(n / 64.0::DOUBLE)) AS h FROM (SELECT image_id, p, v, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
jn AS (SELECT image_id, i, j, -sum(n / 64.0::DOUBLE * {log}(n / 64.0::DOUBLE)) AS h FROM (SELECT a.image_id, a.p AS i, b.p AS j, a.v, b.v AS w, count(*) AS n FROM c a JOIN c b ON a.image_id = b.image_id AND a.o = b.o GROUP BY ALL) GROUP BY ALL)
SELECT jn.image_id, i, j, round(CASE WHEN a.h + b.h < 1e-12 OR abs(a.h + b.h - jn.h) < 1e-12 THEN 1 ELSE 1 - 2 * (a.h + b.h - jn.h) / (a.h + b.h) END, 6) AS w
FROM jn JOIN s a ON a.image_id = jn.image_id AND a.p = i JOIN s b ON b.image_id = jn.image_id AND b.p = j"""


def levels(spark, sf_dir, size: int) -> DataFrame:
    """Patches of whole grey levels, ``size`` values to a level."""
    return grey(spark, sf_dir).withColumn("k", F.transform("k", lambda v: F.floor((v * 255 + 0.5) / size).cast("int")))


@query(GREY + MI.format(bin=1, log="log2"))
def g8_mutual_information(spark, sf_dir):
    return rounded(A.information(levels(spark, sf_dir, 1)))


@query(GREY + MI.format(bin=1, log="ln"))
def g9_nmi_distance(spark, sf_dir):
    return rounded(A.information(levels(spark, sf_dir, 1), natural=True))


COUNTS = " , k AS (SELECT * FROM knn1 UNION ALL SELECT image_id, j, i FROM knn1 UNION ALL SELECT * FROM knn2 UNION ALL SELECT image_id, j, i FROM knn2) SELECT image_id, i, j, count(*) AS w FROM k GROUP BY ALL"
FEATURE = ", f{n} AS (SELECT image_id, p, {f} AS k FROM patches), q{n} AS (SELECT a.image_id, a.p AS i, b.p AS j, a.k AS a, b.k AS b FROM f{n} a JOIN f{n} b ON a.image_id = b.image_id)"


def knn_sql(feature: str, *scales: tuple[int, float]) -> str:
    parts = [FEATURE.format(n=n, f=feature.format(w=w)) + KNN.format(n=n, d=EXACT, q=f"q{n}", k=k) for n, (k, w) in enumerate(scales, 1)]
    return "".join(parts) + COUNTS


@query(knn_sql("list_concat(k, [px * {w}::DOUBLE, py * {w}::DOUBLE])", (8, 0.5), (4, 0.1)))
def g10_ssd_knn_affinity(spark, sf_dir):
    return A.neighbour_counts(patches(spark, sf_dir), A.appearance, ((8, 0.5), (4, 0.1)))


@query(knn_sql("[list_avg(list_transform(k, lambda v: (v - list_avg(k)) * (v - list_avg(k)))) * 1000, px * {w}::DOUBLE, py * {w}::DOUBLE]", (8, 0.0), (4, 0.3)))
def g11_variance_knn_affinity(spark, sf_dir):
    return A.neighbour_counts(patches(spark, sf_dir), lambda w: F.concat(F.array(V.variance(F.col("k")) * 1000), F.slice(A.variation(w), 2, 2)), ((8, 0.0), (4, 0.3)))


@query(knn_sql("[px::DOUBLE, py::DOUBLE]", (9, 1.0), (5, 1.0)))
def g12_position_knn_affinity(spark, sf_dir):
    return A.neighbour_counts(patches(spark, sf_dir), A.position, ((9, 1.0), (5, 1.0)))


@query()
def g13_colour_knn_affinity(spark, sf_dir):
    """Over all pixels of all images; SQL would sort the square of their number."""
    rows = T.pixels(patches(spark, sf_dir)).select("image_id", (F.col("y") * 80 + F.col("x")).alias("p"), F.array((F.col("val") / 255.0).cast("double")).alias("k"), F.col("x").alias("px"), F.col("y").alias("py"))
    return A.neighbour_counts(rows, A.appearance, ((6, 0.01), (3, 0.03)))


@query("SELECT a.image_id, a.y, a.x, b.y AS y2, b.x AS x2, round(exp(-((a.val - b.val) / 25.5 * (a.val - b.val) / 25.5)), 6) AS w FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1")
def g14_random_walk_affinity(spark, sf_dir):
    return rounded(A.random_walk(T.pixels(patches(spark, sf_dir)), 25.5))


FUSED = GP + ", e AS (SELECT image_id, i, j, 0.5 * exp(-0.5 * " + SQUARES + ") AS w FROM q), cs AS (SELECT a.image_id, a.p AS i, b.p AS j, greatest(list_dot_product(a.k, b.k), 0) AS w FROM patches a JOIN patches b ON a.image_id = b.image_id), w AS (SELECT e.image_id, e.i, e.j, e.w + 2.0 * cs.w AS w FROM e JOIN cs USING (image_id, i, j)), d AS (SELECT image_id, i, CASE WHEN sum(w) < 1e-12 THEN 1 ELSE sum(w) END AS d FROM w GROUP BY ALL)"


def fused(spark, sf_dir) -> DataFrame:
    ssd, cosine = A.measured(grey(spark, sf_dir), V.ssd, 0.5), A.cosine_graph(patches(spark, sf_dir), scaled=False)
    return A.fused(((ssd, 0.5), (cosine, 2.0), (cosine, 0.0)))


@query(FUSED + "SELECT image_id, i, j, round(w, 6) AS w FROM w")
def g15_weighted_fusion(spark, sf_dir):
    return rounded(fused(spark, sf_dir))


@query(FUSED + "SELECT image_id, i, round(d, 6) AS d FROM d")
def g16_degrees(spark, sf_dir):
    return rounded(A.degrees(fused(spark, sf_dir)))


@query(FUSED + "SELECT image_id, i, j, round(CASE WHEN i = j THEN d - w ELSE -w END, 6) AS w FROM w JOIN d USING (image_id, i)")
def g17_laplacian(spark, sf_dir):
    return rounded(A.laplacian(fused(spark, sf_dir)))


HALF = ", half AS (SELECT image_id, p, list_transform(range(16), lambda o: (k[o // 4 * 16 + o % 4 * 2 + 1] + k[o // 4 * 16 + o % 4 * 2 + 2] + k[o // 4 * 16 + o % 4 * 2 + 9] + k[o // 4 * 16 + o % 4 * 2 + 10]) / 4) AS k FROM levels)"
SHARP = ", sharp AS (SELECT image_id, p, list_transform(range(36), lambda o: 9 * k[(o // 6 + 1) * 8 + o % 6 + 2] - list_sum(flatten([k[(o // 6 + r) * 8 + o % 6 + 1:(o // 6 + r) * 8 + o % 6 + 3] for r in [0, 1, 2]]))) AS k FROM levels)"


@query(
    GREY + LEVELS + HALF + SHARP + windows_sql("one", "levels", 8, 7, 0, 2) + windows_sql("two", "half", 4, 3, 0, 2) + ssim_sql("m1", "one", 7) + ssim_sql("m2", "two", 3) + windows_sql("whole", "sharp", 6, 6, 0, 1)
    + "SELECT w.image_id, w.i, w.j, round(1 - CASE WHEN va > 0 AND vb > 0 THEN c / sqrt(va * vb) ELSE 0 END, 6) AS scc, round(1 - sqrt(greatest(m1.s, 0)) * sqrt(greatest(m2.s, 0)), 6) AS ms_ssim FROM whole w JOIN m1 USING (image_id, i, j) JOIN m2 USING (image_id, i, j)"
)
def g18_scc_and_ms_ssim(spark, sf_dir):
    scc = measured_levels(spark, sf_dir, L.scc).withColumnRenamed("w", "scc")
    return rounded(scc.join(measured_levels(spark, sf_dir, lambda a, b: L.ms_ssim(a, b, 255.0)).withColumnRenamed("w", "ms_ssim"), ["image_id", "i", "j"]))


def eigen(spark, sf_dir, kind="laplacian_normalised") -> DataFrame:
    return S.eigenvectors(A.cosine_graph(patches(spark, sf_dir)), 5, kind)


@query(
    PP + ", e AS (SELECT image_id, i, j, list_dot_product(a, b) AS w FROM q), w AS (SELECT image_id, i, j, w / max(w) OVER (PARTITION BY image_id) AS w FROM e QUALIFY w > 0), d AS (SELECT image_id, i, sum(w) AS d FROM w GROUP BY ALL), m AS (SELECT w.image_id, i, j, CASE WHEN i = j THEN 1 ELSE 0 END - w / sqrt(d.d * f.d) AS m FROM w JOIN d USING (image_id, i) JOIN d f ON f.image_id = w.image_id AND f.i = w.j)"
    " SELECT image_id, count(DISTINCT i) AS n, round(sum(CASE WHEN i = j THEN m ELSE 0 END), 6) AS total, round(sum(m * m), 6) AS squares, true AS solves, true AS ordered FROM m GROUP BY image_id"
)
def c1_generalised_eigenproblem(spark, sf_dir):
    """For each image all eigenpairs: how many, their sum and sum of squares (the trace and norm of the matrix), whether each has
    (D - W) v = lambda D v within 1e-8, and whether values ascend."""
    edges = store.settled(A.cosine_graph(patches(spark, sf_dir)), "graph")  # read by all that follows
    e = store.settled(S.eigenvectors(edges, T.GRID * T.GRID), "eigen")
    off = S.residuals(edges, e).select("image_id", (F.col("off") < 1e-8).alias("solves"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("k", "eigenvalue"))), lambda x: x["eigenvalue"])
    found = e.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("eigenvalue"), 6).alias("total"), F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 6).alias("squares"), line.alias("line"))
    return found.join(off, "image_id").select("image_id", "n", "total", "squares", "solves", (F.col("line") == F.array_sort("line")).alias("ordered"))


@query()
def c2_affinity_eigenvalues(spark, sf_dir):
    return rounded(eigen(spark, sf_dir, "affinity").unionByName(eigen(spark, sf_dir, "affinity_svd")).select("image_id", "k", "eigenvalue"))


@query(
    PP + ", e AS (SELECT image_id, i, j, list_dot_product(a, b) AS w FROM q), w AS (SELECT image_id, i, j, w / max(w) OVER (PARTITION BY image_id) AS w FROM e QUALIFY w > 0)"
    " SELECT image_id, count(DISTINCT i) AS n, round(sum(CASE WHEN i = j THEN w ELSE 0 END), 6) AS total, round(sum(w * w), 6) AS squares, round(sum(w * w), 6) AS singular_squares FROM w GROUP BY image_id"
)
def c2_affinity_spectrum(spark, sf_dir):
    """All eigenvalues and singular values of each image's affinities: their sum is the trace, their squares are the norm's."""
    edges = store.settled(A.cosine_graph(patches(spark, sf_dir)), "graph")
    n = T.GRID * T.GRID
    values, singular = S.eigenvectors(edges, n, "affinity"), S.eigenvectors(edges, n, "affinity_svd")
    squares = F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 6)
    found = values.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("eigenvalue"), 6).alias("total"), squares.alias("squares"))
    return found.join(singular.groupBy("image_id").agg(squares.alias("singular_squares")), "image_id")


@query("SELECT image_id, p, CASE WHEN pos > 0.5 AND pos < 1 THEN list_transform(k, lambda v: -v) ELSE k END AS k FROM (SELECT *, len(list_filter(k, lambda v: v > 0)) / len(k) AS pos FROM patches)")
def c3_sign_convention(spark, sf_dir):
    return patches(spark, sf_dir).select("image_id", "p", S.signed(F.col("k")).alias("k"))


@query()
def c4_eigengap(spark, sf_dir):
    return S.eigengap(eigen(spark, sf_dir))


@query()
def c5_image_kmeans(spark, sf_dir):
    return S.kmeans_patches(S.spectral_patches(eigen(spark, sf_dir)), 4)


@query()
def c7_power_iteration(spark, sf_dir):
    edges = A.cosine_graph(patches(spark, sf_dir)).where("i < j")
    number = lambda p: F.col("image_id").cast("long") * T.GRID * T.GRID + F.col(p)
    return S.power_clusters(edges.select(number("i").alias("i"), number("j").alias("j"), "w"), 4)


def segments(spark, sf_dir) -> DataFrame:
    """image_id, segment, i (one number a segment), x: unit vectors of the mean features of all images' segments."""
    p = patches(spark, sf_dir)
    rows = K.pooled(p, T.truth(p)).where("segment > 0")
    return rows.select("image_id", "segment", (F.col("image_id").cast("long") * T.GRID * T.GRID + F.col("segment")).alias("i"), K.normalised(F.col("features")).alias("x"))


@query()
def c7_spectral_clusters(spark, sf_dir):
    """Spectral clustering of the segments of all images under one kernel."""
    rows = segments(spark, sf_dir)
    found = E.rbf_clusters(rows.select(F.lit(0).alias("g"), "i", "x"), 5)
    return rows.select("image_id", "segment", "i").join(E.beside(found), "i").select("image_id", "segment", "cluster")


@query()
def c8_optics(spark, sf_dir):
    return S.density_clusters(patches(spark, sf_dir), 4)


@query()
def c10_pca(spark, sf_dir):
    p = patches(spark, sf_dir).select("image_id", "p", F.col("k").alias("features"))
    return S.principal(p, 8).select("image_id", "p", F.transform("features", lambda v: F.round(v, 4)).alias("features"))


@query()
def c11_multi_region(spark, sf_dir):
    from tessella.operators.labelmaps import background_first

    return background_first(S.label_map(c5_image_kmeans(spark, sf_dir), 10), 10, 10)


@query()
def c13_single_region(spark, sf_dir):
    return S.single_region(eigen(spark, sf_dir), 10)


@query()
def c14_crf(spark, sf_dir):
    p = patches(spark, sf_dir)
    val = p.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), (F.element_at("k", 1) * 255).alias("val"))
    return R.refined(T.truth(p), val, 10)


@query()
def c15_slic(spark, sf_dir):
    return superpixels(T.pixels(patches(spark, sf_dir)))


@query()
def c15_felzenszwalb(spark, sf_dir):
    return graph_segments(T.pixels(patches(spark, sf_dir)), 1.0, 50)
