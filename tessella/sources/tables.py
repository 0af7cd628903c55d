"""Images as tables.

patches: image_id, p (number in the image), py, px, k (feature vector), gt (label); pixels: image_id, y, x,
val (0 to 255); label maps: image_id, y, x, label. Long form is canonical: a pixel or a patch is a row, so
that images of any size and number spread over the cluster.

``PATCH`` pixels square make a patch and ``GRID`` patches square an image of the bundled views over a table of
embeddings, in which a vector of 64 numbers is both a patch's feature and its 8 x 8 grey values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH, GRID = 8, 10


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = GRID * GRID
    p = (F.col("vec_id") % n).cast("int")
    return embeddings(spark, sf_dir).select(
        F.expr(f"cast(vec_id div {n} as int)").alias("image_id"),
        p.alias("p"),
        F.floor(p / GRID).cast("int").alias("py"),
        (p % GRID).alias("px"),
        F.col("embedding").cast("array<double>").alias("k"),
        F.col("label").cast("int").alias("gt"),
    )


def pixels(rows: DataFrame, size: int = PATCH) -> DataFrame:
    """Grey pixels of patches whose vector holds size * size values around zero."""
    e = rows.select("image_id", "py", "px", F.posexplode("k").alias("i", "e"))
    return e.select("image_id", (F.col("py") * size + F.floor(F.col("i") / size)).cast("int").alias("y"), (F.col("px") * size + F.col("i") % size).cast("int").alias("x"), F.floor(F.least(F.greatest(F.col("e") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("val"))


def truth(rows: DataFrame) -> DataFrame:
    """Label map of patches from their own labels."""
    return rows.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), F.col("gt").alias("label"))


def nearest_anchor(rows: DataFrame, anchors: int) -> DataFrame:
    """Label map that gives each patch its most similar (dot product) of the first ``anchors`` patches of its
    image, the lower of equals: one assignment step of k-means with fixed centres."""
    c = rows.where(F.col("p") < anchors).select("image_id", F.col("p").alias("a"), F.col("k").alias("c"))
    dot = F.round(F.aggregate(F.zip_with("k", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)
    best = rows.join(c, "image_id").groupBy("image_id", "p", "py", "px").agg(F.min_by("a", F.struct(-dot, F.col("a"))).alias("label"))
    return best.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), "label")


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large table of label pairs (image_id, pred, gt) from order lines, for evaluation at size."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return lines.select(F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).cast("int").alias("pred"), code.cast("int").alias("gt"))


#: The same tables in DuckDB, as the head of a WITH list.
SQL = """
patches AS (
  SELECT (vec_id // 100)::INT AS image_id, (vec_id % 100)::INT AS p, ((vec_id % 100) // 10)::INT AS py, (vec_id % 10)::INT AS px,
    embedding::DOUBLE[] AS k, label::INT AS gt FROM embeddings),
pixels AS (
  SELECT image_id, (py * 8 + (i - 1) // 8)::INT AS y, (px * 8 + (i - 1) % 8)::INT AS x,
    floor(least(greatest(e + 0.5, 0.0), 1.0) * 255)::INT AS val
  FROM (SELECT image_id, py, px, unnest(k) AS e, generate_subscripts(k, 1) AS i FROM patches)),
gt_map AS (SELECT image_id, py AS y, px AS x, gt AS label FROM patches),
sims AS (
  SELECT r.image_id, r.p, r.py, r.px, c.p AS a, round(list_dot_product(r.k, c.k), 9) AS s
  FROM patches r JOIN patches c ON r.image_id = c.image_id AND c.p < 10),
pred10 AS (
  SELECT image_id, py AS y, px AS x, a AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, p ORDER BY s DESC, a) AS r FROM sims) WHERE r = 1),
pred7 AS (
  SELECT image_id, py AS y, px AS x, a AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, p ORDER BY s DESC, a) AS r FROM sims WHERE a < 7) WHERE r = 1)
"""
