"""Queries of frames, windows, sampling and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import augment as U
from tessella.operators import frames as R
from tessella.operators import sampling as V
from tessella.operators.joins import ranked
from tessella.plans.registry import query, rounded
from tessella.sources import store
from tessella.sources import tables as T

TYPES = ("click", "error", "purchase", "signup", "view")
FRAMES = "frames AS (SELECT user_id % 8 AS seq, date_diff('day', DATE '1970-01-01', ts::DATE) AS frame, [" + ", ".join(f"count(*) FILTER (event_type = '{t}')" for t in TYPES) + "] AS hist FROM events GROUP BY ALL)"
DIFFS = ", l AS (SELECT seq, frame, hist, lag(hist) OVER (PARTITION BY seq ORDER BY frame) AS prev FROM frames), d AS (SELECT seq, frame, CASE WHEN prev IS NULL THEN 0 ELSE " + " + ".join(f"abs(hist[{i}] - prev[{i}])" for i in range(1, 6)) + " END::BIGINT AS diff, prev IS NULL AS first FROM l)"
LIMIT = 6


def frames(spark, sf_dir) -> DataFrame:
    """Daily histograms of event types for eight sequences."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    counts = [F.count_if(F.col("event_type") == t) for t in TYPES]
    return events.groupBy((F.col("user_id") % 8).alias("seq"), day.alias("frame")).agg(F.array(*counts).alias("hist"))


@query(DIFFS + f"SELECT seq, frame, diff, first OR diff > {LIMIT} AS changed FROM d", FRAMES)
def w1_shot_detection(spark, sf_dir):
    return R.shot_changes(frames(spark, sf_dir), LIMIT)


SHOTS = DIFFS + f"SELECT seq, frame, diff, first OR diff > {LIMIT} AS changed, (sum((first OR diff > {LIMIT})::INT) OVER (PARTITION BY seq ORDER BY frame) - 1)::INT AS shot FROM d"


@query(SHOTS, FRAMES)
def w2_shot_labels(spark, sf_dir):
    return R.shots(frames(spark, sf_dir), LIMIT)


@query(DIFFS + f"SELECT seq, frame, round(frame / 25.0, 6) AS time FROM d WHERE first OR diff > {LIMIT}", FRAMES)
def w3_shot_times(spark, sf_dir):
    return rounded(R.shot_times(frames(spark, sf_dir), LIMIT, 25.0))


ATTENTION = ", a AS (SELECT image_id, h::INT AS head, p, abs(k[h]) AS v FROM patches, range(1, 5) r(h))"


def attention(spark, sf_dir) -> DataFrame:
    return T.patches(spark, sf_dir).select("image_id", "p", F.posexplode(F.slice("k", 1, 4)).alias("h", "e")).select("image_id", (F.col("h") + 1).alias("head"), "p", F.abs("e").alias("v"))


@query(ATTENTION + "SELECT image_id, head, p, coalesce(sum(v) OVER (PARTITION BY image_id, head ORDER BY v, p ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY image_id, head) > 0.4, false) AS keep FROM a")
def w4_attention_mass(spark, sf_dir):
    return R.attention_mass(attention(spark, sf_dir)).drop("v")


@query(ATTENTION + "SELECT image_id, p, round(avg(v), 6) AS v FROM a GROUP BY ALL")
def w5_head_mean(spark, sf_dir):
    return rounded(R.head_mean(attention(spark, sf_dir)))


@query("SELECT image_id, y, x, round((val - min(val) OVER w) / (max(val) OVER w - min(val) OVER w)::DOUBLE, 6) AS val FROM pixels WINDOW w AS (PARTITION BY image_id)")
def w6_rescale(spark, sf_dir):
    return rounded(R.rescaled(T.pixels(T.patches(spark, sf_dir)), ("image_id",), "val"))


@query(DIFFS + "SELECT seq, frame, diff FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY diff DESC, frame) AS r FROM d) WHERE r <= 3", FRAMES)
def w7_top_changes(spark, sf_dir):
    d = R.shot_changes(frames(spark, sf_dir), LIMIT)
    rank = F.row_number().over(W.partitionBy("seq").orderBy(F.desc("diff"), "frame"))  # cut off before the shuffle, too
    return d.withColumn("r", rank).where("r <= 3").select("seq", "frame", "diff")


@query("SELECT DISTINCT source FROM documents ORDER BY source", "")
def w8_sorted_subfolders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().orderBy("source")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 40", "")
def w9_first_rows(spark, sf_dir):
    return T.embeddings(spark, sf_dir).select("vec_id", "label").orderBy("vec_id").limit(40)


@query("SELECT vec_id FROM embeddings ORDER BY md5(concat_ws(':', vec_id, 1)), vec_id LIMIT 10", "")
def w10_seeded_sample(spark, sf_dir):
    return R.sampled(T.embeddings(spark, sf_dir).select("vec_id"), "vec_id", 10)


@query("SELECT vec_id FROM embeddings WHERE label < 2 UNION ALL SELECT vec_id FROM embeddings WHERE label < 3", "")
def w11_union(spark, sf_dir):
    e = T.embeddings(spark, sf_dir)
    return e.where("label < 2").select("vec_id").unionByName(e.where("label < 3").select("vec_id"))


@query("SELECT DISTINCT label FROM embeddings", "")
def w12_distinct(spark, sf_dir):
    return T.embeddings(spark, sf_dir).select("label").distinct()


def drawn(n: str, *salt: str, digits: int = 8) -> str:
    """What sampling.draw() is in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(salt)})), 1, {digits}))::BIGINT % ({n}))"


IMAGES = ", im AS (SELECT DISTINCT image_id, 80 + image_id * 8 AS height, 80 + image_id * 3 AS width FROM patches), nn AS (SELECT *, unnest(range(floor(height * width / 64)::BIGINT)) AS i FROM im)"


def images(spark, sf_dir) -> DataFrame:
    side = lambda m: (80 + F.col("image_id") * m).cast("int")
    return T.patches(spark, sf_dir).select("image_id").distinct().select("image_id", side(8).alias("height"), side(3).alias("width"))


@query(", im AS (SELECT DISTINCT image_id, 80 + image_id * 8 AS height, 80 + image_id * 3 AS width FROM patches) SELECT image_id, (x // 8 * (height // 8) + y // 8)::INT AS i, x::INT AS x, y::INT AS y FROM im, range(0, 1000, 8) a(x), range(0, 1000, 8) b(y) WHERE x <= width - 8 AND y <= height - 8")
def v1_grid_patches(spark, sf_dir):
    return V.grid(images(spark, sf_dir), 8)


TRIPLETS = IMAGES + ", tr AS (SELECT *, " + ", ".join(f"{drawn(f'{side} - 7', repr(k + c), 'image_id', 'i', '1')} AS {k}{c}" for k in "an" for c, side in (("x", "width"), ("y", "height"))) + ", " + ", ".join(f"{drawn('12', repr('p' + c), 'image_id', 'i', '1')} AS p{c}" for c in "xy") + " FROM nn) SELECT image_id, i::INT AS i, {'x': ax::INT, 'y': ay::INT} AS anchor, {'x': least(greatest(ax - 4 + px, 0), width - 8)::INT, 'y': least(greatest(ay - 4 + py, 0), height - 8)::INT} AS positive, {'x': nx::INT, 'y': ny::INT} AS negative FROM tr"
RANDOM_TRIPLETS = (
    "WITH n AS (SELECT count(*) AS n FROM embeddings), "
    f"a AS (SELECT vec_id::BIGINT AS a, {drawn('n - 1', repr('p'), 'vec_id', '1')} AS p0, {drawn('n - 2', repr('n'), 'vec_id', '1')} AS q0 FROM embeddings, n), "
    "b AS (SELECT a, q0, p0 + (p0 >= a)::INT AS p FROM a), "
    "c AS (SELECT a, p, q0 + (q0 >= least(a, p))::INT AS q1 FROM b), "
    "t AS (SELECT a AS anchor, p::BIGINT AS positive, (q1 + (q1 >= greatest(a, p))::INT)::BIGINT AS negative FROM c) "
)
CLASS_TRIPLETS = (
    "WITH r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(concat_ws(':', vec_id, 1)), 1, 12))::BIGINT, vec_id) - 1 AS r FROM embeddings), "
    "s AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c, count(*) OVER () AS classes FROM r GROUP BY label), "
    f"a AS (SELECT id, r.label, CASE WHEN n = 1 THEN r ELSE (r + 1 + {drawn('greatest(n - 1, 1)', repr('p'), 'id', '1')}) % n END AS pr, (c + 1 + {drawn('greatest(classes - 1, 1)', repr('c'), 'id', '1')}) % classes AS nc FROM r JOIN s USING (label)), "
    f"b AS (SELECT a.*, s.label AS nlabel, {drawn('n', repr('n'), 'id', '1')} AS nr FROM a JOIN s ON s.c = a.nc) "
    "SELECT b.id AS anchor, p.id AS positive, q.id AS negative FROM b JOIN r p ON p.label = b.label AND p.r = b.pr JOIN r q ON q.label = b.nlabel AND q.r = b.nr"
)
UNIT = "((('0x' || substr(md5(concat_ws(':', image_id, y, x, '{s}', 1)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
NOISE = f", m AS (SELECT image_id, avg(val) / (4 + {drawn('4', repr('snr'), 'image_id', '1')}) AS sigma FROM pixels GROUP BY image_id) SELECT image_id, y, x, round(val + sigma * (sqrt(-2 * ln({UNIT.format(s='u')})) * cos(2 * 3.141592653589793::DOUBLE * {UNIT.format(s='v')})), 6) AS val FROM pixels JOIN m USING (image_id)"
VIEWS = IMAGES + ", v AS (SELECT image_id, view, height AS h, width AS w, greatest(floor(height * CASE WHEN view < 2 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 1)::INT AS height, greatest(floor(width * CASE WHEN view < 2 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 1)::INT AS width FROM im, range(8) r(view)) " + f"SELECT image_id, view::INT AS view, CASE WHEN view < 2 THEN 'global' ELSE 'local' END AS kind, {drawn('h - height + 1', repr('y'), 'image_id', 'view', '1')}::INT AS y, {drawn('w - width + 1', repr('x'), 'image_id', 'view', '1')}::INT AS x, height, width FROM v"


@query(IMAGES + f"SELECT image_id, i::INT AS i, {drawn('width - 7', "'x'", 'image_id', 'i', '1')}::INT AS x, {drawn('height - 7', "'y'", 'image_id', 'i', '1')}::INT AS y FROM nn")
def v2_random_patches(spark, sf_dir):
    return V.random_patches(images(spark, sf_dir), 8)


@query(TRIPLETS)
def v3_triplet_patches(spark, sf_dir):
    return V.triplet_patches(images(spark, sf_dir), 8, 4)


@query(RANDOM_TRIPLETS + "SELECT anchor, positive, negative FROM t", "")
def v4_random_triplets(spark, sf_dir):
    e = T.embeddings(spark, sf_dir).select(F.col("vec_id").alias("i"))
    return V.random_triplets(e, e.count())


@query(CLASS_TRIPLETS, "")
def v5_class_triplets(spark, sf_dir):
    return V.class_triplets(T.embeddings(spark, sf_dir), "vec_id", "label")


@query(", im AS (SELECT DISTINCT image_id FROM patches) SELECT p.image_id, printf('patch_%d_%d_%d.png', x // 16 * 16, y // 16 * 16, p.image_id) AS name, y % 16 AS y, x % 16 AS x, val FROM pixels p")
def v6_patch_crop(spark, sf_dir):
    px = T.pixels(T.patches(spark, sf_dir))
    starts = px.select("image_id").distinct().select("image_id", F.lit(80).alias("height"), F.lit(80).alias("width"))
    boxes = V.grid(starts, 16).select("image_id", F.col("i").alias("segment"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 16).alias("xmax"), (F.col("y") + 16).alias("ymax"))
    from tessella.operators.pixels import crop

    cut = crop(px, boxes).join(boxes, ["image_id", "segment"])
    name = V.patch_name(F.col("xmin"), F.col("ymin"), F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    return cut.select("image_id", name.alias("name"), (F.col("y") - F.col("ymin")).alias("y"), (F.col("x") - F.col("xmin")).alias("x"), "val")


@query(RANDOM_TRIPLETS + "SELECT anchor // 64 AS batch, list(anchor ORDER BY anchor) AS anchors, list(positive ORDER BY anchor) AS positives, list(negative ORDER BY anchor) AS negatives FROM t GROUP BY batch", "")
def v7_triplet_batches(spark, sf_dir):
    return V.collated(v4_random_triplets(spark, sf_dir), 64)


@query(NOISE)
def v8_gaussian_noise(spark, sf_dir):
    return rounded(V.noisy(T.pixels(T.patches(spark, sf_dir))))


@query(VIEWS)
def v9_views(spark, sf_dir):
    return V.views(images(spark, sf_dir))


SMALL = U.Views(side_global=24, side_local=10)


def colours(spark, sf_dir) -> DataFrame:
    """Images of three channels: grey values, and the same shifted along rows and along columns."""
    p = T.pixels(T.patches(spark, sf_dir))
    side = T.PATCH * T.GRID
    moved = lambda c, by, name: p.withColumn(c, (F.col(c) + by) % side).withColumnRenamed("val", name)
    return p.withColumnRenamed("val", "r").join(moved("x", 27, "g"), ["image_id", "y", "x"]).join(moved("y", 27, "b"), ["image_id", "y", "x"])


def chain_sql(v: U.Views) -> str:
    """SQL of augment.augmented() without blur over square images of T.PATCH * T.GRID pixels."""
    n, lo, hi = T.PATCH * T.GRID, U.RATIO[0], U.RATIO[1]
    pick = lambda n, what: drawn(str(n), repr(what), "image_id", "view", str(v.seed))
    wide = f"view < {v.n_global}"
    area = f"(CASE WHEN {wide} THEN {v.area_global[0]}::DOUBLE ELSE {v.area_local[0]}::DOUBLE END + {pick(1001, 'area')} / 1000.0::DOUBLE * CASE WHEN {wide} THEN {v.area_global[1] - v.area_global[0]}::DOUBLE ELSE {v.area_local[1] - v.area_local[0]}::DOUBLE END) * {n * n}"
    ratio = f"exp(ln({lo}::DOUBLE) + {pick(1001, 'ratio')} / 1000.0::DOUBLE * (ln({hi}::DOUBLE) - ln({lo}::DOUBLE)))"
    around = lambda most, what: f"CASE WHEN {pick(10, 'jitter')} < {v.jitter} THEN ({pick(2001, what)} - 1000) / 1000.0::DOUBLE * {most}::DOUBLE ELSE 0 END"
    length = lambda x: f"greatest(least(floor(sqrt(round({x}, 6)) + 0.5), {n}), 1)::INT"
    clip = lambda x: f"greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE)"
    grey = f"(r * {U.GREY[0]}::DOUBLE + g * {U.GREY[1]}::DOUBLE + b * {U.GREY[2]}::DOUBLE)"
    each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in U.CHANNELS)
    turn = lambda k: f"((({k} + hue) % 6) + 6) % 6"
    value = lambda c, k: f"CASE WHEN fh = 0 THEN {c} ELSE high - (high - low) * greatest(least({turn(k)}, 4 - {turn(k)}, 1), 0) END AS {c}"
    keep = "image_id, view, y, x, fb, fc, fs, fh, gr, so"
    return f""", rgb AS (SELECT p.image_id, p.y, p.x, p.val / 255.0::DOUBLE AS r, g.val / 255.0::DOUBLE AS g, b.val / 255.0::DOUBLE AS b FROM pixels p JOIN pixels g ON g.image_id = p.image_id AND g.y = p.y AND (g.x + 27) % {n} = p.x JOIN pixels b ON b.image_id = p.image_id AND b.x = p.x AND (b.y + 27) % {n} = p.y),
iv AS (SELECT image_id, view::INT AS view FROM (SELECT DISTINCT image_id FROM patches), range({v.n_global + v.n_local}) r(view)),
sz AS (SELECT *, {length(f"({area}) / ({ratio})")} AS h, {length(f"({area}) * ({ratio})")} AS w FROM iv),
pl AS (SELECT *, CASE WHEN {wide} THEN {v.side_global} ELSE {v.side_local} END AS side, {pick(f"{n} - h + 1", "top")} AS t, {pick(f"{n} - w + 1", "left")} AS l, {pick(10, "flip")} < {v.flip} AS flip,
  1 + {around(v.brightness, "brightness")} AS fb, 1 + {around(v.contrast, "contrast")} AS fc, 1 + {around(v.saturation, "saturation")} AS fs, {around(v.hue, "hue")} AS fh, {pick(10, "grey")} < {v.grey} AS gr, view = 1 AND {pick(10, "solarise")} < {v.solarise} AS so FROM sz),
o AS (SELECT *, unnest(range(side)) AS ox FROM (SELECT *, unnest(range(side)) AS oy FROM pl)),
s0 AS (SELECT o.image_id, view, oy AS y, ox AS x, fb, fc, fs, fh, gr, so, r, g, b FROM o JOIN rgb ON rgb.image_id = o.image_id AND rgb.y = t + floor((oy + 0.5) * h / side)::INT AND rgb.x = l + floor((CASE WHEN flip THEN side - 1 - ox ELSE ox END + 0.5) * w / side)::INT),
s1 AS (SELECT {keep}, {each(lambda c: clip(f"{c} * fb"))} FROM s0),
s2 AS (SELECT {keep}, {each(lambda c: f"CASE WHEN fc = 1 THEN {c} ELSE {clip(f'{c} * fc + mean * (1 - fc)')} END")} FROM s1 JOIN (SELECT image_id, view, avg({grey}) AS mean FROM s1 GROUP BY ALL) USING (image_id, view)),
s3 AS (SELECT {keep}, {each(lambda c: clip(f"{c} * fs + {grey} * (1 - fs)"))} FROM s2),
s4 AS (SELECT *, greatest(r, g, b) AS high, least(r, g, b) AS low FROM s3),
s5 AS (SELECT *, 6 * fh + CASE WHEN high = low THEN 0 WHEN high = r THEN (g - b) / (high - low) WHEN high = g THEN 2 + (b - r) / (high - low) ELSE 4 + (r - g) / (high - low) END AS hue FROM s4),
s6 AS (SELECT {keep}, {value("r", 5)}, {value("g", 3)}, {value("b", 1)} FROM s5),
s7 AS (SELECT {keep}, {each(lambda c: f"CASE WHEN gr THEN {grey} ELSE {c} END")} FROM s6)
SELECT image_id, view, y::INT AS y, x::INT AS x, {each(lambda c: f"round(CASE WHEN so AND {c} >= 0.5 THEN 1 - {c} ELSE {c} END, 6)")} FROM s7"""


@query(chain_sql(SMALL))
def v9_augmented_views(spark, sf_dir):
    """All steps but the blur."""
    return rounded(U.augmented(colours(spark, sf_dir), SMALL, blurred=False, size=(T.PATCH * T.GRID,) * 2))


@query()
def v9_blurred_views(spark, sf_dir):
    """The whole chain."""
    return rounded(U.augmented(colours(spark, sf_dir), SMALL, size=(T.PATCH * T.GRID,) * 2))


@query("SELECT label, batch, list(vec_id ORDER BY vec_id) AS ids FROM (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings) GROUP BY label, batch", "")
def v11_collate(spark, sf_dir):
    """Lists of up to 64 of a label, in numbered batches, whatever the label's size."""
    placed = ranked(T.embeddings(spark, sf_dir).select("label", "vec_id"), ["label", "vec_id"])
    first = placed.groupBy("label").agg(F.min("place").alias("first"))
    at = placed.join(first, "label").withColumn("batch", F.floor((F.col("place") - F.col("first")) / 64))
    return at.groupBy("label", "batch").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def arriving(spark, df: DataFrame, order: str, files: int = 4, last: DataFrame | None = None) -> DataFrame:
    """A stream over df in batches of four files, in the given order; ``last`` comes after all of it."""
    source = store.scratch(spark, "arriving")
    bounds = df.approxQuantile(order, [i / files for i in range(1, files)], 0.01)
    part = sum(((F.col(order) > b).cast("int") for b in bounds), F.lit(0))
    for i in range(files):
        df.where(part == i).repartition(4).write.mode("append").parquet(source)
    if last is not None:
        last.write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(source)


def streamed(spark, stream: DataFrame) -> DataFrame:
    """What an append-mode stream has put out when its source is at its end."""
    from tessella.streaming.frames import appended

    out = store.scratch(spark, "stream")
    appended(stream, out, store.scratch(spark, "state"))
    return spark.read.schema(stream.schema).parquet(out)


DELAY = "10 seconds"


def late(rows: DataFrame, step: str) -> DataFrame:
    """rows with a time (``at``) of a second a step, as Python's times end in 2262, and ``order``: their arrival, up to seven
    steps late."""
    return rows.withColumns({"at": F.timestamp_seconds(F.col(step) + 1), "order": (F.col(step) + F.pmod(F.xxhash64(step), F.lit(8))).cast("long")})


@query(SHOTS, FRAMES)
def t1_streaming_shots(spark, sf_dir):
    """Four batches of frames that come late and out of order: shots go on where the batch before ended."""
    from tessella.streaming.frames import closing, shots

    rows = late(frames(spark, sf_dir), "frame")
    return streamed(spark, shots(arriving(spark, rows, "order", last=closing(rows, "seq", "at", DELAY)), LIMIT, DELAY))


@query("SELECT round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std FROM pixels")
def t2_streaming_moments(spark, sf_dir):
    from tessella.streaming.frames import moments, replaced

    out = store.scratch(spark, "moments")
    replaced(moments(arriving(spark, T.pixels(T.patches(spark, sf_dir)), "image_id", 3)), out, store.scratch(spark, "state"))
    found = spark.read.parquet(out)
    return rounded(found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch"))


ROLLING = "SELECT event_id, v[((len(v) + 1) // 2)::INT] AS median FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS v FROM events WHERE value IS NOT NULL)"


@query(ROLLING, "")
def t3_rolling_medians(spark, sf_dir):
    """Four batches of late values: windows reach back over their borders."""
    from tessella.streaming.frames import closing, rolling

    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    values = events.select(F.col("user_id").alias("key"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    rows = late(values, "step")
    return streamed(spark, rolling(arriving(spark, rows, "order", last=closing(rows, "key", "at", DELAY)), delay=DELAY)).select(F.col("step").alias("event_id"), "median")
