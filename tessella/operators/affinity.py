"""Affinity graphs between the patches of an image, as edges (image_id, i, j, w).

Measures that are column expressions join pairs within an image; symmetric ones are computed for i <= j and
mirrored. Neighbours and joint histograms come from blocks of an image's patches against all of them, in grouped Arrow
functions, so pairs are never rows of a shuffle and an image's work is spread over its blocks; neighbours go by an index
of cells, histograms by matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V

Measure = Callable[[Column, Column], Column]


def all_pairs(patches: DataFrame, upper: bool = True) -> DataFrame:
    """image_id, i, j, a, b of the patch pairs of each image, with i <= j if ``upper``."""
    a = patches.select("image_id", F.col("p").alias("i"), F.col("k").alias("a"))
    b = patches.select("image_id", F.col("p").alias("j"), F.col("k").alias("b"))
    both = a.join(b, "image_id")
    return both.where("i <= j") if upper else both


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges of i <= j and their mirror images; the diagonal stays single."""
    turned = F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return edges.select("image_id", F.explode(turned).alias("e"), "w").select("image_id", "e.i", "e.j", "w")


def cosine_graph(patches: DataFrame, positive: bool = True, scaled: bool = True) -> DataFrame:
    """w: dot products, those not above 0 left out if ``positive``, over the image's largest if ``scaled``."""
    edges = mirrored(all_pairs(patches).select("image_id", "i", "j", V.dot(F.col("a"), F.col("b")).alias("w")))
    if scaled:
        top = edges.groupBy("image_id").agg(F.max("w").alias("top"))
        edges = edges.join(top, "image_id").select("image_id", "i", "j", (F.col("w") / F.nullif("top", F.lit(0.0))).alias("w"))
    return edges.where("w > 0") if positive else edges


def measured(patches: DataFrame, distance: Measure, beta: float | None = None) -> DataFrame:
    """w: the distance of each pair, or exp(-beta * distance). ``distance`` builds a column of two vectors."""
    d = distance(F.col("a"), F.col("b"))
    return mirrored(all_pairs(patches).select("image_id", "i", "j", (d if beta is None else V.affinity(d, beta)).alias("w")))


#: Patches of an image that one task compares with all of the image's; numbers of a matrix that it holds at a time.
BLOCK, MATRIX = 8192, 1 << 20

Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, ...]]]


def blocked(patches: DataFrame, compare: Compare, kind: str, block: int = BLOCK) -> DataFrame:
    """image_id, i, j, w from compare(numbers and vectors of a block, numbers and vectors of the whole image), which
    yields arrays of i, j and w (of the SQL type ``kind``). Numbers ascend. Each block of an image is a group of its own."""
    id_type = dict(patches.dtypes)["image_id"]
    rows = patches.select("image_id", F.col("p").cast("long").alias("p"), F.col("k").cast("array<double>").alias("k"))
    n = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(rows.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", n.alias("blocks")), "image_id")
    some = rows.select("image_id", F.pmod("p", "blocks").cast("int").alias("block"), "p", "k")
    all_of = rows.select(F.col("image_id").alias("image"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"), F.col("p").alias("q"), F.col("k").alias("v"))
    number = pa.int64() if kind == "long" else pa.float64()

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        p = np.asarray(t.column(2))
        k = t.column(3).combine_chunks()
        values = (k if isinstance(k, pa.ListArray) else pa.concat_arrays(k.chunks)).flatten() if t.num_rows else pa.array([], pa.float64())
        order = np.argsort(p, kind="stable")
        return p[order], np.asarray(values, float).reshape(len(p), -1)[order]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(compare(*arrays(left), *arrays(right))) if left.num_rows else []
        i, j, w = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
        return pa.table({"image_id": pa.array([key[0].as_py()] * len(i), right.schema.field(0).type), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "w": pa.array(w, number)})

    return some.groupBy("image_id", "block").cogroup(all_of.groupBy("image", "number")).applyInArrow(run, f"image_id {id_type}, i int, j int, w {kind}")


def entropies(codes: np.ndarray, natural: bool) -> np.ndarray:
    """The entropy of each row's numbers."""
    codes = np.sort(codes, axis=1)
    n = codes.shape[1]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(new)
    run = np.diff(np.r_[row * n + at, codes.size])
    share = run / n
    return np.bincount(row, -share * (np.log(share) if natural else np.log2(share)), len(codes))


def information(patches: DataFrame, beta: float | None = None, natural: bool = False) -> DataFrame:
    """Distance 1 - 2 I / (H1 + H2) of the joint histogram of integer patch values; 1 where nothing is shared
    (also between constant patches). ``natural`` tells between logarithms, which cancel."""

    def compare(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        names, code = np.unique(b, return_inverse=True)
        b = code.reshape(b.shape).astype(np.int64)
        a = np.searchsorted(names, a).astype(np.int64)
        ha, hb = entropies(a, natural), entropies(b, natural)
        step = max(1, MATRIX // max(b.size, 1))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            both = entropies((part[:, None, :] * len(names) + b[None]).reshape(-1, b.shape[1]), natural).reshape(len(part), len(b))
            total = ha[s : s + step, None] + hb[None]
            mi = total - both
            none = (total < 1e-12) | (np.abs(mi) < 1e-12)
            yield np.repeat(i[s : s + step], len(j)), np.tile(j, len(part)), np.where(none, 1.0, 1 - 2 * mi / np.where(none, 1.0, total)).ravel()

    out = blocked(patches, compare, "double")
    return out if beta is None else out.withColumn("w", V.affinity(F.col("w"), beta))


#: Patches of a cell of the neighbour index, and cells that are opened at once after the first.
CELL, STEP = 24, 8


def cells(x: np.ndarray, size: int = CELL) -> list[np.ndarray]:
    """Rows of x in cells of up to ``size``, halved along the widest side as often as it takes."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis = int(np.ptp(x[rows], axis=0).argmax())
        order = rows[np.argsort(x[rows, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to each of b, to 9 digits."""
    d = np.zeros((len(a), len(b)))
    for t in range(b.shape[1]):
        d += (a[:, t, None] - b[None, :, t]) ** 2
    return np.round(d, 9)


def closest(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of a, their k nearest rows of b with ranks (ties to the lower row), and how many distances that took.

    Both are cut into cells with bounding boxes. For a cell of a, cells of b are opened from the nearest box on, twice as
    many at a time, until the distance to the next box is above the k-th distance of every row.
    """
    k = min(k, len(b))
    known = cells(b)
    low, high = (np.array([f(b[c], axis=0) for c in known]) for f in (np.min, np.max))
    size = np.array([len(c) for c in known])
    for rows in known if len(a) == len(b) and (a == b).all() else cells(a):
        part = a[rows]
        gap = np.maximum(np.maximum(low - part.max(0), part.min(0) - high), 0)
        bound = (gap * gap).sum(1)
        order = np.argsort(bound, kind="stable")
        far = bound[order]
        take, step = int(np.searchsorted(np.cumsum(size[order]), k)) + 1, STEP
        near, d, opened = np.zeros(0, np.int64), np.zeros((len(rows), 0)), 0
        while True:
            new = np.concatenate([known[c] for c in order[opened:take]])
            near, d, opened = np.concatenate([near, new]), np.concatenate([d, squares(part, b[new])], axis=1), take
            worst = np.partition(d, k - 1, axis=1)[:, k - 1]
            if opened == len(order) or far[opened] > worst.max() + 1e-9:
                break
            take, step = min(int(np.searchsorted(far, worst.max() + 1e-9, "right")), opened + step, len(order)), 2 * step
        row, at = np.nonzero(d <= worst[:, None])
        first = np.lexsort((near[at], d[row, at], row))
        row, at = row[first], at[first]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        yield rows[row[best]], near[at[best]], rank[best], d.size


def nearest(patches: DataFrame, features: Column, k: int) -> DataFrame:
    """image_id, i, j: the k nearest patches of each by features (array), itself included, ties (within 9 digits of the
    squared distance) to the lower j: by an index of cells, which opens as few as give the certain answer."""

    def compare(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for row, at, rank, _ in closest(a, b, k):
            yield i[row], j[at], rank

    return blocked(patches.select("image_id", "p", features.alias("k")), compare, "long").select("image_id", "i", "j")


def neighbour_counts(patches: DataFrame, features: Callable[[float], Column], scales: Sequence[tuple[int, float]]) -> DataFrame:
    """w: how often i and j are neighbours of each other over all (k, distance weight) scales. A block finds its neighbours of
    all scales, and counts both directions of each edge, where it is; blocks are summed. ``features`` are as many at any weight."""

    def compare(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        size, width = int(j[-1]) + 1, b.shape[1] // len(scales)
        found = []
        for n, (k, _) in enumerate(scales):
            part = slice(n * width, (n + 1) * width)
            for row, at, *_ in closest(a[:, part], b[:, part], k):
                found += [i[row] * size + j[at], j[at] * size + i[row]]
        code, w = np.unique(np.concatenate(found), return_counts=True)
        yield code // size, code % size, w

    rows = patches.select("image_id", "p", F.concat(*[features(weight) for _, weight in scales]).alias("k"))
    return blocked(rows, compare, "long").groupBy("image_id", "i", "j").agg(F.sum("w").alias("w"))


def appearance(weight: float) -> Column:
    """Patch values and weighted position."""
    return F.concat("k", F.array((F.col("px") * weight).cast("double"), (F.col("py") * weight).cast("double")))


def variation(weight: float = 0.0) -> Column:
    """Patch variance and weighted position."""
    return F.array(V.variance(F.col("k")), (F.col("px") * weight).cast("double"), (F.col("py") * weight).cast("double"))


def position(_: float = 1.0) -> Column:
    return F.array(F.col("px").cast("double"), F.col("py").cast("double"))


def random_walk(pixels: DataFrame, sigma: float = 0.033, radius: int = 1) -> DataFrame:
    """image_id, y, x, y2, x2, w = exp(-(difference / sigma)^2) of pixels within a square radius."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    sent = pixels.withColumn("o", F.explode(offsets)).select("image_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("val").alias("v2"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    d = (F.col("val") - F.col("v2")) / sigma
    return pixels.join(sent, ["image_id", "y", "x"]).select("image_id", "y", "x", "y2", "x2", F.exp(-d * d).alias("w"))


def fused(parts: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of edge tables; those of weight 0 are not computed."""
    edges = None
    for table, weight in parts:
        if weight:
            t = table.select("image_id", "i", "j", (F.col("w") * weight).cast("double").alias("w"))
            edges = t if edges is None else edges.unionByName(t)
    if edges is None:
        raise ValueError("all weights are zero")
    return edges.groupBy("image_id", "i", "j").agg(F.sum("w").alias("w"))


def degrees(edges: DataFrame, least: float = 1e-12) -> DataFrame:
    """image_id, i, d: sums of rows, 1 where under ``least``."""
    return edges.groupBy("image_id", "i").agg(F.sum("w").alias("d")).select("image_id", "i", F.when(F.col("d") < least, 1.0).otherwise(F.col("d")).alias("d"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Edges of D - W, the diagonal on every node."""
    d = degrees(edges).select("image_id", "i", F.col("i").alias("j"), F.col("d").alias("w"))
    return edges.select("image_id", "i", "j", (-F.col("w")).alias("w")).unionByName(d).groupBy("image_id", "i", "j").agg(F.sum("w").alias("w"))
