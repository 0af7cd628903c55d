"""Largest eigenpairs of symmetric matrices that no task could hold, by block Lanczos over tables.

A matrix is known by its product with some vectors: a join of edges with the vectors' entries and a sum, or tiles of
a kernel between features. Vectors are kept by node: a row holds the entries of up to ``CHUNK`` nodes of a graph in all
vectors of the basis (q) and in their products (s). What is common to a graph (projections, norms, the small eigenproblem
within the basis) is summed from parts of rows and joined back. Every step takes the products of the newest
vectors, makes them orthogonal to the basis, twice, and adds them to it; a basis of ``most`` vectors is replaced by
its best ones (a thick restart). Many graphs go through the same steps; a graph whose basis spans all it can
reach gets empty vectors. Tables of a step are written ones, so a lost executor costs its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.store import dropped, settled

#: Nodes of a row, and nodes of a tile of a kernel.
CHUNK, TILE = 1024, 1024
#: Length under which a vector counts as within the basis, and share of a unit square that new directions have at least.
NOTHING, ALIKE = 1e-11, 1e-8



def beside(df: DataFrame) -> DataFrame:
    """df, a table of nodes, to be joined by a shuffle: it is never sent to the driver to be broadcast, however small it is."""
    return df.hint("merge")


def common(df: DataFrame, name: str) -> DataFrame:
    """What is common to a graph (g, m), as ``name``, for a join with its rows: a few KB a graph, which are broadcast, so that the rows
    of one graph stay in many tasks."""
    return F.broadcast(df.withColumnRenamed("m", name))


#: Products (g, i, u) with vectors (g, i, v), both arrays.
Product = Callable[[DataFrame], DataFrame]


def edge_product(edges: DataFrame, width: int) -> Product:
    """Products of the matrices of edges (g, i, j, w) with ``width`` vectors."""

    def times(vectors: DataFrame) -> DataFrame:
        sent = edges.join(beside(vectors.withColumnRenamed("i", "j")), ["g", "j"])
        return sent.groupBy("g", "i").agg(F.array(*[F.sum(F.col("w") * F.col("v")[c]) for c in range(width)]).alias("u"))

    return times


def kernel_product(features: DataFrame, gamma: float, width: int, tile: int = TILE) -> Product:
    """Products of exp(-gamma |x - y|^2) over all pairs of a graph's features (g, i, x) with vectors: each pair of tiles is
    a group, and no pair of features is ever a row."""
    kind = dict(features.dtypes)["g"]
    count = features.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = features.join(F.broadcast(count), "g").select("g", "i", "x", "tiles", F.pmod(F.xxhash64("i"), "tiles").cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = np.concatenate([np.zeros(0), *[np.asarray(c.flatten()) for c in column.chunks]])
        return flat.reshape(len(column), -1)

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"g": pa.array([], left.schema.field("g").type), "i": pa.array([], pa.int64()), "p": pa.array([], pa.list_(pa.float64()))})
        a, b, v = matrix(left["x"]), matrix(right["x"]), matrix(right["v"])
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
        p = np.exp(-gamma * np.maximum(square, 0)) @ v
        return pa.table({"g": left["g"], "i": left["i"], "p": pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * width, pa.int32()), pa.array(p.ravel()))})

    def times(vectors: DataFrame) -> DataFrame:
        left = dealt.select("g", F.col("own").alias("a"), every.alias("b"), "i", "x").toDF("g", "a", "b", "i", "x")  # new names, as both sides are of the same table
        right = dealt.join(beside(vectors.toDF("g", "i", "v")), ["g", "i"]).select("g", every.alias("a"), F.col("own").alias("b"), "x", "v").toDF("g", "a", "b", "x", "v")
        parts = left.groupBy("g", "a", "b").cogroup(right.groupBy("g", "a", "b")).applyInArrow(multiply, f"g {kind}, i long, p array<double>")
        return parts.groupBy("g", "i").agg(F.array(*[F.sum(F.col("p")[c]) for c in range(width)]).alias("u"))

    return times


def arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(column.slice(i, 1).flatten()) for i in range(len(column))]


def packed(vectors: DataFrame, name: str) -> DataFrame:
    """g, chunk, nodes, ``name`` (entries, node by node) of vectors (g, i, ``name``)."""
    kind = dict(vectors.dtypes)["g"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        flat = np.concatenate(arrays(table[name].combine_chunks()))
        return pa.table({"g": table["g"].slice(0, 1), "chunk": pa.array([key[1].as_py()], pa.int64()), "nodes": pa.array([np.asarray(table["i"])], pa.list_(pa.int64())), name: pa.array([flat], pa.list_(pa.float64()))})

    return vectors.select("g", F.floor(F.col("i") / CHUNK).alias("chunk"), F.col("i").cast("long").alias("i"), name).groupBy("g", "chunk").applyInArrow(run, f"g {kind}, chunk long, nodes array<long>, {name} array<double>")


def opened(rows: DataFrame, column: str, width: int) -> DataFrame:
    """g, i, v (arrays) of chunks: the inverse of ``packed``."""
    at = F.posexplode("nodes").alias("n", "i")
    return rows.select("g", column, at).select("g", "i", F.slice(column, F.col("n") * width + 1, width).alias("v"))


def summed(rows: DataFrame, part: Callable[..., np.ndarray], columns: tuple[str, ...], then: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """g, m: ``then`` of the sum over a graph's rows of part(nodes, *columns), flat arrays. A batch of rows is summed where it
    is."""
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict = {}
            for g, *rest in zip(batch.column(0).to_pylist(), *map(arrays, batch.columns[1:]), strict=True):
                m = part(*rest).ravel()
                total[g] = total[g] + m if g in total else m
            yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.schema.field(0).type), pa.array(list(total.values()), pa.list_(pa.float64()))], ["g", "m"])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"g": table["g"].slice(0, 1), "m": pa.array([then(np.sum(arrays(table["m"].combine_chunks()), axis=0)).ravel()], pa.list_(pa.float64()))})

    parts = rows.select("g", "nodes", *columns).mapInArrow(run, f"g {kind}, m array<double>")
    return parts.groupBy("g").applyInArrow(finish, f"g {kind}, m array<double>")


def mapped(rows: DataFrame, f: Callable[..., tuple[np.ndarray, ...]], columns: tuple[str, ...], out: tuple[str, ...]) -> DataFrame:
    """g, chunk, nodes and the arrays ``out`` = f(nodes, *columns) of each row."""
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(*rest) for rest in zip(*map(arrays, batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([m[c].ravel() for m in made], pa.list_(pa.float64())) for c in range(len(out))]], ["g", "chunk", "nodes", *out])

    return rows.select("g", "chunk", "nodes", *columns).mapInArrow(run, f"g {kind}, chunk long, nodes array<long>, " + ", ".join(f"{c} array<double>" for c in out))


def largest(nodes: DataFrame, times: Callable[[int], Product], k: int, tolerance: float = 1e-8, extra: int = 2, most: int = 6, steps: int = 60) -> tuple[DataFrame, DataFrame]:
    """The k largest eigenvalues (g, values: descending) and their eigenvectors (g, i, v: array of k) of one symmetric
    matrix for each graph of nodes (g, i: long from 0, dense enough to be cut into chunks). times(b) gives products with b vectors.

    Steps end when every pair's residual is at most ``tolerance`` (for matrices of norm about 1). Graphs of fewer than k
    nodes get NaN for the rest. A basis has up to ``most`` blocks of k + ``extra`` vectors.
    """
    b = k + extra
    product = times(b)
    start = nodes.select("g", "i", F.array(*[F.xxhash64("i", F.lit(c)) / 2.0**63 for c in range(b)]).alias("q"))
    first = settled(packed(start, "q"), "start")

    def unit(gram: np.ndarray) -> np.ndarray:
        """What makes vectors of these inner products orthonormal. Those of no length, and what nearly lies within the span
        of others, become 0; lengths may differ widely."""
        length = np.sqrt(np.maximum(np.diag(gram), 0))
        over = np.where(length > NOTHING, 1 / np.where(length > NOTHING, length, 1), 0)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2 * over[:, None] * over)
        fine = values > ALIKE
        return over[:, None] * vectors * np.where(fine, 1 / np.sqrt(np.where(fine, values, 1)), 0)

    square = lambda x, m: x.reshape(-1, m)
    for _ in range(2):  # twice, as the first time leaves errors of the start's condition
        scale = summed(first, lambda n, q: square(q, b).T @ square(q, b), ("q",), lambda m: unit(m.reshape(b, b)))
        first = settled(mapped(first.join(common(scale, "m"), "g"), lambda n, q, m: (square(q, b) @ m.reshape(b, b),), ("q", "m"), ("q",)), "start")

    def with_products(rows: DataFrame, new: str) -> DataFrame:
        return rows.join(beside(packed(product(opened(rows, new, b)), "u").drop("nodes")), ["g", "chunk"], "left")

    rows = settled(with_products(first, "q").select("g", "chunk", "nodes", "q", F.col("u").alias("s")), "basis")
    m, newest = b, slice(0, b)
    for step in range(steps):
        if m + b > most * b or step == steps - 1:
            # the best vectors within the basis, and how far they are from eigenvectors
            def inner(n, q, s, m=m):
                return np.concatenate([square(q, m).T @ square(s, m), square(q, m).T @ square(q, m)])

            keep = min(2 * b, m)

            def solve(t, m=m, keep=keep):
                t = t.reshape(2 * m, m)
                t, live = (t[:m] + t[:m].T) / 2, np.diag(t[m:]) > 0.5
                values, vectors = np.linalg.eigh(t[np.ix_(live, live)])
                values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
                out = np.zeros((m + 1, keep))
                out[0] = np.nan
                out[0, : len(values)] = values
                out[1:][live, : len(values)] = vectors
                return out

            ritz = settled(summed(rows, inner, ("q", "s"), solve), "ritz")
            turned = lambda n, q, s, r, m=m, keep=keep: (square(q, m) @ r.reshape(m + 1, keep)[1:], square(s, m) @ r.reshape(m + 1, keep)[1:])
            before, rows = rows, settled(mapped(rows.join(common(ritz, "r"), "g"), turned, ("q", "s", "r"), ("q", "s")), "basis")
            dropped(before)
            m, newest = keep, slice(max(keep - b, 0), keep)  # residuals all lie in the span of those of the last
            off = lambda n, q, s, r, m=m: np.nansum((square(s, m) - square(q, m) * r[:m])[:, :k] ** 2, axis=0)
            left = summed(rows.join(common(ritz, "r"), "g"), off, ("q", "s", "r"), np.sqrt)
            if (left.agg(F.max(F.array_max("m"))).first()[0] or 0.0) <= tolerance or step == steps - 1:
                values = ritz.select("g", F.slice("m", 1, k).alias("values"))
                return values, opened(mapped(rows, lambda n, q, m=m: (square(q, m)[:, :k],), ("q",), ("v",)), "v", k)
        # the part of the newest products that is orthogonal to the basis
        def project(n, q, s, m=m, newest=newest):
            return square(q, m).T @ square(s, m)[:, newest]

        h = summed(rows, project, ("q", "s"), lambda x: x)

        def again(n, q, s, h, m=m, newest=newest):
            q, w = square(q, m), square(s, m)[:, newest]
            w = w - q @ h.reshape(m, b)
            return np.concatenate([q.T @ w, w.T @ w])

        def finish(x, m=m):
            x = x.reshape(m + b, b)
            return np.concatenate([x[:m], unit(x[m:] - x[:m].T @ x[:m])])

        def grow(n, q, s, h, c, m=m, newest=newest):
            q, c = square(q, m), c.reshape(m + b, b)
            return ((square(s, m)[:, newest] - q @ (h.reshape(m, b) + c[:m])) @ c[m:],)

        with_h = settled(rows.join(common(h, "h"), "g"), "projected")
        c = summed(with_h, again, ("q", "s", "h"), finish)
        new = settled(mapped(with_h.join(common(c, "c"), "g"), grow, ("q", "s", "h", "c"), ("new",)), "new")
        both = rows.join(beside(with_products(new, "new").drop("nodes")), ["g", "chunk"])
        wider = lambda n, q, s, v, u, m=m: (np.hstack([square(q, m), square(v, b)]), np.hstack([square(s, m), square(u, b)]))
        before, rows = rows, settled(mapped(both, wider, ("q", "s", "new", "u"), ("q", "s")), "basis")
        dropped(before, with_h, new)
        newest, m = slice(m, m + b), m + b
    raise AssertionError("steps end with a return")


def normalised_laplacian(edges: DataFrame, k: int, **how) -> tuple[DataFrame, DataFrame]:
    """The k smallest eigenvalues (g, values: ascending) and eigenvectors (g, i, v) of (D - W) v = lambda D v for the graphs of
    edges (g, i, j, w), from the largest of D^-1/2 W D^-1/2; a degree of 0 counts as 1, and v' D v is 1."""
    degree = settled(edges.groupBy("g", "i").agg(F.sum("w").alias("d")).select("g", "i", F.when(F.col("d") < 1e-12, 1.0).otherwise(F.col("d")).alias("d")), "degrees")
    scaled = edges.join(beside(degree), ["g", "i"]).join(beside(degree.select("g", F.col("i").alias("j"), F.col("d").alias("e"))), ["g", "j"])
    scaled = settled(scaled.select("g", "i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "scaled")
    values, vectors = largest(degree.select("g", "i"), lambda b: edge_product(scaled, b), k, **how)
    own = vectors.join(beside(degree), ["g", "i"]).select("g", "i", F.transform(F.arrays_zip("v", F.array_repeat(F.sqrt("d"), k).alias("r")), lambda x: x["v"] / x["r"]).alias("v"))
    return values.select("g", F.transform("values", lambda x: 1 - x).alias("values")), own


def pivots(vectors: DataFrame, k: int) -> list[tuple]:
    """Rows (key columns, v) whose vectors a QR decomposition with column pivoting takes first, in order: each the longest
    beside the span of those before; the first by key of equals."""
    keys = [c for c in vectors.columns if c != "v"]
    basis = np.zeros((0, k))
    out = []
    for _ in range(k):
        span = F.lit(0.0)
        for u in basis.tolist():
            dot = F.aggregate(F.arrays_zip("v", F.array(*map(F.lit, u)).alias("u")), F.lit(0.0), lambda s, x: s + x["v"] * x["u"])
            span = span + dot * dot
        long = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) - span
        row = vectors.select(F.struct(F.round(long, 9).alias("long"), *keys, "v").alias("r")).agg(F.max_by("r", F.struct(F.col("r.long"), *[-F.col(f"r.{c}") for c in keys])).alias("r")).first()["r"]
        v = np.array(row["v"], float)
        v = v - basis.T @ (basis @ v)
        norm = np.linalg.norm(v)
        if norm < 1e-9:
            break
        basis = np.vstack([basis, v / norm])
        out.append(tuple(row[c] for c in keys) + (list(row["v"]),))
    return out


def rbf_clusters(features: DataFrame, k: int, gamma: float = 1.0, **how) -> DataFrame:
    """g, i, cluster: spectral clustering of each row's features (g: one graph; i: long; x: array) under the kernel
    exp(-gamma |x - y|^2): rows fall to the pivot rows of the kernel's k leading vectors, after these are turned to be
    orthogonal (the polar factor of the pivots)."""
    rows = settled(features.select("g", "i", "x"), "features")
    ones = kernel_product(rows, gamma, 1)(rows.select("g", "i", F.array(F.lit(1.0)).alias("v")))
    degree = settled(ones.select("g", "i", F.sqrt(F.col("u")[0]).alias("root")), "degrees")

    def times(b: int) -> Product:
        kernel = kernel_product(rows, gamma, b)
        over = lambda name: F.transform(F.arrays_zip(F.col(name).alias("x"), F.array_repeat("root", b).alias("r")), lambda x: x["x"] / x["r"])
        return lambda v: kernel(v.join(beside(degree), ["g", "i"]).select("g", "i", over("v").alias("v"))).join(beside(degree), ["g", "i"]).select("g", "i", over("u").alias("u"))

    _, vectors = largest(degree.select("g", "i"), times, k, **how)
    scaled = settled(vectors.join(beside(degree), ["g", "i"]).select("g", "i", F.transform(F.arrays_zip("v", F.array_repeat("root", k).alias("r")), lambda x: x["v"] / x["r"]).alias("v")), "embedding")
    chosen = pivots(scaled.select("i", "v"), k)
    u, _, w = np.linalg.svd(np.array([v for _, v in chosen]).T)
    turn = (u[:, : len(chosen)] @ w[: len(chosen)]).T.tolist()
    near = F.array(*[F.abs(F.aggregate(F.arrays_zip("v", F.array(*map(F.lit, t)).alias("u")), F.lit(0.0), lambda s, x: s + x["v"] * x["u"])) for t in turn])
    return scaled.select("g", "i", (F.array_position(near, F.array_max(near)) - 1).cast("int").alias("cluster"))
