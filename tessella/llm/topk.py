"""Exact top-k inner products: tiles of queries against shards of the table.

Vectors are packed into matrices, one row a shard of up to ``SHARD`` candidates or a tile of up to ``TILE``
queries, fewer where vectors are long. Shards and tiles are taken in groups of ``GRID``, and each group of shards
meets each group of tiles once, as a cogroup, so either table is sent as often as the other has groups. A matrix
product with partial selection leaves each query's k best of a shard, and the best of a group's shards are
merged at once. Lists of ``FAN_IN`` groups at a time are merged, level by level, until each query has one.
Products are exact integers: in double arithmetic where all sums stay under 2**53, else in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import stash

SHARD, TILE, GRID, FAN_IN = 8192, 1024, 8, 64
#: Bytes of a shard's or a tile's matrix, at most (for more than one row).
MATRIX_BYTES = 1 << 23
#: Scores end here; what lies beyond counts as this much.
HIGHEST = (1 << 63) - 1
#: The score of no candidate.
NONE = -(1 << 63)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k highest (score, id) of each row of scores, ties to the smaller id, without the row's own id; rows
    with fewer end in scores of ``NONE``."""
    scores = np.where(ids == own[:, None], NONE, scores)
    top, names = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64)
    least = max(scores.shape[1] - k, 0)
    row, at = np.nonzero(scores >= np.partition(scores, least, axis=1)[:, least, None])
    order = np.lexsort((ids[at], ~scores[row, at], row))
    row, at = row[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, at, rank = row[rank < k], at[rank < k], rank[rank < k]
    top[row, rank], names[row, rank] = scores[row, at], ids[at]
    return top, names


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists for each row."""
    scores, ids = (np.concatenate(x, axis=1) for x in zip(one, other, strict=True))
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """part, ids, vectors (binary, little-endian doubles): one row per part of up to about ``size`` rows."""
    parts = max(1, -(-rows.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids.append(np.asarray(batch.column(0), "<i8").tobytes())
            vectors.append(np.asarray(batch.column(1).flatten(), "<f8").tobytes())
        if ids and any(ids):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b"".join(ids)]), pa.array([b"".join(vectors)])], ["part", "ids", "vectors"])

    return stash(rows.repartition(parts).mapInArrow(run, "part int, ids binary, vectors binary"), name)


def usable(vector: Column) -> Column:
    """False for vectors that are null or empty, or hold a null, a NaN or an infinity."""
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """query_id, rank (from 1), id, score (long): the k rows of highest integer inner product for each query.

    Components x become floor(scale * x) with x as double; a vector in which that is infinite takes no part. Scores
    beyond the range of a long count as its ends, and as ties. Rows with null ids, and those whose vector is null, empty,
    or holds a null or non-finite component, take no part. Vectors are of one length: shorter ones count
    as if ended by zeros. A query's candidates are all rows of another id, repeated ones as often as they
    stand; ties go to the smaller id. Of several queries of one id the smallest vector asks.
    """
    scaled = F.transform(F.col(f"`{vector_col}`"), lambda x: F.lit(scale) * x.cast("double"))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # doubles from 2**53 on are whole, and more than floor() can return
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    shard, tile = (max(1, min(n, MATRIX_BYTES // (8 * max(width, 1)))) for n in (shard, tile))
    rows = rows.select("id", F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))).alias("v"), "asks")
    shards = packed(rows.select("id", "v"), shard, "shards")
    tiles = packed(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), tile, "tiles")
    n_shards, n_tiles = (t.agg(F.max("part")).first()[0] for t in (shards, tiles))
    if n_tiles is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    numbered = lambda df, own, other, n: df.select(F.floor(F.col("part") / GRID).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n // GRID))).alias(other), "part", "ids", "vectors")
    left, right = numbered(shards, "shard", "tile", n_tiles), numbered(tiles, "tile", "shard", n_shards)
    schema = pa.schema([("query_id", pa.int64()), ("group", pa.int32()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])

    def matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, vectors in sorted(zip(table["ids"].to_pylist(), table["vectors"].to_pylist(), strict=True)):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, width)

    def multiply(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asking = list(matrices(queries))
        tops = [(np.full((len(own), k), NONE), np.zeros((len(own), k), np.int64)) for own, _ in asking]
        for ids, a in matrices(candidates):
            for (own, q), (top, names) in zip(asking, tops, strict=True):
                b = a
                if float(np.abs(a).max()) * float(np.abs(q).max()) * width >= 2.0**53:
                    whole = np.frompyfunc(int, 1, 1)
                    b, q = whole(a), whole(q)
                for i in range(0, len(q), 128):
                    scores = q[i : i + 128] @ b.T
                    if scores.dtype == object:
                        scores = np.minimum(np.maximum(scores, -HIGHEST), HIGHEST)
                    some = slice(i, i + 128)
                    top[some], names[some] = merged((top[some], names[some]), best(scores.astype(np.int64), ids, own[some], k), k)
        top, names = (np.concatenate([np.zeros((0, k), np.int64), *[t[c] for t in tops]]) for c in (0, 1))
        found = top > NONE
        own = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in asking]])[found.any(1)]
        offsets = np.r_[0, np.cumsum(found.sum(1)[found.any(1)])]
        hits = pa.StructArray.from_arrays([pa.array(-top[found]), pa.array(names[found])], ["score", "id"])
        return pa.table([pa.array(own), pa.array(np.full(len(own), key[0].as_py()), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)], schema=schema)

    pairs = left.groupBy("shard", "tile").cogroup(right.groupBy("shard", "tile"))
    lists = pairs.applyInArrow(multiply, "query_id long, group int, best array<struct<score: long, id: long>>")
    groups = n_shards // GRID + 1
    while True:
        groups = -(-groups // FAN_IN)
        lists = lists.groupBy("query_id", F.floor(F.col("group") / FAN_IN).cast("int").alias("group")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if groups <= 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.score")).alias("score"))


#: DuckDB SQL for query_id, rank, vec_id, score over embeddings.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
