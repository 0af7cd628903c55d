"""Prefix tries of conversations: what a corpus of dialogues shares from its first turns on.

A conversation becomes the digests of its turns (role and text) in order; equal conversations become one sequence with a
count. Sequences are dealt out by the digest of their first turn, and in each group a grouped pandas function builds
tries of dictionaries, whose figures are summed from last node to first, without recursion. A first turn with
more turns below it than ``LIMIT`` is no group: what all its sequences begin with becomes a chain of nodes, and the
sequences are dealt out by the next turn after it, as often as it takes. Figures of chains come from the tops of the
groups below them, from the deepest level up.

A conversation is one row, of 36 bytes a turn. The conversations that end at a node are hashed in order of their ids by way
of texts of up to ``CHUNK`` ids, so that equal conversations, however many, meet as few rows.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.storage import discard, stash

#: Turns of the sequences of a group (for more than one sequence), and groups that a table is cut into at least, if it has
#: ``LEAST`` turns for each.
LIMIT, GROUPS, LEAST = 50_000, 64, 500
#: Ids hashed together.
CHUNK = 1000
#: Characters of a turn's digest.
WIDTH = 32
NOBODY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns (array of digest and words, in order): one row per conversation.

    Turns go by number, null first, those of one number by digest; null role or text is empty. Words are runs of other
    characters than ASCII white space. Rows of null conversation take no part.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    number = F.col(f"`{turn_col}`")
    row = F.struct(number.isNotNull().alias("known"), number.alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    own = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv"), row.alias("turn"))
    return own.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_starts(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % every (all if fewer, none if absent), where h is
    the CRC-32 of the id c as text modulo ``most``."""
    convs = stash(convs, "conversations")
    heads = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumns({"base": F.col("conv") - F.col("conv") % every, "h": h})
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), rest).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """path (digests, joined), words, depth, n, conv, ends: each distinct sequence of turns with the number, least id and
    hash of ids of its conversations."""
    rows = convs.select("conv", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = stash(rows.select(F.md5("path").alias("key"), "*"), "sequences")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, conv = np.asarray(batch.column(0).dictionary_encode().indices), np.asarray(batch.column(1))
            new = np.r_[True, key[1:] != key[:-1]]
            run = np.flatnonzero(new)
            cut = np.flatnonzero(new | ((np.arange(len(key)) - run[np.cumsum(new) - 1]) % CHUNK == 0)).tolist()
            ids = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(cut, [*cut[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cut)), pa.array(conv[cut]), pa.array(ids)], ["key", "conv", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in done], pa.string()) for c in (0, 1)], ["key", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["key", "ends"])

    narrow = rows.select("key", "conv").repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv")
    ids = narrow.mapInArrow(chunked, "key string, conv long, ids string")
    ends = ids.repartition(n, "key").sortWithinPartitions("key", "conv").mapInArrow(hashed, "key string, ends string")
    alike = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    return alike.join(ends, "key").select("path", "words", F.size("words").alias("depth"), "n", "conv", "ends")


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some tries: each sequence (path, words, depth, n, conv, ends) from depth ``top`` on. Top nodes have their
    path, the others the least id of their parent."""
    tops: dict[str, int] = {}
    children: list[dict[str, int]] = []
    parent, at_depth, words, n, conv, ends, path = [], [], [], [], [], [], []
    for r in rows.itertuples(index=False):
        at = -1
        for level in range(r.top, r.depth + 1):
            known, name = (tops, r.path[: WIDTH * level]) if at < 0 else (children[at], r.path[WIDTH * (level - 1) : WIDTH * level])
            to = known.get(name)
            if to is None:
                to = known[name] = len(parent)
                children.append({})
                for column, value in zip((parent, at_depth, words, n, conv, ends, path), (at, level, int(r.words[level - 1]), 0, r.conv, NOBODY, name if at < 0 else None), strict=True):
                    column.append(value)
            n[to] += r.n
            conv[to] = min(conv[to], r.conv)
            at = to
        ends[at] = r.ends
    leaves, saved = [int(not c) for c in children], [(k - 1) * w for k, w in zip(n, words, strict=True)]
    for at in range(len(parent) - 1, -1, -1):  # children have larger numbers than their parents
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    above = pd.array([conv[p] if p >= 0 else None for p in parent], "Int64")
    return pd.DataFrame({"path": pd.array(path, "object"), "conv_id": conv, "depth": at_depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


FIGURES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """How many digests two paths begin with alike."""
    return pd.Series([len(os.path.commonprefix(both)) // WIDTH for both in zip(low, high, strict=True)], dtype="int32")


def upper(path: str = "path", top: str = "top"):
    """The path of the node above a top node."""
    return F.substring(path, F.lit(1), WIDTH * (F.col(top) - 1))


def dealt(rows: DataFrame, limit: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Sequences with the depth ``top`` at which their group's trie begins, and for each round the chains (path: to
    the last node; top, last: depths; words) of large tries with the sequences that end at the last node of one."""
    common, groups, chains = F.pandas_udf(shared, "int"), [], []
    rows = rows.withColumn("top", F.lit(1))
    while True:
        keyed = rows.withColumn("key", F.substring("path", F.lit(1), WIDTH * F.col("top")))
        large = stash(keyed.groupBy("key").agg(F.sum(F.col("depth") - F.col("top") + 1).alias("size")).where(F.col("size") > limit).select("key"), "large")
        if not large.limit(1).count():
            discard(large)
            break
        ends = keyed.join(large, "key").groupBy("key", "top").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("words", "path").alias("words")).withColumn("last", common("low", "high"))
        chain = stash(ends.select("key", F.substring("low", F.lit(1), WIDTH * F.col("last")).alias("path"), "top", "last", F.slice("words", F.col("top"), F.col("last") - F.col("top") + 1).alias("words")), "chains")
        marked = stash(keyed.join(chain.select("key", "last"), "key", "left").drop("key"), "marked")
        groups.append(marked.where("last is null").drop("last"))
        chains.append((chain.drop("key"), marked.where("depth = last").select("path", "n", "conv", "ends")))
        rows = marked.where("depth > last").withColumn("top", F.col("last") + 1).drop("last")
        discard(large)
    for more in groups:
        rows = rows.unionByName(more)
    return rows, chains


def trie(convs: DataFrame, limit: int = LIMIT, groups: int = GROUPS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per distinct
    sequence of first turns, from the empty one on, of the conversations (conv, turns: see ``conversations``).

    conv_id: the least id of those that begin so; ends_sha256: of the ids of those that end so, ascending,
    comma-joined; saved_tokens: over a node and all below it, words of its last text times the conversations less
    one. Of rows that repeat an id each counts. Without conversations there is no node.
    """
    spark = convs.sparkSession
    all_of = stash(sequences(convs), "distinct")
    total = all_of.agg(F.sum("depth")).first()[0]
    if total is None:
        return spark.createDataFrame([], FIGURES)
    limit = min(limit, max(LEAST, total // groups))
    rows, chains = dealt(all_of.where("depth > 0"), limit)
    chains.insert(0, (spark.range(1).select(F.lit("").alias("path"), F.lit(0).alias("top"), F.lit(0).alias("last"), F.array(F.lit(0)).alias("words")), all_of.where("depth = 0").select("path", "n", "conv", "ends")))
    key = F.substring("path", F.lit(1), WIDTH * F.col("top"))
    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, 2 * total // limit))).alias("bucket")
    built = rows.select(bucket, "*").groupBy("bucket").applyInPandas(build, f"path string, {FIGURES}")
    built = stash(built, "tries")
    tops = built.where("path is not null").select("path", F.col("depth").alias("top"), F.col("conv_id").alias("conv"), F.col("n_convs").alias("n"), "n_leaves", "saved_tokens")
    ready, made = tops, []
    for chain, ended in reversed(chains):
        below = ready.groupBy(upper().alias("path")).agg(F.min("conv").alias("c"), F.sum("n").alias("k"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        joined = chain.join(below, "path", "left").join(ended, "path", "left")
        none = F.lit(0).cast("long")
        joined = joined.select("path", "top", "last", "words", F.least("conv", "c").alias("conv"), (F.coalesce("n", none) + F.coalesce("k", none)).alias("n"), F.coalesce("n_children", none).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("below", none).alias("below"), F.coalesce("ends", F.lit(NOBODY)).alias("ends"))
        node = joined.select("*", F.posexplode("words").alias("step", "own")).withColumn("depth", F.col("top") + F.col("step"))
        deeper = F.sum((F.col("n") - 1) * F.col("own")).over(W.partitionBy("path").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0))
        at_end = F.col("depth") == F.col("last")
        node = node.select("path", "top", "depth", "conv", "n", F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + deeper).alias("saved_tokens"), F.when(at_end, F.col("ends")).otherwise(NOBODY).alias("ends"))
        made.append(stash(node, "nodes"))
        above = made[-1].where("depth = top").select("path", "top", "conv", "n", "n_leaves", "saved_tokens")
        ready = tops.unionByName(above)
    chained = made[0]
    for more in made[1:]:
        chained = chained.unionByName(more)
    named = chained.select("path", F.col("conv").alias("parent")).distinct()
    columns = [F.col(c).cast("long").alias(a) for c, a in (("conv", "conv_id"), ("depth", "depth"), ("parent_conv_id", "parent_conv_id"), ("n", "n_convs"), ("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved_tokens", "saved_tokens"))]
    inner = chained.where("depth > top").withColumn("parent_conv_id", F.col("conv"))
    first = chained.where("depth = top and depth > 0").withColumn("path", upper()).join(named, "path").withColumn("parent_conv_id", F.col("parent"))
    root = chained.where("depth = 0").withColumn("parent_conv_id", F.lit(None))
    out = [t.select(*columns, F.col("ends").alias("ends_sha256")) for t in (root, inner, first)]
    names = out[0].columns
    hung = built.where("path is not null").withColumn("path", upper(top="depth")).join(named, "path").withColumn("parent_conv_id", F.col("parent"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(hung.select(*names)).unionByName(built.where("path is null").select(*names))


#: DuckDB SQL for the nodes of ``trie`` over the rebuilt conversations (``with_shared_starts``).
ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda p: ascii(substr(conv_id::VARCHAR, p, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda r, k: xor(r // 2, (r % 2) * 3988292384))), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i AS place, md5(strlen(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, i AS place, md5(strlen(role) || ':' || role || text), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM c JOIN t USING (conv_id) WHERE i > h),
s AS (SELECT conv_id, list(key ORDER BY place) AS keys, list(words ORDER BY place) AS words FROM r GROUP BY conv_id),
m AS (SELECT conv_id, coalesce(keys, []) AS keys, coalesce(words, []) AS words FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, d, keys[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(keys) AS ends FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM m)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:a] AS path, sum(own) AS saved, sum((n_children = 0)::INT) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, a.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN f a ON f.d > 0 AND a.path = f.path[1:f.d - 1]
"""
