"""Ranked lexical search with integer scores: documents reordered by recursive graph bisection, clusters visited by bound.

Bisection splits documents into halves so that each term's documents fall into few parts: with d of a half's n documents
a term costs d log2(n / (d + 1)), and pairs of documents are swapped between the halves while that lowers the sum. The top
levels are fitted on a bounded sample of texts; every document goes down these halves by what its terms cost in either.
A leaf with more documents or bytes than a task should hold is dealt out evenly to several groups. Within each group
the documents themselves are bisected, down to clusters of ``CLUSTER`` or fewer, one row of the index each: postings, and
for each term the highest value that a document of the cluster has for it.

A search takes queries in blocks of bounded size. A query's bound in a cluster is the sum of its terms' weights times
their highest values there. Clusters of high bound are visited first; what has been found gives the score that the
k-th document has at least, and only clusters whose bound reaches it are visited after that. A cluster that is
left out has no document that could enter the list, nor one that could tie for its last place. Scores are sums of whole
numbers, in doubles where all stay under 2**53, else in 64-bit integers. The index keeps the documents' own ids, so that
ties go by these and not by the new order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.decontamination import Words
from tessella.llm.storage import discard, stash
from tessella.llm.textbytes import chunks

#: Texts that the top levels are fitted on (about), the longest of them in bytes, and texts of a leaf.
SAMPLE, SAMPLE_BYTES, LEAF = 4096, 4096, 64
#: Documents and bytes of text of a group (about), documents of a cluster, rounds of swaps at a level.
GROUP, GROUP_BYTES, CLUSTER, ROUNDS = 2048, 1 << 21, 256, 5
#: Bytes (about) and number of clusters that a task holds while it writes or reads them.
ROW_GROUP, ROWS, BATCH = 1 << 23, 32, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts of a batch while the index is built.
TEXTS = 512
#: Queries, and terms of queries, that are searched together (about).
BLOCK, BLOCK_TERMS = 256, 1 << 16
#: Clusters are visited from this share of a query's highest bound on, round by round.
SHARES = (0.9, 0.6, 0.0)
#: Stands for null ids, which come last among ties.
NO_ID = (1 << 63) - 1


class Index(NamedTuple):
    clusters: DataFrame
    n_docs: int
    n_terms: int


def terms_of(words: Words) -> tuple[np.ndarray, pa.Array]:
    """The term of each word, as numbers into the distinct terms."""
    inside = np.zeros(len(words.low) + 1, np.int8)
    inside[words.starts], inside[words.ends] = 1, -1
    data = words.low[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    coded = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def cost(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    return left * np.log2(n_left / (left + 1)) + right * np.log2(n_right / (right + 1))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, leaf: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The part (numbered in order) of each of n documents, from distinct pairs (doc, term), with parts of ``leaf`` documents
    or fewer; and for each level the part, term and cost in the left half less that in the right half of the
    terms that several documents of a part have."""
    part, levels = np.zeros(n, np.int64), []
    n_terms = int(term.max()) + 1 if len(term) else 1
    while n and np.bincount(part).max() > leaf:
        size = np.bincount(part)
        first = np.cumsum(size) - size
        n_right = size // 2
        n_left = size - n_right
        side = np.zeros(n, np.int8)
        side[np.argsort(part, kind="stable")] = np.arange(n) - np.repeat(first, size) >= np.repeat(n_left, size)
        pair, of, count = np.unique(part[doc] * n_terms + term, return_inverse=True, return_counts=True)
        several = count > 1
        number = np.cumsum(several) - 1
        keep = several[of]
        d, p = doc[keep], number[of[keep]]
        pair, count = pair[several], count[several]
        nl, nr = n_left[pair // n_terms].astype(float), n_right[pair // n_terms].astype(float)
        across = np.arange(n_right.sum()) - np.repeat(np.cumsum(n_right) - n_right, n_right)
        for _ in range(rounds):
            right = np.bincount(p, side[d], len(pair))
            left = count - right
            now = cost(left, right, nl, nr)
            leave_left, leave_right = now - cost(np.maximum(left - 1, 0), right + 1, nl, nr), now - cost(left + 1, np.maximum(right - 1, 0), nl, nr)
            gain = np.bincount(d, np.where(side[d] == 0, leave_left[p], leave_right[p]), n)
            order = np.lexsort((-gain, side, part))
            a, b = order[np.repeat(first, n_right) + across], order[np.repeat(first + n_left, n_right) + across]
            swap = gain[a] + gain[b] > 1e-9
            if not swap.any():
                break
            side[a[swap]], side[b[swap]] = 1, 0
        right = np.bincount(p, side[d], len(pair))
        levels.append((pair // n_terms, pair % n_terms, np.log2(nl / (count - right + 1)) - np.log2(nr / (right + 1))))
        part = 2 * part + side
    return part, levels


def fitted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The halves of the top levels, from a sample of distinct texts: sorted hashes of terms, for each term and half of each
    level what it costs more in the left one, and the number of levels."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(words.hashes[i:j]).view(np.int64) for i, j in zip(words.first[:-1], words.first[1:], strict=True)], pa.list_(pa.int64()))], ["terms"])

    some = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & pick).select("text").distinct()
    rows = [np.array(r.terms, np.int64).view(np.uint64) for r in some.mapInArrow(run, "terms array<long>").limit(2 * SAMPLE).collect()]
    rows.sort(key=lambda t: t[:1].tolist())
    doc = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    names, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]), return_inverse=True)
    _, levels = bisected(doc, term, len(rows), LEAF, 4 * ROUNDS)
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *[t for _, t, _ in levels]]))
    weights = np.zeros((len(known), (1 << len(levels)) - 1), np.float32)
    for depth, (part, t, weight) in enumerate(levels):
        weights[np.searchsorted(known, t), (1 << depth) - 1 + part] = weight
    return names[known], weights, len(levels)


def leaves(words: Words, names: np.ndarray, weights: np.ndarray, depth: int) -> np.ndarray:
    """The leaf that each text of a slice goes down to."""
    node = np.zeros(words.n, np.int64)
    if not len(names):
        return node
    doc = np.repeat(np.arange(words.n), np.diff(words.first))
    at = np.minimum(np.searchsorted(names, words.hashes), len(names) - 1)
    known = names[at] == words.hashes
    doc, at = doc[known], at[known]
    for level in range(depth):
        node = 2 * node + (np.bincount(doc, weights[at, (1 << level) - 1 + node[doc]], words.n) > 0)
    return node


CLUSTERS = "cluster long, ids array<long>, lengths array<long>, terms array<string>, counts array<int>, highest array<long>, places array<int>, tfs array<int>"


def values(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurring term adds to a document's score, before its weight."""
    m = 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents that have a term: whole texts, every row a document of its own."""
    with few_rows(docs.sparkSession, TEXTS):
        return built(docs, id_col, text_col)


def built(docs: DataFrame, id_col: str, text_col: str) -> Index:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(rows))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << model.value[2]), np.int64)
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(0).cast(pa.large_string()))
                n = np.diff(words.first)
                leaf = leaves(words, *model.value)
                for row, weight in zip(total, ((n > 0), n, np.where(n > 0, np.asarray(pc.binary_length(part.column(0))), 0)), strict=True):
                    np.add.at(row, leaf, weight)
        leaf = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(leaf), *[pa.array(row[leaf]) for row in total]], ["leaf", "docs", "terms", "bytes"])

    found = rows.select("text").mapInArrow(sizes, "leaf long, docs long, terms long, bytes long").groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("docs", "terms", "bytes")]).collect()
    n_docs, n_terms = sum(r.docs for r in found), sum(r.terms for r in found)
    groups, begin = np.zeros(1 << model.value[2], np.int64), np.zeros(1 << model.value[2], np.int64)
    for r in sorted(found, key=lambda r: r.leaf):
        begin[r.leaf], groups[r.leaf] = groups.sum(), max(-(-r.docs // GROUP), -(-r.bytes // GROUP_BYTES))
    if not n_docs:
        return Index(spark.createDataFrame([], CLUSTERS), 0, 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.full(len(groups), TaskContext.get().partitionId(), np.int64)
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(1).cast(pa.large_string()))
                fine = np.flatnonzero(np.diff(words.first))
                leaf = leaves(words, *model.value)[fine]
                order = np.argsort(leaf, kind="stable")
                size = np.bincount(leaf, minlength=len(groups))
                rank = np.empty(len(fine), np.int64)
                rank[order] = np.arange(len(fine)) - np.repeat(np.cumsum(size) - size, size)
                group = begin[leaf] + (turn[leaf] + rank) % np.maximum(groups[leaf], 1)
                turn += size
                kept = part.take(pa.array(fine))
                yield pa.RecordBatch.from_arrays([pa.array(group), *kept.columns], ["group", "id", "text"])

    def clusters(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        ids = np.asarray(pc.fill_null(table["id"], NO_ID).combine_chunks())
        words = Words(table["text"].combine_chunks().cast(pa.large_string()))
        code, names = terms_of(words)
        n, length = len(ids), np.diff(words.first).astype(np.int64)
        both, tf = np.unique(np.repeat(np.arange(n), length) * len(names) + code, return_counts=True)
        doc, term = both // len(names), both % len(names)
        part, _ = bisected(doc, term, n, CLUSTER)
        place = np.empty(n, np.int64)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part)
        place[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        value = values(tf, length[doc], n_docs, n_terms)
        by = np.lexsort((place[doc], term, part[doc]))
        doc, term, tf, value = doc[by], term[by], tf[by], value[by]
        edge = np.searchsorted(part[doc], np.arange(len(size) + 1))
        out = []
        for c, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            mine = order[np.cumsum(size)[c] - size[c] : np.cumsum(size)[c]]
            start = np.flatnonzero(np.diff(term[i:j], prepend=-1))
            number = (key[0].as_py() << 20) + c
            out.append((number, ids[mine], length[mine], names.take(pa.array(term[i:j][start])), np.diff(start, append=j - i), np.maximum.reduceat(value[i:j], start), place[doc[i:j]], tf[i:j]))
        kinds = [pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
        columns = [pa.array([x[0] for x in out], pa.int64())]
        for i, kind in enumerate(kinds[1:], 1):
            parts = [x[i] if isinstance(x[i], pa.Array) else pa.array(x[i]) for x in out]
            flat = pa.concat_arrays([p.cast(kind.value_type) for p in parts])
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), flat))
        return pa.table(columns, [c.split()[0] for c in CLUSTERS.split(", ")])

    dealt = rows.mapInArrow(deal, "group long, id long, text string")
    return Index(stash(dealt.groupBy("group").applyInArrow(clusters, CLUSTERS), "index", **{"parquet.block.size": str(ROW_GROUP)}), n_docs, n_terms)


def queries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, terms: the distinct terms of all texts of each id."""
    term = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(1).cast(pa.large_string()))
                code, names = terms_of(words)
                own = [names.take(pa.array(np.unique(code[i:j]))).cast(pa.string()).to_pylist() for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, term)], ["item", "terms"])

    rows = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item long, terms array<string>").groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


@contextmanager
def few_rows(spark: SparkSession, n: int = ROWS):
    """Arrow batches of n rows meanwhile: a text can be a large row, and a cluster is one."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, n)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def lists(column: pa.Array) -> Iterator[pa.Array]:
    """The values of each list of a column."""
    for i in range(len(column)):
        yield column.slice(i, 1).flatten()


def searched(index: Index, block: list, k: int) -> tuple[DataFrame, dict[str, int]]:
    """item, id, score: the k best documents, and ties of the last, for the queries (item, terms) of a block; and how many pairs
    of queries and clusters there are, and were visited."""
    spark, n_docs, n_terms = index.clusters.sparkSession, index.n_docs, index.n_terms
    share = spark.sparkContext.broadcast
    block = sorted(block, key=lambda r: r["item"])
    vocabulary = sorted({t for r in block for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = np.array([r["item"] for r in block], np.int64)
    query = np.repeat(np.arange(len(block)), [len(r["terms"]) for r in block])
    term = np.array([number[t] for r in block for t in r["terms"]], np.int64)
    words = share(pa.array(vocabulary, pa.string()))

    def matched(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the query terms that a cluster has, and where in its list."""
        at = pc.index_in(terms.cast(pa.string()), value_set=words.value)
        where = np.flatnonzero(np.asarray(at.is_valid()))
        return np.asarray(at.take(pa.array(where))).astype(np.int64), where

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.value), np.int64)
        for batch in batches:
            for terms, counts in zip(lists(batch.column(0)), lists(batch.column(1)), strict=True):
                t, where = matched(terms)
                total[t] += np.asarray(counts)[where]
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], ["term", "df"])

    df = np.zeros(len(vocabulary), np.int64)
    for r in index.clusters.select("terms", "counts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)[term]
    asks = share((query, term, weight))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, term, weight = asks.value
        for batch in batches:
            for cluster, terms, highest in zip(batch.column(0).to_pylist(), lists(batch.column(1)), lists(batch.column(2)), strict=True):
                top = np.zeros(len(words.value), np.int64)
                t, where = matched(terms)
                top[t] = np.asarray(highest)[where]
                bound = np.zeros(len(asked), np.int64)
                np.add.at(bound, query, weight * top[term])
                q = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), cluster)), pa.array(q), pa.array(bound[q])], ["cluster", "query", "bound"])

    all_bounds = stash(index.clusters.select("cluster", "terms", "highest").mapInArrow(bounds, "cluster long, query long, bound long"), "bounds")
    top = np.zeros(len(asked), np.int64)
    for r in all_bounds.groupBy("query").agg(F.max("bound").alias("bound")).collect():
        top[r["query"]] = r["bound"]
    least, high = np.ones(len(asked), np.int64), top + 1
    best, visited = None, 0
    for part in SHARES:
        low = np.maximum(least, np.ceil(part * top).astype(np.int64))
        if not (low < high).any():
            continue
        window = F.broadcast(spark.createDataFrame([(int(q), int(low[q]), int(high[q])) for q in np.flatnonzero(low < high)], "query long, low long, high long"))  # a row a query of the block
        chosen = stash(all_bounds.join(window, "query").where("bound >= low and bound < high").groupBy("cluster").agg(F.collect_list("query").alias("asks")), "chosen")
        visited += chosen.agg(F.sum(F.size("asks"))).first()[0] or 0
        floor = share(least)

        def score(batches: Iterator[pa.RecordBatch], floor=floor) -> Iterator[pa.RecordBatch]:
            query, term, weight = asks.value
            exact = np.bincount(query, weight, len(asked)).max(initial=0) * 1e6 < 2.0**53
            kind = np.float64 if exact else np.int64
            found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for ids, lengths, terms, counts, places, tfs, who in zip(*(lists(batch.column(i)) for i in range(7)), strict=True):
                    ids, lengths, who = np.asarray(ids), np.asarray(lengths), np.sort(np.asarray(who))
                    t, where = matched(terms)
                    row = np.full(len(words.value), -1)
                    row[t] = np.arange(len(t))
                    size = np.asarray(counts).astype(np.int64)
                    start = np.cumsum(size) - size
                    size, start = size[where], start[where]
                    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    doc = np.asarray(places)[at]
                    worth = np.zeros((len(t), len(ids)), kind)
                    worth[np.repeat(np.arange(len(t)), size), doc] = values(np.asarray(tfs)[at].astype(np.int64), lengths[doc], n_docs, n_terms)
                    wanted = np.zeros((len(who), len(t)), kind)
                    mine = np.full(len(asked), -1)
                    mine[who] = np.arange(len(who))
                    used = (mine[query] >= 0) & (row[term] >= 0)
                    wanted[mine[query[used]], row[term[used]]] = weight[used]
                    scores = (wanted @ worth).astype(np.int64)
                    limit = floor.value[who]
                    if len(ids) > k:
                        limit = np.maximum(limit, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                    q, d = np.nonzero(scores >= limit[:, None])
                    cut = np.searchsorted(q, np.arange(len(who) + 1))
                    for n, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                        if j > i:
                            old = found.get(int(who[n]), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            s, x = np.r_[old[0], scores[n, d[i:j]]], np.r_[old[1], ids[d[i:j]]]
                            first = np.lexsort((x, -s))[:k]
                            found[int(who[n])] = s[first], x[first]
            for q, (s, x) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(x), pa.array(s)], ["query", "id", "score"])

        visit = index.clusters.drop("highest").join(chosen, "cluster").select("ids", "lengths", "terms", "counts", "places", "tfs", "asks")
        new = visit.mapInArrow(score, "query long, id long, score long")
        before = best
        order = W.partitionBy("query").orderBy(F.desc("score"), "id")
        best = stash((new if best is None else new.unionByName(best)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        discard(chosen, *[before] * (before is not None))
        for r in best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect():
            least[r["query"]] = max(r["score"], 1)
        high = np.minimum(high, low)
    pairs = all_bounds.count()
    discard(all_bounds)
    if best is None:
        return spark.createDataFrame([], "item long, rank int, id long, score long"), {"pairs": 0, "visited": 0}
    names = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(asked)], "query long, item long"))  # the same
    order = W.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = best.join(names, "query").select("item", F.row_number().over(order).alias("rank"), F.when(F.col("id") < NO_ID, F.col("id")).alias("id"), "score")
    return ranked, {"pairs": pairs, "visited": visited}


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank (from 1), id, score: the k documents of highest score above 0 for each query, ties to the smaller id, null
    ids last.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case; null texts have none. A query's
    terms count once. Queries of one id are one query, those of null id take no part.
    """
    asked = stash(queries_of(items, id_col, text_col), "queries")
    n, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if not n or not index.n_docs:
        discard(asked)
        return items.sparkSession.createDataFrame([], "item long, rank int, id long, score long")
    blocks = max(-(-n // BLOCK), -(-terms // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if block:
            with few_rows(asked.sparkSession):
                found, _ = searched(index, block, k)
            out = found if out is None else out.unionByName(found)
    discard(asked)
    return out


#: DuckDB SQL for item_id, rank, doc_id, score over documents and benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}0-9]+') AS t FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}0-9]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT row, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, c WHERE len(t) > 0),
v AS (SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS v FROM p JOIN w USING (term) JOIN m USING (row)),
s AS (SELECT item_id, row, sum(v)::BIGINT AS score FROM b JOIN v USING (term) GROUP BY item_id, row),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
