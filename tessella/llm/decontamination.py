"""Benchmark decontamination: a broadcast hash set of the n-grams of test items, looked up by every window of the texts.

Items and texts are lower-cased (A-Z) and cut into words, so that case, spacing and punctuation do not hide a
passage. A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. Windows
are looked up by hash; every hit is verified on the words themselves, so hashes decide nothing. What windows cover in a
text is marked; spans of marked words, or the documents that have any, can be removed.

Texts are never shuffled. What is broadcast is bounded: items are cut into chunks of at most ``CHUNK`` words (windows that
cross a cut belong to the chunk in which they begin), and where the chunks take more than ``BROADCAST_BYTES`` they
are dealt out to as many parts as that takes. Texts are scanned once a part, and marks add up from scan to scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import discard, stash
from tessella.llm.textbytes import Text, chunks, range_hashes, window_hashes

N = 10
#: Bytes of items that are broadcast at a time (for more than one chunk), and words of a chunk.
BROADCAST_BYTES, CHUNK = 1 << 23, 4096


def separators() -> np.ndarray:
    """True for the bytes between words: ASCII but for letters and digits."""
    table = np.ones(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return table


class Words:
    """The words of a slice of texts, lower-cased: where each starts in ``packed`` (bytes with one space after every word),
    its hash, and for each text its first word (one more than texts)."""

    def __init__(self, column: pa.Array):
        text = Text(column, separators())
        low = text.data
        low[(low >= 65) & (low <= 90)] += 32
        self.n, self.first, self.hashes = text.n, text.first, range_hashes(low, text.starts, text.ends)
        self.low, self.starts, self.ends = low, text.starts, text.ends
        self.to = np.zeros(len(text.starts) + 1, np.int64)
        np.cumsum(text.ends - text.starts + 1, out=self.to[1:])

    def packed(self) -> bytes:
        out = np.full(int(self.to[-1]), 32, np.uint8)
        inside = np.zeros(len(self.low) + 1, np.int8)
        inside[self.starts], inside[self.ends] = 1, -1
        letters = np.ones(len(out), bool)
        letters[self.to[1:] - 1] = False
        out[letters] = self.low[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return out.tobytes()


class Windows:
    """The distinct windows of some chunks: ``by_length`` has for each length the sorted hashes, a table of bits that most
    other hashes fail, and where in ``packed`` each window stands; ``owners`` the item numbers of each window."""

    def __init__(self, texts: list[str], items: list[int], begins: list[int], n: int):
        words = Words(pa.array(texts, pa.large_string()))
        self.packed, to, first = words.packed(), words.to, words.first
        found: dict[bytes, tuple[int, int, int, set[int]]] = {}
        for chunk, (item, stop) in enumerate(zip(items, begins, strict=True)):
            lo, hi = int(first[chunk]), int(first[chunk + 1])
            k = min(n, hi - lo)
            for at in range(lo, min(hi - k + 1, lo + stop)) if k else ():
                key = self.packed[to[at] : to[at + k] - 1]
                if key not in found:
                    found[key] = (k, int(to[at]), int(to[at + k]) - 1, set(), at)
                found[key][3].add(item)
        self.owners, self.by_length = [], {}
        for k in sorted({v[0] for v in found.values()}):
            mine = [v for v in found.values() if v[0] == k]
            all_of = window_hashes(words.hashes, k)
            hashes = all_of[[v[4] for v in mine]]
            order = np.argsort(hashes, kind="stable")
            bits = max(16, (8 * len(mine)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            number = len(self.owners)
            self.owners += [sorted(mine[i][3]) for i in order]
            where = np.array([mine[i][1:3] for i in order], np.int64)
            self.by_length[k] = (hashes[order], np.uint64(64 - bits), table, where, number)

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first words and numbers of the windows that occur in texts."""
        packed = None
        doc = np.repeat(np.arange(words.n), np.diff(words.first))
        for k, (known, shift, table, where, number) in self.by_length.items():
            hashes = window_hashes(words.hashes, k)
            at = np.flatnonzero(table[hashes >> shift])
            at = at[doc[at] == doc[at + k - 1]]
            lo, hi = (np.searchsorted(known, hashes[at], side) for side in ("left", "right"))
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            while len(at):  # once, but for windows of equal hash
                packed = words.packed() if packed is None else packed
                a, b = words.to[at].tolist(), (words.to[at + k] - 1).tolist()
                same = np.array([packed[i:j] == self.packed[x:y] for i, j, (x, y) in zip(a, b, where[lo].tolist(), strict=True)], bool)
                yield k, at[same], number + lo[same]
                at, lo, hi = at[lo + 1 < hi], lo[lo + 1 < hi] + 1, hi[lo + 1 < hi]


#: The columns that ``scan`` adds.
MARKS = {"hits": "array<struct<start: long, stop: long>>", "items": "array<string>", "n_words": "long"}


def scan(rows: DataFrame, windows: Broadcast, names: list[str | None], text_col: str, prefix: str) -> DataFrame:
    """rows with the columns of MARKS, their names after ``prefix``, to which the windows of one part add theirs."""
    schema = rows.schema if f"{prefix}hits" in rows.columns else rows.withColumns({f"{prefix}{c}": F.lit(None).cast(kind) for c, kind in MARKS.items()}).schema
    place, width = rows.columns.index(text_col), len(schema) - 3
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = windows.value
        for batch in batches:
            before = batch.num_columns > width
            for part in chunks(batch, text_col):
                words = Words(part.column(place).cast(pa.large_string()))
                total = int(words.first[-1])
                edge = np.zeros(total + 1, np.int32)
                owners: dict[int, set[str]] = {}
                for k, at, number in known.hits(words):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    doc = np.searchsorted(words.first, at, "right") - 1
                    for d, w in np.unique(np.stack([doc, number], 1), axis=0).tolist():
                        owners.setdefault(d, set()).update(names[i] for i in known.owners[w] if names[i] is not None)
                if before:
                    spans, of = part.column(width), pc.list_parent_indices(part.column(width))
                    base = words.first[np.asarray(of)]
                    np.add.at(edge, base + np.asarray(spans.flatten().field(0)), 1)
                    np.add.at(edge, base + np.asarray(spans.flatten().field(1)), -1)
                    for d, old in enumerate(part.column(width + 1).to_pylist()):
                        if old:
                            owners.setdefault(d, set()).update(old)
                marked = np.cumsum(edge[:-1]) > 0
                # runs of marked words end where texts do
                first = np.zeros(total + 1, bool)
                first[words.first] = True
                start = np.flatnonzero(marked & (first[:-1] | ~np.r_[False, marked][:-1]))
                stop = np.flatnonzero(marked & (first[1:] | ~np.r_[marked, False][1:])) + 1
                doc = np.searchsorted(words.first, start, "right") - 1
                offsets = np.searchsorted(doc, np.arange(words.n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(stop - words.first[doc])], fields=list(span))
                made = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    pa.array([sorted(owners.get(d, ()), key=str.encode) for d in range(words.n)], pa.list_(pa.string())),
                    pa.array(np.diff(words.first).astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def parts_of(items: DataFrame, id_col: str, text_col: str, n: int, limit: int) -> tuple[DataFrame, int]:
    """item (string), part, text, begins: the chunks of items (windows begin at a chunk's first ``begins`` words), and how
    many parts they are dealt out to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                words = Words(one.column(1).cast(pa.large_string()))
                packed, total = words.packed(), len(words.to) - 1
                for at in range(0, max(total - n + 1, min(total, 1)), CHUNK):
                    text = packed[words.to[at] : words.to[min(at + CHUNK + n - 1, total)] - 1].decode(errors="replace")
                    yield pa.RecordBatch.from_arrays([one.column(0), pa.array([text]), pa.array([CHUNK], pa.int32())], ["item", "text", "begins"])

    cut = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "item string, text string, begins int")
    cut = stash(cut, "items")
    size = F.sum(F.octet_length("text").cast("long") + 1)
    parts = 1
    while True:
        dealt = cut.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int"))
        found = dealt.groupBy("part").agg(size.alias("bytes"), F.count("*").alias("n"), F.countDistinct("text").alias("texts")).agg(F.sum("bytes").alias("all"), F.max(F.when(F.col("texts") > 1, F.col("bytes"))).alias("most")).first()
        if (found["most"] or 0) <= limit:
            dealt.stashed_at = cut.stashed_at
            return dealt, parts
        parts = max(2 * parts, -(-found["all"] // limit))


def contamination(docs: DataFrame, items: DataFrame, n: int = N, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES, prefix: str = "") -> DataFrame:
    """docs with three more columns: ``hits`` (spans of words, from 0, that windows of items cover; they do not touch),
    ``items`` (ids, as strings, of the items that have a window there, sorted by bytes) and ``n_words``.

    Null texts have no words. Items of null id mark words, but are not listed; items that repeat an id are one item;
    items without words have no windows. An empty table of items, or of documents, marks nothing. The three
    names come after ``prefix`` and must be new: Spark tells no case of letters apart.
    """
    taken = {f"{prefix}{c}".lower() for c in MARKS} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"docs have columns {sorted(taken)}")
    spark = docs.sparkSession
    dealt, parts = parts_of(items, item_id, item_text, n, limit)
    rows, before = docs, None
    for part in range(parts):
        chosen = dealt.where(F.col("part") == part).groupBy("text", "begins").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
        mine = sorted(chosen.toLocalIterator(), key=lambda r: r["text"])
        names: list[str | None] = [None, *sorted({x for r in mine for x in r["items"]})]
        number = {x: i for i, x in enumerate(names)}
        listed = [(r["text"], number[x], r["begins"]) for r in mine for x in [*r["items"], *[None] * bool(r["unnamed"])]]
        windows = spark.sparkContext.broadcast(Windows(*([x[c] for x in listed] for c in range(3)), n))
        rows = scan(rows, windows, names, text_col, prefix)
        if part + 1 < parts:  # marks of one scan are what the next begins with
            rows = stash(rows, "marked")
            if before is not None:
                discard(before)
            before = rows
    discard(dealt)
    return rows


def without_spans(text: str, hits: list[dict]) -> str:
    """A text without the words of its hits and what stands between them; the rest stays as it is."""
    words = Words(pa.array([text], pa.large_string()))
    data, out, at = text.encode(), [], 0
    for h in hits:
        out.append(data[at : int(words.starts[h["start"]])])
        at = int(words.ends[h["stop"] - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, whole: bool = False, text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that have a hit if ``whole``, else without the spans; other columns as they are, whatever their
    names."""
    prefix = "marks of " + " ".join(docs.columns) + " "
    found = contamination(docs, items, text_col=text_col, prefix=prefix, **how)
    if whole:
        return found.where(F.size(F.col(f"`{prefix}hits`")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column(place), batch.column(len(schema))
            kept = pa.array([without_spans(t.as_py(), h.as_py()) if len(h) else t.as_py() for t, h in zip(texts, hits, strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([kept if i == place else batch.column(i) for i in range(len(schema))], schema.fieldNames())

    return found.mapInArrow(run, schema)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 (of the item ids, comma-joined), contaminated: one row per row of docs."""
    found = contamination(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{how.get('text_col', 'text')}`").cast("string").alias("text")), items, **{k: v for k, v in how.items() if k != "text_col"})
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["stop"] - h["start"])
    return found.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


#: DuckDB SQL for doc_id, n_words, n_hit, n_items, items_sha256, contaminated over documents (of distinct ids) and benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}0-9]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}0-9]+') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, k, p, item_id FROM g JOIN i USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
