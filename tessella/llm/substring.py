"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is factored, left to right and greedily, relative to text of documents with smaller ids: where a
seed of ``window`` words stands in a reference block the match is extended word by word, on the words
themselves, as far as it goes, and is a factor. The parse then goes on ``window`` - 1 words before the factor's
end, since a factor of another block may begin there: what is a factor is thus checked at every boundary.
Words between factors are literals. The factors' words are the duplicate spans.

Reference blocks are ``BLOCK`` words of a document, with the ``window`` - 1 words after them. Which blocks a
document is parsed against comes from an index that never compares pairs of documents: windows are grouped
into runs at content-defined places (consecutive windows whose smallest 8-word hash, their anchor, is the
same), so equal text is cut alike wherever it stands. Equal runs collapse to their smallest document before
anything else, so a passage in a third of all documents costs one row per task; of runs that share an anchor
and differ (at the edges of copied passages) the single windows are looked up. The index hands every
document the blocks that hold its seeds; the index works on hashes, the parse decides on words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import discard, stash
from tessella.llm.textbytes import MULTIPLIER, WINDOW_MULTIPLIER, Text, chunks, inverse, mix, powers, sliding_min, window_hashes

WINDOW = 50
ANCHOR = 8
#: Words that start in one reference block.
BLOCK = 128


def blocks_of(text: Text, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """doc (number in the slice), start (word in its document), n (windows), anchor hash, block hash."""
    words = text.word_hashes()
    n = len(words)
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    least = sliding_min(window_hashes(words, anchor), window - anchor + 1)
    doc = text.document()
    whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    first = np.ones(len(whole), bool)
    first[1:] = (least[whole[1:]] != least[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(first)
    start = whole[at]
    count = np.diff(np.r_[at, len(whole)])
    stop = start + count + window - 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(WINDOW_MULTIPLIER, n), out=sums[1:])
        block = mix((sums[stop] - sums[start]) * powers(inverse(WINDOW_MULTIPLIER), n)[start] + count.astype(np.uint64))
    return doc[start], start - text.first[doc[start]], count, least[start], block


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text; the key tells rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def candidates(rows: DataFrame, window: int, anchor: int, block: int) -> DataFrame:
    """id, key, of, of_key, number: which reference blocks (by document and number) each row of ``rows`` is parsed
    against. Every window that also starts in a document with a smaller id has a block that holds it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, start, n, least, run = blocks_of(Text(part.column(2)), window, anchor)
                for i in range(0, len(doc), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    take = pa.array(doc[s])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(start[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(least[s].view(np.int64)), pa.array(run[s].view(np.int64))],
                        ["id", "key", "start", "n", "anchor", "run"],
                    )

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = Text(part.column(2))
                words = text.word_hashes()
                lists = part.column(3)
                pieces = lists.flatten()
                doc = np.repeat(np.arange(text.n), np.asarray(pc.list_value_length(lists)))
                start, n = (np.asarray(pieces.field(i)).astype(np.int64) for i in (0, 1))
                which = np.repeat(np.arange(len(start)), n)
                pos = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = text.first[doc[which]] + pos
                whole = window_hashes(words, window)[at]
                half = mix(window_hashes(words, window // 2)[at] + np.uint64(window)) >> np.uint64(33)
                for i in range(0, len(at), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    take = pa.array(doc[which[s]])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(pos[s].astype(np.int32)), pa.array(whole[s].view(np.int64)), pa.array(half[s].astype(np.int32))],
                        ["id", "key", "start", "window", "check"],
                    )

    pieces = stash(rows.mapInArrow(cut, "id long, key long, start int, n int, anchor long, run long"), "runs")
    known = stash(pieces.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "anchors")
    shared = stash(pieces.join(known, "anchor"), "shared")
    discard(pieces, known)
    # the index: each distinct run with its smallest document, and whether its anchor has other runs
    first = [F.min("id").alias("of"), F.min_by("key", "id").alias("of_key"), F.min_by("start", "id").alias("of_start")]
    distinct = stash(shared.groupBy("anchor", "run").agg(*first), "distinct")
    several = stash(distinct.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1").select("anchor"), "several")
    index = stash(distinct.join(several.withColumn("open", F.lit(True)), "anchor", "left").select("anchor", "run", "of", "of_key", "of_start", F.coalesce("open", F.lit(False)).alias("open")), "index")
    discard(distinct, several)
    found = stash(shared.join(index, ["anchor", "run"]).where("of < id or open").select("id", "key", "start", "n", "of", "of_key", "of_start", (F.col("of") < F.col("id")).alias("whole")), "found")
    discard(shared, index)
    # windows of the runs that their own document was first to have
    asked = found.where("not whole").groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    opened = stash(rows.join(asked, ["id", "key"]).select("id", "key", "text", "spans").mapInArrow(open_windows, "id long, key long, start int, window long, check int"), "windows")
    firsts = stash(opened.groupBy("window", "check").agg(*first, F.max("id").alias("high")).where("of < high").drop("high"), "firsts")
    columns = ["id", "key", "n", "of", "of_key", "of_start"]
    single = opened.join(firsts, ["window", "check"]).where("of < id").withColumn("n", F.lit(1)).select(columns)
    both = found.where("whole").select(columns).unionByName(single)
    numbers = F.sequence(F.floor(F.col("of_start") / block), F.floor((F.col("of_start") + F.col("n") - 1) / block))
    out = stash(both.select("id", "key", "of", "of_key", F.explode(numbers).alias("number")).distinct(), "candidates")
    discard(opened, firsts, found)
    return out


def referred(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, block: int) -> DataFrame:
    """id, key, blocks (array of: of, number, words) of the rows that have reference blocks; null ids take no part."""
    rows = keyed(docs, id_col, text_col).where("id is not null")
    asked = candidates(rows, window, anchor, block)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = Text(part.column(2))
                body, at = pack(text, np.ones(len(text.starts), bool))
                # where each word starts in ``body``
                length = text.ends - text.starts + 1
                to = np.r_[0, np.cumsum(length)]
                lists = part.column(3)
                doc = np.repeat(np.arange(text.n), np.asarray(pc.list_value_length(lists)))
                number = np.asarray(lists.flatten()).astype(np.int64)
                begin = text.first[doc] + number * block
                end = np.minimum(begin + block + window - 1, text.first[doc + 1])
                for i in range(0, len(doc), 4096):
                    s = slice(i, i + 4096)
                    take = pa.array(doc[s])
                    words = [body[x : y - 1].decode() for x, y in zip(to[begin[s]].tolist(), to[end[s]].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(number[s]), pa.array(words, pa.string())], ["of", "of_key", "number", "words"])

    wanted = asked.select(F.col("of").alias("id"), F.col("of_key").alias("key"), "number").distinct().groupBy("id", "key").agg(F.collect_list("number").alias("numbers"))
    fetched = rows.join(wanted, ["id", "key"]).select("id", "key", "text", "numbers").mapInArrow(fetch, "of long, of_key long, number long, words string")
    reference = stash(fetched.groupBy("of", "of_key", "number").agg(F.first("words").alias("words")), "reference")  # rows that repeat an id and text have the same words
    given = asked.join(reference, ["of", "of_key", "number"]).groupBy("id", "key").agg(F.collect_list(F.struct("of", "number", "words")).alias("blocks"))
    out = stash(given, "given")
    discard(asked, reference)
    return out


def parse(text: Text, blocks: pa.Array, window: int, block: int) -> list[tuple[int, int, int, int, int]]:
    """Factors (document of the slice, start, length, reference document, start in it), in order.

    ``blocks`` has each document's reference blocks. Seeds are looked up by hash; a factor is what words that
    are compared one by one have in common, ``window`` of them at least."""
    lists = blocks.combine_chunks() if isinstance(blocks, pa.ChunkedArray) else blocks
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    if not counts.sum():
        return []
    pieces = lists.flatten()
    reference = Text(pieces.field(2))
    mine, theirs = window_hashes(text.word_hashes(), window), window_hashes(reference.word_hashes(), window)
    if not len(mine) or not len(theirs):
        return []
    doc = np.repeat(np.arange(text.n), counts)  # of each block
    mine_doc, their_block = text.document(), reference.document()
    whole = mine_doc[: len(mine)] == mine_doc[window - 1 :]
    inside = np.flatnonzero(their_block[: len(theirs)] == their_block[window - 1 :])
    with np.errstate(over="ignore"):
        mine = mix(mine + mine_doc[: len(mine)].astype(np.uint64) * MULTIPLIER)
        theirs = mix(theirs[inside] + doc[their_block[inside]].astype(np.uint64) * MULTIPLIER)
    order = np.argsort(theirs, kind="stable")  # of equal seeds the first of the reference comes first
    theirs, seed = theirs[order], inside[order]
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    hit = np.flatnonzero((theirs[at] == mine) & whole)
    if not len(hit):
        return []
    (body, _), (other, _) = (pack(t, np.ones(len(t.starts), bool)) for t in (text, reference))
    to, other_to = (np.r_[0, np.cumsum(t.ends - t.starts + 1)] for t in (text, reference))
    of, number = np.asarray(pieces.field(0)), np.asarray(pieces.field(1)).astype(np.int64)

    def common(i: int, j: int) -> int:
        """How many words from i of the slice and from j of the reference on are equal, within document and block."""
        x, y = int(to[i]), int(other_to[j])
        n = min(int(to[text.first[mine_doc[i] + 1]]) - x, int(other_to[reference.first[their_block[j] + 1]]) - y)
        same, step = 0, 256
        while same < n:
            step = min(step, n - same)
            if body[x + same : x + same + step] != other[y + same : y + same + step]:
                a, b = (np.frombuffer(z, np.uint8, step, p + same) for z, p in ((body, x), (other, y)))
                same += int(np.argmax(a != b))
                break
            same += step
            step *= 4
        return int(np.searchsorted(to, x + same, "right")) - 1 - i  # whole words only

    out, n = [], 0
    while n < len(hit):
        i = int(hit[n])
        length, j = 0, 0
        for k in range(int(at[i]), len(theirs)):
            if theirs[k] != mine[i]:
                break
            j = int(seed[k])
            length = common(i, j)
            if length >= window:  # else the hashes clash, and the next equal one is tried
                break
        if length < window:
            n += 1
            continue
        b = their_block[j]
        out.append((int(mine_doc[i]), i - int(text.first[mine_doc[i]]), length, int(of[b]), int(number[b]) * block + j - int(reference.first[b])))
        n = max(n + 1, int(np.searchsorted(hit, i + length - window + 1)))
    return out


def pack(text: Text, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of every document joined by one space: a buffer, and where each document's part starts (the
    part ends one byte before the next one starts; a document without kept words has an empty part)."""
    length = (text.ends - text.starts)[keep]
    to = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=to[1:])
    out = np.full(int(to[-1]), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[to[1:] - 1] = False
    edge = np.zeros(len(text.data) + 1, np.int8)
    edge[text.starts[keep]] = 1
    edge[text.ends[keep]] -= 1
    out[letters] = text.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out.tobytes(), to[kept[text.first]]


def covered(text: Text, factors: list[tuple]) -> np.ndarray:
    """True for the words of a slice that factors cover."""
    edge = np.zeros(len(text.starts) + 1, np.int64)
    for doc, start, length, *_ in factors:
        edge[text.first[doc] + start] += 1
        edge[text.first[doc] + start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """id, key, start, length, of, of_start: the factors of each row of docs, one row a factor; its words are also
    ``length`` words of document ``of``, whose id is smaller, from ``of_start`` on. What no factor covers is literal."""
    given = referred(docs, id_col, text_col, window, anchor, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = parse(Text(part.column(2)), part.column(3), window, block)
                doc, *rest = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), *map(pa.array, rest)], ["id", "key", "start", "length", "of", "of_start"])

    rows = keyed(docs, id_col, text_col).join(given, ["id", "key"]).select("id", "key", "text", "blocks")
    return rows.mapInArrow(run, "id long, key long, start long, length long, of long, of_start long")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """docs with its own columns and rows, the text replaced by what is left of it: the original text where
    nothing is removed, else the kept words joined by one space. See ``digest`` for what is removed."""
    own = "blocks of " + " ".join(docs.columns)
    given = referred(docs, id_col, text_col, window, anchor, block).select(F.col("id").alias(own + " id"), F.col("key").alias(own + " key"), F.col("blocks").alias(own))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.join(given, (docs[id_col].cast("long") == F.col(f"`{own} id`")) & (F.xxhash64(text) == F.col(f"`{own} key`")), "left").select(*[F.col(f"`{c}`") for c in docs.columns], f"`{own}`")
    schema, at = docs.schema, docs.columns.index(text_col)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                text = Text(part.column(at))
                gone = covered(text, parse(text, part.column(part.num_columns - 1), window, block))
                body, cut = pack(text, ~gone)
                lost = np.diff(np.r_[0, np.cumsum(gone)][text.first])
                old = part.column(at)
                new = [body[s : max(e - 1, s)].decode() if n else old[i].as_py() for i, (s, e, n) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), lost.tolist(), strict=True))]
                columns = list(part.columns[:-1])
                columns[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return rows.mapInArrow(finish, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row of docs.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. Removed is each word of a factor, that is each word
    covered by a window of ``window`` words of one document whose words also start in a document with a smaller
    id; windows are judged on the input. ``kept_sha256`` is of the kept words joined by one space. Null texts have
    no words; texts under ``window`` words lose none. Rows that repeat an id are parts of one document: they never
    count as smaller than each other. Rows of null id are kept whole. An empty table gives no rows. A very long
    text is parsed by one task, in memory of some 50 bytes a word.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = Text(part.column(1))
                gone = covered(text, parse(text, part.column(2), window, block))
                body, cut = pack(text, ~gone)
                sums = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=sums[1:])
                sha = [hashlib.sha256(body[s : max(e - 1, s)]).hexdigest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(text.first).astype(np.int64)), pa.array(np.diff(sums[text.first])), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    given = referred(docs, id_col, text_col, window, anchor, block)
    rows = keyed(docs, id_col, text_col).join(given, ["id", "key"], "left").select("id", "text", "blocks")
    return rows.mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB SQL for doc_id, n_words, n_removed, kept_sha256 over documents (of distinct ids).
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS owner FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(k.i, k.i + 50)) AS i FROM k JOIN f USING (k) WHERE owner < doc_id),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT p.* FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.i = g.i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
