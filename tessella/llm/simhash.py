"""SimHash near-duplicates: fingerprints compared at the anchors of a covering code.

Bits are cut into blocks of 15, each covered by the perfect Hamming [15, 11] code of radius 1, and bits that stand
for themselves. A code word of this direct sum is an anchor: every point has an anchor within the covering
radius, the number of blocks, which decoding each block finds. Of two points that differ in t bits or fewer, some
point lies within ceil(t / 2) of both; so both are replicated to the anchors of all points within ceil(t / 2) of
them (all within covering radius plus threshold), and each linked pair meets at an anchor.

``near_duplicates`` has fingerprints of 64 bits, four blocks and four bits: for t = 2 at most 33 anchors, out of
2**48. ``near_copies`` is for looser likeness, which no code can cover in 64 bits at bearable cost: fingerprints
of 512 bits, of which 16 parts of 30 bits (two blocks, at most 15 anchors out of 2**22) have anchors of their own,
with t = 2 in each. Texts that meet at an anchor of any part are linked if all their bits differ in ``LIMIT`` or
fewer. Up to 47 differing bits some part differs in 2 at most, so the pair surely meets; beyond, chances are
those of 16 independent parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.storage import discard, stash
from tessella.llm.textbytes import MULTIPLIER, Text, chunks, mix, whitespace_table, window_hashes

SEED = 42
THRESHOLD = 2
#: Shingles whose bits are counted together.
STEP = 255 * 96
#: Fingerprints at one anchor that are compared with one another; more are probed by flipping bits.
COMPARED = 1024
#: near_copies: 64-bit words of a fingerprint, parts of it with anchors, bits of a part, bits that may differ in all.
LANES, PARTS, PART_BITS, LIMIT = 8, 16, 30, 88
#: Parts whose anchors are shuffled together.
TOGETHER = 2
#: Fingerprints of one anchor that a task holds; an anchor with more is cut into cells, and pairs of cells are dealt out.
CELL = 1 << 16


def fingerprints_of(text: Text, shingle: int = 3) -> np.ndarray:
    """The fingerprints of all documents of a slice: see ``fingerprints``."""
    import xxhash

    low = text.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    length = text.ends - text.starts
    # the words of a document side by side with one space between them
    to = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=to[1:])
    packed = np.full(int(to[-1]), 32, np.uint8)
    letters = np.ones(len(packed), bool)
    letters[to[1:] - 1] = False
    packed[letters] = low[~whitespace_table()[low]]
    packed = packed.tobytes()
    counts = np.diff(text.first)
    shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    begin = np.zeros(text.n + 1, np.int64)
    np.cumsum(shingles, out=begin[1:])
    which = np.repeat(np.arange(text.n), shingles)
    start = text.first[which] + np.arange(begin[-1]) - begin[which]
    stop = start + np.minimum(shingle, counts[which])
    digest, ones = xxhash.xxh64_intdigest, np.zeros((text.n, 64), np.int64)
    for i in range(0, len(start), STEP):
        s, e = to[start[i : i + STEP]], to[stop[i : i + STEP]] - 1
        hashes = np.array([digest(packed[x:y], SEED) for x, y in zip(s.tolist(), e.tolist(), strict=True)], np.uint64)
        count_bits(hashes[:, None], which[i : i + STEP], ones)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def count_bits(hashes: np.ndarray, doc: np.ndarray, ones: np.ndarray) -> None:
    """Adds the bits of rows of hashes to the counts of their documents, which ascend; bytes are added, of 255 rows at most."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    cut = np.unique(np.r_[begin, np.arange(0, len(doc), 255)])
    sums = np.add.reduceat(bits.view(np.uint64), cut, axis=0).view(np.uint8)
    ones[doc[begin]] += np.add.reduceat(sums, np.searchsorted(cut, begin), axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (long with the fingerprint's bits): one row per row of docs.

    The text is lower-cased (A-Z) and cut into words at ASCII white space; h of each shingle of ``shingle``
    words joined by one space, repeats included, is its XXH64 with seed 42. A bit of the fingerprint is set
    if it is set in over half of all h. A text of fewer words is one shingle; one without words or null has
    fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                fp = fingerprints_of(Text(part.column(1)), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def decode(points: np.ndarray, blocks: int = 4) -> np.ndarray:
    """The anchor of each point: each of its lowest ``blocks`` blocks of 15 bits moved to its nearest code word."""
    table = np.arange(1 << 15, dtype=np.uint64)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where((np.arange(1 << 15) >> bit) & 1, bit + 1, 0)
    table ^= np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint64), np.uint64(0))
    out = points >> np.uint64(15 * blocks) << np.uint64(15 * blocks)
    for block in range(blocks):
        at = np.uint64(15 * block)
        out = out | (table[((points >> at) & np.uint64(0x7FFF)).astype(np.int64)] << at)
    return out


def flips(bits: int, width: int = 64) -> np.ndarray:
    """All words of ``width`` bits with at most ``bits`` bits set."""
    out = {0}
    for _ in range(bits):
        out |= {x | 1 << b for x in out for b in range(width)}
    return np.array(sorted(out), np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links_at_anchor(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints of one anchor that differ in ``threshold`` bits or fewer.

    fps are distinct. Each one is linked to the root (the smallest) of its part. A few are compared with one another; of many, each looks its neighbours
    up by flipping bits, which takes time in proportion to their number.
    """
    fps = np.sort(fps)
    n = len(fps)
    if n <= COMPARED:
        near = popcount(fps[:, None] ^ fps[None, :]) <= threshold
        pairs = [np.nonzero(np.triu(near, 1))]
    else:
        pairs = []
        for mask in flips(threshold)[1:]:
            other = fps ^ mask
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero((fps[at] == other) & (at > np.arange(n)))
            if len(hit):
                pairs.append((hit, at[hit]))
    if not pairs:
        return fps[:0], fps[:0]
    root = rooted(n, *(np.concatenate([p[i] for p in pairs]) for i in (0, 1)))
    linked = np.flatnonzero(root != np.arange(n))
    return fps[root[linked]], fps[linked]


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest one that the pairs (a, b) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def column(a: pa.Array) -> np.ndarray:
    """Numbers as they are; binary values of 8 * LANES bytes as rows of LANES words."""
    if not pa.types.is_binary(a.type):
        return np.asarray(a).astype(np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[a.offset * 8 * LANES :][: len(a) * 8 * LANES].view(np.uint64).reshape(-1, LANES) if len(a) else np.zeros((0, LANES), np.uint64)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches sorted by the first one, in pieces that cut no key."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        columns = tuple(map(column, batch.columns))
        if not batch.num_rows:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
        if cut:
            yield tuple(np.concatenate([*x, y[:cut]]) for x, y in zip(zip(*held, strict=True), columns, strict=True)) if held else tuple(c[:cut] for c in columns)
            held = [tuple(c[cut:] for c in columns)]
        else:
            held.append(columns)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) at ``threshold`` or fewer differing bits.

    Not all pairs: for each anchor a spanning forest of its fingerprints, which loses no link between
    components. An anchor holds at most 16**4 * 65 distinct points that decode to it, whatever the input.
    """
    around = flips(-(-threshold // 2))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for i in range(0, len(fp), 4096):
                at = np.sort(decode((fp[i : i + 4096, None] ^ around[None, :]).ravel()).reshape(-1, len(around)), axis=1)
                new = np.ones(at.shape, bool)
                new[:, 1:] = at[:, 1:] != at[:, :-1]
                who = np.broadcast_to(fp[i : i + 4096, None], at.shape)[new]
                yield pa.RecordBatch.from_arrays([pa.array(at[new].view(np.int64)), pa.array(who.view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, fp in whole_keys(batches):
            edge = np.flatnonzero(np.diff(anchor)) + 1
            begin, end = np.r_[0, edge], np.r_[edge, len(anchor)]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            size = end - begin
            two = begin[size == 2]
            x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            close = popcount(x ^ y) <= threshold
            out.append((x[close], y[close]))
            out += [links_at_anchor(fp[b:e].view(np.uint64), threshold) for b, e in zip(begin[size > 2], end[size > 2], strict=True)]
            a, b = (np.concatenate([p[i] for p in out]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    at = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    n = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return at.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = 3) -> DataFrame:
    """id, fp, component: each row's fingerprint and the smallest id that links of fingerprints reach.

    Rows of equal fingerprint are one node, named by its smallest id, so copies cost no pairs; repeated ids
    with several texts join the components of all of them. Rows of null id have a fingerprint but no links, and
    component null. An empty table gives an empty result.
    """
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stash(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    pairs = stash(links(nodes, threshold), "links")
    names = nodes.withColumnRenamed("first", "id")
    edges = pairs.join(names.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    named = components_of(nodes, edges)
    discard(nodes, pairs)
    return rows.where("id is not null").join(named, "fp").select("id", "fp", "component").unionByName(rows.where("id is null").select("id", "fp", F.lit(None).cast("long").alias("component")))


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component of nodes (fp, first: the id that edges know it by)."""
    label = components(edges)
    out = stash(nodes.join(label.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("label", "first").alias("component")), "components")
    discard(label)
    return out


def wide_of(text: Text, shingle: int = 5) -> np.ndarray:
    """The 512-bit fingerprints (LANES words each) of all documents of a slice: see ``near_copies``."""
    low = text.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    words = text.word_hashes(low)
    counts = np.diff(text.first)
    out = np.zeros((text.n, LANES), np.uint64)  # also of texts without words
    lanes = mix(np.arange(1, LANES + 1, dtype=np.uint64) * MULTIPLIER)
    hashes, doc = window_hashes(words, shingle), text.document()
    at = np.flatnonzero(doc[: len(hashes)] == doc[shingle - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    ones = np.zeros((text.n, 64 * LANES), np.int64)
    for i in range(0, len(at), STEP):
        some = at[i : i + STEP]
        count_bits(mix(hashes[some][:, None] ^ lanes), doc[some], ones)
    many = counts >= shingle
    out[many] = np.packbits(2 * ones[many] > (counts[many] - shingle + 1)[:, None], axis=1, bitorder="little").view(np.uint64)
    for i in np.flatnonzero((counts > 0) & ~many).tolist():
        out[i] = mix(window_hashes(words[text.first[i] : text.first[i + 1]], int(counts[i])) ^ lanes)
    return out


def parts_of(fps: np.ndarray, part: int) -> np.ndarray:
    """The bits of one part of each fingerprint."""
    lane, shift = divmod(part * PART_BITS, 64)
    out = fps[:, lane] >> np.uint64(shift)
    if shift + PART_BITS > 64:
        out = out | fps[:, lane + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << PART_BITS) - 1)


def near_pairs(key: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b) between the fingerprints of one key that differ in ``limit`` bits or fewer: all of them
    within a small group; in a large one a spanning forest, found by spreading from one to all that are
    near it, so that what is near has been compared with little more than one other."""
    edge = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.r_[0, edge], np.r_[edge, len(key)]
    size = end - begin
    last, at = np.repeat(end, size), np.flatnonzero(np.repeat(size <= 64, size))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, 64):
        at = at[at + lag < last[at]]
        if not len(at):
            break
        for i in range(0, len(at), 1 << 16):
            x = at[i : i + (1 << 16)]
            near = x[popcount(fps[x] ^ fps[x + lag]).sum(1, dtype=np.int64) <= limit]
            a.append(near)
            b.append(near + lag)
    for lo, hi in zip(begin[size > 64].tolist(), end[size > 64].tolist(), strict=True):
        left = np.arange(lo, hi)
        while len(left):
            root, left = left[0], left[1:]
            front = np.array([root])
            while len(front) and len(left):
                found = np.zeros(len(left), bool)
                for i in range(0, len(front), 64):
                    rest = np.flatnonzero(~found)
                    for j in range(0, len(rest), 8192):
                        to = rest[j : j + 8192]
                        bits = np.zeros((len(front[i : i + 64]), len(to)), np.int16)
                        for lane in range(LANES):
                            bits += popcount(fps[front[i : i + 64], None, lane] ^ fps[left[to], lane])
                        found[to] = (bits <= limit).any(0)
                front, left = left[found], left[~found]
                a.append(np.full(len(front), root))
                b.append(front)
    return np.concatenate(a), np.concatenate(b)


def near_links(nodes: DataFrame, parts: range, limit: int, cell: int) -> DataFrame:
    """Links a, b (ids) between nodes (fp, first) that meet at an anchor of one of the parts: for what a task compares
    at a time, a spanning forest."""
    around = flips(1, PART_BITS)
    spark = nodes.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                fps = column(part.column(0))
                for p in parts:
                    at = np.sort(decode((parts_of(fps, p)[:, None] ^ around).ravel(), 2).reshape(-1, len(around)), axis=1)
                    new = np.ones(at.shape, bool)
                    new[:, 1:] = at[:, 1:] != at[:, :-1]
                    who = pa.array(np.nonzero(new)[0])
                    yield pa.RecordBatch.from_arrays([pa.array((at[new] | np.uint64(p << PART_BITS)).view(np.int64)), part.column(1).take(who), part.column(0).take(who)], ["anchor", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fps in whole_keys(batches):
            ids, place = np.unique(node, return_inverse=True)
            a, b = near_pairs(key, fps, limit)
            root = rooted(len(ids), place[a], place[b])
            linked = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[linked]]), pa.array(ids[linked])], ["a", "b"])

    at = nodes.select("fp", "first").mapInArrow(replicate, "anchor long, node long, fp binary")
    hot = stash(at.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > cell).select(F.col("anchor").alias("hot"), F.ceil(F.col("n") / cell).cast("int").alias("cells")), "hot")
    if hot.limit(1).count():
        # an anchor with more than a task holds: each pair of its cells is a group of its own
        own = F.pmod(F.xxhash64("node"), F.col("cells"))
        groups = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.xxhash64("anchor", F.least(own, o), F.greatest(own, o)))
        at = at.join(hot, F.col("anchor") == F.col("hot"), "left").select(F.explode(F.coalesce(groups, F.array("anchor"))).alias("anchor"), "node", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = stash(at.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(hot)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, limit: int = LIMIT, cell: int = CELL) -> DataFrame:
    """id, component: the smallest id that links of 512-bit fingerprints reach, null for null ids.

    The text is lower-cased (A-Z) and cut into words at ASCII white space. Each shingle of ``shingle`` words, repeats
    included, has 512 hashed bits; a bit of the fingerprint is set if it is set in over half of them. Texts of fewer
    words are one shingle; those without words have fingerprint zero and are copies of each other. The default
    limit is where texts share 0.8 of their different shingles or more, with a little room for chance. Equal
    fingerprints are one node. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                fps = wide_of(Text(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in fps], pa.binary())], ["id", "fp"])

    rows = stash(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp binary"), "fingerprints")
    nodes = stash(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    found = [near_links(nodes, range(i, min(i + TOGETHER, PARTS)), limit, cell) for i in range(0, PARTS, TOGETHER)]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    # a text of a large group has another root in each task: its roots are linked with their smallest, which most
    # texts of the group have in common, so that few links are left (a text has one root at most a part and anchor)
    stars = edges.distinct().groupBy("b").agg(F.collect_set("a").alias("roots"))
    least = F.array_min("roots")
    both = F.array_append(F.transform("roots", lambda r: F.struct(least.alias("a"), r.alias("b"))), F.struct(least.alias("a"), F.col("b")))
    named = components_of(nodes, stars.select(F.explode(both).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
    discard(nodes, *found)
    return rows.where("id is not null").join(named, "fp").select("id", "component").unionByName(rows.where("id is null").select("id", F.lit(None).cast("long").alias("component")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[..., DataFrame] = near_copies, **how) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates, as ``near`` finds them, keeps one: the row of the
    group's smallest id. Of rows that repeat that id the smallest text stays, of equal ones any. Rows of null id stay."""
    own = "kept id of " + " ".join(docs.columns)
    found = near(docs, id_col, text_col, **how).where("id = component")
    keep = stash(found.groupBy(F.col("id").alias(own)).agg((F.count("*") > 1).alias(own + " again")), "kept")
    mine, again = docs[id_col].cast("long") == F.col(f"`{own}`"), F.col(f"`{own} again`")
    out = docs.join(keep.where(~again), mine, "left_semi").unionByName(docs.where(docs[id_col].isNull()))
    if keep.where(again).limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = docs.join(keep.where(again), mine, "left_semi").groupBy(F.col(f"`{id_col}`").cast("long").alias(own)).agg(F.min_by(row, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
