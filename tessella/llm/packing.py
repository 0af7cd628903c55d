"""Packing documents into sequences of equal cost.

A piece of n tokens costs ``linear * n + quadratic * n**2``, since a token attends to its own document only.
Each task takes documents as they come, in groups of ``GROUP`` tokens; what is longer than ``PIECE`` of a sequence
is cut into equal pieces no longer than that, so that no sequence is dear because one piece fills it. All pieces
of a group go, in descending order, to the sequence of lowest cost that still has room for them. A group has just
as many sequences as its tokens fill, so at the end pieces that fit nowhere whole are cut over the sequences
of lowest cost that have room. All but the last few tokens of a group's sequences are filled; nothing is
shuffled and no task holds more than one group and a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.encoding import encoder as worker_encoder

CAPACITY = 1024
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
#: The longest piece, as a share of a sequence. Cost per sequence then spreads by some 4 % about its mean; at 1 by 9 %.
PIECE = 0.75
#: Tokens of pieces that are packed together.
GROUP = 1 << 21


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset) of items into ceil(total / capacity) sequences."""
    total = sum(lengths)
    n = -(-total // capacity)
    cost, used = np.zeros(n), np.zeros(n, np.int64)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            room = capacity - used
            fits = room >= left
            to = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(left, int(room[to]))
            out.append((item, start, take, to, int(used[to])))
            cost[to] += linear * take + quadratic * take * take
            used[to] += take
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, tokenizer: str, kind: str = "spaced", end_id: int = 0, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group: int = GROUP, piece: float = PIECE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, lasting: bool = True) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row per piece.

    Every id of every row, the end id included, lies in exactly one piece; pieces of a sequence are gapless
    from offset 0 and hold at most ``capacity`` ids. Null and empty texts are the end id alone. Rows that
    repeat an id are packed one by one, each from start 0. A sequence's number tells its task and its place there.
    ``lasting``: whether workers keep the words they have learned for their next tasks.
    """
    end, longest = np.array([end_id], "<u4").tobytes(), max(1, int(piece * capacity))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) if pieces else [()] * 7
        ids = columns.pop(3)
        columns.insert(3, [zlib.crc32(x) for x in ids])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns + [ids] * with_ids, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, kind, lasting)
        sequence = TaskContext.get().partitionId() << 33
        rests: list[tuple[int, int, bytes, int]] = []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, rests, held
            placed = assign([len(r[2]) // 4 for r in rests], capacity, linear, quadratic)
            pieces = [(rests[i][0], rests[i][1] + s, rests[i][2][4 * s : 4 * (s + n)], rests[i][3], sequence + to, at, n) for i, s, n, to, at in placed]
            yield rows([(d, s, n, x, t, q, o) for d, s, x, t, q, o, n in pieces])
            sequence += -(-held // capacity)
            rests, held = [], 0

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    k = -(-n // longest)
                    for j in range(k):
                        s, e = n * j // k, n * (j + 1) // k
                        rests.append((doc_id, s, ids[4 * s : 4 * e], n))
                        held += e - s
                        if held >= group:
                            yield from settle()
        if rests:
            yield from settle()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
