"""Binary token files: independent zstandard frames, one per document, with a trailing seek table.

A file holds, little-endian:

    frames       one zstandard frame per document: its ids as unsigned 32-bit integers
    seek table   per document: id int64, offset uint64, compressed uint32, n_tokens uint64, crc32 uint32
    footer       number of documents uint64, crc32 of the seek table uint32, magic b"TSK1"

The seek table is a skippable zstandard frame, so a plain zstandard reader gets all ids in one stream. A
reader takes the footer and the table from the end of the file, and then only the frames that it wants; each
frame is checked against its crc32 when it is opened.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.encoding import encoder as worker_encoder
from tessella.llm.storage import new_folder, stash

MAGIC = b"TSK1"
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("compressed", "<u4"), ("n_tokens", "<u8"), ("crc32", "<u4")])
ENTRY_OF = "<qQIQI"
FOOTER = "<QI4s"
SKIPPABLE = "<II"
SKIPPABLE_MAGIC = 0x184D2A5E
#: zstandard's level.
LEVEL = 3
#: A file is closed at so many bytes of frames or so many documents, so its seek table stays far below the 4 GB that a
#: skippable frame can hold; a task is meant for so many bytes of text, and writes as many files as it takes.
FILE_BYTES, FILE_DOCS, TASK_BYTES = 1 << 28, 1 << 20, 1 << 30


def open_store(url: str):
    """The file system and path of a shared folder's URL."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else fs.FileSystem.from_uri(f"file://{url.removeprefix('file:')}")


class Writer:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, url: str):
        import zstandard

        self.url = url
        self.fs, self.path = open_store(url)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.part, compression=None)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.at, self.n, self.n_tokens, self.entries = 0, 0, 0, bytearray()

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.compress(ids)
        self.file.write(frame)
        self.entries += struct.pack(ENTRY_OF, doc_id, self.at, len(frame), len(ids) // 4, zlib.crc32(ids))
        self.at += len(frame)
        self.n += 1
        self.n_tokens += len(ids) // 4

    @property
    def full(self) -> bool:
        return self.at >= FILE_BYTES or self.n >= FILE_DOCS

    def close(self) -> None:
        table = bytes(self.entries)
        tail = table + struct.pack(FOOTER, self.n, zlib.crc32(table), MAGIC)
        self.file.write(struct.pack(SKIPPABLE, SKIPPABLE_MAGIC, len(tail)) + tail)
        self.file.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Reads documents of one file by their place in it."""

    def __init__(self, url: str):
        import zstandard

        self.fs, path = open_store(url)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(FOOTER)
        n, crc, magic = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"{url} is no token file")
        table = self.file.read_at(n * ENTRY.itemsize, size - tail - n * ENTRY.itemsize)
        if zlib.crc32(table) != crc:
            raise ValueError(f"{url}: the seek table is damaged")
        self.table = np.frombuffer(table, ENTRY)
        self.decompress = zstandard.ZstdDecompressor().decompress

    def ids(self, i: int) -> bytes:
        e = self.table[i]
        out = self.decompress(self.file.read_at(int(e["compressed"]), int(e["offset"])), max_output_size=max(4 * int(e["n_tokens"]), 1))
        if len(out) != 4 * e["n_tokens"] or zlib.crc32(out) != e["crc32"]:
            raise ValueError(f"document {e['id']}: its frame is damaged")
        return out

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """The rows of the given ids, of which only their frames are read."""
        for doc_id in doc_ids:
            lo, hi = (int(np.searchsorted(self.table["id"], doc_id, side)) for side in ("left", "right"))
            for i in range(lo, hi):
                yield doc_id, self.ids(i)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "words", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending order of id; returns the files:
    task int, file int, path, n_docs, n_tokens (one small row for each file).

    Documents are dealt to tasks by ranges of id, so that files follow each other in order of task and file; tasks
    are as many as the text's bytes call for, and a task that runs again writes the same files. Null and empty texts
    have the end id alone. Rows that repeat an id stay side by side, ordered by text; null ids come first, as
    id -2**63.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    if tasks is None:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // TASK_BYTES))
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("task", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, encoder = None, 0, None
        task = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"task": task, "file": file, "path": out.url, "n_docs": out.n, "n_tokens": out.n_tokens}], schema=schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                encoder = encoder or worker_encoder(tokenizer, kind)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    out = out or Writer(f"{folder}/part-{task:08d}-{file:06d}.tsk")
                    out.add(doc_id, ids + end)
                    if out.full:
                        yield closed()
                        out, file = None, file + 1
        if out is not None:
            yield closed()

    written = rows.repartitionByRange(tasks, "id").sortWithinPartitions("id", "text").mapInArrow(run, "task int, file int, path string, n_docs long, n_tokens long")
    return stash(written, "files")


def read(spark: SparkSession, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32 (and ids) of every document of the files; start counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                for i in range(0, len(reader.table), 256):
                    t = reader.table[i : i + 256]
                    ids = [reader.ids(j) for j in range(i, i + len(t))]
                    counts = np.array([len(x) // 4 for x in ids], np.int64)
                    begin = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    doc = pa.array(t["id"].astype(np.int64), mask=t["id"] == -(1 << 63))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(begin), pa.array(counts), pa.array([zlib.crc32(x) for x in ids], pa.int64()), *[pa.array(ids, pa.binary())] * with_ids], ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                reader.close()

    # ids before a file: those of the tasks before its own, and of its task's files before it
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("task").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.withColumn("within", within).join(tasks, "task").select("path", (F.col("before") + F.col("within")).alias("start"))
    return parts.repartition(max(1, files.count()), "path").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False, **how) -> DataFrame:
    """Writes docs to the shared folder and reads the files back: see ``write`` and ``read``."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_folder(spark, "tokens"), tokenizer, **how), with_ids)
