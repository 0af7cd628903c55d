"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words (lower-cased runs of letters, digits and bytes above 0x7F) are hashed, and so are their first
``STEM`` bytes; a word is the sum of both vectors. Hashes that enough sampled documents share have a vector,
all others the zero vector. Filters of several widths run over the whole
text, each gives the largest value it finds, and a logistic unit turns these into a score. All is trained in
numpy by stochastic gradient descent on a bounded sample of labelled documents. Thresholds are calibrated by
language on all labelled documents that are neither held out nor trained on, counted by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.samples import held_out, labelled_sample, marked
from tessella.llm.storage import stash
from tessella.llm.textbytes import Text, chunks

BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
#: Documents of each class that are sampled for fitting, and bytes of their texts, at most; training leaves out one in
#: ``CALIBRATION``.
PER_CLASS, CLASS_BYTES, CALIBRATION = 2500, 1 << 24, 5
#: Places of a filter that are looked at together.
PLACES = 1 << 16
#: Steps of the scores that thresholds lie on; a power of two, so that they are exact.
STEPS = 4096
#: Sampled documents that must share a word before it gets a vector.
SHARED = 4
#: Leading bytes of a word that have a vector too.
STEM = 4
EPOCHS, RATE, DECAY, SEED = 8, 0.1, 1e-4, 1
MODULUS, HELD, THRESHOLD = 5, 0, 0.5


def word_buckets(column: pa.Array) -> tuple[Text, np.ndarray]:
    """The words of a slice and the buckets of each, its own and its stem's."""
    separators = np.ones(256, bool)
    separators[48:58] = separators[65:91] = separators[97:123] = separators[128:] = False
    text = Text(column, separators)
    low = text.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    both = np.stack([text.word_hashes(low), ~text.word_hashes(low, STEM)], 1)
    return text, (both & np.uint64(BUCKETS - 1)).astype(np.int32)


def sequences(rows: DataFrame) -> DataFrame:
    """id, label, lang, buckets of the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text, buckets = word_buckets(part.column(3))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(2 * text.first.astype(np.int32)), pa.array(buckets.ravel()))], ["id", "label", "lang", "buckets"])

    return rows.select("id", "label", "lang", "text").mapInArrow(run, "id long, label int, lang string, buckets array<int>")


class Network:
    """row: for each bucket its vector's number, 0 for the zero vector."""

    def __init__(self, row: np.ndarray, rng: np.random.Generator):
        self.row = row
        self.vectors = rng.normal(0, 0.1, (int(row.max(initial=0)) + 1, DIMENSIONS)).astype(np.float32)
        self.vectors[0] = 0
        self.kernels = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out, self.bias = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(0)

    def pool(self, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest value of each filter, and where it stands."""
        x = self.vectors[words].sum(1)
        top, at = [], []
        for k in self.kernels:
            n = len(words) - len(k) + 1
            values = sum(x[j : j + n] @ k[j] for j in range(len(k)))
            at.append(values.argmax(0))
            top.append(values.max(0))
        return np.concatenate(top), at

    def step(self, words: np.ndarray, label: int, rate: float) -> None:
        top, at = self.pool(words)
        hidden = np.maximum(top, 0)
        error = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.bias, -30, 30))) - label
        back = error * self.out * (top > 0)
        self.out -= rate * (error * hidden + DECAY * self.out)
        self.bias -= np.float32(rate * error)
        for i, (k, where) in enumerate(zip(self.kernels, at, strict=True)):
            d = back[i * FILTERS : (i + 1) * FILTERS]
            for j in range(len(k)):
                used = words[where + j]
                moved = d[:, None] * k[j].T
                k[j] -= rate * (self.vectors[used].sum(1).T * d + DECAY * k[j])
                for both in (0, 1):
                    np.subtract.at(self.vectors, used[:, both], rate * moved)
        self.vectors[0] = 0

    def tables(self) -> tuple:
        """For scoring: each vector's product with every kernel slice, by width and place."""
        return self.row, [[self.vectors @ k[j] for j in range(len(k))] for k in self.kernels], self.out, float(self.bias)


def padded(row: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """A text's vector numbers, with zero vectors at its end so that the widest filter fits."""
    return np.concatenate([row[buckets], np.zeros((max(WIDTHS), 2), row.dtype)])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = MODULUS, held: int = HELD, per_class: int = PER_CLASS) -> tuple[tuple, list[int]]:
    """A network's tables and the ids that it was trained on. Without documents of both labels all scores
    are one half and there are no such ids."""
    rows = sequences(labelled_sample(docs, labels, label_col, modulus, held, per_class, CLASS_BYTES, "lang")).toArrow().sort_by("id")  # a bounded sample
    samples = [(i, y, lang, np.asarray(b.values, np.int64).reshape(-1, 2)) for i, y, lang, b in zip(rows["id"].to_pylist(), rows["label"].to_pylist(), rows["lang"].to_pylist(), rows["buckets"], strict=True)]
    rng = np.random.default_rng(SEED)
    row = np.zeros(BUCKETS, np.int32)
    if len({y for _, y, _, _ in samples}) < 2:
        network = Network(row, rng)
        network.out[:] = 0
        return network.tables(), []
    chosen = [n % CALIBRATION == 0 for n in range(len(samples))]
    training = [(y, b) for (_, y, _, b), c in zip(samples, chosen, strict=True) if not c]
    shared = np.zeros(BUCKETS, np.int32)
    for _, b in training:
        shared[np.unique(b)] += 1
    common = np.flatnonzero(shared >= SHARED)
    row[common] = np.arange(1, len(common) + 1)
    network = Network(row, rng)
    training = [(y, padded(row, b)) for y, b in training]
    steps, done = EPOCHS * len(training), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(training)):
            network.step(training[i][1], training[i][0], RATE * (1 - done / steps))
            done += 1
    return network.tables(), [i for (i, _, _, _), c in zip(samples, chosen, strict=True) if not c]


def calibrated(counts: pd.DataFrame) -> float:
    """The threshold of best F1 over counts (step, label, rows: all, fresh: those not trained on) of one language;
    of equal ones the nearest to ``THRESHOLD``. THRESHOLD where a label is missing.

    Fresh rows of a label stand for all of its rows, so that the mix of labels is that of the table although
    training takes more of a rare one.
    """
    after = []
    for label in (0, 1):
        mine = counts[counts["label"] == label]
        fresh = np.bincount(mine["step"], mine["fresh"], STEPS + 1)
        if not fresh.any():
            return THRESHOLD
        after.append(fresh[::-1].cumsum()[::-1] * (mine["rows"].sum() / fresh.sum()))
    clean, toxic = after
    f1 = np.round(2 * toxic / (clean + toxic + toxic[0]), 12)
    cuts = np.flatnonzero(f1 == f1.max()) / STEPS
    return float(cuts[np.abs(cuts - THRESHOLD).argmin()])


def thresholds(scores: DataFrame, labels: DataFrame, trained: list[int], label_col: str = "toxic", modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """language, own: the threshold of each language (null as empty) with labelled documents in ``scores``.

    Every labelled row that is not held out is counted; what is grouped by language has at most two rows a step.
    """
    used = scores.sparkSession.createDataFrame([(i,) for i in trained], "id long").withColumn("trained", F.lit(True))
    known = scores.join(marked(labels, label_col, modulus, held), "id").join(F.broadcast(used), "id", "left")  # at most 2 * PER_CLASS ids
    step = F.floor(F.col("score") * STEPS).cast("int")
    counts = known.groupBy(F.coalesce("lang", F.lit("")).alias("language"), step.alias("step"), "label").agg(F.count("*").alias("rows"), F.count_if(F.col("trained").isNull()).alias("fresh"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"language": [part["language"].iloc[0]], "own": [calibrated(part)]})

    return counts.groupBy("language").applyInPandas(best, "language string, own double")


def scores(texts: pa.Array, tables: tuple) -> np.ndarray:
    """The score of each text. Filters are looked at ``PLACES`` places at a time, whatever the length of a text."""
    row, kernels, out, bias = tables
    widest = max(WIDTHS)
    text, buckets = word_buckets(texts)
    # each document followed by zero vectors, as in training
    count = np.diff(text.first)
    begin = text.first[:-1] + widest * np.arange(text.n)
    words = np.zeros((len(buckets) + widest * (text.n + 1), 2), np.int32)
    words[np.arange(len(buckets)) + widest * text.document()] = row[buckets]
    total = np.full(text.n, bias)
    for i, (width, parts) in enumerate(zip(WIDTHS, kernels, strict=True)):
        # places of a filter: those of training, which end within the document's own zero vectors
        end = begin + count + widest - width + 1
        top = np.full((text.n, FILTERS), -np.inf, np.float32)
        for lo in range(0, len(words) - widest + 1, PLACES):
            at = np.arange(lo, min(lo + PLACES, len(words) - widest + 1))
            doc = np.searchsorted(begin, at, "right") - 1
            fine = at < end[doc]
            at, doc = at[fine], doc[fine]
            if not len(at):
                continue
            values = np.zeros((len(at), FILTERS), np.float32)
            for j in range(width):
                values += parts[j][words[at + j, 0]]
                values += parts[j][words[at + j, 1]]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            top[doc[first]] = np.maximum(top[doc[first]], np.maximum.reduceat(values, first))
        total += np.maximum(top, 0) @ out[i * FILTERS : (i + 1) * FILTERS]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, tables: tuple, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, score of every row. Null and empty texts have no words, and so the score of zero vectors."""
    given = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by BUCKETS and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores(part.column(2), given.value))], ["id", "lang", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang string, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted (by ``threshold``), language_threshold, flagged (by that of the row's
    language, ``threshold`` where it has none) of every row of docs."""
    tables, trained = fit(docs, labels)
    scores = stash(score(docs, tables), "scores")
    own = stash(thresholds(scores, labels, trained), "thresholds")  # one row a language
    rows = scores.join(F.broadcast(own), F.coalesce("lang", F.lit("")) == F.col("language"), "left").withColumn("own", F.coalesce("own", F.lit(threshold)))
    return rows.select("id", held_out(F.col("id"), MODULUS, HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("own").alias("language_threshold"), (F.col("score") >= F.col("own")).cast("int").alias("flagged"))
