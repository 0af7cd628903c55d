"""Quality classifier: supervised subword embeddings.

The words of a text, marks for words that repeat one of the two before them, and the character n-grams
within words are hashed to ``BUCKETS`` vectors; a document is
the mean of the vectors of all it has, and a softmax over it gives the classes. Vectors and softmax are
trained together with plain stochastic gradient descent in numpy on a bounded sample of labelled documents.
For scoring, each vector's product with the softmax weights is taken once, so a document costs one look-up
per word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.samples import held_out, labelled_sample
from tessella.llm.textbytes import CHUNK_BYTES, MULTIPLIER, Text, chunks, inverse, mix, powers

BUCKETS, DIMENSIONS, NGRAMS = 1 << 16, 8, (3, 4)
#: Documents of each class that a model is fitted on, and bytes of their texts, at most.
PER_CLASS, CLASS_BYTES = 1500, 1 << 23
#: Vectors after those of the buckets: of words that repeat the one before them, and the one before that.
REPEATS = 2
EPOCHS, RATE, SEED = 6, 1.0, 1
MODULUS, HELD, THRESHOLD = 4, 2, 0.7


def features(text: Text, buckets: int, ngrams: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all words, of repeated words, then of all n-grams of each size.

    n-grams are of characters; they may start before a word and end after it, but hold no white space inside. They
    are taken by blocks of bytes, so that a very long text needs little more memory than a short one.
    """
    data, words, of = text.data, text.word_hashes(), text.document()
    yield of, (words & np.uint64(buckets - 1)).astype(np.int64)
    for lag in range(1, REPEATS + 1):
        again = np.flatnonzero((words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])) + lag
        yield of[again], np.full(len(again), buckets + lag - 1, np.int64)
    more = 4 * max(ngrams, default=0)  # bytes that the last n-gram of a block may take
    up, down = powers(MULTIPLIER, min(CHUNK_BYTES + more, len(data))), powers(inverse(MULTIPLIER), min(CHUNK_BYTES + more, len(data)))
    for lo in range(0, len(data), CHUNK_BYTES):
        block = data[lo : lo + CHUNK_BYTES + more]
        chars = np.flatnonzero((block & 0xC0) != 0x80)
        space = np.zeros(len(chars) + 1, np.int64)
        blank = block[chars]
        np.cumsum((blank == 0x20) | ((blank >= 9) & (blank <= 13)), out=space[1:])
        edge = np.r_[chars, len(block)]
        doc = np.searchsorted(text.offsets, lo + chars, "right") - 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
            sums = sums[edge]
            for n in ngrams:
                if len(chars) < n:
                    continue
                fine = (space[n - 1 : -1] == space[1 : 1 - n]) & (doc[n - 1 :] == doc[: len(doc) - n + 1]) & (chars[: len(chars) - n + 1] < CHUNK_BYTES)
                at = np.flatnonzero(fine)
                yield doc[at], (mix((sums[at + n] - sums[at]) * down[chars[at]]) & np.uint64(buckets - 1)).astype(np.int64)


def bags(rows: DataFrame, buckets: int, ngrams: tuple[int, ...]) -> DataFrame:
    """id, label, buckets, counts of the sampled rows: at most ``buckets`` entries a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = Text(part.column(2))
                size = buckets + REPEATS
                key = np.concatenate([doc * size + b for doc, b in features(text, buckets, ngrams)])
                key, count = np.unique(key, return_counts=True)
                cut = np.searchsorted(key, np.arange(text.n + 1) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(count.astype(np.float32)))], ["id", "label", "buckets", "counts"])

    return rows.select("id", "label", "text").mapInArrow(run, "id long, label int, buckets array<int>, counts array<float>")


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax weights and biases from (label, buckets, counts) of each sampled document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets + REPEATS, dimensions)).astype(np.float32)
    weights, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
    samples = [(y, b, (c / max(c.sum(), 1))[:, None]) for y, b, c in samples]
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, b, share = samples[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = (vectors[b] * share).sum(0)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            vectors[b] -= step * share * back
    return vectors, weights, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = MODULUS, held: int = HELD, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and the odds' constant. Without documents of both
    labels all scores are one half."""
    rows = bags(labelled_sample(docs, labels, label_col, modulus, held, per_class, CLASS_BYTES), BUCKETS, NGRAMS).toArrow()  # a bounded sample
    rows = rows.sort_by("id")
    samples = [(y, np.asarray(b.values, np.int64), np.asarray(c.values, np.float32)) for y, b, c in zip(rows["label"].to_pylist(), rows["buckets"], rows["counts"], strict=True)]
    if len({y for y, _, _ in samples}) < 2:
        return np.zeros(BUCKETS + REPEATS, np.float32), 0.0
    vectors, weights, bias = train(samples)
    return vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def scores(texts: pa.Array, value: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text."""
    text = Text(texts)
    total, count = np.zeros(text.n), np.zeros(text.n)
    for doc, bucket in features(text, BUCKETS, NGRAMS):
        total += np.bincount(doc, value[bucket], text.n)
        count += np.bincount(doc, minlength=text.n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (the softmax of class 1) of every row; a text without words gets the bias alone. Null texts are empty."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = given.value
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1), value, bias))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of every row of docs: see ``fit`` and ``score``."""
    return score(docs, fit(docs, labels)).select("id", held_out(F.col("id"), MODULUS, HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
