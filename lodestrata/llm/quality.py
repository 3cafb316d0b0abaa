"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A document's features are its words, their coarse shapes, and pairs of neighbours, hashed into one table; each counts
with its share of the document's n-grams. A score is the logistic function of a sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import batches
from .words import U64, Words, as_strings, mix, slices

BITS = 18
SCALE = 40.0
_UPPER, _LOWER, _DIGIT, _OTHER = 1, 2, 3, 0
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _LOWER


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and where each text's begin (one more at the end)."""
    words = Words(texts)
    hashes, n = words.hashes(), len(words.start)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    if n:
        kinds = _CLASS[words.data]
        size = words.end - words.start
        shape = kinds[words.start].astype(U64) | kinds[words.start + (size > 1)].astype(U64) << U64(2) | kinds[words.end - 1].astype(U64) << U64(4)
        shape |= words.data[words.end - 1].astype(U64) * (kinds[words.end - 1] == _OTHER) << U64(8)
        shape |= np.minimum(np.log2(size).astype(U64), U64(5)) << U64(16)
    else:
        shape = hashes
    pair = row[1:] == row[:-1]
    same = hashes[1:] == hashes[:-1]
    two = np.where(same, U64(7), mix(hashes[1:] * U64(3) + hashes[:-1]))[pair]
    shapes = mix(shape[1:] * U64(5) + shape[:-1] + U64(1 << 40))[pair]
    found = np.concatenate([hashes, mix(shape + U64(1 << 41)), two, shapes])
    rows = np.concatenate([row, row, row[1:][pair], row[1:][pair]])
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(texts) + 1))
    return (found[order] >> U64(64 - bits)).astype(np.int64), first


class FollowTheLeader:
    """FTRL-proximal logistic regression with per-coordinate rates."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the intercept

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        sigma = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient**2


def fit(docs: DataFrame, known: DataFrame, bits: int = BITS, most: int = 4000, rounds: int = 3) -> np.ndarray:
    """Weights learned from docs (doc_id, text) and known labels (doc_id, label); the intercept comes last.

    Learns from the documents of at most `most` labels: those whose doc_id hashes lowest, so the choice doesn't depend
    on partitions. It is made on ids alone, before texts are read, and what is broadcast has `most` rows. Rows with a
    null label are left out; with no labelled row all weights are 0 and every score is a half. A repeated doc_id counts once, with its least text.
    """
    chosen = known.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).toPandas().sort_values("doc_id")
    model, size = FollowTheLeader(bits), 1 << bits
    ready = []
    for low in range(0, len(sample), 500):
        part = sample.iloc[low : low + 500]
        found, first = features(as_strings(pa.array(part["text"].tolist(), pa.string())), bits)
        for k, label in enumerate(part["label"]):
            at, counts = np.unique(found[first[k] : first[k + 1]], return_counts=True)
            values = SCALE * counts / max(1, counts.sum())
            ready.append((np.append(at, size), np.append(values, 1.0), int(label)))
    for turn in range(rounds):
        for k in np.random.default_rng(turn).permutation(len(ready)):
            model.update(*ready[k])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document, its whole text read. Null and empty texts get the score of the intercept alone."""
    spark = docs.sparkSession
    batches(spark)
    bits = (len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for frame in frames:
            texts, scores = as_strings(frame.column("text")), []
            for low, high in slices(texts):
                found, first = features(texts.slice(low, high - low), bits)
                total = np.concatenate([[0.0], np.cumsum(table[found], dtype=np.float64)])
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))
                scores.append(1 / (1 + np.exp(-np.clip(SCALE * mean + table[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def remainder(doc_id: str, by: int):
    """crc32 of a doc_id's text modulo `by`."""
    return F.crc32(F.col(doc_id).cast("string")) % by


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 4000) -> DataFrame:
    """Score all documents, learning from the labelled ones outside the held-out quarter.

    One row per row of `docs`: doc_id, held_out, score, predicted. A null doc_id is not held out (and has no label).
    Of several labels for a doc_id the lowest counts; repeated documents are scored each; other columns are ignored.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    weights = fit(rows, known.where(remainder("doc_id", 4) != 2), most=most)
    return score(rows, weights).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
