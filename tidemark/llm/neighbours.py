"""Quality by nearest neighbours: latent semantic vectors of labelled texts, exact cosines, votes weighted by similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from . import words
from .common import bounded_batches, small_side

SAMPLE = 3000  # labelled rows at most that are learnt from, those with the least hashes of their ids
DIMENSIONS = 48
NEIGHBOURS = 15
BUCKETS = 1024  # hashed terms of a kind
BLOCK = 256  # texts whose cosines with all labelled vectors are held at once
PARTS = 2  # kinds of terms: pairs of bytes, shapes of words
U = np.uint64
#: Bytes in shapes: capitals, letters and digits are a class each, others stand for themselves.
CLASSES = np.arange(256, dtype=np.uint64) + U(4)
CLASSES[65:91], CLASSES[97:123], CLASSES[128:], CLASSES[48:58] = 0, 1, 1, 2


def _shares(row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
    """Roots of each term's share among a row's terms: the cosine of two such rows is the affinity of their distributions."""
    counts = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def terms(column: pa.Array) -> np.ndarray:
    """A row of PARTS * BUCKETS term weights for each text; all zero for a null and an empty one.

    Terms are pairs of neighbouring bytes, and the shape of each word, in which runs of one class are one; a word that
    repeats the word before it is a term of its own instead.
    """
    w = words.split_words(column)
    data, rows = w.data, len(column)
    if not len(data):
        return np.zeros((rows, PARTS * BUCKETS), np.float32)
    of_byte = np.repeat(np.arange(rows), np.diff(w.offsets))
    pair = data[:-1].astype(U) * U(256) + data[1:].astype(U)
    inner = of_byte[1:] == of_byte[:-1]
    pairs = _shares(of_byte[:-1][inner], (words.mix(pair) % U(BUCKETS)).astype(np.int64)[inner], rows)
    cls = CLASSES[data]
    begins = np.ones(len(data), bool)
    begins[1:] = cls[1:] != cls[:-1]
    begins[w.start] = True
    of_word = np.searchsorted(w.start, np.arange(len(data)), "right") - 1
    begins &= (of_word >= 0) & (np.arange(len(data)) < np.append(w.end, 0)[of_word])
    at = np.flatnonzero(begins)
    first = np.searchsorted(of_word[at], np.arange(len(w.start) + 1))
    shape = words.context_hash(words.mix(cls[at] + U(1)), first[:-1], first[1:])
    bucket = (shape % U(BUCKETS - 1)).astype(np.int64) + 1
    h = w.hashes()
    bucket[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])] = 0
    return np.hstack([pairs, _shares(w.row, bucket, rows)])


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-9)


@dataclass
class Model:
    """Weights of the terms, the latent space, and the labelled rows' unit vectors in it: at most SAMPLE * DIMENSIONS numbers."""

    weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        """Latent semantic analysis: the leading right singular vectors of the weighted rows, from their Gram matrix."""
        found = (rows > 0).sum(0)
        weights = (1 + np.log((1 + len(rows)) / (1 + found))).astype(np.float32)
        weighted = (rows * weights).astype(np.float64)
        space = np.linalg.eigh(weighted.T @ weighted)[1][:, ::-1][:, :dimensions].astype(np.float32)
        return Model(weights, space, _unit((rows * weights) @ space), labels.astype(np.float64))

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return _unit((rows * self.weights) @ self.space)

    def scores(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, by similarity.

        Cosines with all labelled vectors, block by block; of several at the last place's cosine the first in the model's order
        stay. A text without similarity to any has the share of label 1 among all, 0.5 where nothing is labelled.
        """
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        k, out = min(neighbours, len(self.labels)), np.empty(len(vectors))
        for low in range(0, len(vectors), BLOCK):
            cosine = np.round(vectors[low : low + BLOCK] @ self.vectors.T, 5)
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            above, level = cosine > last, cosine == last
            taken = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
            votes = np.where(taken, np.maximum(cosine, 0), 0).astype(np.float64)
            total = votes.sum(1)
            out[low : low + BLOCK] = np.where(total > 0, (votes @ self.labels) / np.maximum(total, 1e-12), self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """The model of the labelled documents, ``sample`` at most; their terms are counted in tasks, over whole texts.

    Labels join documents by ``key``; null keys and labels are left out, of a key's repeated rows the least counts. The
    driver gets ``sample`` rows of PARTS * BUCKETS numbers, whatever the length of the texts.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(sample)
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(small_side(chosen, sample), "key")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                rows = pa.array([r.tobytes() for r in terms(part.column("text"))], pa.binary())
                yield pa.record_batch([part.column("key"), part.column("label"), rows], names=["key", "label", "terms"])

    schema = StructType().add("key", docs.schema[key].dataType).add("label", DoubleType()).add("terms", BinaryType())
    rows = some.mapInArrow(run, schema).groupBy("key").agg(F.min(F.struct("label", "terms")).alias("r")).select("key", "r.*").orderBy("key").collect()
    found = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows]) if rows else np.zeros((0, PARTS * BUCKETS), np.float32)
    return Model.of(found, np.array([r["label"] for r in rows]))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns with ``score``, 0 to 1, of every whole text; the model is broadcast, its size bound by ``fit``'s sample.

    A null or an empty text has no terms and gets the share of label 1 among the labelled rows. Equal texts get equal
    scores, wherever they stand; a column named score is replaced. A long text is counted whole in one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = [f for f in docs.schema.fields if f.name not in (text, "score")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, text):
                score = np.round(shared.value.scores(shared.value.embed(terms(part.column(text)))), 6)
                yield pa.record_batch([*(part.column(f.name) for f in rest), pa.array(score)], names=[*(f.name for f in rest), "score"])

    return docs.mapInArrow(run, StructType([*rest]).add("score", DoubleType()))


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels of those whose id's CRC-32 leaves 0 or 2 by 3."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(third != 1)
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
