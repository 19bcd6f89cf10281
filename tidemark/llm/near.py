"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, cut, link_buckets, shared

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
U = np.uint64


def weighted_shingles(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by row: (row, hash, weight), the weight being 1 + ln(count).

    A text of fewer than k words is one shingle; a text without words has none.
    """
    w = words.split_words(text)
    h = w.hashes()
    value, at = words.shingles(h, w.row, k)
    row = w.row[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = [words.mix(np.add.reduce(h[w.first[r] : w.first[r + 1]] * (np.arange(n[r]).astype(U) * U(2) + U(3)), keepdims=True))[0] for r in short]
        value, row = np.concatenate([value, np.array(whole, U)]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(value)))
    return row[at], value[at], 1.0 + np.log(count)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """k coordinates for each weighted set; two sets agree on a coordinate with probability their weighted Jaccard.

    Each element owns the region [0, weight) x [0, inf) of weight and rank. Darts fall on it as a Poisson process that
    depends on the element alone: on each weight cell [0,1), [1,2), [2,4), ... they come in order of rank, at the cell's
    width. Those under a rank that gives k ln k + 2k darts to a set are thrown; each has a coordinate, and the earliest
    of a coordinate is kept. Sets with a coordinate left empty are thrown at again with twice the rank.
    """
    out = np.zeros((rows, k), U)
    total = np.bincount(row, weight, rows)
    todo = np.flatnonzero(total > 0)
    rank = np.zeros(rows)
    rank[todo] = (k * np.log(k) + 2 * k) / total[todo]
    while len(todo):
        pick = np.isin(row, todo, kind="table") if len(todo) < rows else np.ones(len(row), bool)
        r, v, w = row[pick], value[pick], weight[pick]
        found = []
        low, width = 0.0, 1.0
        while True:
            on = np.flatnonzero(w > low)
            if not len(on):
                break
            seed = words.mix(v[on] ^ U((0x5851F42D4C957F2D * (int(low) + 1)) % 2**64))
            at, step = np.zeros(len(on)), 0
            live = np.arange(len(on))
            while len(live):
                s = words.mix(seed[live] + U((0x9E3779B97F4A7C15 * (step + 1)) % 2**64))
                at[live] -= np.log(_uniform(s)) / width
                live_ok = at[live] <= rank[r[on[live]]]
                live, s = live[live_ok], s[live_ok]
                dart = words.mix(s + U(0xA0761D6478BD642F))
                hit = low + width * _uniform(words.mix(dart + U(1))) < w[on[live]]
                found.append((r[on[live]][hit], (dart[hit] % U(k)).astype(np.int64), at[live][hit], dart[hit]))
                step += 1
            low, width = low + width, max(1.0, low + width)
        where, slot, when, dart = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((when, slot, where))
        where, slot, dart = where[order], slot[order], dart[order]
        first = np.ones(len(where), bool)
        first[1:] = (where[1:] != where[:-1]) | (slot[1:] != slot[:-1])
        out[where[first], slot[first]] = dart[first] | U(1)
        full = np.bincount(where[first], minlength=rows)
        todo = todo[full[todo] < k]
        rank[todo] *= 2
        out[todo] = 0
    return out


def signatures(docs: DataFrame, text: str = "text", id: str = "doc_id", bands: int = BANDS, band_rows: int = BAND_ROWS, weighted: bool = False) -> DataFrame:
    """(id, exact, n, bands): a digest of the word sequence, the number of shingles, and a hash per band.

    Each distinct shingle weighs 1, as in the sets that are compared, or 1 + ln(count) if ``weighted``. One pass over the
    texts, no shuffle. Null ids, and texts without a word, have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                w = words.split_words(part.column("text"))
                h = w.hashes()
                row, value, weight = weighted_shingles(part.column("text"))
                weight = weight if weighted else np.ones(len(row))
                sketch = dart_minhash(row, value, weight, part.num_rows, bands * band_rows)
                band = np.zeros((part.num_rows, bands), U)
                for j in range(band_rows):
                    band = words.mix(band + sketch[:, j::band_rows][:, :bands] + U(j))
                band = words.mix(band + np.arange(bands).astype(U)).view(np.int64)
                some = np.flatnonzero(np.diff(w.first) > 0)
                digest = [hashlib.md5(h[w.first[i] : w.first[i + 1]].tobytes()).digest() for i in some]
                yield pa.record_batch(
                    {
                        "id": part.column("id").take(pa.array(some)),
                        "exact": pa.array(digest, pa.binary()),
                        "n": pa.array(np.bincount(row, minlength=part.num_rows)[some].astype(np.int64)),
                        "bands": pa.FixedSizeListArray.from_arrays(pa.array(band[some].ravel()), bands).cast(pa.list_(pa.int64())),
                    }
                )

    docs = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "id long, exact binary, n long, bands array<long>")


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(id, item): the distinct shingles of documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                row, value, _ = weighted_shingles(part.column("text"))
                yield pa.record_batch({"id": part.column("id").take(pa.array(row)), "item": pa.array(value.view(np.int64))})

    return docs.select("id", "text").mapInArrow(run, "id long, item long")


def similar_pairs(pairs: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b) of docs (id, text) whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "y"):
                keep = []
                sets = []
                for side in ("x", "y"):
                    for piece in words.chunks(part, side):
                        row, value, _ = weighted_shingles(piece.column(side))
                        sets += np.split(value, np.searchsorted(row, np.arange(1, piece.num_rows)))
                n = part.num_rows
                for p, q in zip(sets[:n], sets[n:]):
                    low = min(len(p), len(q)) < threshold * max(len(p), len(q))
                    both = 0 if low else len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= threshold * (len(p) + len(q) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = docs.select(F.col("id").alias("a"), F.col("text").alias("x")), docs.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents: (id, class), the class being its smallest id, for every non-null id.

    Documents with the same words are one class. Others are linked when the sets of their 5-word shingles have at least
    the given Jaccard similarity, candidates being those that agree on a whole band of a DartMinHash signature whose
    elements weigh the same; classes are the components of the links. A text of fewer than five words is one shingle.
    Null and empty texts, and texts of separators only, are each a class of their own. Rows that share an id are one
    document: their rows must be the same. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    signed = cut(signatures(docs, id="id"))
    head = signed.groupBy("exact").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    many = head.where("head < last").select("exact", "head")
    copies = cut(signed.select("id", "exact").join(many, "exact").select("id", "head").distinct())
    single = signed.join(copies.where("id <> head"), "id", "left_anti")
    members = cut(shared(single.select("id", F.explode("bands").alias("bucket"))))
    near = cut(members.select("id").distinct())
    texts = cut(docs.join(near, "id", "left_semi").dropDuplicates(["id"]))
    items = lambda ids: shingle_rows(texts.join(ids, "id", "left_semi"))
    groups = link_buckets(members, lambda p: similar_pairs(p, texts, threshold), items, threshold)
    found = copies.join(groups.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("component", "head").alias("class"))
    found = found.unionAll(groups.select("id", F.col("component").alias("class"))).groupBy("id").agg(F.min("class").alias("class"))
    return docs.select("id").distinct().join(found, "id", "left").select(F.col("id"), F.coalesce("class", "id").alias("class"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates; the smallest doc_id of a class stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), (F.col("id") == F.col("class")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    keep = near_duplicates(docs).where("id = class").select("id")
    return docs.join(keep, docs["doc_id"] == keep["id"], "left_semi")
