"""Benchmark decontamination by a BM25 index of the test items with block-max pruning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, cut

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the score that an item has with itself
OVERLAP = 0.6  # of the 5-word shingles of the question, and of those of the answer
SHINGLE = 5
SHARD_BYTES = 4 << 20  # of item texts that one index, and so one broadcast, is made of
BLOCK = 8  # items
RARE = 0.04  # share of a shard's items up to which a term's postings are walked for every passage
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Index:
    """Items in id order, in blocks of BLOCK. An impact is a BM25 term score as a share of the item's score with itself."""

    ids: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes
    first: np.ndarray  # of each term's postings
    item: np.ndarray  # of the postings, ascending in a term
    impact: np.ndarray
    block_first: np.ndarray  # of each term's block maxima
    block: np.ndarray
    block_max: np.ndarray
    rare: np.ndarray  # terms
    rest: np.ndarray  # of each block: the most that its items can get from terms that aren't rare
    longest: int  # words of an item
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # of each item: words of a shingle and shingles, for question and answer


@dataclass
class Corpus:
    """Of all items, whatever shards they are dealt into: their number, mean and greatest words, and the items of each term."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]  # of the terms that a shard has


def build(items: list[tuple[int, str]], corpus: Corpus | None = None) -> Index | None:
    """The index of a shard's items, or of all where no corpus is given. None where no item has a word."""
    items = sorted((i, t) for i, t in items if t is not None and i is not None)
    column = pa.array([t for _, t in items], pa.string())
    w = words.split_words(column, True)
    if not len(w.start):
        return None
    h, n = w.hashes(), len(items)
    length = np.diff(w.first)
    vocabulary, term = np.unique(h, return_inverse=True)
    pair, tf = np.unique(term * n + w.row, return_counts=True)
    term, item = pair // n, pair % n
    df = np.bincount(term, minlength=len(vocabulary))
    whole = corpus or Corpus(n, float(length[length > 0].mean()), int(length.max()), {})
    count = np.array([whole.df[int(v)] for v in vocabulary.view(np.int64)]) if corpus else df
    idf = np.log(1 + (whole.n - count + 0.5) / (count + 0.5))
    score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / whole.mean))
    impact = score / np.bincount(item, score, n)[item]
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    key = term * (n // BLOCK + 1) + item // BLOCK
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    block_term = term[at]
    rare = df <= max(1, int(RARE * n))
    common = np.bincount(item, np.where(rare[term], 0, impact), n)
    rest = np.zeros(n // BLOCK + 1)
    np.maximum.at(rest, np.arange(n) // BLOCK, common)
    parts = []
    for row, (_, t) in enumerate(items):
        own = h[w.first[row] : w.first[row + 1]]
        last = words.split_words(pa.array([SENTENCE.split(t.strip())[-1]]), True)
        cut = max(0, len(own) - max(SHINGLE, len(last.start)))
        parts.append(tuple((k := min(SHINGLE, len(x)), _shingles(x, k)) for x in (own[:cut] if cut else own, own[cut:])))
    return Index(np.array([i for i, _ in items]), vocabulary, first, item, impact, np.searchsorted(block_term, np.arange(len(vocabulary) + 1)), (item // BLOCK)[at], np.maximum.reduceat(impact, at), rare, rest, whole.longest, parts)


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    return np.unique(words.shingles(h, np.zeros(len(h), np.int64), k)[0]) if k else np.zeros(0, np.uint64)


def _spread(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``term``, the postings of that term: index of the place, index of the posting."""
    size = first[term + 1] - first[term]
    place = np.repeat(np.arange(len(term)), size)
    return place, np.arange(len(place)) + np.repeat(first[term] - (np.cumsum(size) - size), size)


def candidates(index: Index, term: np.ndarray, passage: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (passage, item, score) with at least the threshold, given the distinct (passage, term) pairs by passage.

    Block-max pruning of all passages at once: for each block of items the maxima of a passage's rare terms are added to
    the most that the block's items can get from other terms; blocks below the threshold are skipped whole, the items of
    the others are scored exactly.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pick = np.flatnonzero(index.rare[term])
    place, at = _spread(index.block_first, term[pick])
    if not len(at):
        bound_key, bound = np.zeros(0, np.int64), np.zeros(0)
    else:
        blocks = len(index.rest)
        bound_key, inverse = np.unique(passage[pick][place] * blocks + index.block[at], return_inverse=True)
        bound = np.bincount(inverse, index.block_max[at])
    keep = bound + index.rest[bound_key % len(index.rest)] >= threshold - 1e-9
    bound_key = bound_key[keep]
    if (alone := np.flatnonzero(index.rest >= threshold - 1e-9)).size:  # common terms may do there, so no passage is skipped
        every = np.unique(passage)
        bound_key = np.unique(np.concatenate([bound_key, (every[:, None] * len(index.rest) + alone).ravel()]))
    if not len(bound_key):
        return none
    hit = np.isin(passage, np.unique(bound_key // len(index.rest)))
    passage, term = passage[hit], term[hit]
    place, at = _spread(index.first, term)
    open_block = np.isin(passage[place] * len(index.rest) + index.item[at] // BLOCK, bound_key)
    place, at = place[open_block], at[open_block]
    key, inverse = np.unique(passage[place] * len(index.ids) + index.item[at], return_inverse=True)
    score = np.bincount(inverse, index.impact[at]) if len(key) else np.zeros(0)
    good = score >= threshold - 1e-9
    return key[good] // len(index.ids), key[good] % len(index.ids), score[good]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, words): each distinct term of each item, and a row without a term that has its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words.split_words(batch.column("text"), True)
            ids = batch.column("item_id").to_numpy()
            row, term = np.unique(np.stack([w.row, w.hashes().view(np.int64)]), axis=1) if len(w.start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.record_batch({"item_id": pa.array(ids[row]), "term": pa.array(term), "words": pa.nulls(len(row), pa.int64())})
            yield pa.record_batch({"item_id": pa.array(ids), "term": pa.nulls(len(ids), pa.int64()), "words": pa.array(np.diff(w.first).astype(np.int64))})

    return items.select("item_id", "text").mapInArrow(run, "item_id long, term long, words long")


def find(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_id: str = "item_id", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, item_id, score, question, answer): the items that a document has leaked from, one row each.

    A document's passages are windows of twice the words of the longest item, each half of which begins another, so that
    any item stands whole in one. A passage queries the index with its distinct words and retrieves every item with at
    least ``threshold`` of the item's score with itself; it has leaked if at least ``overlap`` of the 5-word shingles of
    the item's question, and of those of its answer, stand in the passage. The answer is the last sentence, or the
    last five words if it is shorter; the question is what is before it, or all where that is nothing; fewer than five
    words are one shingle. Words are runs of letters and digits, ASCII capitals made small. Values are of the best passage.

    Items without words, null texts and null ids match nothing. Rows that share an id must be one row repeated. The items
    are indexed in shards of about ``shard_bytes`` of text, one after the other; one shard at a time is on the driver and
    broadcast. Number, lengths and document frequencies are of all items, so that scores do not depend on the shards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    items = items.where(F.col(item_id).isNotNull() & F.col("text").isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // (shard_bytes // 2))
    if shards > 1:
        terms = cut(item_terms(items))
        size = terms.where("term is null").agg(F.count("*"), F.avg(F.when(F.col("words") > 0, F.col("words"))), F.max("words")).first()
        terms = terms.where("term is not null")
        df = cut(terms.groupBy("term").agg(F.count("*").alias("df")))
    schema = "id long, item_id long, score double, question double, answer double"
    out = None
    for k in range(shards):
        own = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k
        texts = [(r["item_id"], r["text"]) for r in items.where(own).collect()]
        corpus = None
        if shards > 1:
            frequent = df.join(terms.where(own).select("term").distinct(), "term")  # as many as the shard has words at most
            corpus = Corpus(size[0], size[1] or 1.0, size[2] or 0, {r["term"]: r["df"] for r in frequent.collect()})
        index = build(texts, corpus)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            half = index.longest
            for batch in batches:
                for part in words.chunks(batch, "text"):
                    w = words.split_words(part.column("text"), True)
                    h = w.hashes()
                    if not len(h):
                        continue
                    place = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
                    known = np.flatnonzero(index.vocabulary[place] == h)
                    term = place[known]
                    count = -(-np.diff(w.first) // half)
                    base = np.cumsum(count) - count
                    own = base[w.row[known]] + (known - w.first[w.row[known]]) // half
                    back = known - w.first[w.row[known]] >= half
                    pair = np.unique(np.concatenate([own, own[back] - 1]) * len(index.vocabulary) + np.concatenate([term, term[back]]))
                    passage, item, score = candidates(index, pair % len(index.vocabulary), pair // len(index.vocabulary), threshold)
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for p, i, s in zip(passage, item, score):
                        row = int(np.searchsorted(base, p, "right")) - 1
                        low = w.first[row] + (p - base[row]) * half
                        passage_words = h[low : min(low + 2 * half, w.first[row + 1])]
                        q, a = (np.isin(x, _shingles(passage_words, k)).mean() if len(x) else 1.0 for k, x in index.parts[i])
                        if min(q, a) >= overlap:
                            key = (row, i)
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (float(s), float(q), float(a)))
                    if best:
                        rows = [r for r, _ in best]
                        s, q, a = zip(*best.values())
                        yield pa.record_batch({"id": part.column("id").take(pa.array(rows)), "item_id": pa.array(index.ids[[i for _, i in best]], pa.int64()), "score": pa.array(s), "question": pa.array(q), "answer": pa.array(a)})

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document holds question and answer."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find(docs, items)
    return found.select(F.col("id").alias("doc_id"), "item_id", *(F.round(c, 6).alias(n) for c, n in (("score", "score"), ("question", "question_overlap"), ("answer", "answer_overlap"))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("id").distinct()
    return docs.join(found, docs["doc_id"] == found["id"], "left_anti")
