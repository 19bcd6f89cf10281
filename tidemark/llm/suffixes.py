"""Passages that repeat across documents, by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, cut

MIN_WORDS = 50
ANCHOR = 5
SPREAD = 40  # shingles among which a suffix's place is the smallest
SYMBOL = 3  # bytes of a word
ROWS = "key long, doc long, pos long, suffix binary, before binary, twin long, twin_pos long"


def sparse_suffixes(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR, spread: int = SPREAD) -> DataFrame:
    """The suffixes at minimiser positions, three bytes of hash a word: ``min_words`` words of each, and the words before it.

    Any passage of ``min_words`` words has a minimiser in its first ``spread`` shingles, so what two documents share
    begins at most spread - 1 words before a suffix of both, whose first min_words - spread + 1 words are equal.
    Inside a chunk of texts, of suffixes with the same words around only the smallest document's is sent; the others
    are repeats for certain and say so in a row without ``suffix`` that names that document and place in ``twin`` and
    ``twin_pos``, with the words around in number alone.
    """
    least, back = min_words - spread + 1, spread - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                w = words.split_words(part.column("text"))
                h = w.hashes()
                _, anchor, _, _ = words.anchors(h, w.row, k, spread)
                anchor = np.unique(anchor)
                if not len(anchor):
                    continue
                end = w.first[w.row[anchor] + 1]
                anchor, end = anchor[end - anchor >= least], end[end - anchor >= least]
                begin = w.first[w.row[anchor]]
                low, high = np.maximum(anchor - back, begin), np.minimum(anchor + min_words, end)
                fits = high - low >= min_words
                anchor, low, high, begin = anchor[fits], low[fits], high[fits], begin[fits]
                doc = part.column("doc").to_numpy()[w.row[anchor]]
                key = words.context_hash(h, anchor, anchor + least)
                content = words.context_hash(h, low, high) + (anchor - low).astype(np.uint64)
                order = np.lexsort((doc, content))
                head = np.ones(len(order), bool)
                head[1:] = content[order][1:] != content[order][:-1]
                twin = np.zeros(len(order), np.int64)
                twin[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
                later = doc > doc[twin]
                pos = anchor - begin
                symbol = h.view(np.uint8).reshape(-1, 8)[:, :SYMBOL]
                own = ~later
                right, left = words.gather(symbol, anchor[own], high[own]), words.gather(symbol, low[own], anchor[own])
                yield pa.record_batch(
                    {"key": pa.array(key[own].view(np.int64)), "doc": pa.array(doc[own]), "pos": pa.array(pos[own]), "suffix": words.binary_array(right[0], right[1] * SYMBOL), "before": words.binary_array(left[0], left[1] * SYMBOL), "twin": pa.nulls(int(own.sum()), pa.int64()), "twin_pos": pa.nulls(int(own.sum()), pa.int64())}
                )
                if later.any():
                    n = int(later.sum())
                    # key and pos hold the words before and after the place
                    yield pa.record_batch({"key": pa.array((anchor - low)[later]), "doc": pa.array(doc[later]), "pos": pa.array(pos[later]), "suffix": pa.nulls(n, pa.binary()), "before": words.binary_array(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)), "twin": pa.array(doc[twin][later]), "twin_pos": pa.array(((high - anchor)[later] << 40) | pos[twin][later])})

    return docs.mapInArrow(run, ROWS)


def _common(x: bytes, y: bytes) -> int:
    """Words of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // SYMBOL
    a, b = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    return int(np.argmax(a != b)) // SYMBOL


def _common_end(x: bytes, y: bytes) -> int:
    return _common(x[::-1], y[::-1])


def _windows(s: bytes, b: bytes, min_words: int) -> Iterator[tuple[int, bytes]]:
    """The passages of min_words words around a suffix, by the number of words before it."""
    text, back = b + s, len(b) // SYMBOL
    for o in range(back, max(0, min_words - len(s) // SYMBOL) - 1, -1):
        yield o, text[(back - o) * SYMBOL : (back - o + min_words) * SYMBOL]


def _extend(run: list[tuple[int, int, bytes, bytes]], min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(doc, pos, low, high, source) for a run of neighbouring suffixes (doc, pos, suffix, before) that begin alike."""
    out = []
    if len(run) == 2:
        (d1, p1, s1, b1), (d2, p2, s2, b2) = sorted(run)
        if d1 != d2:
            right, left = _common(s1, s2), _common_end(b1, b2)
            if left + right >= min_words:
                out.append((d2, p2, p2 - left, p2 + right, d1))
        return out
    if len({r[0] for r in run}) == 1:
        return out
    first: dict[bytes, int] = {}
    for d, _, s, b in run:
        for _, x in _windows(s, b, min_words):
            if first.get(x, d) >= d:
                first[x] = d
    for d, p, s, b in run:
        own: list[tuple[int, int, int, int, int]] = []
        for o, x in _windows(s, b, min_words):
            if (f := first[x]) < d:
                if own and own[-1][4] == f and own[-1][3] >= p - o:
                    own[-1] = (d, p, own[-1][2], p - o + min_words, f)
                else:
                    own.append((d, p, p - o, p - o + min_words, f))
        out += own
    return out


FOUND = ("doc", "pos", "low", "high", "source", "twin_pos")


def _batch(found: list[tuple]) -> pa.RecordBatch:
    """Rows of FOUND; ``twin_pos`` is null but for suffixes that a chunk has left out, whose source is their twin."""
    return pa.record_batch(dict(zip(FOUND, (pa.array(x, pa.int64()) for x in zip(*(r if len(r) == 6 else (*r, None) for r in found))))))


def _neighbours(min_words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes, bytes]] = []
        found: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                found.extend(_extend(group, min_words))
            group.clear()

        for batch in batches:
            doc, pos, key = (batch.column(c).to_numpy() for c in ("doc", "pos", "key"))
            before, twin, place = (batch.column(c) for c in ("before", "twin", "twin_pos"))
            for i, s in enumerate(batch.column("suffix").to_pylist()):
                if s is None:
                    at = place[i].as_py()
                    found.append((int(doc[i]), int(pos[i]), int(pos[i] - key[i]), int(pos[i]) + (at >> 40), twin[i].as_py(), at & ((1 << 40) - 1)))
                    continue
                if group and group[-1][2][: least * SYMBOL] != s[: least * SYMBOL]:
                    close()
                group.append((int(doc[i]), int(pos[i]), s, before[i].as_py()))
            if found:
                yield _batch(found)
                found.clear()
        close()
        if found:
            yield _batch(found)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping parts of a passage become one maximal span, whose source is the smallest of theirs."""
    for batch in batches:
        out = []
        for doc, parts in zip(batch.column("doc").to_pylist(), batch.column("parts").to_pylist()):
            low = high = source = None
            for p in sorted((x["low"], x["high"], x["source"]) for x in parts):
                if high is not None and p[0] <= high:
                    high, source = max(high, p[1]), min(source, p[2])
                    continue
                if high is not None:
                    out.append((doc, low, high - low, source))
                low, high, source = p
            out.append((doc, low, high - low, source))
        yield pa.record_batch(dict(zip(("doc", "start", "n_words", "source"), (pa.array(x, pa.int64()) for x in zip(*out)))) if out else {c: pa.array([], pa.int64()) for c in ("doc", "start", "n_words", "source")})


def repeated_passages(docs: DataFrame, text: str = "text", id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, start, n_words, source): maximal runs of words made of passages of ``min_words`` words that a document with
    a smaller id has too; ``source`` is the smallest such document of the run.

    Words are as in ``words``; a null text has none, a null id is left out, and rows that share an id must be one row
    repeated. Other columns are not read. Suffixes are dealt by their first words, sorted in each task, and compared with their
    neighbours: those that begin alike stand together, and matches are extended to the right and to the left of the place.
    Those are one task's work and stand in its memory. A suffix that a chunk has left out takes the sources of its twin as
    well, so that spans and sources are the same however rows lie in files.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 1000)
    docs = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sparse_suffixes(docs, min_words)
    dealt = rows.repartition(parts, F.when(F.col("twin").isNotNull(), F.xxhash64("doc", "pos")).otherwise(F.col("key"))).sortWithinPartitions("suffix", "doc")
    found = dealt.mapInArrow(_neighbours(min_words, min_words - SPREAD + 1), ", ".join(f"{c} long" for c in FOUND))
    found = cut(found)
    twins = found.where("twin_pos is not null").withColumnRenamed("twin_pos", "from")
    found = found.where("twin_pos is null")
    # all that a twin shares around the place lies inside the words around, so the least of its sources is the suffix's too
    none = F.lit(None).cast("long")
    known = found.select(F.col("doc").alias("source"), F.col("pos").alias("from"), F.col("source").alias("first"), none.alias("doc"), none.alias("low"), none.alias("high"))
    twins = twins.select("source", "from", none.alias("first"), "doc", "low", "high").unionByName(known)
    twins = twins.withColumn("first", F.min("first").over(W.partitionBy("source", "from"))).where("doc is not null").select("doc", "low", "high", F.coalesce("first", "source").alias("source"))
    every = found.select("doc", "low", "high", "source").unionByName(twins)
    return every.groupBy("doc").agg(F.collect_set(F.struct("low", "high", "source")).alias("parts")).mapInArrow(_merged, "doc long, start long, n_words long, source long")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that repeat a document with a smaller doc_id; one row a span."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = repeated_passages(docs)
    return out.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.col("source").alias("source_doc_id"))
