"""Runs of words that repeat with a period, found through the dictionary of basic factors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from . import words
from .common import bounded_batches

POWER = 4  # a run has so many of its periods at least
LEAST = 6  # and so many words
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs and for no others."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    name = np.empty(len(a), np.int64)
    name[order] = np.cumsum(new) - 1
    return name


def _same(ids: np.ndarray, low: int, high: int, period: int) -> np.ndarray:
    return ids[low:high] == ids[low + period : high + period]


def _extended(ids: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch [start, end) within [low, high) around ``at`` whose words are those a period later, as far as they go.

    Steps double, so that a stretch costs about its own length.
    """
    end, step = at, 64
    while end < high - period:
        stop = min(end + step, high - period)
        same = _same(ids, end, stop, period)
        if not same.all():
            end += int(same.argmin())
            break
        end, step = stop, 2 * step
    start, step = at, 64
    while start > low:
        stop = max(start - step, low)
        same = _same(ids, stop, start, period)[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = stop, 2 * step
    return start, end + period


def runs(ids: np.ndarray, text: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Every run (start, length, period) of words ``ids``, numbered through; ``text`` is a word's row, ``first`` a row's first word.

    For k = 0, 1, ... the factors of 2**k words are named by pairs of names before, at the places that may still recur. A
    run of period q, with 2**(k - 1) < q <= 2**k, is at least 4 q words long, so the factor at its start comes again after q
    words, not earlier, and once more after 2 q: the successors within 2 * 2**k form an arithmetic progression whose
    head is the run's start. Each head of a progression of three proposes its difference; the proposal is extended both ways
    and kept if long enough. A multiple of a run's period is proposed for the same words; the least stays.
    """
    place = np.arange(len(ids))
    name, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 0
    known: dict[tuple[int, int], int] = {}
    longest = int(np.diff(first).max(initial=0))
    while len(place) and (1 << k) < max(longest // 2, 2):
        # occurrences of a name inside one text, in order of place as they come
        order = np.argsort(text[place] * len(ids) + name, kind="stable")
        p, v = place[order], name[order]
        next_ = np.full(len(p), -1)
        linked = (v[1:] == v[:-1]) & (text[p[1:]] == text[p[:-1]])
        next_[:-1][linked] = (p[1:] - p[:-1])[linked]
        again = np.zeros(len(p), bool)  # the same difference once more
        again[:-1] = linked & (next_[:-1] == next_[1:])
        head = again & (next_ > 0) & (next_ <= 2 << k)
        head[1:] &= ~(linked & (next_[1:] == next_[:-1]))
        done: dict[tuple[int, int], int] = {}  # (row, period): the end of the last stretch looked at
        for at, period in sorted(zip(p[head].tolist(), next_[head].tolist())):
            row = int(text[at])
            if done.get((row, period), -1) > at + period:
                continue  # inside that stretch
            start, end = _extended(ids, at, period, int(first[row]), int(first[row + 1]))
            done[row, period] = end
            if end - start >= max(LEAST, POWER * period) and known.get((start, end), period + 1) > period:
                known[start, end] = period
        # a longer factor can recur only where both of its halves do
        several = np.zeros(len(p), bool)
        several[:-1] |= linked
        several[1:] |= linked
        recurs = np.full(len(ids) + 1, -1)
        recurs[p[several]] = v[several]
        left = np.flatnonzero(recurs[:-1] >= 0)
        right = left + (1 << k)
        inside = right < len(ids)
        left, right = left[inside], right[inside]
        both = (recurs[right] >= 0) & (text[left] == text[right])
        place = left[both]
        name = _names(recurs[place], recurs[right[both]])
        k += 1
    for (start, end), period in sorted(known.items(), key=lambda x: (x[0][0], x[1])):
        yield start, end - start, period


def word_ids(w: words.Words) -> np.ndarray:
    """Equal numbers for equal words, by the words themselves."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    data, at = words.gather(w.data, w.start, w.end)
    return words.binary_array(data, at).dictionary_encode().indices.to_numpy().astype(np.int64)


def looped(first: np.ndarray, keys: list) -> np.ndarray:
    """For each word of the texts the number of the word that stands there once loops are planted, as the key of a text says."""
    source = np.arange(first[-1])
    for row, key in enumerate(keys):
        low, n = int(first[row]), int(first[row + 1] - first[row])
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[low + a : low + n] = low + a + np.arange(n - a) % p
    return source


def with_runs(docs: DataFrame, text: str = "text", key: str | None = None, planted: Callable[[np.ndarray, list], np.ndarray] | None = None) -> DataFrame:
    """The other columns with n_words, runs (start, length, period) and collapsed, the bytes of the text without repetitions.

    A run is a stretch of words with the smallest period q, of POWER * q and LEAST words at least, that no neighbour extends;
    ``runs`` ascend by start, then period. ``collapsed`` has the words that no run contains after its first q words, joined by
    a space. ``planted`` may put words of a text elsewhere first, given the texts' first words and the column ``key``.

    A null or empty text has no words and no runs. A text is always whole in one task, in memory of some tens of bytes a word;
    it is never shuffled. Repeated rows get equal results. Columns named as results are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*({"n_words", "runs", "collapsed"} - {text, key}))
    rest = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            for part in words.chunks(batch, text):
                w = words.split_words(part.column(text))
                source = planted(w.first, part.column(key).to_pylist()) if planted else np.arange(len(w.start))
                ids = word_ids(w)[source]
                found = np.array(list(runs(ids, w.row, w.first)), np.int64).reshape(-1, 3)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 0] + found[:, 1], -1)
                keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                stays = source[keep]
                data, at = words.gather(w.data, w.start[stays], w.end[stays], 1)
                if len(stays):
                    data = data.copy()
                    data[at[1:] - 1] = 32
                edge = at[np.searchsorted(keep, w.first)]
                texts = [data[a : b - 1].tobytes() if b > a else b"" for a, b in zip(edge[:-1], edge[1:])]
                row = w.row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                found[:, 0] -= w.first[row]
                flat = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.record_batch(
                    [*(part.column(f.name) for f in rest), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(offsets), flat).cast(kind), pa.array(texts, pa.binary())],
                    names=[*(f.name for f in rest), "n_words", "runs", "collapsed"],
                )

    schema = StructType([*rest]).add("n_words", LongType()).add("runs", ArrayType(RUN)).add("collapsed", BinaryType())
    return docs.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest power (ties: smallest start, then period), and digests of runs and collapsed text."""
    names = ("start", "length", "period", "exponent_milli")
    schema = StructType(found.select("doc_id").schema.fields).add("n_runs", LongType())
    for c in names:
        schema = schema.add(c, LongType())
    schema = schema.add("runs_sha256", "string").add("collapsed_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, text in zip(batch.column("runs").to_pylist(), batch.column("collapsed").to_pylist()):
                best = None
                for r in one:  # they ascend by start, then period: the first of equals stays
                    if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                        best = r
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in one)
                four = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                rows.append((len(one), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=schema.names)

    return found.mapInArrow(run, schema)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs, once loops are planted in some by their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(with_runs(docs, key="doc_id", planted=looped).select("doc_id", "runs", "collapsed"))
