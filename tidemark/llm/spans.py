"""Removal of word runs that a smaller document already has, by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches

WINDOW = 13  # words of a run that counts
ANCHOR = 4  # words of an anchor
SHARD_WORDS = 100_000  # bound of one automaton
SEEN = 50_000  # segments of one anchor that are remembered whole
CHECK = 8  # bytes of a window's hash: all of them, for a byte a word confuses windows
ROWS = "key long, doc long, pos long, n int, seg binary, checks binary"


class Automaton:
    """A suffix automaton over byte strings, extended string by string."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.size = [-1], [0], 0

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for what p reads with c: q, or q cut down to that length."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, text: bytes) -> None:
        last = 0
        for c in text:
            p = last
            if c in self.next[p]:
                last = self._split(p, c, self.next[p][c])
                continue
            last = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, c, self.next[p][c])
        self.size += len(text)

    def statistics(self, text: bytes) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        state = length = 0
        out = []
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            out.append(length)
        return out


class Shards:
    """The reference segments of one anchor, in automata of at most SHARD_WORDS words each; ``check`` bytes tell a window apart."""

    def __init__(self, check: int = 3) -> None:
        self.check = check
        self.automata: list[Automaton] = []
        self.waiting: list[bytes] = []
        self.seen: set[bytes] = set()
        self.checks: set[bytes] = set()

    def add(self, text: bytes, checks: bytes) -> None:
        if checks not in self.seen:
            self.waiting.append(text)
            self.checks.update(checks[i : i + self.check] for i in range(0, len(checks), self.check))
            if len(self.seen) < SEEN:
                self.seen.add(checks)

    def covered(self, text: bytes, checks: bytes, window: int) -> list[int]:
        """First places of the windows of a segment that the reference has.

        A byte a word lets one window in 256 that differs in one word pass for another; the 64-bit window hashes tell them
        apart, wherever in the reference they come from: a window is covered when its own hash is there.
        """
        if checks in self.seen:
            return list(range(len(text) - window + 1))
        for x in self.waiting:
            if not self.automata or self.automata[-1].size >= SHARD_WORDS:
                self.automata.append(Automaton())
            self.automata[-1].add(x)
        self.waiting = []
        found = {i - window + 1 for a in self.automata for i, n in enumerate(a.statistics(text)) if n >= window}
        return sorted(p for p in found if checks[p * self.check : (p + 1) * self.check] in self.checks)


def _runs(w: words.Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Each run of windows with one anchor: its first word, number of windows and the anchor's hash; and all words' hashes."""
    h = w.hashes()
    start, anchor, value, at = words.anchors(h, w.row, k, window - k + 1)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    hash_at = np.zeros(len(h), np.uint64)
    hash_at[at] = value
    return start[first], np.diff(np.append(first, len(start))), hash_at[anchor[first]], h


def shared_anchors(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc, keys): for each document its anchors that another document has too; what is around others repeats nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", 2 * words.CHUNK_BYTES):
                w = words.split_words(part.column("text"))
                low, _, key, _ = _runs(w, window, k)
                row = w.row[low]
                order = np.lexsort((key, row))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
                order = order[new]
                yield pa.record_batch({"key": pa.array(key[order].view(np.int64)), "doc": part.column("doc").take(pa.array(row[order]))})

    group = W.partitionBy("key")
    found = docs.mapInArrow(run, "key long, doc long").select("doc", "key", (F.min("doc").over(group) < F.max("doc").over(group)).alias("more"))
    return found.where("more").groupBy("doc").agg(F.collect_list("key").alias("keys"))


def segments(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """For each anchor of a document (doc, packed text, keys) among its ``keys`` the run of words that its windows cover, a byte a word.

    An anchor is the smallest hash of the k-word shingles of a window, so two equal windows have the same anchor at the
    same place, and meet under its hash. Inside a chunk of texts only the smallest document with a segment is sent; the
    others are covered whole, and each run of them is one row without ``seg``, dealt by document. ``checks`` has the
    64-bit hash of each window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("keys").is_valid())
            for part in words.chunks(unpacked(batch), "text", 2 * words.CHUNK_BYTES):
                w = words.split_words(part.column("text"))
                low, n, key, h = _runs(w, window, k)
                own = part.column("keys")
                in_row = lambda row, x: words.mix(words.mix(row.astype(np.uint64)) ^ x)
                of = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy())
                meets = np.isin(in_row(w.row[low], key), in_row(of, own.flatten().to_numpy().view(np.uint64)))
                low, n, key = low[meets], n[meets], key[meets]
                if not len(low):
                    continue
                high = low + n + window - 1
                doc = part.column("doc").to_numpy()[w.row[low]]
                pos = low - w.first[w.row[low]]
                content = words.context_hash(h, low, high)
                order = np.lexsort((doc, content, key))
                head = np.ones(len(order), bool)
                head[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
                smallest = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
                later = np.zeros(len(order), bool)
                later[order] = doc[order] > smallest
                data, offsets = words.gather(h.view(np.uint8)[::8], low[~later], high[~later])
                whole, at = words.shingles(h, w.row, window)
                first = np.searchsorted(at, low)
                checks = words.gather(whole.view(np.uint8).reshape(-1, 8)[:, :CHECK], first[~later], (first + n)[~later])
                yield pa.record_batch(
                    {"key": pa.array(key[~later].view(np.int64)), "doc": pa.array(doc[~later]), "pos": pa.array(pos[~later]), "n": pa.array(n[~later].astype(np.int32)), "seg": words.binary_array(data, offsets), "checks": words.binary_array(checks[0], checks[1] * CHECK)}
                )
                if later.any():
                    d, p, m = doc[later], pos[later], n[later]
                    new = np.ones(len(d), bool)  # rows come by document and place
                    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + m[:-1])
                    at = np.flatnonzero(new)
                    m = np.add.reduceat(m, at).astype(np.int32)
                    none = pa.nulls(len(at), pa.binary())
                    yield pa.record_batch({"key": pa.array(d[at]), "doc": pa.array(d[at]), "pos": pa.array(p[at]), "n": pa.array(m), "seg": none, "checks": none})

    return docs.mapInArrow(run, ROWS)


def _match(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor and document: what smaller documents have is in the automata before a document is read."""
        key = shards = current = None
        own: list[tuple[bytes, bytes]] = []
        for batch in batches:
            keys, doc, pos, n = (batch.column(c).to_numpy() for c in ("key", "doc", "pos", "n"))
            seg, checks = batch.column("seg"), batch.column("checks")
            known = seg.is_valid().to_numpy(zero_copy_only=False)
            sent = np.flatnonzero(~known)
            out_doc, out_low, out_high = [doc[sent]], [pos[sent]], [pos[sent] + n[sent] + window - 1]
            rows = np.flatnonzero(known)
            if len(rows):
                k = keys[rows]
                alone = np.ones(len(rows), bool)
                alone[1:] &= k[1:] != k[:-1]
                alone[:-1] &= k[1:] != k[:-1]
                alone[0] = alone[-1] = False  # the group may go on in another batch
                found = []
                for i in rows[~alone]:
                    if keys[i] != key:
                        key, shards, current, own = keys[i], Shards(CHECK), doc[i], []
                    elif doc[i] != current:
                        for x in own:
                            shards.add(*x)
                        current, own = doc[i], []
                    text, check = seg[i].as_py(), checks[i].as_py()
                    if shards.waiting or shards.automata:
                        begin = None
                        for p in shards.covered(text, check, window):
                            if begin is None or p > begin[1] + 1:
                                if begin:
                                    found.append((doc[i], pos[i] + begin[0], pos[i] + begin[1] + window))
                                begin = [p, p]
                            begin[1] = p
                        if begin:
                            found.append((doc[i], pos[i] + begin[0], pos[i] + begin[1] + window))
                    own.append((text, check))
                if found:
                    d, lo, hi = map(np.array, zip(*found))
                    out_doc.append(d), out_low.append(lo), out_high.append(hi)
            yield pa.record_batch({"doc": pa.array(np.concatenate(out_doc).astype(np.int64)), "low": pa.array(np.concatenate(out_low).astype(np.int64)), "high": pa.array(np.concatenate(out_high).astype(np.int64))})

    return run


def repeated_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc, low, high): runs of words, of ``window`` words at least, that also begin in a document with a smaller id.

    The reference of a document is all smaller documents. Its shards are dealt by anchor: the segments around an anchor
    meet in one task, which streams them in document order against bounded automata of those before. Only anchors of two
    documents or more are dealt, which a grouping of their hashes finds first. Runs may overlap.
    """
    bounded_batches(docs.sparkSession, 1000)
    known = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, texts = shared_anchors(known, window), packed(docs, text, id)
    # a left join like that of ``without_spans``, so that both read one shuffle of the texts
    both = texts.join(keys, texts["id"] == keys["doc"], "left").select(F.col("id").alias("doc"), "text", "keys")
    found = segments(both, window).repartition(parts, "key").sortWithinPartitions("key", "doc")
    return found.mapInArrow(_match(window), "doc long, low long, high long")


def packed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Documents as (id, text) with zstd-compressed texts: a shuffle of them writes two thirds of what its own codec would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            small = []
            for t in batch.column("text").to_pylist():
                raw = None if t is None else t.encode()
                small.append(None if raw is None else len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array(small, pa.binary())})

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, text binary")


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = pa.Codec("zstd")
    texts = [None if b is None else codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) for b in batch.column("text").to_pylist()]
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))


def without_spans(docs: DataFrame, spans: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of their spans (doc, low, high), joined by one space.

    A null text has no words and an empty ``kept``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(unpacked(batch), "text"):
                w = words.split_words(part.column("text"))
                count = np.diff(w.first)
                spans = part.column("spans")
                change = np.zeros(len(w.start) + 1, np.int64)
                flat = spans.flatten()
                if len(flat):
                    row = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy())
                    np.add.at(change, w.first[row] + flat.field("low").to_numpy(), 1)
                    np.add.at(change, w.first[row] + flat.field("high").to_numpy(), -1)
                keep = np.cumsum(change)[:-1] == 0
                kept = np.bincount(w.row[keep], minlength=part.num_rows)
                data, at = words.gather(w.data, w.start[keep], w.end[keep], 1)
                data = data.copy()
                data[at[1:] - 1] = 32
                last = at[np.append(0, np.cumsum(kept))]
                raw = data.tobytes()
                texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(last[:-1], last[1:])]
                yield pa.record_batch({"id": part.column("id"), "n_words": pa.array(count), "n_removed": pa.array(count - kept), "kept": pa.array(texts, pa.string())})

    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    docs = packed(docs, text, id)
    both = docs.join(spans, docs["id"] == spans["doc"], "left").select("id", "text", "spans")
    return both.mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that also start in a document with a smaller doc_id.

    Rows that share a doc_id must be one row repeated; a null doc_id is neither smaller nor larger than any.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = without_spans(docs, repeated_spans(docs))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
