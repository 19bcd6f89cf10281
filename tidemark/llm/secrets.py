"""Secret scans: base patterns, and a linear-chain conditional random field that tags tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches

# The base kinds, in their order.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = 0, 1, 2
BITS = 15  # of a hashed feature
MASKED = (0, 2, 4, 6)  # features that name a word or a neighbour, or begin with its first letters
SAMPLE = 800  # documents with a base secret to learn from, about, and half as many others
SAMPLE_CHARS = 20_000  # of a document to learn from
U = np.uint64


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


_CLASS = np.full(256, 4, np.uint8)  # other symbols
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 2, 1, 0, 3
_CLASS[[ord(c) for c in "=:"]] = 5
_IS = [_CLASS == k for k in range(6)]
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[48:58] = _HEXDIGIT[97:103] = True


def features(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each token (tokens x features), and the number of the line that it stands in.

    Of the token: its hash, its shape (classes of characters, runs collapsed), its first characters, and length with the
    classes that occur. Of its neighbours: hash and shape. Of its file: how many tokens hold = or :, with the token's
    place in its line.
    """
    data, n = w.data, len(w.start)
    h = w.hashes()
    counts = [np.append(0, np.cumsum(x[data])) for x in _IS]
    part = [c[w.end] - c[w.start] for c in counts]
    hexes = np.append(0, np.cumsum(_HEXDIGIT[data]))
    length = w.end - w.start
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[w.start] = True
    power, inverse = words._power_tables(len(data) + 1)
    rank = np.cumsum(change)
    total = np.append(np.zeros(1, U), np.cumsum(np.where(change, (kind.astype(U) + U(11)) * U(0x9E3779B97F4A7C15) * power[rank], U(0)), dtype=U))
    shape = words.mix((total[w.end] - total[w.start]) * inverse[rank[w.start]])
    size = np.minimum(length, 40) // 3
    marks = sum(((part[k] > 0).astype(np.int64) << k) for k in range(6))
    look = (size * 64 + marks) * 4 + (hexes[w.end] - hexes[w.start] == length) * 2 + (part[2] * 3 > length)
    head = words.context_hash(data.astype(U), w.start, np.minimum(w.start + 4, w.end))
    newline = np.append(0, np.cumsum(data == 10))[w.start]
    fresh = np.ones(n, bool)
    fresh[1:] = (newline[1:] != newline[:-1]) | (w.row[1:] != w.row[:-1])
    line = np.cumsum(fresh) - 1
    place = np.arange(n) - np.flatnonzero(fresh)[line]
    rows = len(w.first) - 1
    share = np.bincount(w.row, part[5] > 0, rows) / np.maximum(np.diff(w.first), 1)
    file = np.digitize(share, (0.005, 0.02, 0.1))[w.row] * 4 + np.minimum(place, 3)
    far = U(0)
    before = lambda x: np.where(fresh, far, np.append(np.zeros(1, U), x[:-1]))
    last = np.append(fresh[1:], True)
    after = lambda x: np.where(last, far, np.append(x[1:], np.zeros(1, U)))
    raw = [h, shape, head, look.astype(U), before(h), before(shape), after(h), after(shape), file.astype(U), np.zeros(n, U)]
    out = np.empty((n, len(raw)), np.int32)
    for k, x in enumerate(raw):
        out[:, k] = (words.mix(x + U(k * 0x1234567 + 1)) >> U(64 - BITS)).astype(np.int32)
    return out, line


@dataclass
class Field:
    weight: np.ndarray  # features x tags
    change: np.ndarray  # tag before x tag
    start: np.ndarray

    def emissions(self, found: np.ndarray) -> np.ndarray:
        total = self.weight[found[:, 0]]
        for k in range(1, found.shape[1]):
            total = total + self.weight[found[:, k]]
        return total

    def decode(self, emit: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The likeliest tags of each line, by Viterbi over all lines at once.

        Lines in which no token can gain on being outside, whatever its neighbours are, are outside as a whole.
        """
        tags = np.zeros(len(emit), np.int8)
        if not len(emit):
            return tags
        t, flat = self.change, self.change[OUT, OUT]
        gain = np.full(len(emit), -np.inf)
        for y in (BEGIN, INSIDE):
            into = max(t[:, y].max() - flat, self.start[y] - self.start[OUT])
            gain = np.maximum(gain, emit[:, y] - emit[:, OUT] + into + max(0.0, t[y, OUT] - flat))
        live = np.unique(line[gain > 0])
        first = np.searchsorted(line, live)
        size = np.searchsorted(line, live, "right") - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        if not len(live):
            return tags
        score = self.start + emit[first]
        back = []
        for k in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -k, "left"))  # lines longer than k
            step = score[:n, :, None] + t
            best = step.argmax(1)
            back.append(best.astype(np.int8))
            score[:n] = np.take_along_axis(step, best[:, None], 1)[:, 0] + emit[first[:n] + k]
        now = score.argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -k, "left"))
            tags[first[:n] + k] = now[:n]
            if k:
                now[:n] = back[k - 1][np.arange(n), now[:n]]
        return tags


def train(found: np.ndarray, tags: np.ndarray, line: np.ndarray, rounds: int = 40, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Adam on the conditional log-likelihood of the lines' tags, by forward and backward sums over all lines at once."""
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(first, len(line)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    k_max = int(size[0])
    live = [int(np.searchsorted(-size, -k, "left")) for k in range(k_max)]
    p = [np.zeros((1 << BITS, 3)), np.zeros((3, 3)), np.zeros(3)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    flat, one = found.ravel(), np.repeat(np.arange(len(found)), found.shape[1])
    soft = lambda x, axis: (top := x.max(axis, keepdims=True)) .squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, rounds + 1):
        field = Field(*p)
        emit = field.emissions(found)
        alpha = [field.start + emit[first]]
        for k in range(1, k_max):
            alpha.append(soft(alpha[-1][: live[k], :, None] + field.change, 1) + emit[first[: live[k]] + k])
        beta = np.zeros((len(first), 3))
        d = np.zeros_like(emit)
        g = [None, np.zeros((3, 3)), np.zeros(3)]
        end = np.array([soft(alpha[s - 1][i][None], 1)[0] for i, s in enumerate(size)])
        for k in range(k_max - 1, -1, -1):
            n = live[k]
            d[first[:n] + k] = np.exp(alpha[k][:n] + beta[:n] - end[:n, None])
            if k:
                into = emit[first[:n] + k] + beta[:n]
                both = np.exp(alpha[k - 1][:n, :, None] + field.change + into[:, None] - end[:n, None, None])
                g[1] += both.sum(0)
                np.subtract.at(g[1], (tags[first[:n] + k - 1], tags[first[:n] + k]), 1)
                beta[:n] = soft(field.change[None] + into[:, None], 2)
        g[2] = d[first].sum(0) - np.bincount(tags[first], minlength=3)
        d[np.arange(len(tags)), tags] -= 1
        g[0] = np.stack([np.bincount(flat, d[one, y], 1 << BITS) for y in range(3)], 1)
        for i in range(3):
            x = g[i] / len(first) + decay * p[i]
            m[i] += 0.1 * (x - m[i])
            v[i] += 0.01 * (x**2 - v[i])
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(p[0].astype(np.float32), p[1], p[2])


def _heads(w: words.Words) -> np.ndarray:
    """Code points before each byte, and one more."""
    return np.append(0, np.cumsum((w.data & 192) != 128))


def learn(docs: DataFrame, text: str = "text", id: str = "doc_id") -> Field | None:
    """A field learnt from base spans as labels, on about SAMPLE documents that have one and half as many that have none.

    Documents are picked by a hash of their ids, those whose whole text has a base form apart from others, and the first
    SAMPLE_CHARS of each are learnt from; what reaches the driver is bounded by these parameters. Every line is learnt twice,
    the second time with what names it masked (MASKED): so that the field finds values that look like secrets beside words
    that the base patterns do not know. None without a base span.
    """
    known = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    marked = known.withColumn("has", F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    counts = {r["has"]: r["n"] for r in marked.groupBy("has").agg(F.count("*").alias("n")).collect()}
    if not counts.get(True):
        return None
    share = F.when(F.col("has"), F.lit(min(1.0, SAMPLE / counts[True]))).otherwise(F.lit(min(1.0, SAMPLE / 2 / max(1, counts.get(False, 0)))))
    picked = marked.where(F.pmod(F.xxhash64("id", F.lit("secrets")), F.lit(1_000_003)) / 1_000_003 < share)
    texts = pa.record_batch({"text": pa.array([r["text"] for r in sorted(picked.select("id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect())], pa.string())})
    parts, lines = [], 0
    for part in words.chunks(texts, "text", words.CHUNK_BYTES // 2):
        w = words.split_words(part.column("text"))
        if not len(w.start):
            continue
        found, line = features(w)
        heads = _heads(w)
        tags = np.zeros(len(line), np.int64)
        for row, t in enumerate(part.column("text").to_pylist()):
            at = slice(w.first[row], w.first[row + 1])
            start, end = heads[w.start[at]] - heads[w.offsets[row]], heads[w.end[at]] - heads[w.offsets[row]]
            for a, b, _ in base_spans(t):
                i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
                tags[w.first[row] + i : w.first[row] + j] = INSIDE
                tags[w.first[row] + i] = BEGIN
        # every line with a secret, and every eighth of the others
        pick = np.isin(line, np.unique(line[tags > 0])) | (words.mix(line.astype(U)) % U(8) == 0)
        masked = found[pick]
        masked[:, MASKED] = 0
        parts += [(found[pick], tags[pick], line[pick] + lines), (masked, tags[pick], line[pick] + lines + int(line[-1]) + 1)]
        lines += 2 * (int(line[-1]) + 1)
    if not parts:
        return None
    found, tags, line = (np.concatenate(x) for x in zip(*parts))
    return train(found, tags, line) if tags.any() else None


def scan(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The other columns with n_assign, n_access, n_hex, base_sha256 and spans, over every whole text.

    Spans are ``kind:start:end`` in code points, by start and then kind, joined by commas. The field's are of kind ``crf``;
    one that overlaps a base span is left out. A null text is an empty one. Columns with the names of results are replaced;
    repeated rows and null ids are rows like others; of kinds that begin together the one listed first comes first.
    """
    docs = docs.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                spans = [base_spans(t) for t in texts]
                if field is not None:
                    w = words.split_words(part.column(text))
                    found, line = features(w) if len(w.start) else (np.zeros((0, 1), np.int32), np.zeros(0, np.int64))
                    tags = field.decode(field.emissions(found), line) if len(line) else np.zeros(0, np.int8)
                    heads = _heads(w)
                    begin = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & np.append(True, (tags[:-1] == OUT) | (line[1:] != line[:-1]))[: len(tags)]))
                    for i in begin:
                        j = i
                        while j + 1 < len(tags) and tags[j + 1] == INSIDE and line[j + 1] == line[i]:
                            j += 1
                        row = w.row[i]
                        a, b = int(heads[w.start[i]] - heads[w.offsets[row]]), int(heads[w.end[j]] - heads[w.offsets[row]])
                        if not any(x < b and a < y for x, y, k in spans[row] if k != "crf"):
                            spans[row].append((a, b, "crf"))
                show = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))))
                base = [[x for x in s if x[2] != "crf"] for s in spans]
                columns = [pa.array([sum(x[2] == k for x in s) for s in base], pa.int64()) for k in KINDS[:3]]
                columns.append(pa.array([hashlib.sha256(show(s).encode()).hexdigest() for s in base], pa.string()))
                columns.append(pa.array([show(s) for s in spans], pa.string()))
                yield pa.record_batch([*(part.column(c) for c in names), *columns], names=[*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(rest)
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, LongType())
    return docs.mapInArrow(run, schema.add("base_sha256", StringType()).add("spans", StringType()))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, learn(docs))
