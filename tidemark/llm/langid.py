"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 12, 8
SAMPLE = 400  # documents a language to learn from, about
SAMPLE_WINDOWS = 4  # of a document
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    """Embedded bytes, filters of several widths, the largest response of each over a window, softmax."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # features x languages
    out_bias: np.ndarray

    def lookup(self) -> list[list[np.ndarray]]:
        """For each width and place in it, what a byte adds to the filters' responses."""
        return [[(self.embed @ f[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        tables = self.lookup()
        out = np.zeros((len(windows), len(self.languages)))
        for i in range(0, len(windows), block):
            part, pooled = windows[i : i + block], []
            for w, places in zip(WIDTHS, tables):
                n = part.shape[1] - w + 1
                response = places[0][part[:, :n]]
                for j in range(1, w):
                    response += places[j][part[:, j : j + n]]
                pooled.append(response.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + block] = z / z.sum(1, keepdims=True)
        return out


def train(windows: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> Network:
    """Adam on the cross entropy of windows, whatever their number; deterministic."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    features = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.3, (256, EMBED)), *(rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS), np.zeros(features), rng.normal(0, 0.2, (features, len(languages))), np.zeros(len(languages))]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            x, t = windows[order[at : at + batch]], y[order[at : at + batch]]
            n = len(x)
            e = p[0][x]
            pooled, where = [], []
            for k, w in enumerate(WIDTHS):
                s = x.shape[1] - w + 1
                patch = np.concatenate([e[:, j : j + s] for j in range(w)], 2)
                response = patch @ p[1 + k]
                top = response.argmax(1)
                where.append((top, np.take_along_axis(patch, top[:, :, None], 1)))
                pooled.append(np.take_along_axis(response, top[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + p[-3]
            hidden = np.maximum(raw, 0)
            z = hidden @ p[-2] + p[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(n), t] -= 1
            d /= n
            g = [np.zeros_like(q) for q in p]
            g[-1], g[-2] = d.sum(0), hidden.T @ d
            back = (d @ p[-2].T) * (raw > 0)
            g[-3] = back.sum(0)
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                top, patch = where[k]
                g[1 + k] = np.einsum("nf,nfd->df", b, patch)
                into = (b[:, :, None] * p[1 + k].T[None]).reshape(n, FILTERS, w, EMBED)
                for j in range(w):
                    np.add.at(g[0], np.take_along_axis(x, top + j, 1), into[:, :, j])
            step += 1
            for i in range(len(p)):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.001 * (g[i] ** 2 - v[i])
                p[i] = p[i] - (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1])


def text_windows(column: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text cut whole into windows of ``size`` bytes, the last filled with zeros: windows, row of each, its bytes."""
    data, offsets = words.text_bytes(column)
    length = np.diff(offsets)
    count = -(-length // size)
    row = np.repeat(np.arange(len(length)), count)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    used = np.minimum(size, offsets[row + 1] - start)
    index = start[:, None] + np.arange(size)
    data = np.append(data, np.zeros(1, np.uint8))
    return np.where(np.arange(size) < used[:, None], data[np.minimum(index, len(data) - 1)], 0).astype(np.uint8), row, used


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> Network | None:
    """A network from about ``sample`` documents a language, picked by a hash of their ids; None without any.

    What reaches the driver is bounded by that parameter and SAMPLE_WINDOWS windows a document.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    picked = known.where(draw < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                got, row, _ = text_windows(part.column("text"))
                if not len(row):
                    continue
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                pick = np.unique(np.concatenate([np.linspace(a, b - 1, SAMPLE_WINDOWS).astype(int) for a, b in zip(first[:-1], first[1:]) if b > a]))
                yield pa.record_batch({"id": part.column("id").take(pa.array(row[pick])).cast(pa.int64()), "lang": part.column("lang").take(pa.array(row[pick])), "w": pa.array([x.tobytes() for x in got[pick]], pa.binary())})

    rows = sorted(picked.mapInArrow(run, "id long, lang string, w binary").collect())
    if not rows:
        return None
    return train(np.frombuffer(b"".join(r["w"] for r in rows), np.uint8).reshape(len(rows), WINDOW), [r["lang"] for r in rows])


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """The documents' columns, lang_pred and score: the language likeliest over all windows of the whole text, by bytes.

    ``und`` and 0 where the text is null or has no letter, or nothing could be learnt. Columns of the same names are replaced.
    Of languages that are equally likely the first by name is taken; repeated rows and null ids are rows like others.
    """
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, text):
                n = part.num_rows
                names, scores = [UNKNOWN] * n, np.zeros(n)
                if network is not None:
                    windows, row, used = text_windows(part.column(text))
                    if len(row):
                        p = network.probabilities(windows) * used[:, None]
                        total = np.zeros((n, p.shape[1]))
                        np.add.at(total, row, p)
                        total /= np.maximum(np.bincount(row, used, n), 1)[:, None]
                        best = total.argmax(1)
                        for i, t in enumerate(part.column(text).to_pylist()):
                            if t is not None and LETTER.search(t):
                                names[i], scores[i] = network.languages[best[i]], min(1.0, float(total[i, best[i]]))
                yield pa.record_batch([*(part.column(c) for c in columns if c != text), pa.array(names), pa.array(scores)], names=[*(c for c in columns if c != text), "lang_pred", "score"])

    schema = [f for f in docs.schema.fields if f.name != text]
    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType([*schema]).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out(id):
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language by a network that has seen no document of the held-out fifth."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), network)


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a language, or with one less likely than ``least``, go."""
    bounded_batches(spark)
    network = learn(docs)
    row = docs.select(F.struct("*").alias("row"), F.col("text"))
    return predict(row, network).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
