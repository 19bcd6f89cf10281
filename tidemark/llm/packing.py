"""Packing of documents into sequences by minimum bin slack over the multiset of piece lengths."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

CAPACITY = 2048
END = 1  # the id after each document
SALTS = 64  # parts of a length's pieces, at least
SALT_ROWS = 200_000  # pieces of one length in a part, about, at most
LONG_RUN = 2000  # bytes with or without white space
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def long_run(text: str, limit: int = LONG_RUN) -> bool:
    """Whether a text has that many bytes in a row that are all ASCII white space, or all not."""
    if len(text) * 4 < limit:
        return False
    space = _SPACE[np.frombuffer(text.encode(), np.uint8)]
    edges = np.flatnonzero(np.append(True, space[1:] != space[:-1]))
    return bool((np.diff(np.append(edges, len(space))) >= limit).any())


def byte_ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer as bytes; printable bytes stand for themselves there, others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(sign[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in sign for c in t)}


class Encoder:
    """Ids of a byte-level BPE tokenizer, little-endian unsigned 32-bit.

    Texts are merged by tiktoken over the tokenizer's own vocabulary, which gives the same ids several times as fast; one
    with the string of a special token, or with a run of LONG_RUN bytes, for which tiktoken has no bound of its stack, goes
    through the tokenizer itself. ``pattern`` is what the tokenizer cuts text into before it merges.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=byte_ranks(self.tokenizer), special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if any(s in t for s in self.special) or long_run(t):
                yield array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
            else:
                yield array("I", self.merge(t)).tobytes()


def cut_pieces(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and END, cut into whole sequences and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, pattern)
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("id").to_pylist(), encoder.encode(texts)):
                ids += tail
                total = len(ids) // 4
                for a in range(0, total, capacity):
                    b = min(total, a + capacity)
                    rows.append((doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total))
            yield pa.record_batch(dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)))))

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def padding(total: int, capacity: int = CAPACITY) -> int:
    """Places that a sequence is filled up with: none at a power of two, else up to the capacity."""
    return 0 if total & (total - 1) == 0 else capacity - total


def least_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Sequences (times, {length: count}) that use up the multiset of lengths.

    Minimum bin slack: each sequence holds the longest piece left; a bitset of the sums that subsets of the other lengths
    reach, grown length by length with counts in binary parts, gives the sum nearest to the capacity, and backtracking
    through the bitsets gives the counts. A choice is repeated as often as the multiset allows, so there are at most a few
    choices a length whatever the number of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        top = max(left)
        room = capacity - top
        mask = (1 << (room + 1)) - 1
        stages, reach = [], 1
        for size in sorted(left, reverse=True):
            many = min(left[size] - (size == top), room // size) if size <= room else 0
            part = 1
            while many > 0:
                take = min(part, many)
                stages.append((size, take, reach))
                reach |= (reach << size * take) & mask
                many -= take
                part *= 2
            if reach >> room & 1:
                break
        sums = [s for s in range(room, -1, -1) if reach >> s & 1] if not reach >> room & 1 else [room]
        best = min(sums, key=lambda s: (padding(top + s, capacity), -s))
        chosen, rest = {top: 1}, best
        for size, take, before in reversed(stages):
            if not before >> rest & 1:
                chosen[size] = chosen.get(size, 0) + take
                rest -= size * take
        times = min(left[k] // n for k, n in chosen.items())
        out.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """The pieces with sequence_id and offset.

    The plan is made from the number of pieces of each length alone, at most ``capacity`` numbers; pieces of one length
    are interchangeable, so each gets its place from its rank among them. Ranks are counted in ``salts`` parts of a length, or
    as many more as leave SALT_ROWS pieces to each, for one length may have most of the pieces.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    salts = max(salts, pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    parts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # for each run of equal sequences and each place in it: which ranks of a length stand there
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, chosen in least_slack(counts, capacity):
        at = 0
        for size in sorted(chosen, reverse=True):
            rows.append((size, used[size], used[size] + times * chosen[size], sequence, chosen[size], at))
            used[size] += times * chosen[size]
            at += size * chosen[size]
        sequence += times
    plan = spark.createDataFrame(rows, "length long, low long, high long, first long, each long, at long")
    from pyspark.sql import Window as W

    before = parts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    # the plan has a few rows a length and at most a few thousand in all
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(plan["length"])
    inside = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(inside / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("at") + F.pmod(inside, F.col("each")) * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids, and END after each document, in sequences of at most ``capacity``: one row a piece.

    A null or empty text is END alone. Long texts fill whole sequences, and what is left of each document is packed with
    the rests of others by ``least_slack``. Rows that share an id are packed each; a null id stays null.
    """
    if tokenizer is None or pattern is None:
        import public_tokenizers

        tokenizer, pattern = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    bounded_batches(docs.sparkSession)
    return pack(cut_pieces(docs, tokenizer, pattern, text, id, capacity), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the documents that are left."""
    return packed(docs)
