import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity=2048):
    """Each id in exactly one piece, sequences gapless from 0; returns the padding's share."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == {d for d, _ in docs}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    pad = total = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        pad, total = pad + packing.padding(at), total + at
    return pad / (pad + total)


def test_round_trip_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = packing.op3_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(rows, docs) < 0.002


def test_defined_cases(spark):
    rnd = random.Random(1)
    odd = ["", None, " ", "  a  b", "a \nb", "a\n \nb\n ", "x<|endoftext|>y z", "a\0b c", "été déjà vu's don't 12 3.5", "\tq \t w", "w " * 9000, "end ", " ½² ٣ 字字", "   x   y"]
    docs = list(enumerate(odd)) + [(100 + i, "".join(rnd.choice(" \n\tab1.é'") for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, length long, rank long, salt long").repartition(3)
    check(packing.packed(df).collect(), docs)
    assert packing.packed(df.limit(0)).count() == 0
    twice = packing.packed(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in twice) == [(0, 2), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


def test_least_slack_is_optimal_for_one_sequence_and_uses_all():
    rnd = random.Random(7)
    for _ in range(60):
        counts = {rnd.randint(1, 60): rnd.randint(1, 4) for _ in range(rnd.randint(1, 7))}
        plan = packing.least_slack(counts, 64)
        used = defaultdict(int)
        for times, chosen in plan:
            assert sum(k * n for k, n in chosen.items()) <= 64
            for k, n in chosen.items():
                used[k] += times * n
        assert used == counts
        reach = {0}
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(items))
        for k in items:
            reach |= {s + k for s in reach}
        best = min(packing.padding(max(counts) + s, 64) for s in reach if max(counts) + s <= 64)
        first = plan[0][1]
        assert packing.padding(sum(k * n for k, n in first.items()), 64) == best


def test_long_runs_give_the_tokenizer_s_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "\t" * 200_000, "a" * 200_000, "x" + " " * 5000 + "y", "\u3000" * 3000, "字" * 3000, "plain text, don't worry"]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert list(np.frombuffer(ids, "<u4")) == plain.encode(t, add_special_tokens=False).ids
