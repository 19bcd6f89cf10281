import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """All runs by comparing every word with that of every distance."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda x: (x[0], x[2]))


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if n and doc_id is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()


def test_query_is_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in periods.op13_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    some = [d for d in docs if len(d["text"] or "") < 12000]
    assert len(some) > 900 and all(got[d["doc_id"]] == brute(*d) for d in some)
    assert sum(r[1] > 0 for r in got.values()) > 50


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_all_runs_of_random_words(letters):
    """Several texts in one chunk, so that no run crosses their borders."""
    rnd = random.Random(letters)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            t = []
            while rnd.random() < 0.8:
                block = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
                t += block * rnd.choice([1, 1, 2, 4, 5, 9]) + block[: rnd.randint(0, len(block))]
            texts.append(t)
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        ids, row = np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = list(periods.runs(ids, row, first))
        assert got == [(s + int(first[k]), length, q) for k, t in enumerate(texts) for s, length, q in brute_runs(t)]


def test_defined_cases(spark):
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (None, "a b " * 10, 5, "x"), (4, "a b c\n" * 4, 5, "x"), (5, "one " * 300_000, 5, "x"), (5, "one " * 300_000, 5, "x"), (6, "é ü\t" * 3 + "é", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = periods.with_runs(docs).collect()
    assert [r["n_words"] for r in got] == [0, 0, 20, 8, 300_000, 300_000, 7]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[], [], [(0, 20, 2)], [(0, 8, 2)], [(0, 300_000, 1)], [(0, 300_000, 1)], []]
    assert [bytes(r["collapsed"]).decode() for r in got] == ["", "", "a b", "a b c", "one", "one", "é ü é ü é ü é"]
    assert periods.digests(periods.with_runs(docs)).where("n_runs = 0").count() == 3
    assert periods.with_runs(docs.limit(0)).count() == 0


def test_long_text_with_large_periods(spark):
    rnd = random.Random(4)
    block = [str(rnd.randrange(10**9)) for _ in range(20_000)]
    text = " ".join(["head"] + block * 4 + block[:10] + ["tail"])
    got = periods.with_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(1, 80_010, 20_000)]
    assert bytes(got["collapsed"]).decode() == " ".join(["head"] + block + ["tail"])
