import math
import random
import re

import numpy as np

from tidemark.llm import leaks

SMALL = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def benchmark(spark, sf="sf0.01"):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]


def exact_scores(items, passage):
    """BM25 of each item against a passage's distinct words, as a share of the item's score with itself."""
    split = {i: WORD.findall(t.translate(SMALL)) for i, t in items}
    n, mean = len(items), np.mean([len(w) for w in split.values()])
    df = {}
    for w in split.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for i, w in split.items():
        part = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (leaks.K1 + 1) / (w.count(x) + leaks.K1 * (1 - leaks.B + leaks.B * len(w) / mean)) for x in set(w)}
        out[i] = sum(v for x, v in part.items() if x in passage) / sum(part.values())
    return out


def test_retrieval_is_exact(spark):
    items = benchmark(spark)
    index = leaks.build(items)
    rnd = random.Random(2)
    texts = [WORD.findall(t.translate(SMALL)) for _, t in items]
    for _ in range(40):
        a, b = rnd.choice(texts), rnd.choice(texts)
        passage = set(rnd.sample(a, rnd.randint(0, len(a))) + rnd.sample(b, rnd.randint(0, len(b))))
        import pyarrow as pa

        from tidemark.llm import words

        h = np.unique(words.split_words(pa.array([" ".join(sorted(passage))]), True).hashes())
        at = np.searchsorted(index.vocabulary, h)
        _, item, score = leaks.candidates(index, at, np.full(len(at), 5), 0.5)
        want = {i: s for i, s in exact_scores(items, passage).items() if s >= 0.5}
        got = dict(zip(index.ids[item].tolist(), score))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_planted_items_are_found_and_clean_documents_left(spark):
    got = {(r["doc_id"], r["item_id"]) for r in leaks.op10_decontamination(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {(d["doc_id"], i) for i, t in benchmark(spark) for d in docs if t in (d["text"] or "")}
    assert got == want and got


def test_defined_cases_and_shards(spark, monkeypatch):
    items = [(1, "What is the capital of the moon people now? It is a town called Luna Nova there."), (2, None), (3, ""), (4, "tiny"), (None, "x")]
    text = "Some words before this. " + items[0][1] + " And after."
    rows = [(10, text, 1, 2.0), (11, "word " * 50000 + text, 1, 2.0), (12, items[0][1][:40], 1, 2.0), (13, None, 1, 2.0), (14, "", 1, 2.0), (10, text, 1, 2.0), (None, text, 1, 2.0), (15, "a tiny one", 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(10, 1), (11, 1), (15, 4)]
    assert sorted((r["id"], r["item_id"]) for r in leaks.find(docs, bench).collect()) == want
    monkeypatch.setattr(leaks, "SHARD_BYTES", 20)
    assert sorted((r["id"], r["item_id"]) for r in leaks.find(docs, bench).collect()) == want
    assert leaks.find(docs, bench.limit(0)).count() == 0 and leaks.find(docs.limit(0), bench).count() == 0


def test_scores_do_not_depend_on_shards(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [{tuple(r[:2]): round(r["score"], 9) for r in leaks.find(docs, items, threshold=0.3, overlap=0.0, shard_bytes=b).collect()} for b in (4 << 20, 16_000)]
    assert rows[0] and rows[0] == rows[1]
