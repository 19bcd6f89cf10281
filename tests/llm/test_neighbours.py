import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def area(score, label):
    """Chance that a text with label 1 scores above one with label 0."""
    one, zero = score[label == 1], score[label == 0]
    return ((one[:, None] > zero[None]).mean() + 0.5 * (one[:, None] == zero[None]).mean()).item()


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in neighbours.op11_quality_classifier(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    score, label = np.array([got[r["doc_id"]]["score"] for r in labels]), np.array([r["quality"] for r in labels])
    assert len(label) > 1000 and area(score, label) > 0.99
    assert ((score >= 0.5) == (label == 1)).mean() > 0.98 and (score[label == 0] < 0.5).mean() > 0.95


def test_votes_are_the_brute_force():
    rng = np.random.default_rng(5)
    model = neighbours.Model(np.ones(1), np.ones((1, 1)), neighbours._unit(rng.normal(size=(400, 12)).astype(np.float32)), rng.integers(0, 2, 400).astype(float))
    model.vectors[50:60] = model.vectors[7]  # ties
    queries = neighbours._unit(np.vstack([rng.normal(size=(600, 12)), np.zeros((1, 12)), model.vectors[7:8]]).astype(np.float32))
    got = model.scores(queries, 9)
    for q, s in zip(queries, got):
        cosine = np.round(model.vectors @ q, 5)
        best = sorted(range(400), key=lambda i: (-cosine[i], i))[:9]
        weight = np.maximum(cosine[best], 0).astype(float)
        assert abs(s - (weight @ model.labels[best] / weight.sum() if weight.sum() > 0 else model.labels.mean())) < 1e-4
    assert (neighbours.Model(model.weights, model.space, model.vectors[:3], np.ones(3)).scores(queries, 9)[:-2] == 1).all()


def test_terms_do_not_depend_on_their_neighbours():
    texts = ["One two two, THREE!! 44", None, "", "a|b | c", "ü é\n\nx", " lead", "x" * 100_000]
    whole = neighbours.terms(pa.array(texts))
    assert whole.shape == (7, neighbours.PARTS * neighbours.BUCKETS) and not whole[1:3].any()
    for i, t in enumerate(texts):
        assert np.array_equal(neighbours.terms(pa.array([t], pa.string()))[0], whole[i])


def test_defined_cases(spark):
    rnd = random.Random(2)
    good = ["the plain words of a text about nothing much".split(), "it is some other text with words".split()]
    rows = [(i, " ".join(rnd.choices(good[i % 2], k=30)) if i < 40 else " ".join(w.upper() + "!!" for w in rnd.choices(good[0], k=30)), "x", 0.1) for i in range(80)]
    rows += [(80, None, None, None), (81, "", "x", None), (None, "words", "x", None), (82, "LOUD!! " * 200_000, "x", None), (3, rows[3][1], "x", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, score double")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)] + [(None, 1), (1, None), (500, 1), (2, 1)], "doc_id long, quality int")
    model = neighbours.fit(docs, labels)
    assert len(model.labels) == 40
    got = [(r["doc_id"], r["score"]) for r in neighbours.scored(docs, model).select("doc_id", "score", "key").collect()]
    assert len(got) == len(rows) and all(s > 0.9 for i, s in got if i is not None and i < 40) and all(s < 0.1 for i, s in got if i is not None and 40 <= i < 80)
    score = dict(got)
    assert score[80] == score[81] == 0.5 and score[82] < 0.5
    none = neighbours.fit(docs, labels.limit(0))
    assert {r["score"] for r in neighbours.scored(docs, none).collect()} == {0.5}
    assert neighbours.scored(docs.limit(0), model).count() == 0
    assert len(neighbours.fit(docs, labels, sample=11).labels) <= 11
    assert neighbours.scored(docs.where(F.col("doc_id") == 3), model).count() == 2
