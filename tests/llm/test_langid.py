import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tidemark.llm import langid


def test_held_out_accuracy_and_defined_cases(spark):
    got = langid.op8_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in out) and sum(r["held_out"] for r in rows) == len(out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out if r["lang_pred"] != "und"]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nulls_no_letters_long_texts_and_nothing_learnt(spark):
    text = "the cat sat on the mat and "
    rows = [(i, text * 5, "en", "x", 0.5) for i in range(8)] + [(i, "el gato está en la mesa y " * 5, "es", "x", 0.5) for i in range(8, 16)]
    rows += [(20, None, "en", None, None), (21, "", None, None, None), (22, "12 34 %", None, None, None), (23, text * 20000, None, None, None), (23, text, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred_ string, score_ double")
    got = {}
    for r in langid.predict(df, langid.learn(df)).collect():
        got[r["doc_id"]] = (r["lang_pred"], r["score"])
    assert [got[i] for i in (20, 21, 22)] == [("und", 0.0)] * 3
    assert got[23][0] == "en" and got[0][0] == "en" and got[9][0] == "es"
    empty = df.limit(0)
    assert langid.learn(empty) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(empty, None).count() == 0


def test_lookup_equals_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 32)).astype(np.uint8)
    net = langid.train(x, list("ababa"), epochs=1)
    e = net.embed[x]
    pooled = []
    for w, f in zip(langid.WIDTHS, net.filters):
        patch = np.concatenate([e[:, j : j + 33 - w] for j in range(w)], 2)
        pooled.append((patch @ f).max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(p, net.probabilities(x), atol=1e-5)


def test_windows_cover_whole_texts():
    w, row, used = langid.text_windows(pa.array(["a" * 300, None, "", "b"]))
    assert row.tolist() == [0, 0, 3] and used.tolist() == [256, 44, 1] and (w[1] == 97).sum() == 44


def test_letters_and_clashing_columns(spark):
    assert [bool(langid.LETTER.search(t)) for t in ("½ ² Ⅷ 12_", "é", "字", "ª")] == [False, True, True, True]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"score": F.lit("old"), "lang_pred": F.lit(7)})
    out = langid.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0.9 * docs.count() and out.select("score", "lang_pred").distinct().collect() == [("old", 7)]
