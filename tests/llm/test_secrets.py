import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import secrets, words


def brute(text):
    """The base spans by other means: no lookup tables, one pattern a kind, failing matches dropped afterwards."""
    text, out = text or "", []
    name = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(name + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)), [sum(x[1] == k for x in out) for k in range(3)]


def test_base_matches_brute_force_and_field_adds(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = secrets.op6_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    base = more = 0
    for r in rows:
        want, counts = brute(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("crf")] == [x for x in want.split(",") if x]
        base, more = base + sum(counts), more + r["spans"].count("crf")
    assert base and more < base


def test_defined_cases(spark):
    key = "AKIA" + "B" * 16
    rows = [(1, None, 1), (2, "", 2), (3, 'é PassWord = "hunter2hunter" x', 3), (4, "secret: ab token: abcdef", 4), (5, key + " " + key[:-1], 5), (6, "x " * 100000 + "token=abcdefgh", 6), (6, "q", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hex_ long")
    got = {(r["doc_id"], r["n_hex_"]): r for r in secrets.scan(df, secrets.learn(df)).collect()}
    assert got[1, 1]["spans"] == got[2, 2]["spans"] == "" and got[1, 1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3, 3]["spans"].startswith("assign:2:27")
    assert got[4, 4]["n_assign"] == 1 and got[5, 5]["n_access"] == 1 and "assign:200000:200014" in got[6, 6]["spans"]
    assert secrets.learn(df.limit(0)) is None and secrets.scan(df.limit(0), None).count() == 0


def test_viterbi_is_exact_and_training_learns():
    rng = np.random.default_rng(4)
    line = np.repeat(np.arange(6), [1, 4, 5, 2, 3, 5])
    emit = rng.normal(0, 2, (len(line), 3))
    field = secrets.Field(np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    got = field.decode(emit, line)
    for k in range(6):
        at = np.flatnonzero(line == k)
        score = {}
        for tags in itertools.product(range(3), repeat=len(at)):
            score[tags] = field.start[tags[0]] + sum(emit[i, y] for i, y in zip(at, tags)) + sum(field.change[a, b] for a, b in zip(tags, tags[1:]))
        assert tuple(got[at]) == max(score, key=score.get)
    texts = [f"the word {i} key is sk-{rng.integers(1e9)}abcDEF{i} and more words" for i in range(60)]
    w = words.split_words(pa.array(texts))
    found, line = secrets.features(w)
    tags = np.array([1 if "sk-" in texts[r].split()[j - w.first[r]] else 0 for j, r in enumerate(w.row)])
    half = line < 40
    model = secrets.train(found[half], tags[half], line[half])
    assert (model.decode(model.emissions(found[~half]), line[~half]) == tags[~half]).mean() > 0.98


def test_field_finds_secrets_beside_unknown_words(spark):
    """Learnt from base spans; measured on names that the base patterns do not have, and on prose."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    value = lambda: "".join(rng.choice("abcXYZ0123456789") for _ in range(rng.randint(16, 24)))
    teach = [(i, f"{prose(20)}\n{prose(4)} {rng.choice(['password', 'secret', 'api_key'])}={value()} {prose(3)}\n{prose(20)}") for i in range(150)]
    teach += [(1000 + i, f"{prose(30)}\n{prose(3)} a={word()} {rng.randint(1, 99)}: {prose(4)}") for i in range(80)]
    field = secrets.learn(spark.createDataFrame(teach, "doc_id long, text string"))
    held = [(i, f"{prose(10)}\n{prose(3)} {rng.choice(['credential', 'auth', 'pin'])}={value()} {prose(3)}", True) for i in range(60)]
    held += [(100 + i, f"{prose(25)}\n{prose(3)} b={word()} {rng.randint(1, 99)}: {prose(4)}", False) for i in range(60)]
    rows = secrets.scan(spark.createDataFrame(held, "doc_id long, text string, has boolean"), field).collect()
    assert all(r["n_assign"] == r["n_access"] == r["n_hex"] == 0 for r in rows)
    hit = {r["doc_id"] for r in rows if "crf" in r["spans"]}
    good = {r["doc_id"] for r in rows if r["has"]}
    assert len(hit & good) >= 0.8 * len(good) and len(hit & good) >= 0.9 * len(hit)


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "old", 9)], "doc_id long, text string, spans string, n_hex long")
    assert [tuple(r)[:4] for r in secrets.scan(df, None).select("doc_id", "spans", "n_hex", "n_assign").collect()] == [(1, "assign:0:14", 0, 1)]
