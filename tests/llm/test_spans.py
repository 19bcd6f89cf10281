import hashlib
import random
import re

from tidemark.llm import spans, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_covered(docs, window):
    """For each document the set of covered words, and for each the smallest document."""
    first = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        out[d] = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
    return split, out


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["é", "ça", " x", "a b"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(8, 90))] for _ in range(12)]
    docs = []
    for d in range(n):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "changed"
            a = rnd.randint(0, len(p) // 3)
            w += p[a:] * rnd.choice([1, 1, 1, 2])
        docs.append((d * 3, rnd.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(1000, docs[5][1]), (1001, docs[5][1]), (1002, None), (1003, ""), (1004, " \n"), (1005, "w1 " * 60), (1006, "w1 w2 " * 3000)]
    rnd.shuffle(docs)
    return docs


def test_substring_dedup_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0, 1, 2) for d, t in docs], "doc_id long, text string, doc long, key long, low long").repartition(5)
    split, covered = brute_covered(docs, 13)
    got = {r["id"]: r for r in spans.without_spans(df, spans.repeated_spans(df)).collect()}
    assert set(got) == set(split)
    for d, w in split.items():
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(covered[d])), d
        assert got[d]["kept"] == " ".join(x for i, x in enumerate(w) if i not in covered[d])


def test_shards_stay_exact_when_small(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_WORDS", 20)
    monkeypatch.setattr(spans, "SEEN", 1)
    a = spans.Shards()
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(20)) for _ in range(60)]
    seen = set()
    for t in texts:
        c = b"".join(t[i : i + 6][-3:] for i in range(15))
        assert a.covered(t, c, 6) == [i for i in range(15) if t[i : i + 6] in seen] if (a.waiting or a.automata) else not seen
        a.add(t, c)
        seen |= {t[i : i + 6] for i in range(15)}
    assert len(a.automata) > 10


def test_substring_dedup_empty_and_repeated_rows(spark):
    text = " ".join(f"x{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["id"] or -1, r["n_removed"]) for r in spans.without_spans(df, spans.repeated_spans(df)).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 20)]
    none = df.limit(0)
    assert spans.without_spans(none, spans.repeated_spans(none)).count() == 0


def test_suffix_array_matches_brute_force(spark):
    docs = corpus(8, 150)
    df = spark.createDataFrame([(d, t, 0, 1, 2) for d, t in docs], "doc_id long, text string, doc long, key long, pos long").repartition(5)
    _, covered = brute_covered(docs, 50)
    got = {}
    for r in suffixes.repeated_passages(df).collect():
        assert r["n_words"] >= 50 and r["source"] < r["doc"]
        new = set(range(r["start"], r["start"] + r["n_words"]))
        assert not new & got.setdefault(r["doc"], set())
        got[r["doc"]] |= new
    assert {d: sorted(got.get(d, set()) ^ s) for d, s in covered.items() if got.get(d, set()) != s} == {}
    assert len(got) > 20
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def test_op1_digest(spark, tmp_path):
    text = " ".join(f"x{i}" for i in range(20))
    spark.createDataFrame([(1, text), (2, "a " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in spans.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(text.encode()).hexdigest(), 2: hashlib.sha256(b"a").hexdigest()}


def test_windows_that_only_whole_hashes_tell_apart(spark):
    """Two windows of one anchor that differ in one word whose byte, and three bytes of the window's hash, are the same."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import words

    n = 400_000
    varying = words.split_words(pa.array([f"v{i}" for i in range(n)])).hashes()
    for turn in range(200):  # an anchor among the words that stay
        fixed = [f"t{turn}w{i}" for i in range(12)]
        f = words.split_words(pa.array([" ".join(fixed)])).hashes()
        if words.shingles(f[:6], np.zeros(6, int), 4)[0].min() < 2**64 // 40:
            break
    flat = np.concatenate([np.tile(f[:6], (n, 1)), varying[:, None], np.tile(f[6:], (n, 1))], 1).ravel()
    row = np.repeat(np.arange(n), 13)
    check = words.shingles(flat, row, 13)[0].view(np.uint8).reshape(-1, 8)[:, :3].astype(np.int64)
    value = words.shingles(flat, row, 4)[0].reshape(n, 10)
    code = check @ np.array([1, 1 << 8, 1 << 16]) + ((varying & np.uint64(255)).astype(np.int64) << 24)
    moves = np.flatnonzero((value.argmin(1) > 2) & (value.argmin(1) < 7))  # the anchor has the word that varies
    code[moves] = -1 - moves
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order][1:] == code[order][:-1])
    assert len(same)
    pairs = [(order[i], order[i + 1]) for i in same[:1]]
    texts = [" ".join([*fixed[:6], f"v{x}", *fixed[6:]]) for x in pairs[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["n_removed"] for r in spans.without_spans(df, spans.repeated_spans(df)).collect()}
    assert got == {0: 0, 1: 0}


def test_only_anchors_of_two_documents_are_sent(spark):
    passage = [f"p{i}" for i in range(30)]
    own = lambda d: [f"d{d}x{i}" for i in range(40)]
    rows = [(1, " ".join(own(1) + passage)), (2, " ".join(passage + own(2))), (3, " ".join(own(3))), (4, " ".join(own(4) * 2)), (5, ""), (3, " ".join(own(3)))]
    got = {r["doc"]: set(r["keys"]) for r in spans.shared_anchors(spark.createDataFrame(rows, "doc long, text string").repartition(3)).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and got[1]
    assert spans.shared_anchors(spark.createDataFrame([], "doc long, text string")).count() == 0


def passages(df):
    return sorted(tuple(r) for r in suffixes.repeated_passages(df).collect())


def test_suffix_spans_and_sources_do_not_depend_on_the_layout(spark):
    """One file or many: the same spans with the same sources."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = passages(docs.coalesce(1))
    assert len(one) > 100
    assert passages(docs.repartition(16)) == one
    assert passages(docs.repartition(3)) == one


def test_a_passage_that_very_many_documents_share(spark):
    """A licence head in most documents, with different words around: every later document names the first that has it."""
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    head = words(70)
    rows = [(i, " ".join(words(30) + head + words(20))) for i in range(300)] + [(400, None), (None, " ".join(head)), (401, ""), (500, " ".join(words(100_000) + head)), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: r[1:] for r in passages(df)}
    assert got == {i: (30, 70, 0) for i in range(1, 300)} | {500: (100_000, 70, 0)}
