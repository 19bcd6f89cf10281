import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from tidemark.llm import common, near
from tidemark.llm.common import components, link_buckets


def brute_classes(docs, k=5, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        if w:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= threshold:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i, _ in docs}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, n = [], 0

    def add(words):
        nonlocal n
        docs.append((n, " ".join(words)))
        n += 1

    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 200))]
        add(base)
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            add(copy)
    chain = [rnd.choice(vocabulary) for _ in range(120)]
    for _ in range(12):  # a chain whose ends are far apart
        add(chain)
        chain = chain[3:] + [rnd.choice(vocabulary) for _ in range(3)]
    for t in (None, "", "  \n ", "a", "a", "one two three", "one  two\nthree", "short text only here"):
        docs.append((n, t))
        n += 1
    return docs


def test_classes_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id long, class long").drop("id")
    got = {r["id"]: r["class"] for r in near.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_repeated_rows_clashing_names_and_empty(spark):
    rows = [(1, "a b c d e f g", 7, 8, 9), (1, "a b c d e f g", 7, 8, 9), (2, "a b c d e f g", 0, 0, 0), (None, "a b c d e f g", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, bucket long, component long")
    assert sorted(map(tuple, near.near_duplicates(df).collect())) == [(1, 1), (2, 1)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 2**62, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 5, 300), rng.uniform(0.5, 5, 300)
    row, value = np.repeat([0, 1], 300), np.concatenate([v, v])
    k = 2048
    s = near.dart_minhash(row, value, np.concatenate([wa, wb]), 2, k)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    assert (s != 0).all()


def test_shingle_weights():
    row, value, weight = near.weighted_shingles(pa.array(["a b c d e a b c d e a b c d e", None, "x y"]))
    assert row.tolist().count(0) == 5 and row.tolist().count(1) == 0 and row.tolist().count(2) == 1
    assert np.isclose(weight.max(), 1 + np.log(3))


def test_components_and_link_buckets(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    # in one bucket, only x and x+7 are links: stars alone would miss most
    members = spark.createDataFrame([(1, i) for i in range(40)], "bucket long, id long")
    got = dict(map(tuple, link_buckets(members, lambda p: p.where("b - a = 7")).collect()))
    assert got == {i: i % 7 for i in range(40)}


def test_repeated_blocks_do_not_hide_a_copy(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(80)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base * 10)), (3, " ".join(base[:79] + ["new"] + base))], "doc_id long, text string")
    assert dict(map(tuple, near.near_duplicates(df).collect())) == brute_classes([tuple(r) for r in df.collect()]) == {1: 1, 2: 1, 3: 1}


def test_links_of_a_later_round_contract_components_alone(spark, monkeypatch):
    """Links that have been contracted are not contracted once more with each round."""
    seen, whole = [], components
    monkeypatch.setattr(common, "components", lambda links: seen.append(links.count()) or whole(links))
    members = spark.createDataFrame([(b, i) for b in range(3) for i in range(60) if i % (b + 1) == 0] + [(9, 100), (9, 101)], "bucket long, id long")
    verified, verify = [], lambda p: p.where("(b - a) % 4 = 0 or a = 100")
    got = dict(map(tuple, link_buckets(members, lambda p: verified.append(verify(p).count()) or verify(p)).collect()))
    assert got == {i: i % 4 for i in range(60)} | {100: 100, 101: 100}
    assert len(seen) > 1 and sum(seen) <= sum(verified)
