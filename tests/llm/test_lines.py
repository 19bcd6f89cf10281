import random
import re

from pyspark.sql import functions as F

from tidemark.llm import lines


def shingles(line, k=5):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute(docs, threshold=0.8):
    """Numbers of the lines that go, by the sets of all runs of five characters."""
    place, sets = {}, {}
    for d, t in sorted(docs):
        for no, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if re.search(r"\S", line):
                place.setdefault(line, []).append((d, no))
                sets[line] = shingles(line)
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    keep = {}
    for x, where in place.items():
        keep[find(x)] = min(keep.get(find(x), where[0]), min(where))
    out = {}
    for x, where in place.items():
        for d, no in where:
            if (d, no) != keep[find(x)]:
                out.setdefault(d, set()).add(no)
    return {d: sorted(s) for d, s in out.items()}


def corpus():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdeéfghi") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(4, 40))] for _ in range(30)]
    docs = []
    for d in range(80):
        text = []
        for _ in range(rnd.randint(0, 8)):
            line = list(rnd.choice(bases)) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))]
            if rnd.random() < 0.4 and len(line) > 12:
                line[rnd.randrange(len(line))] = rnd.choice(vocabulary)
            text.append(rnd.choice(["", " "]) + " ".join(line))
        docs.append((d, "\n".join(text)))
    return docs + [(200, None), (201, ""), (202, "\n\n\n"), (203, "short\nshort"), (204, docs[3][1]), (205, "x" * 5000 + "\n" + "y z " * 3000), (206, "\t" * 40)]


def test_lines_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0, 0, 0) for d, t in docs], "doc_id long, text string, doc long, h long, removed long").repartition(3)
    got = {r["doc"]: list(r["removed"]) for r in lines.repeated_lines(df).collect()}
    want = brute(docs)
    # links are exact; a candidate is missed with a chance of a few hundredths at the threshold
    found, due = ({(d, n) for d, x in y.items() for n in x} for y in (got, want))
    assert found <= due and len(found) >= 0.95 * len(due)
    want = got
    left = {r["doc_id"]: r for r in lines.without_lines(df, lines.repeated_lines(df)).collect()}
    assert len(left) == len(docs) and left[200]["text"] is None and left[203]["text"] == "short"
    for d, t in docs:
        if t is not None:
            assert left[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, []))


def test_empty_and_repeated_rows(spark):
    line = "a line that is long enough to count here"
    df = spark.createDataFrame([(1, line), (1, line), (2, f"x\n{line}"), (None, line)], "doc_id long, text string")
    assert [tuple(r) for r in lines.repeated_lines(df).collect()] == [(2, [1])]
    assert lines.repeated_lines(df.limit(0)).count() == 0


def edited(min_length, max_length, n, seed):
    rnd = random.Random(seed)
    docs = []
    for d in range(n):
        line = " ".join("".join(rnd.choice("abcdeéfghi😀") for _ in range(rnd.randint(2, 8))) for _ in range(20))[: rnd.randint(min_length, max_length)].strip()
        at = rnd.randrange(len(line))
        docs += [(2 * d, line), (2 * d + 1, line[:at] + "z" + line[at + 1 :])]
    return docs


def test_one_edited_letter_matches_brute_force(spark):
    docs = edited(50, 90, 60, 3)
    got = {r["doc"]: list(r["removed"]) for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert len(want) > 30
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_short_lines_take_part(spark):
    docs = [(1, "Share\nRead more\n\nx\nTheand thble reingwh thorin."), (2, "Read more\n \nx\n\nabc"), (3, " Share \nTheand thble reingwh thorin!\nabd")]
    got = {r["doc"]: list(r["removed"]) for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) == {2: [0, 2], 3: [0, 1]}


def test_text_without_spaces(spark):
    line = "这是一个没有空格的很长的句子它有三十五个字左右并且只有最后一个字不同于另外那一行天地玄黄宇宙洪荒日"
    docs = [(1, line + "甲"), (2, line + "乙"), (3, "完全不同的另一行文字在这里没有任何重复的内容出现")]
    got = {r["doc"]: list(r["removed"]) for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) == {2: [0]}


def test_shingles_are_runs_of_characters(spark):
    texts = ["a😀b😀cdé", "abc", "ab\tcd ef", "😀" * 9, "", "abcde" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string")
    got = {}
    for r in lines.items_of(df).collect():
        got.setdefault(r["id"], []).append(r["item"])
    assert {i: len(s) for i, s in got.items()} == {i: len(shingles(t)) for i, t in enumerate(texts)}
    assert all(len(s) == len(set(s)) for s in got.values())


def test_large_bucket_of_near_copies_loses_no_link(spark):
    """Copies of one line with edits that recur: pairs grow with the copies, not with their square."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefghij klmnop") for _ in range(160))
    docs = [(0, base)]
    for d in range(1, 400):
        line = list(base)
        for _ in range(rnd.randint(1, 4)):
            line[rnd.randrange(160)] = rnd.choice("XYZ")
        docs.append((d, "".join(line)))
    got = {r["doc"] for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = set(brute(docs))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_repetitive_long_lines(spark):
    docs = [(1, "The " * 3000), (2, "The " * 3001 + "x"), (3, "abcdefghijklm" * 900), (4, "abcdefghijklm" * 700 + "q")]
    got = {r["doc"]: list(r["removed"]) for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) <= set(brute(docs))


def test_sketches_rule_out_no_similar_pair(spark):
    docs = [t for _, d in corpus() for t in (d or "").split("\n") if t.strip(" ")][:120] + [t for _, t in edited(20, 90, 40, 5)] + ["abc", "abd", "x" * 400, "x" * 399 + "y"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, line string")
    known = lines.sketches(df)
    x, y = known.alias("x"), known.alias("y")
    left = {tuple(r) for r in x.join(y, F.expr("x.id < y.id")).where(lines.may_be_similar("x", "y", 0.8)).select("x.id", "y.id").collect()}
    sets = [shingles(t) for t in docs]
    due = {(i, j) for j in range(len(docs)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert due <= left and len(due) > 20 and len(left) < 0.2 * len(docs) * (len(docs) - 1) / 2


def test_buckets_of_lines_that_are_not_similar_list_few_pairs(spark, monkeypatch):
    """Lines that share most bands and no link: their texts are not compared pair by pair."""
    rnd, n, compared, similar = random.Random(2), 200, [], lines.similar
    base = [rnd.choice("abcdefghij klmnop") for _ in range(160)]
    docs = []
    for d in range(n):
        line = list(base)
        for at in rnd.sample(range(160), 4):
            line[at] = rnd.choice("QRSTUVWXYZ")
        docs.append((d, "".join(line)))
    monkeypatch.setattr(lines, "similar", lambda pairs, *a: compared.append(pairs.count()) or similar(pairs, *a))
    got = {r["doc"] for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= set(brute(docs)) and 0 < sum(compared) <= lines.BANDS * n


def test_sketches_rule_out_long_lines_under_the_threshold(spark):
    """Long lines that share most shingles: what they have in common fills no bits in which they would differ."""
    rnd, docs = random.Random(6), []
    base = [rnd.choice("abcdefghij klmnop") for _ in range(1500)]
    for d in range(12):
        line = list(base)
        for at in rnd.sample(range(1500), 45):
            line[at] = rnd.choice("QRSTUVWXYZ")
        docs.append((d, "".join(line)))
    known = lines.sketches(spark.createDataFrame(docs, "id long, line string"))
    x, y = known.alias("x"), known.alias("y")
    assert known.count() == 12 and x.join(y, F.expr("x.id < y.id")).where(lines.may_be_similar("x", "y", 0.8)).count() == 0


def test_members_come_with_size_and_head_of_their_bucket(spark):
    members = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 4), (3, 8), (3, 7)], "bucket long, id long")
    got = {(r["bucket"], r["id"]): (r["size"], r["head"]) for r in lines.in_company(members).collect()}
    assert got == {(1, 5): (3, 3), (1, 3): (3, 3), (1, 9): (3, 3), (3, 8): (2, 7), (3, 7): (2, 7)}


def test_similar_fetches_the_lines_of_its_pairs_alone(spark):
    texts = spark.createDataFrame([(i, f"line number {i} of many {'abcdefgh' * (i % 7)}") for i in range(50)] + [(99, "line number 1 of many abcdefgh.")], "id long, line string")
    pairs = spark.createDataFrame([(1, 99), (2, 3)], "a long, b long")
    assert {r["id"] for r in lines.of_pairs(texts, pairs).collect()} == {1, 2, 3, 99}
    assert lines.of_pairs(texts.where("id < 4"), pairs).count() == 4
    assert [tuple(r) for r in lines.similar(pairs, texts, 0.8, lines.sketches(texts)).collect()] == [(1, 99)]
