"""Fuzzy line dedup by MinHash, in DataFrame functions only."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, link_buckets, small_side

MIN_CHARS = 1  # shorter lines are left alone: every line that is not blank takes part
SHINGLE_CHARS = 5
SIMILARITY = 0.8
BINS = 20  # of a signature
BANDS, BAND_ROWS = 12, 5
BLOCK = 16  # shingles that meet the bins at once
SET_BLOCK = 8  # and the words of a sketch
WORDS = 16  # of 64 bits in a line's sketch
DIRECT = 20_000  # members of a bucket whose sketches are compared pair by pair: some nanoseconds each, where the prefix filter takes milliseconds a member
SEED = 9  # of the choice of bins for the bands: 0.94 of pairs at a similarity of 0.8 share a band, 0.98 at 0.85


def _held(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are worked out once a row, however often they are used above: no projection is merged through
    a generator."""
    held = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__held"))
    return held.select(*df.columns, *(F.col(f"__held.{n}").alias(n) for n in columns))


def line_rows(docs: DataFrame, text: str = "text", id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc, no, line): the lines between \\n of at least min_chars characters, without spaces at their ends.

    ``key`` is two 64-bit hashes of the line.
    """
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("no", "line"))
    rows = rows.select("doc", "no", F.trim("line").alias("line")).where((F.length("line") >= min_chars) & ((F.ascii("line") > 32) | F.col("line").rlike(r"\S")))
    return rows.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), "doc", "no", "line")


def shingle_hashes(lines: DataFrame, *names: str, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(names, s): a 64-bit hash of the run of characters that begins at each character of a line; a shorter line is one run.

    Lines are cut in UTF-32, in which each character has four bytes, so that no cut looks for its place.
    """
    n = F.greatest(F.length("line") - (chars - 1), F.lit(1))
    each = _held(lines.select(*names, "line"), runs=F.encode("line", "UTF-32"), n=n)
    each = each.select(*names, "runs", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return each.select(*names, F.xxhash64(F.substr("runs", 4 * F.col("at") + 1, F.lit(4 * chars))).alias("s"))


def shingle_list(line, chars: int = SHINGLE_CHARS):
    """The same hashes of one line as an array, in their order, as a column. The outer function names the line's UTF-32 form, which
    would be copied for each shingle as a column."""
    places = F.sequence(F.lit(1), F.greatest(4 * (F.length(line) - chars) + 1, F.lit(1)), F.lit(4))
    hashes = lambda runs: F.transform(places, lambda at: F.xxhash64(F.substr(runs, at, F.lit(4 * chars))))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), hashes), F.lit(0))


def shingle_set(line, chars: int = SHINGLE_CHARS):
    """The same array with each hash once."""
    return F.array_distinct(shingle_list(line, chars))


def bands() -> list[list[int]]:
    """The bins of each band."""
    draw = random.Random(SEED)
    return [sorted(draw.sample(range(BINS), BAND_ROWS)) for _ in range(BANDS)]


def signatures(lines: DataFrame, chars: int = SHINGLE_CHARS) -> DataFrame:
    """(h, buckets): the band hashes of the one-permutation MinHash of each distinct line.

    BINS marks lie at even distances, and each bin keeps the shingle whose hash is nearest to its mark, by the bits in which they
    differ: one of the bin's own range if there is any, or else of the range beside it. Hashes are met BLOCK at a time, so that a
    minimum in the grouping is touched once a block. The grouping takes minima alone and equal lines have equal minima, so copies
    collapse before the shuffle, and no text is shuffled.
    """
    n = F.greatest(F.length("line") - (chars - 1), F.lit(1))
    each = _held(lines.select("h", "line"), runs=F.encode("line", "UTF-32"), n=n)
    each = each.select("h", "runs", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK))).alias("at"))
    at = [F.expr(f"if(at + {j} < n, at + {j}, n - 1)") for j in range(BLOCK)]  # the last shingle fills the last block
    high = [F.shiftright(F.xxhash64(F.substr("runs", 4 * i + 1, F.lit(4 * chars))), 32).cast("int") for i in at]
    each = each.select("h", *(v.alias(f"v{j}") for j, v in enumerate(high)))
    marks = [i * 2**32 // BINS - 2**31 for i in range(BINS)]
    least = [F.min(F.least(*(F.col(f"v{j}").bitwiseXOR(F.lit(x)) for j in range(BLOCK)))).alias(f"m{i}") for i, x in enumerate(marks)]
    bucket = [F.xxhash64(F.lit(b), *(F.col(f"m{j}") for j in bins)) for b, bins in enumerate(bands())]
    return each.groupBy("h").agg(*least).select("h", F.array(*bucket).alias("buckets"))


def in_company(members: DataFrame) -> DataFrame:
    """(bucket, id, size, head): those members (bucket, id) whose bucket has another, with the bucket's size and its least id, in one
    shuffle. Nothing but the bucket is sorted by, which is one number."""
    bucket = W.partitionBy("bucket")
    return members.select("bucket", "id", F.count("*").over(bucket).alias("size"), F.min("id").over(bucket).alias("head")).where("size > 1")


def sketches(lines: DataFrame) -> DataFrame:
    """(id, n, w0, w1, ...): of each line (id, line) its number of distinct shingles, and for each of 64 * WORDS cells, a bit each,
    whether an odd number of them fall there. What two lines have in common cancels out in the difference of their bits."""
    each = lines.select("id", shingle_set(F.col("line")).alias("items"))
    # outer, though no set is empty: for an inner one Spark adds a filter on its size, which would work out the set once more
    each = each.select("id", "items", F.explode_outer(F.sequence(F.lit(0), F.size("items") - 1, F.lit(SET_BLOCK))).alias("at"))
    items = [F.get("items", F.col("at") + j) for j in range(SET_BLOCK)]  # null beyond the last: no bit
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    bit = [F.coalesce(one(F.shiftrightunsigned(item, 58)), F.lit(0).cast("long")).alias(f"bit{j}") for j, item in enumerate(items)]
    word = [F.coalesce(one(item.bitwiseAND(F.lit(WORDS - 1))), F.lit(0).cast("long")).alias(f"word{j}") for j, item in enumerate(items)]
    each = each.select("id", F.size("items").alias("n"), *word, *bit)
    # the word's own bit, moved to the sign and spread over all bits: no branch for a shingle and word
    in_word = lambda i, j: F.shiftright(F.shiftleft(f"word{j}", 63 - i), 63).bitwiseAND(F.col(f"bit{j}"))
    odd = [F.bit_xor(reduce(lambda x, j: x.bitwiseXOR(in_word(i, j)), range(1, SET_BLOCK), in_word(i, 0))).alias(f"w{i}") for i in range(WORDS)]
    return each.groupBy("id").agg(F.max("n").alias("n"), *odd)


def may_be_similar(x: str, y: str, threshold: float):
    """Whether the sketches x and y leave it open that their lines have the similarity, as a column; false for no pair that has.

    A bit in which they differ is a shingle at least that one line has alone. Of n and m shingles, c in common, n + m - 2 c are
    on one side alone, which the threshold bounds by its share of n + m. The smaller set has at least the threshold's share of the larger.
    """
    sizes = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= threshold * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")) - 1e-6
    differ = sum((F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{x}.w0").bitwiseXOR(F.col(f"{y}.w0"))))
    return sizes & (differ * (1 + threshold) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (1 - threshold) + 1e-6)


def of_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of table (id, ...) that the pairs (a, b) name, where these are fewer; else all: what is joined is moved and sorted whole."""
    rows = 2 * pairs.count()
    if rows >= table.count():
        return table
    return table.join(small_side(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rows), "id", "left_semi")


def similar(pairs: DataFrame, lines: DataFrame, threshold: float, sketched: DataFrame) -> DataFrame:
    """Those pairs (a, b) of lines (id, line) whose sets of shingles have at least this Jaccard similarity.

    Pairs whose sketches rule that out are left before the texts are fetched.
    """
    known = of_pairs(sketched, pairs)
    p = pairs.alias("p").join(known.alias("x"), F.col("p.a") == F.col("x.id")).join(known.alias("y"), F.col("p.b") == F.col("y.id"))
    open_ = cut(p.where(may_be_similar("x", "y", threshold)).select("p.a", "p.b", (F.col("x.n") + F.col("y.n")).alias("total")))
    texts = of_pairs(lines, open_)
    x, y = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    common = F.size(F.array_intersect(shingle_list(F.col("x")), shingle_list(F.col("y"))))  # each once
    # two sets of n and m items with c in common: c / (n + m - c) is to reach the threshold
    return open_.join(x, "a").join(y, "b").where(common * (1 + threshold) >= F.col("total") * threshold - 1e-9).select("a", "b")


def items_of(lines: DataFrame) -> DataFrame:
    """(id, item): the hashes of the shingles of lines (id, line), each once."""
    return lines.select("id", F.explode(shingle_set(F.col("line"))).alias("item"))


def repeated_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, removed): for each document with any, the numbers from 0 of the lines that go.

    Lines are equal, or linked when the Jaccard similarity of their character shingles is at least the threshold, with
    candidates that agree on a band of their MinHash; of each component of the links, copies included, the line that
    comes first by document and number stays. Lines under min_chars characters stay. A null or empty text has no line, a
    null id keeps all its lines, and rows that share an id must be one row repeated.
    """
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = line_rows(docs, min_chars=min_chars)
    places = cut(lines.select("h", "g", "doc", "no"))
    first = cut(places.groupBy("h", "g").agg(F.min(F.struct("doc", "no")).alias("place"), F.count("*").alias("n")))
    members = signatures(lines).select(F.explode("buckets").alias("bucket"), F.col("h").alias("id"))
    members = cut(in_company(members))
    near = cut(members.select(F.col("id").alias("h")).distinct())
    texts = lines.select("h", "line").join(small_side(near, near.count()), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = cut(texts.withColumnRenamed("h", "id"))
    items = lambda ids: items_of(texts.join(ids, "id", "left_semi"))
    sketched = cut(sketches(texts))
    bound = (sketched, lambda x, y: may_be_similar(x, y, threshold))
    groups = link_buckets(members, lambda pairs: similar(pairs, texts, threshold, sketched), items, threshold, direct=DIRECT, bound=bound)
    placed = first.join(small_side(groups.select(F.col("id").alias("h"), "component"), groups.count()), "h", "left").where("n > 1 or component is not null")
    keep = placed.where("component is not null").groupBy("component").agg(F.min("place").alias("kept"))
    placed = placed.join(keep, "component", "left").select("h", "g", F.coalesce("kept", "place").alias("kept"))
    gone = places.join(placed, ["h", "g"]).where(F.struct("doc", "no") != F.col("kept"))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def without_lines(docs: DataFrame, gone: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents, all their columns, without the lines of gone (doc, removed)."""
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("removed").alias("__removed"))
    both = docs.join(gone, docs[id] == gone["__doc"], "left")
    return both.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(rest)).drop("__doc", "__removed")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of lines and the numbers of those that repeat an earlier line, nearly or exactly."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = repeated_lines(docs)
    out = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = out.join(gone, out["doc_id"] == gone["doc"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines go, and documents whose every line of words went; n_chars follows the text."""
    out = without_lines(docs.withColumn("__had", F.col("text").rlike(r"\S")), repeated_lines(docs))
    out = out.where(~F.col("__had") | F.col("text").rlike(r"\S") | F.col("text").isNull()).drop("__had")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
