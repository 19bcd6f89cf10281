"""Merkle manifest of a dataset: leaf digests, subtree roots swapped between blocks round by round, proofs and verification."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_side

FANOUT = 8
LOCAL_LEVELS = 4  # levels that a block of FANOUT ** LOCAL_LEVELS leaves hashes by itself: some MB a block with its proofs
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before string, after string>>"


def digest(values: list[Column]) -> Column:
    """H of the values: each ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings give, level by level."""
    return F.aggregate(proof, leaf, lambda at, level: F.sha2(F.concat(level["before"], at, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """H of all siblings of a proof, from the leaf's level to the root's, left to right."""
    return F.sha2(joined(F.transform(proof, lambda level: F.concat(level["before"], level["after"]))), 256)


def numbered(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``rank`` of their group and ``place`` in it, both from 0, and a table (rank, by, n) of the groups.

    One global sort, whose partitions Spark samples; the row's number in its partition, less that of the group's first row
    there, is added to the rows of the group in earlier partitions. The sums are over a row for each partition and group.
    Groups ascend with null first, strings bytewise. Equal rows are told apart by where they are stored, so that copies of
    one row spread over partitions too.
    """
    stored = cut(rows).withColumn("tie", F.monotonically_increasing_id())
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(stored.orderBy(by, *order, "tie").select(*rows.columns, F.spark_partition_id().alias("part"), number.alias("number")))
    parts = cut(placed.groupBy("part", by).agg(F.min("number").alias("first"), F.count("*").alias("rows")))
    earlier = F.coalesce(F.sum("rows").over(W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = parts.groupBy(by).agg(F.sum("rows").alias("n"))
    # one row a group in one task
    groups = cut(groups.select((F.row_number().over(W.orderBy(F.col(by).asc_nulls_first())) - 1).cast("long").alias("rank"), F.col(by).alias("of"), "n"))
    bases = parts.join(groups, parts[by].eqNullSafe(groups["of"])).select("part", "rank", "of", (earlier - F.col("first")).alias("base"))
    bases = cut(bases).withColumnRenamed("part", "of_part")
    placed = placed.join(small_side(bases, bases.count()), (F.col("part") == F.col("of_part")) & F.col(by).eqNullSafe(F.col("of")))
    return placed.select(*rows.columns, "rank", (F.col("number") + F.col("base")).alias("place")), groups


def _above(digests: Column, fanout: int) -> Column:
    """The next level of a subtree."""
    runs = F.sequence(F.lit(0), ((F.size(digests) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(joined(F.slice(digests, i * fanout + 1, F.lit(fanout))), 256))


def swapped(nodes: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round over nodes (rank, at, n, digest, proof), whose digest is that of their subtree of ``width`` nodes.

    Nodes at the same place of the aligned subtrees under one parent are a group of fanout members at most: each gets the
    digests of all, hashes the parent for itself and appends its siblings. Where the last subtree is short, its nodes also
    answer in the groups of the places that it lacks, in turn. Trees of one node left stay as they are.
    """
    tree, lane = F.expr(f"at div {width}L"), F.expr(f"at % {width}L")
    last = F.expr(f"(n - 1) div {width}L")
    size = F.when(tree < last, F.lit(width)).otherwise(F.col("n") - last * width).cast("long")
    alone = (tree == last) & (last % fanout == 0)
    lanes = F.when(alone, F.array(lane)).otherwise(F.sequence(lane, F.lit(width - 1).cast("long"), size))
    active = nodes.where(F.col("n") > width)
    sent = active.select("rank", "at", "n", "digest", "proof", tree.alias("tree"), lane.alias("lane"), F.explode(lanes).alias("to"))
    own = F.when(F.col("to") == F.col("lane"), F.struct("at", "n", "proof")).alias("own")
    sent = sent.select("rank", F.expr(f"tree div {fanout}L").alias("parent"), "to", (F.col("tree") % fanout).cast("int").alias("digit"), "digest", own)
    met = sent.groupBy("rank", "parent", "to").agg(F.sort_array(F.collect_list(F.struct("digit", "digest", "own"))).alias("met"))
    met = met.select("rank", F.transform("met", lambda m: m["digest"]).alias("digests"), F.explode(F.filter("met", lambda m: m["own"].isNotNull())).alias("m"))
    digit = F.col("m.digit")
    level = F.struct(joined(F.slice("digests", F.lit(1), digit)).alias("before"), joined(F.slice("digests", digit + 2, F.lit(fanout))).alias("after"))
    proof = F.concat(F.col("m.own.proof"), F.array(level)).alias("proof")
    return met.select("rank", F.col("m.own.at").alias("at"), F.col("m.own.n").alias("n"), F.sha2(joined(F.col("digests")), 256).alias("digest"), proof).unionByName(nodes.where(F.col("n") <= width))


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes (rank, at, n, digest) with their tree's root as ``digest`` and the siblings on the way to it as ``proof``.

    After the round of width w every node knows the root of its subtree of w * fanout nodes, so that no downward pass is
    needed; a round is one shuffle of the nodes, written before the next.
    """
    nodes = cut(nodes.select("rank", "at", "n", "digest", F.array().cast(PROOF).alias("proof")))
    most = nodes.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < most:
        nodes = cut(swapped(nodes, width, fanout))
        width *= fanout
    return nodes


def manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, received: Mapping[str, Column] | None = None, fanout: int = FANOUT, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """Rows (by, order, leaf, received, subroot, root, proof), one for each row of docs.

    A leaf is the digest of the row's fields. The leaves of each value of ``by`` ascend by ``order`` under a tree of its own,
    the roots of these trees, in the order of ``by``, under one more: every ``fanout`` consecutive nodes, a last run of fewer,
    even one, become their H while there are several. ``proof`` has for each level the siblings before and after; ``received``
    is the digest with some fields replaced, null where it is the leaf.

    A null in any field is a ``-``; a null ``by`` is a group like another, the first; a null ``order`` comes first. Rows with
    an equal ``order`` follow by their digests; repeated rows are a leaf each. Other columns of docs are not read, whatever
    their names. An empty table gives no rows. A long text is hashed where it is read and never shuffled.
    """
    names = dict(zip(("__by", "__order"), (by, order)))
    rows = docs.select(*(F.col(c).alias(k) for k, c in names.items()), digest([F.col(c) for c in fields]).alias("leaf"), digest([(received or {}).get(c, F.col(c)) for c in fields]).alias("received"))
    rows = rows.withColumn("received", F.when(F.col("received") != F.col("leaf"), F.col("received")))
    placed, groups = numbered(rows, "__by", ["__order", "leaf", "received"])
    wide = fanout**local_levels
    member = F.struct(F.col("place"), "__by", "__order", "leaf", "received")
    blocks = placed.groupBy("rank", F.expr(f"place div {wide}L").alias("at")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    depth = sum((F.when(F.col("rows") > fanout**t, 1).otherwise(0) for t in range(local_levels)), F.lit(0))
    sizes = groups.select("rank", F.col("n").alias("rows")).withColumns({"depth": depth, "n": F.expr(f"(rows - 1) div {wide}L + 1")})
    blocks = blocks.join(small_side(sizes, sizes.count()), "rank").withColumn("l0", F.transform("members", lambda m: m["leaf"]))
    for t in range(local_levels):
        blocks = blocks.withColumn(f"l{t + 1}", _above(F.col(f"l{t}"), fanout))
    top = F.element_at(F.array(*(F.element_at(f"l{t}", 1) for t in range(local_levels + 1))), F.col("depth") + 1)
    blocks = cut(blocks.select("rank", "at", "n", "depth", "members", *(f"l{t}" for t in range(local_levels)), top.alias("digest")))

    upper = butterfly(blocks.select("rank", "at", "n", "digest"), fanout).select("rank", "at", F.col("digest").alias("subroot"), F.col("proof").alias("middle"))
    several = groups.count()
    trees = butterfly(upper.where("at = 0").select(F.lit(0).cast("long").alias("rank"), F.col("rank").alias("at"), F.lit(several).cast("long").alias("n"), F.col("subroot").alias("digest")), fanout)
    trees = trees.select(F.col("at").alias("rank"), F.col("digest").alias("root"), F.col("proof").alias("last"))

    def local(i: Column) -> Column:
        levels = []
        for t in range(local_levels):
            at = F.floor(i / fanout**t).cast("int")
            run = at - at % fanout
            before = joined(F.slice(f"l{t}", run + 1, at - run))
            levels.append(F.struct(before.alias("before"), joined(F.slice(f"l{t}", at + 2, run + fanout - 1 - at)).alias("after")))
        return F.slice(F.array(*levels), F.lit(1), F.col("depth"))

    shown = F.transform("members", lambda m, i: F.struct(m["__by"].alias("by"), m["__order"].alias("order"), m["leaf"].alias("leaf"), m["received"].alias("received"), local(i).alias("proof")))
    found = blocks.select("rank", "at", shown.alias("members")).join(upper, ["rank", "at"]).join(small_side(trees, several), "rank")
    found = found.select("subroot", "root", "middle", "last", F.explode("members").alias("m"))
    proof = F.concat("m.proof", "middle", "last").alias("proof")
    return found.select(F.col("m.by").alias(by), F.col("m.order").alias(order), F.col("m.leaf").alias("leaf"), F.col("m.received").alias("received"), "subroot", "root", proof)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether what was received under its id still proves the root.

    What is received differs where 3 divides the CRC-32 of the id: there the text's A to Z are small letters.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, small).otherwise(F.col("text"))
    found = manifest(docs, received={"text": changed})
    found = found.withColumn("folded_root", folded(F.coalesce("received", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
