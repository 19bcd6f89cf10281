"""What the operators share: lineage cuts in the shared folder, union-find over links, and linking inside buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARROW_ROWS = 500
BROADCAST_ROWS = 1_000_000  # of a few numbers each: some tens of MB
DIRECT = 8  # members of a bucket whose pairs are compared one by one: a few a member at most


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches hold so many rows at most: the default of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of this machine only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (id, component) per node, the component being its smallest id.

    Distributed union-find by alternating star contraction: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows, until the links are stars. Each step is one grouping with map-side minima and
    one join, which Spark splits where a hub is hot. Ids may be of any type that orders. Self links and nulls are ignored.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = edges.select(F.explode(F.array(pair(F.col("a"), F.col("b")), pair(F.col("b"), F.col("a")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(pair(F.col("b"), F.col("m")), pair(F.col("a"), F.col("m")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots).distinct()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Those components (id, component) with more links (a, b) between any ids: only components that a link meets are contracted anew."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    over = components(ends).select(F.col("id").alias("component"), F.col("component").alias("least"))
    single = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups, "id", "left_anti")
    every = groups.select("id", "component").unionAll(single.select("id", F.col("id").alias("component")))
    return every.join(over, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def shared(members: DataFrame) -> DataFrame:
    """Those members (bucket, ...) whose bucket has another."""
    many = members.groupBy("bucket").agg(F.count("*").alias("__n")).where("__n > 1").select("bucket")
    return members.join(many, "bucket", "left_semi")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with the hint to broadcast it where it is known to have that many rows of a few numbers each at most."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefix_pairs(items: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets in different components that may have the Jaccard similarity, given their items (id, item).

    Prefix filter: in one order of all items, the rarest first, two such sets share one of the first
    n - ceil(threshold * n) + 1 items of each. Items of one set alone count in the order and are not joined; sizes and the
    places of the shared item bound the overlap before a row is made. No pair above the threshold is left out.
    """
    known = items.groupBy("item").agg(F.count("*").alias("df"))
    order = W.partitionBy("id").orderBy("df", "item")
    own = items.join(known, "item").select("id", "item", "df", (F.row_number().over(order) - 1).alias("at"), F.count("*").over(W.partitionBy("id")).alias("n"))
    own = own.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6)))
    own = cut(own.join(groups, "id", "left").select("id", "item", "at", "n", F.coalesce("component", "id").alias("component")))
    x, y = own.alias("x"), own.alias("y")
    low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    on = (F.col("x.item") == F.col("y.item")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    on = on & (low >= threshold * high - 1e-6) & (left >= (low + high) * (threshold / (1 + threshold)) - 1e-6)
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], items: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 1.0, stars: int = 2, direct: int = DIRECT, bound: tuple[DataFrame, Callable] | None = None) -> DataFrame:
    """Components (id, component) of the verified links between members (bucket, id) that share a bucket.

    Never all pairs of a large bucket: in each of ``stars`` rounds the components that a bucket holds are each compared with
    one member of the bucket's first component, and what is verified is merged. What then still shares a bucket without
    being in one component is compared pair by pair in buckets of ``direct`` members at most, and by ``prefix_pairs`` over the
    items of their members in larger ones, so that no link can be missed. ``items`` gives the sets' items (id, item) for a
    table of ids; without it large buckets are compared pair by pair too. ``bound`` is a table with a row for each id and a
    function that gives, of two aliases of it, a condition which all links meet: pairs that don't are not listed. ``verify`` takes distinct pairs (a, b), a < b, and
    returns those that are links. Members may come with the size and the least id (head) of their bucket, which are not counted then.
    """
    spark = members.sparkSession
    groups = tried = None
    headed = {"size", "head"} <= set(members.columns)
    members = members if headed else cut(members)
    pairs_of = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    for turn in range(stars + 1):
        if turn == 1 and headed:
            members = members.where("size > 2").select("bucket", "id")
        placed = members if groups is None else members.join(small_side(groups, groups.count()), "id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "id") if groups is not None else F.col("id"))
        if groups is not None:
            mixed = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("size"))
            # the one pair of a bucket of two has been compared
            placed = cut(placed.join(mixed.where("p <> q and size > 2").select("bucket", "size"), "bucket"))
        if turn == 0 and headed:
            found = members.where("id <> head").select(*pairs_of(F.col("id"), F.col("head")))
        elif turn < stars:
            # a different member stands for its component in each turn
            order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id") if turn else F.struct(F.lit(0).alias("h"), "id")
            one = placed.groupBy("bucket", "component").agg(F.min(order).alias("o")).select("bucket", "component", F.col("o.id").alias("id"))
            head = one.groupBy("bucket").agg(F.min(F.struct("component", "id")).alias("head"))
            found = one.join(head, "bucket").where(F.col("component") != F.col("head.component")).select(*pairs_of(F.col("id"), F.col("head.id")))
        else:
            some = placed if items is None else placed.where(F.col("size") <= direct)
            on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component"))
            if bound is not None:
                own = some.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
                # a pair is listed in the first bucket that it shares, not in each
                first = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")
                some, on = some.join(bound[0], "id").join(own, "id"), on & bound[1]("x", "y") & first
            found = some.alias("x").join(some.alias("y"), on).select(*pairs_of(F.col("x.id"), F.col("y.id")))
            if items is not None:
                large = cut(placed.where(F.col("size") > direct).select("id").distinct())
                if not large.isEmpty():
                    found = found.unionAll(prefix_pairs(items(large), groups, threshold).select(*pairs_of(F.col("a"), F.col("b"))))
        found = found.distinct()
        found = cut(found if tried is None else found.join(tried, ["a", "b"], "left_anti"))
        if found.isEmpty():
            if groups is None:
                break
            continue
        tried = found if tried is None else tried.unionAll(found)
        good = cut(verify(found).select("a", "b"))
        if groups is None:
            groups = cut(components(good))
        elif not good.isEmpty():
            groups = cut(merged(groups, good))
    if groups is None:
        kind = members.schema["id"].dataType
        return spark.createDataFrame([], f"id {kind.simpleString()}, component {kind.simpleString()}")
    return groups
