"""URL filters: host and path rules, then association rules mined by FP-growth, in DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.002, 0.6
LEAST = 5  # labelled urls that a rule must fit
LIFT = 1.1  # of a rule: its confidence over the share of its label among all labelled urls
STEPS = 10**6  # of a confidence or a support in the order of rules
BLOCK, ALLOW = "label=block", "label=allow"


def host_and_path(url):
    """The host, A-Z made small, and the path of a url; both empty for null and for a url without ``://``."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    after = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    small = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, small).otherwise(""), F.when(has, path).otherwise("")


def matched_rule(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | F.endswith(host, F.lit("." + r[0]))) & F.startswith(path, F.lit(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest):
        rule, verdict = F.when(fits(r), r[0] + r[1]).otherwise(rule), F.when(fits(r), r[2]).otherwise(verdict)
    return rule, verdict


def tokens(url, host, path):
    """The distinct tokens of a url: scheme, host and its labels by place from the right, path parts without their digits,
    extension, query keys, fragment."""
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    named = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:/?#]*)://", 1)), F.concat(F.lit("host="), host)),
        F.transform(labels, lambda x, i: F.concat(F.lit("label"), i.cast("string"), F.lit("="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, lift: float = LIFT) -> DataFrame:
    """Rules (rule_id, antecedent, index_token, blocks, confidence, support) from labelled urls (tokens, label).

    Frequent combinations of tokens by FP-growth over all labelled urls; those rules are kept whose consequent is a label,
    with the given support and confidence, if their confidence is at least ``lift`` times the share of that label among all
    labelled urls: others restate the share. ``index_token`` is the antecedent's rarest token. No labels give no rules.
    """
    baskets = cut(labelled.select(F.concat("tokens", F.array("label")).alias("items")))
    total = baskets.count()
    if not total:
        return baskets.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, index_token string, blocks boolean, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / total), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).isin(BLOCK, ALLOW))
    rules = rules.where(~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
    rules = rules.where(F.col("lift") >= lift)
    rules = rules.select(F.xxhash64(F.array_sort("antecedent"), "consequent").alias("rule_id"), "antecedent", (F.element_at("consequent", 1) == BLOCK).alias("blocks"), "confidence", "support")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    each = rules.select("rule_id", F.explode("antecedent").alias("token")).join(counts, "token")
    rarest = each.groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("r")).select("rule_id", F.col("r.token").alias("index_token"))
    return cut(rules.join(rarest, "rule_id").select("rule_id", "antecedent", "index_token", "blocks", "confidence", "support"))


def judged(pages: DataFrame, labels: DataFrame, url: str = "url", id: str = "page_id", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) of each url, one row for each row of pages.

    A url gets the verdict of the longest fixed rule that fits it. Others get that of the mined rule with the highest
    confidence, then support, both to 1e-6, then longest antecedent, then block, among those whose antecedent's tokens it all
    has; rules are found by an inverted index from their rarest token, which is broadcast where it is small. Where none fits, and for a null url, the verdict is allow. Labels (id, label)
    are of any urls in pages; a null label or id teaches nothing, and a null page id is a
    page like others.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"), F.col(url).alias("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    kinds = rows.where("rule is null and url is not null").select("url", "host", "path").distinct()
    kinds = cut(kinds.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    known = pages.select(F.col(id).alias("id"), F.col(url).alias("url")).where("url is not null").join(labels.where("id is not null and label is not null"), "id")
    known = known.select("url", "label", *(c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))))
    mined = mine(known.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "label"))
    # one number orders the rules and says what they say: confidence and support in 21 bits each, then length, then the verdict
    order = F.round(F.col("confidence") * STEPS).cast("long") * 2**42 + F.round(F.col("support") * STEPS).cast("long") * 2**21 + F.least(F.size("antecedent"), F.lit(2**19)) * 2 + F.col("blocks").cast("long")
    index = cut(mined.select("index_token", "antecedent", order.alias("order")))
    hits = kinds.select("url", "tokens", F.explode("tokens").alias("index_token")).join(small_side(index, 10 * index.count()), "index_token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("url").agg(F.max("order").alias("best"))
    best = best.select("url", F.when(F.col("best") % 2 == 1, "block").otherwise("allow").alias("mined"), (F.shiftright("best", 42) / STEPS).alias("confidence"))
    out = rows.join(best, "url", "left")
    return out.select("id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def label_rows(labels: DataFrame) -> DataFrame:
    """(id, label): toxic or low-quality is to be blocked."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return labels.select(F.col("doc_id").alias("id"), F.when(bad, BLOCK).otherwise(ALLOW).alias("label"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; labels are those of the documents with the pages' ids."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    out = judged(pages.select("page_id", "url"), label_rows(labels))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("confidence", 6).alias("confidence"))
