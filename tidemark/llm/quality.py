"""Quality rules: counted base rules, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, cut, small_side

COVERAGE = 0.75  # share of a group that the determinant is minimised over
STEPS = 5  # concentration steps
LEAST_GROUP = 50  # smaller groups are judged by the estimate of all
TAIL = 1e-4  # chance of a regular text to be rejected, were its statistics normal
FEATURES = ("f0", "f1", "f2", "f3")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_SD = 1e-3  # standard deviation of a statistic that does not vary, so that a scatter can be inverted
REPEAT = 10  # words of a 5-word run and its repetition
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _chi2(x: float, dof: int) -> float:
    """Distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, dof) < p else (low, mid)
    return high


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, text):
                w = words.split_words(part.column(text))
                h, rows = w.hashes(), part.num_rows
                n = np.diff(w.first)
                data, offsets = w.data, w.offsets
                heads = np.append(0, np.cumsum((data & 192) != 128))  # code points before each byte
                chars = np.bincount(w.row, heads[w.end] - heads[w.start], rows)
                marks = np.append(0, np.cumsum(SYMBOLS[data]))
                symbols = marks[offsets[1:]] - marks[offsets[:-1]]
                value, at = words.shingles(h, w.row, 5)
                order = np.lexsort((value, w.row[at]))
                v, r = value[order], w.row[at][order]
                same = np.zeros(len(v) + 1, bool)
                same[1:-1] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
                twice = at[order][same[1:] | same[:-1]]
                change = np.zeros(len(h) + 1, np.int64)
                np.add.at(change, twice, 1)
                np.add.at(change, twice + 5, -1)
                repeat = np.bincount(w.row[np.cumsum(change)[:-1] > 0], minlength=rows)
                dup = []
                for t in part.column(text).to_pylist():
                    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                    dup.append(len(lines) - len(set(lines)))
                yield pa.record_batch([*(part.column(c) for c in names), *(pa.array(np.asarray(x).astype(np.int64)) for x in (n, chars, symbols, dup, repeat))], names=[*names, *COUNTS])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(rest)
    for c in COUNTS:
        schema = schema.add(c, LongType())
    return docs.mapInArrow(run, schema)


def with_features(stats: DataFrame) -> DataFrame:
    """base_failed, and the transformed statistics: word length, symbols a word, repeated words, repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "f0": F.col("word_chars") / n,
            "f1": F.log1p(10 * F.col("n_symbols") / n),
            "f2": F.sqrt(F.col("n_repeat_words") / n),
            "f3": F.sqrt(F.col("n_dup_lines") / n),
        }
    )


def _shapes(mean: pd.Series, cov: pd.Series, factor: pd.Series) -> pd.DataFrame:
    """Covariance made consistent by a factor and kept from being singular, its inverse and determinant."""
    p = len(FEATURES)
    out = []
    for m, c, f in zip(mean, cov, factor):
        c = np.array(c, float).reshape(p, p) * f
        scale = np.sqrt(np.maximum(np.diag(c), LEAST_SD**2))
        own = np.sqrt(np.maximum(np.diag(c), 1e-12))
        r = c / np.outer(own, own)
        r = 0.95 * r + 0.05 * np.eye(p)
        np.fill_diagonal(r, 1.0)
        full = r * np.outer(scale, scale)
        out.append((list(m), full.ravel().tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.det(full))))
    return pd.DataFrame(out, columns=["mean", "cov", "inverse", "det"])


def _shape(mean, cov, factor):
    return F.pandas_udf(_shapes, "struct<mean array<double>, cov array<double>, inverse array<double>, det double>")(mean, cov, factor)


def distance(mean, inverse):
    """Squared Mahalanobis distance of the features, as a column."""
    p = len(FEATURES)
    d = [F.col(f) - F.get(mean, F.lit(i)) for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            total = total + d[i] * d[j] * F.get(inverse, F.lit(i * p + j))
    return total


def sampling_variances(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Variances that the features of regular texts of n words have by chance alone, a row a text.

    Word lengths spread by about half their mean; symbols, repeated runs and repeated lines are counts, which vary by their
    expected number, one at least.
    """
    n = np.maximum(n, 1.0)
    symbols = np.maximum(n * np.expm1(mean[:, 1]) / 10, 1.0)
    return np.stack([(mean[:, 0] / 2) ** 2 / n, symbols * (10 / (n + 10 * symbols)) ** 2, REPEAT / n / 4, 1 / n / 4], 1)


def _row_distances(mean: pd.Series, cov: pd.Series, n: pd.Series, *features: pd.Series) -> pd.Series:
    """Squared distance by the scatter of a text's group, each variance being at least that of chance at its n words."""
    out, p = np.full(len(n), np.nan), len(FEATURES)
    some = np.flatnonzero(mean.notna().to_numpy())
    if len(some):
        m, c = np.stack(mean.iloc[some].tolist()), np.stack(cov.iloc[some].tolist()).reshape(-1, p, p)
        own = np.sqrt(np.diagonal(c, axis1=1, axis2=2))
        stretch = np.maximum(np.sqrt(sampling_variances(m, n.to_numpy(float)[some])) / own, 1.0)
        d = np.stack([f.to_numpy(float)[some] for f in features], 1) - m
        out[some] = (d * np.linalg.solve(c * stretch[:, :, None] * stretch[:, None, :], d[:, :, None])[:, :, 0]).sum(1)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """(g, start, mean, cov, inverse, det) of each group of rows (g, start, features)."""
    pairs = [(a, b) for a in FEATURES for b in FEATURES]
    cov = F.array(*(F.covar_pop(a, b) for a, b in pairs))
    found = rows.groupBy("g", "start").agg(F.array(*(F.avg(f) for f in FEATURES)).alias("m"), cov.alias("c"))
    return found.select("g", "start", _shape("m", "c", F.lit(float(factor))).alias("s")).select("g", "start", "s.*")


def robust_estimates(stats: DataFrame) -> DataFrame:
    """(g, mean, cov, inverse, det): location and scatter of the half-spread COVERAGE of each group's rows (g, features).

    Deterministic fast MCD of two starts: medians with scaled median absolute deviations, and the mean and covariance of all.
    Each concentration step keeps the COVERAGE of a group nearest to the last estimate and estimates again, by which the
    determinant never grows but through LEAST_SD; of the two ends the one with the lesser determinant is taken. Every step is
    two groupings of all rows with map-side aggregates; estimates are a few numbers a group.
    """
    p = len(FEATURES)
    reach = _chi2_quantile(COVERAGE, p)
    factor = COVERAGE / _chi2(reach, p + 2)
    mid = cut(stats.groupBy("g").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m_{f}") for f in FEATURES)))
    groups = mid.count()
    off = stats.join(small_side(mid, groups), "g").select("g", *(F.abs(F.col(f) - F.col(f"m_{f}")).alias(f) for f in FEATURES))
    mad = off.groupBy("g").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"d_{f}") for f in FEATURES))
    diagonal = F.array(*((F.col(f"d_{f}") * 1.4826) ** 2 if i == j else F.lit(0.0) for i, f in enumerate(FEATURES) for j in range(p)))
    robust = mid.join(mad, "g").select("g", _shape(F.array(*(F.col(f"m_{f}") for f in FEATURES)), diagonal, F.lit(1.0)).alias("s")).select("g", "s.*")
    estimate = robust.withColumn("start", F.lit(0)).unionByName(_moments(stats.withColumn("start", F.lit(1)), 1.0))
    for _ in range(STEPS):
        estimate = cut(estimate)
        near = stats.join(small_side(estimate, 2 * groups), "g").select("g", "start", *FEATURES, distance(F.col("mean"), F.col("inverse")).alias("d2"))
        limit = cut(near.groupBy("g", "start").agg(F.percentile_approx("d2", COVERAGE, 1000).alias("q")))
        estimate = _moments(near.join(small_side(limit, 2 * groups), ["g", "start"]).where("d2 <= q"), factor)
    best = F.min_by(F.struct("mean", "cov", "inverse", "det"), F.struct("det", "start")).alias("s")
    return cut(cut(estimate).groupBy("g").agg(best).select("g", "s.*"))


def judged(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The documents' columns but the text, the counts, base_failed, kept and the squared distance.

    A text that passes the base rules is kept unless its transformed statistics lie further from those of its language and
    source than all but TAIL of a normal distribution; the scatter is the robust one, and no statistic is taken for more exact
    than its sampling error at the text's number of words. The estimates come from all texts that pass; groups with fewer than
    LEAST_GROUP of them are judged by the estimate of all. A null language or source is a value like another. A null text
    has no words, and fails. Columns with the names of results are replaced; repeated rows count as often as they stand, and
    get equal verdicts, as ties do.
    """
    bounded_batches(docs.sparkSession)
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in by)))
    clash = [c for c in docs.columns if c in ("g", "kept", "d2", "own", "mean", "cov", "base_failed", *COUNTS, *FEATURES)]
    stats = cut(with_features(statistics(docs.drop(*clash).withColumn("g", key), text)))
    good = stats.where(~F.col("base_failed")).select("g", *FEATURES)
    large = good.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUP).select("g", F.col("g").alias("own"))
    large = cut(large)
    # the estimate of all has the key ''; salted partial sums are Spark's own map-side aggregates
    estimates = robust_estimates(good.join(large, "g").select("g", *FEATURES).unionAll(good.select(F.lit("").alias("g"), *FEATURES)))
    placed = stats.join(large, "g", "left").withColumn("own", F.coalesce("own", F.lit("")))
    estimates = estimates.select(F.col("g").alias("own"), "mean", "cov")
    placed = placed.join(small_side(estimates, estimates.count()), "own", "left").withColumn("d2", F.pandas_udf(_row_distances, "double")("mean", "cov", "n_words", *FEATURES))
    limit = _chi2_quantile(1 - TAIL, len(FEATURES))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    return placed.withColumn("kept", kept).drop("own", "g", "mean", "cov", *FEATURES)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs).select(*names, F.round("d2", 3).alias("distance2"))
