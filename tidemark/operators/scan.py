"""Recurrences over ordered rows: prefix scans over range partitions, and ordered folds by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from ..sources.shared import written

SMALL_ROWS = 200_000  # of a summary table that may be broadcast: some numbers each


@dataclass
class Affine:
    """y = a * (y before) + b in the order of a key's rows, where y begins as the key's first ``start`` that is not null.

    ``before`` gives a row the value that it finds, not the one that it leaves. Where a is null the row leaves y as it is; rows
    before the first start have to be such, and get it too.
    """

    a: Column
    b: Column
    start: Column
    before: bool = False


def _blocks(keys: pa.Array) -> list[tuple[int, int]]:
    """Stretches [low, high) of rows with one key."""
    if not len(keys):
        return []
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    return list(zip(edges, edges[1:]))


def _sorted(rows: DataFrame, key: str, order: list[str], more: list[str], run: Callable) -> DataFrame:
    """The rows in one global order, dealt by ranges of (key, order), with what ``run`` adds, written: a key with very many
    rows is many partitions. ``__part`` and ``__at`` say where a row stands; a table written once is read the same again."""
    schema = StructType(list(rows.schema.fields)).add("__at", LongType())
    for c in more:
        schema = schema.add(c, rows.schema[c.removeprefix("previous_")].dataType if c.startswith("previous_") else DoubleType())
    return written(rows.orderBy(key, *order).mapInArrow(run, schema).withColumn("__part", F.spark_partition_id()), "ordered")


def _carried(summary: DataFrame) -> DataFrame:
    """A summary of (part, key), with the hint to broadcast it where it is small."""
    return F.broadcast(summary) if summary.count() <= SMALL_ROWS else summary


def with_previous(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``previous_<column>`` of the key's row before; null at its first row. ``first`` tells that row.

    Each range partition looks back in itself; the first row of a key there gets the last one of an earlier partition, by
    a table of one row for each partition and key.
    """
    names = [f"previous_{c}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last_key, last = 0, None, None
        for batch in batches:
            keys = batch.column(key)
            added = [[] for _ in columns]
            for low, high in _blocks(keys):
                same = last is not None and keys[low].as_py() == last_key
                for out, c, i in zip(added, columns, range(len(columns))):
                    head = pa.array([last[i] if same else None], batch.schema.field(c).type)
                    out += [head, batch.column(c).slice(low, high - low - 1)]
                last_key, last = keys[high - 1].as_py(), [batch.column(c)[high - 1].as_py() for c in columns]
            if not len(keys):
                continue
            number = pa.array(range(at, at + len(keys)), pa.int64())
            at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, number, *(pa.concat_arrays(x) for x in added)], names=[*batch.schema.names, "__at", *names])

    done = _sorted(rows, key, [order], names, run)
    ends = done.groupBy("__part", F.col(key).alias("__key")).agg(F.min("__at").alias("__low"), F.max_by(F.struct(*columns), "__at").alias("__last"))
    w = W.partitionBy("__key").orderBy("__part")
    ends = written(ends.select(F.col("__part").alias("__p"), "__key", "__low", F.lag("__last").over(w).alias("__last"), (F.row_number().over(w) == 1).alias("__begins")), "ends")
    joined = done.join(_carried(ends), (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    edge = F.col("__at") == F.col("__low")
    filled = [F.when(edge, F.col(f"__last.{c}")).otherwise(F.col(n)).alias(n) for c, n in zip(columns, names)]
    return joined.select(*rows.columns, *filled, (edge & F.col("__begins")).alias("first"))


#: Rows of a key in a batch, in the mean, from which an array operation for each key is faster than a loop over rows.
LONG = 16


def _composed(a: list, b: list, blocks: list, reset: list, x: float, y: float, before: bool) -> tuple[list, list]:
    """The maps composed up to every row, from (x, y) on or anew from where ``reset`` says; and at the end the last one."""
    out_x, out_y = [0.0] * len(a), [0.0] * len(a)
    for (low, high), anew in zip(blocks, reset):
        if anew:
            x, y = 1.0, 0.0
        for j in range(low, high):
            if before:
                out_x[j], out_y[j] = x, y
            x, y = a[j] * x, a[j] * y + b[j]
            if not before:
                out_x[j], out_y[j] = x, y
    return [*out_x, x], [*out_y, y]


def affine_scans(rows: DataFrame, key: str, order: str | list[str], maps: dict[str, Affine]) -> DataFrame:
    """The rows with a column for each recurrence ``out: Affine``, by one prefix scan for all.

    Maps y -> a y + b compose to maps of the same form. The rows are dealt by ranges of (key, order), so that a key which
    holds most rows is the work of many tasks; each composes the maps from a key's first row in its partition to every row,
    in Arrow batches. The last map of each partition and key is a row of a small table, whose fold by key gives the value
    that a partition starts with; a projection then puts it through each row's map. The rows move once.
    """
    names = list(maps)
    plain = rows.columns
    for i, m in enumerate(maps.values()):
        rows = rows.withColumns({f"__a{i}": F.coalesce(m.a.cast("double"), F.lit(1.0)), f"__b{i}": F.when(m.a.isNull(), 0.0).otherwise(F.coalesce(m.b.cast("double"), F.lit(0.0))), f"__s{i}": m.start.cast("double")})
    before = [m.before for m in maps.values()]
    more = [f"__{x}{i}" for i in range(len(names)) for x in ("P", "Q")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last_key, totals = 0, None, None
        for batch in batches:
            keys = batch.column(key)
            if not len(keys):
                continue
            blocks, values = _blocks(keys), []
            reset = [totals is None or keys[low].as_py() != last_key or low > 0 for low, _ in blocks]
            state = totals or [(1.0, 0.0)] * len(names)
            totals = []
            for i in range(len(names)):
                a, b = batch.column(f"__a{i}").to_numpy(), batch.column(f"__b{i}").to_numpy()
                x, y = state[i]
                out_x, out_y = np.zeros(len(a)), np.zeros(len(a))
                if LONG * len(blocks) <= len(a) and (a == 1).all():  # running sums of long stretches
                    for (low, high), anew in zip(blocks, reset):
                        if anew:
                            x, y = 1.0, 0.0
                        sums = np.cumsum(np.concatenate(([y], b[low:high])))
                        out_x[low:high], out_y[low:high], y = x, sums[:-1] if before[i] else sums[1:], float(sums[-1])
                else:
                    out_x, out_y = _composed(a.tolist(), b.tolist(), blocks, reset, x, y, before[i])
                    x, y = out_x.pop(), out_y.pop()
                totals.append((x, y))
                values += [pa.array(out_x), pa.array(out_y)]
            last_key = keys[len(keys) - 1].as_py()
            number = pa.array(range(at, at + len(keys)), pa.int64())
            at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, number, *values], names=[*batch.schema.names, "__at", *more])

    done = _sorted(rows, key, [order] if isinstance(order, str) else order, more, run)
    total = lambda i: (F.col(f"__a{i}") * F.col(f"__P{i}"), F.col(f"__a{i}") * F.col(f"__Q{i}") + F.col(f"__b{i}")) if before[i] else (F.col(f"__P{i}"), F.col(f"__Q{i}"))
    flat = []
    for i in range(len(names)):
        a, b = total(i)
        flat += [F.max_by(a, "__at").alias(f"a{i}"), F.max_by(b, "__at").alias(f"b{i}"), F.min_by(f"__s{i}", F.when(F.col(f"__s{i}").isNotNull(), F.col("__at"))).alias(f"s{i}")]
    ends = done.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(*flat)
    w = W.partitionBy("__key").orderBy("__p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.withColumns({f"s{i}": F.first(f"s{i}", ignorenulls=True).over(w) for i in range(len(names))})

    def carry(state: dict, row) -> tuple:
        found = []
        for i in range(len(names)):
            y = state.get(i, getattr(row, f"s{i}"))
            found.append(y)
            if y == y:
                state[i] = getattr(row, f"a{i}") * y + getattr(row, f"b{i}")
        return tuple(found)

    schema = ", ".join(f"{f.name.replace('__', '_')} {f.dataType.simpleString()}" for f in ends.schema.fields)
    schema += "".join(f", y{i} double" for i in range(len(names)))
    starts = fold(ends.withColumnsRenamed({"__key": "_key", "__p": "_p"}), "_key", ["_p"], carry, schema)
    starts = written(starts.select("_key", "_p", *(F.nanvl(f"y{i}", F.lit(None)).alias(f"y{i}") for i in range(len(names)))), "starts")
    joined = done.join(_carried(starts), (F.col("__part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    value = lambda i: F.when(F.col(f"__P{i}") == 0, F.col(f"__Q{i}")).otherwise(F.col(f"__P{i}") * F.col(f"y{i}") + F.col(f"__Q{i}"))
    return joined.select(*plain, *(value(i).alias(n) for i, n in enumerate(names)))


def emas(rows: DataFrame, key: str, order: str, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Exponential means ``out: (value, alpha)``, each with the first value as its seed, in one pass."""
    return affine_scans(rows, key, order, {out: Affine(F.lit(1 - alpha), alpha * F.col(value), F.col(value)) for out, (value, alpha) in means.items()})


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float, out: str) -> DataFrame:
    """Exponential mean with the first value as its seed."""
    return emas(rows, key, order, {out: (value, alpha)})


#: Constant, weight of a squared return, more of it after a fall, weight of the variance before.
GARCH = (5e-6, 0.06, 0.10, 0.87)


def garch(rows: DataFrame, key: str, order: str, value: str, out: str, parameters: tuple[float, float, float, float] = GARCH) -> DataFrame:
    """Volatility whose variance is omega + (alpha + gamma [r < 0]) r^2 + beta * variance, r being the return of the row before.

    The first row has the long-run variance."""
    omega, alpha, gamma, beta = parameters
    long_run = omega / max(0.01, 1 - alpha - gamma / 2 - beta)
    r = F.col(value)
    found = affine_scans(rows, key, order, {"__variance": Affine(F.lit(beta), omega + (alpha + F.when(r < 0, gamma).otherwise(0.0)) * r * r, F.lit(long_run), before=True)})
    return found.withColumn(out, F.sqrt("__variance")).drop("__variance")


def adx(bars: DataFrame, key: str = "symbol", order: str = "ts", n: int = 14) -> DataFrame:
    """plus_di, minus_di and adx: Wilder means of directional movement over that of the true range, from the second bar on.

    They are 0 at the first bar and where the range is none, which leaves the means as they are. Three passes in order: the
    bar before, the means of movement, and the mean of what they give.
    """
    ph, pl, pc = (F.col(f"previous_{c}") for c in ("high", "low", "close"))
    rows = with_previous(bars, key, order, ["high", "low", "close"])
    up, down = F.col("high") - ph, pl - F.col("low")
    moved = {"__p": F.when((up > down) & (up > 0), up).otherwise(0.0), "__m": F.when((down > up) & (down > 0), down).otherwise(0.0), "__t": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))}
    later = ~F.col("first")
    mean = lambda x, when: Affine(F.when(when, F.lit(1 - 1 / n)), x / n, F.when(when, x))
    rows = affine_scans(rows, key, order, {out: mean(x, later) for out, x in moved.items()})
    moves = later & (F.col("__t") >= 1e-10)
    rows = rows.withColumns({"__moves": moves, "plus_di": F.when(moves, 100 * F.col("__p") / F.col("__t")).otherwise(0.0), "minus_di": F.when(moves, 100 * F.col("__m") / F.col("__t")).otherwise(0.0)})
    total = F.col("plus_di") + F.col("minus_di")
    dx = F.when(total <= 1e-10, 0.0).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)
    rows = affine_scans(rows, key, order, {"__adx": mean(dx, F.col("__moves"))})
    return rows.select(*bars.columns, "plus_di", "minus_di", F.when(F.col("__moves"), F.col("__adx")).otherwise(0.0).alias("adx"))


def fold(rows: DataFrame, key: str, order: list[str], step: Callable[[dict, object], tuple], schema: str, start: Callable[[], dict] = dict, dealt: bool = False) -> DataFrame:
    """An ordered fold per key for state that no window or scan can carry.

    ``step`` takes the key's state and a row and returns what is put after the row's columns named in ``schema``, which
    begins with the columns of ``rows``. Rows of a key come in order to one task, in Arrow batches, so that a long history
    never stands in memory; state does not leave the task. ``dealt`` says that rows of a key are in one partition already.

    The rows are dealt by a hash of the key, not by the key: below a dealing by the key itself that a join has made already
    Spark leaves the second one out, and may then split a key's rows for the join, since nothing asks it not to.
    """
    names = rows.columns
    at = names.index(key)
    more = [c.split()[0] for c in schema.split(",")][len(names) :]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = current = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if state is None or row[at] != current:
                    state, current = start(), row[at]
                out.append(step(state, row))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=more)], axis=1)

    return (rows if dealt else rows.repartition(F.xxhash64(key))).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def latch(set_to: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value up to here: a position that holds until a signal changes it."""
    return F.last(set_to, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
