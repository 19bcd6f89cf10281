"""Operators against numpy twins, published constants, and metamorphic checks."""

import math
import random
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import book, detectors, features, ledger, pairs, runs, scan, signals, single, stats, tables
from tidemark.sources import equity_reports
from tidemark.streaming import streams


def series(spark, n=300, keys=3, seed=1, parts=4):
    rnd = random.Random(seed)
    rows = [(f"k{k}", i, rnd.uniform(1, 9), rnd.uniform(-1, 1)) for k in range(keys) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "symbol string, ts long, close double, ret double").repartition(parts)


def mean_of(rows, key, alpha=0.2):
    y, out = None, {}
    for _, i, c, _ in sorted(r for r in rows if r[0] == key):
        y = c if y is None else (1 - alpha) * y + alpha * c
        out[key, i] = y
    return out


@contextmanager
def partitions(spark, n):
    """So many partitions of every shuffle, however small."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(was, (str(n), "false")):
            spark.conf.set(c, v)
        yield
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_affine_scan_equals_loop_for_any_partitions(spark):
    rows, df = series(spark)
    want = {k: v for key in ("k0", "k1", "k2") for k, v in mean_of(rows, key).items()}
    for n in (1, 3, 40):
        with partitions(spark, n):
            got = {(r["symbol"], r["ts"]): r["e"] for r in scan.ema(df, "symbol", "ts", "close", 0.2, "e").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_one_key_is_the_work_of_many_tasks(spark):
    """One key with all rows: it is dealt over the partitions, none of which holds much more than its share, and joins up."""
    rows, df = series(spark, 20_000, 1)
    with partitions(spark, 16):
        found = scan._sorted(df, "symbol", ["ts"], [], lambda batches: (pa.RecordBatch.from_arrays([*b.columns, pa.array(range(b.num_rows), pa.int64())], names=[*b.schema.names, "__at"]) for b in batches))
        shares = [r["n"] for r in found.groupBy("__part").agg(F.count("*").alias("n")).collect()]
        got = {(r["symbol"], r["ts"]): r["e"] for r in scan.ema(df, "symbol", "ts", "close", 0.2, "e").collect()}
    assert len(shares) == 16 and max(shares) < 2 * 20_000 / 16
    want = mean_of(rows, "k0")
    assert len(got) == 20_000 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_with_previous_across_partitions(spark):
    rows = [("a", i, float(i), "x") for i in range(50)] + [("b", 1, 7.0, None)] + [(None, i, float(i), "n") for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double, first_name string").repartition(3)
    with partitions(spark, 12):
        got = {(r["symbol"], r["ts"]): (r["previous_close"], r["previous_first_name"], r["first"]) for r in scan.with_previous(df, "symbol", "ts", ["close", "first_name"]).collect()}
    assert len(got) == 60
    for k, i, _, name in rows:
        head = i == (1 if k == "b" else 0)
        assert got[k, i] == ((None, None, True) if head else (float(i - 1), name, False))
    assert scan.with_previous(df.limit(0), "symbol", "ts", ["close"]).count() == 0


def test_maps_that_wait_and_begin_late(spark):
    """Nulls leave the value; the first start may come some rows after the key's first row."""
    rows = [("a", i, None if i < 7 or i % 3 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double").repartition(2)
    x = F.col("x")
    with partitions(spark, 9):
        got = {r["ts"]: (r["y"], r["z"]) for r in scan.affine_scans(df, "symbol", "ts", {"y": scan.Affine(F.when(x.isNotNull(), 0.5), x / 2, x), "z": scan.Affine(F.lit(1.0), F.lit(1.0), F.lit(5.0), before=True)}).collect()}
    y = None
    for _, i, v in rows:
        if v is not None:
            y = v if y is None else 0.5 * y + v / 2
        assert got[i][1] == 5.0 + i
        assert abs(got[i][0] - (7.0 if y is None else y)) < 1e-12


def test_garch_equals_loop(spark):
    rows, df = series(spark, 80, 1)
    with partitions(spark, 9):
        got = [r["v"] for r in scan.garch(df, "symbol", "ts", "ret", "v").orderBy("ts").collect()]
    omega, alpha, gamma, beta = scan.GARCH
    h, before, want = omega / (1 - alpha - gamma / 2 - beta), None, []
    for _, _, _, x in sorted(rows):
        if before is not None:
            h = omega + (alpha + (gamma if before < 0 else 0)) * before * before + beta * h
        want.append(math.sqrt(h))
        before = x
    assert np.allclose(got, want)


def test_adx_equals_loop(spark):
    rnd = random.Random(8)
    bars, price = [], 100.0
    for i in range(120):
        price = price if 40 < i < 80 else price + rnd.uniform(-2, 2)
        spread = 0.0 if 40 < i < 80 else rnd.uniform(0, 1)
        bars.append(("k", i, price + spread, price - spread, price))
    state, want = {}, []
    for _, _, high, low, close in bars:
        want.append(detectors.adx_step(state, high, low, close))
    df = spark.createDataFrame(bars, "symbol string, ts long, high double, low double, close double").repartition(3)
    with partitions(spark, 7):
        got = [(r["adx"], r["plus_di"], r["minus_di"]) for r in scan.adx(df).orderBy("ts").collect()]
    assert np.allclose(got, want, atol=1e-6) and max(x[0] for x in want) > 0


def test_fold_is_ordered_whatever_the_partitions(spark):
    rows, df = series(spark, 60)
    step = lambda s, x: (s.__setitem__("n", s.get("n", 0) + 1) or s["n"],)
    for parts in (1, 5):
        out = scan.fold(df.repartition(parts), "symbol", ["ts"], step, "symbol string, ts long, close double, ret double, n int")
        assert all(r["n"] == r["ts"] + 1 for r in out.collect())


def pair_bars(n=900, seed=5):
    """Hourly prices of two legs whose spread reverts, with a jump that stops a position."""
    rnd, spread, out = random.Random(seed), 0.0, []
    for i in range(n):
        spread = 0.97 * spread + rnd.gauss(0, 0.01) + (0.15 if i > 400 and i % 50 == 0 else 0.0)
        b = 50 * math.exp(0.1 * math.sin(i / 90))
        out.append(("a/b", 1_700_006_400_000 + i * 3_600_000, b**0.8 * math.exp(0.3 + spread), b, 0.3, 0.8, 9.0, 0, 0))
    return out


MONTH = {"enter": 1.0, "leave": 0.3, "stop": 3.0, "window": 6, "longest": 5, "shortest": 1, "close_minute": 1500, "offset_hours": 0}


def test_streamed_pair_machine_is_that_of_the_batch(spark, tmp_path):
    machine = pairs.PairLegs(**MONTH)
    names = "pair_id string, millis long, price_a double, price_b double, alpha double, beta double, kappa double, max_hold int, blocked_until long"
    rows = pair_bars()
    df = spark.createDataFrame(rows, names)
    step = lambda s, x: machine.step(s, x.millis, x.price_a, x.price_b, x.alpha, x.beta, x.kappa, x.max_hold, x.blocked_until)
    schema = f"{names}, {pairs.PAIR_COLUMNS}"
    batch = {r["millis"]: tuple(r) for r in scan.fold(df, "pair_id", ["millis"], step, schema).collect()}
    edges = [0, rows[300][1], rows[301][1], 2**60]
    parts = [df.where((F.col("millis") >= low) & (F.col("millis") < high)) for low, high in zip(edges, edges[1:])]
    stream = {r["millis"]: tuple(r) for r in streams.drain(streams.keyed_steps(in_batches(spark, tmp_path, parts), "pair_id", ["millis"], step, schema), "pair-twin").collect()}
    assert batch == stream and len(batch) == 900
    events = [x[13] for x in batch.values() if x[13]]
    assert {"entry", "reversion", "stop_loss"} <= set(events) and all((a == "entry") != (b == "entry") for a, b in zip(events, events[1:]))


def test_pair_machine_rules():
    def run(rows, **more):
        machine, state = pairs.PairLegs(**(MONTH | more)), {}
        return [machine.step(state, *r[1:]) for r in rows]

    rows = pair_bars()
    plain = run(rows)
    entries = [i for i, x in enumerate(plain) if x[4] == "entry"]
    for i in entries:
        side, price_a = plain[i][3], rows[i][2]
        assert rows[i][1] % 86_400_000 == 0 and side == (1 if plain[i][1] < 0 else -1) and 1.0 < abs(plain[i][1]) <= 3.0
        assert plain[i][5] == side * math.floor(10_000 / price_a) and plain[i][6] * side < 0
        j = next(k for k in range(i + 1, len(plain)) if plain[k][4])
        assert (plain[j][5], plain[j][6]) == (-plain[i][5], -plain[i][6])
        if plain[j][4] == "reversion":
            assert side * plain[j][2] > -0.3
    assert all(x[4] != "entry" for x in run([(*r[:8], 2**60) for r in rows]))  # blacked out
    assert {x[4] for x in run([(*r[:7], 1, 0) for r in rows])} >= {"max_hold"}  # held for a day at most
    assert "eod_close" in {x[4] for x in run(rows, close_minute=1380)}
    assert "drift_stop" in {x[4] for x in run(rows, drift=0.5)}
    assert not any(x[4] for x in run(rows, last_hour=0)) and all(x == (None,) * 3 + (0,) + (None,) * 5 for x in run([(r[0], r[1], 0.0, *r[3:]) for r in rows]))
    intraday = run(rows, intraday=True, confirm=3)
    assert any(rows[i][1] % 86_400_000 for i, x in enumerate(intraday) if x[4] == "entry")
    count = lambda **more: sum(x[4] == "entry" for x in run([(*r[:7], 1, 0) for r in pair_bars(4000)], enter=0.5, **more))
    assert count(cost_bps=1e6) < count()  # five losses pause it


def test_adf_separates_reverting_from_walking():
    rng = np.random.default_rng(3)
    walk, back = np.cumsum(rng.normal(size=150)), np.zeros(150)
    for i in range(1, 150):
        back[i] = 0.6 * back[i - 1] + rng.normal()
    assert stats.adf_statistic(back)[0] < -4 < stats.adf_statistic(walk)[0]
    y, x = np.diff(back)[1:], np.column_stack([np.ones(148), back[1:-1], np.diff(back)[:-1]])
    b, ssr, *_ = np.linalg.lstsq(x, y, rcond=None)
    t = b[1] / math.sqrt(ssr[0] / 145 * np.linalg.inv(x.T @ x)[1, 1])
    assert abs(stats.adf_statistic(back, 1)[0] - t) < 1e-6 or stats.adf_statistic(back, 1)[1] == 0


def test_passage_time_is_the_quadrature():
    """The mean time between -k and k and back, of a unit process, is sqrt(2 pi) times the integral of exp(y^2 / 2)."""
    for k in (0.12, 0.5, 1.0, 2.0, 4.0):
        y = np.linspace(-k, k, 400_001)
        v = np.exp(y * y / 2)
        want = math.sqrt(2 * math.pi) * ((v[1:] + v[:-1]) / 2 * np.diff(y)).sum()
        assert abs(stats.passage_time(np.array([k]))[0] / want - 1) < 1e-6
    assert abs(stats.passage_time(np.array([1.0]))[0] - 5.991) < 1e-3


def test_bertram_threshold_is_a_maximum():
    k, rate, cycle = stats.best_threshold(42.4605095197822, 0.006483021011400561, 0.0005)
    f = lambda k: (2 * k * 0.006483021011400561 - 0.0005) * 42.4605095197822 / stats.passage_time(np.array([k]))[0]
    assert rate >= max(f(x) for x in np.linspace(0.05, 4, 800)) - 1e-9 and abs(f(k) - rate) < 1e-12 and cycle > 0
    assert stats.best_threshold(1.0, 0.001, 0.01) is None


def test_ou_fit_recovers_parameters(spark):
    rng = np.random.default_rng(9)
    x = [0.0]
    for _ in range(4000):
        x.append(0.02 + 0.9 * x[-1] + rng.normal(0, 0.1))
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, day int, spread double")
    r = stats.ou_fit(df, ["g"], n=4001).first()
    assert abs(r["b"] - 0.9) < 0.03 and abs(r["mu"] - 0.2) < 0.1 and abs(r["sigma_eq"] - 0.1 / math.sqrt(1 - 0.81)) < 0.04


def test_contributions_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"2024-01-{d:02d}", float(np.exp(rng.normal(3, 0.1)))) for s in "abcd" for d in range(1, 29)]
    closes = spark.createDataFrame(rows, "symbol string, day string, close double").withColumn("day", F.to_date("day"))
    baskets = spark.createDataFrame([("S", "a", p) for p in "bcd"], "sector string, target string, peer string")
    got = [r["contribution"] for r in stats.contributions(closes, baskets).collect()]
    assert len(got) == 4 and abs(sum(got) - 1) < 1e-9


def test_detectors():
    state, fired = {}, 0
    for x in [0.4] * 5:
        fired += detectors.cusum_step(state, x, 1.0)
    assert fired == 1
    rng = np.random.default_rng(1)
    state, runs = {}, []
    for x in np.concatenate([rng.normal(0, 0.01, 60), rng.normal(0.2, 0.01, 30)]):
        runs.append(detectors.change_point_step(state, float(x))[1])
    assert max(runs[:60]) > 30 and min(runs[60:70]) < 10
    state = {}
    assert detectors.change_point_step(state, 0.01) == (0.0, 0)
    two = {"log": [0.0, math.log(249.0)]}  # by hand: both from run 0, with chances of 1 and 249 in 250
    chance, run = detectors.change_point_step(state, 0.02)
    assert abs(chance - 1 / 250) < 1e-12 and run == 1 and np.allclose(state["log"] - state["log"][0], two["log"])
    assert list(state["n"]) == [1.0, 2.0] and np.allclose(state["total"], [0.02, 0.03])
    for _ in range(80):
        detectors.change_point_step(state, 0.01)
    assert len(state["log"]) == len(state["n"]) == 50 and state["n"][49] == 0 and state["n"][48] == 49
    state = {}
    for i in range(400):
        a, b, ready = detectors.kalman_step(state, float(np.sin(i)), 0.5 + 2 * float(np.sin(i)))
    assert ready and abs(a - 0.5) < 0.05 and abs(b - 2) < 0.05


def test_staged_orders_reach_the_target(spark):
    rows = [("a", 10.0, -5.0), ("b", 0.0, 7.0), ("c", 8.0, 3.0), ("d", -4.0, 0.0), ("e", 2.0, 2.0), ("f", None, 3.0)]
    b = spark.createDataFrame(rows, "symbol string, current_shares double, target_shares double")
    orders = book.staged_orders(b)
    after = {r["symbol"]: r["shares"] for r in book.apply_orders(b.fillna(0.0), orders, ["symbol"]).collect()}
    assert after == {"a": -5.0, "b": 7.0, "c": 3.0, "e": 2.0, "f": 3.0}
    assert orders.where("symbol = 'a'").count() == 2


def test_next_after_and_blackout(spark):
    orders = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "a", "2024-01-03"), (3, "b", "2024-01-01")], "order_id long, symbol string, day string").withColumn("day", F.to_date("day"))
    bars = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-03", 3.0)], "symbol string, day string, close double").withColumn("day", F.to_date("day"))
    got = {r["order_id"]: r["price"] for r in tables.next_after(orders, bars).collect()}
    assert got == {1: 3.0, 2: None, 3: None}


def test_streak_and_latch(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1, 0])], "symbol string, ts long, x int")
    out = df.select("ts", features.streak(F.col("x") == 1, ["symbol"], ["ts"]).alias("s"), scan.latch(F.when(F.col("x") == 0, F.col("ts")), ["symbol"], ["ts"]).alias("l")).orderBy("ts").collect()
    assert [r["s"] for r in out] == [1, 2, 0, 1, 2, 3, 0] and [r["l"] for r in out] == [None, None, 2, 2, 2, 2, 6]


def test_pair_score_parts(spark):
    """Hand-computed: each part alone, and what is missing."""
    rows = [(0.01, 8.0, 0.05, 0.9, False), (0.055, 1.5, 0.125, 2.0, False), (0.2, 27.5, 0.0, -1.0, True), (0.1, 41.0, 0.3, None, False), (None, None, None, None, True)]
    df = spark.createDataFrame(rows, "p double, life double, cv double, r2 double, broken boolean")
    got = [r[0] for r in df.select(stats.score(*(F.col(c) for c in df.columns))).collect()]
    assert np.allclose(got, [0.35 + 0.25 + 0.25 + 0.135, 0.175 + 0.125 + 0.125 + 0.15, 0.25 * 0.5, 0.0, 0.0])


def test_overlay_rule_dwells_confirms_and_scales():
    rule, state = signals.OverlayRule(), {}
    assert rule.step(state, False, 0.0, 0.0, 0.0, 1.0) == ("basket", "no_leadership", 0.0)
    assert rule.step(state, True, 0.0, 0.2, 0.0, 1.0) == ("basket", "healthy", 0.0)
    assert rule.step(state, True, 0.0, -0.01, 0.06, 0.5) == ("basket", "crowded", 0.0)
    assert rule.step(state, True, 0.0, 0.01, 0.06, 0.7) == ("sleeve", "weak_basket", 0.5)
    assert [rule.step(state, False, 0.0, 0.0, 0.12, 0.0) for _ in range(5)] == [("sleeve", "dwell", 0.25)] * 5
    assert [rule.step(state, x, 0.0, 0.0, 0.0, 0.0)[:2] for x in (False, True, False, False)] == [("sleeve", "active")] * 3 + [("basket", "cleared")]
    assert rule.step(state, True, 0.2, 0.03, 0.03, 0.9) == ("suppress", "conflict", 0.0)
    assert [rule.step(state, True, 0.2, 0.0, 0.0, 0.0)[1] for _ in range(6)] == ["dwell"] * 5 + ["active"]
    assert [rule.step(state, True, 0.05, 0.0, 0.0, 0.0)[:2] for _ in range(2)] == [("suppress", "active"), ("basket", "cleared")]
    assert rule.step({}, True, 0.1, 0.1, 0.0, 0.85)[:2] == ("sleeve", "spare_room")


def test_kelly_and_capital_by_hand(spark):
    from tidemark.operators import reports

    rows = [("a", 1, 2.0, 10.0, 1.0), ("a", 2, 4.0, 10.0, 2.0), ("a", 3, -1.0, 20.0, 1.0), ("b", 1, -5.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, n long, pnl double, capital_per_leg double, hold_days double")
    last = {(r["k"], r["n"]): r["fraction"] for r in reports.kelly(df, ["k"], ["n"]).collect()}
    p, sd = 4 / 7, math.sqrt(4 * 3 / (49 * 8))
    assert math.isclose(last["a", 3], (p - (1 - p) / 3) * max(0.2, 1 - 4 * sd)) and last["b", 1] == 0
    got = {r["k"]: r for r in reports.capital_metrics(df, ["k"], 100.0, 10).collect()}
    assert set(got) == {"a"} and math.isclose(got["a"]["roec"], 5 / 100) and math.isclose(got["a"]["utilisation"], 0.1) and math.isclose(got["a"]["rocc"], 5 / 1000)
    assert reports.expected_best_sharpe(1) == 0 and 1.8 < reports.expected_best_sharpe(20) < 1.95


def test_session_basket():
    import datetime as dt

    basket, state, d = streams.SessionBasket(2, 0.0, 1.0, 0.5, dt.date(2024, 1, 2)), {}, dt.date(2024, 1, 1)
    assert basket.step(state, d, True, math.e) == (None, None, None) == basket.step(state, d, False, 1.0) and state["position"] == -1
    d = dt.date(2024, 1, 2)
    assert basket.step(state, d, False, 1.0) == (None, None, None) and basket.step(state, d, True, 1.0) == (0.0, -1, False)


def in_batches(spark, tmp_path, parts):
    """A stream that gives each of some tables as a batch of its own, in order."""
    import time

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # batches go by the files' times, which have seconds
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_features_are_those_of_the_batch_whatever_the_batches(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for symbol in ("a", "b"):
        price = 100.0
        for i in range(220):
            price = max(1.0, price * (1 + rnd.gauss(0, 0.02 if i < 120 else 0.06)))
            high, low = price * (1 + rnd.random() / 50), price * (1 - rnd.random() / 50)
            rows.append((symbol, i * 3_600_000 + 1_700_000_000_000, high, low, price, float(rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "symbol string, millis long, high double, low double, close double, volume double")
    want = {(r["symbol"], r["ts"]): tuple(r)[2:] for r in features.feature_rows(df.select("symbol", F.timestamp_millis("millis").alias("ts"), "high", "low", "close", "volume")).collect()}
    state = features.FeatureState()
    step = lambda s, x: state.step(s, x.millis, x.high, x.low, x.close, x.volume)
    schema = "symbol string, millis long, high double, low double, close double, volume double, " + features.FEATURE_SCHEMA
    edges = [rows[70][1], rows[71][1], rows[150][1]]
    parts = [df.where((F.col("millis") >= low) & (F.col("millis") < high)) for low, high in zip([0, *edges], [*edges, 2**60])]
    got = streams.drain(streams.keyed_steps(in_batches(spark, tmp_path, parts), "symbol", ["millis"], step, schema), "feature-twin")
    found = {(r["symbol"], r["ts"]): tuple(r[c] for c in features.FEATURES) for r in got.withColumn("ts", F.timestamp_millis("millis")).collect()}
    assert found.keys() == want.keys() and len(want) == 440
    for k in want:
        for name, x, y in zip(features.FEATURES, found[k], want[k]):
            assert x == y if not isinstance(y, float) else abs(x - y) < 1e-7 * max(1, abs(y)), (k, name, x, y)
    warm = streams.keyed_steps(in_batches(spark, tmp_path / "live", parts[3:]), "symbol", ["millis"], step, schema, df.where(F.col("millis") < edges[2]))
    live = {(r["symbol"], r["ts"]): r["adx"] for r in streams.drain(warm, "feature-warm").withColumn("ts", F.timestamp_millis("millis")).collect()}
    at = features.FEATURES.index("adx")
    assert len(live) == 2 * 70 and all(abs(live[k] - want[k][at]) < 1e-7 for k in live)


def test_a_symbol_that_is_never_heard_again_raises_an_alarm(spark, tmp_path):
    at = lambda s: 1_700_000_000_000 + s * 1000
    batches = [[("a", 0), ("b", 1), ("a", 8)], [("a", 15), ("a", 40), ("a", 30)], [("a", 44), ("c", 45)], [("c", 100), ("a", 101)]]
    frames = [spark.createDataFrame([(k, at(s)) for k, s in rows], "k string, millis long").select("k", F.timestamp_millis("millis").alias("ts")) for rows in batches]
    rows = in_batches(spark, tmp_path, frames).withWatermark("ts", "0 seconds")
    got = {(r["key"], r["since"]) for r in streams.drain(streams.silence_alarms(rows, "k", 10), "alarms").collect()}
    assert got == {("b", at(1)), ("a", at(15)), ("a", at(44)), ("c", at(45))}


def test_static_tables_are_merged_into_streams_not_broadcast_with_each_batch(spark, tmp_path):
    from tidemark.plans import journal_queries, registry

    plans, drain = [], streams._drained

    def kept(stream, name):
        runs = set()
        start = type(stream.writeStream).start
        type(stream.writeStream).start = lambda self, *a, **b: runs.add(run := start(self, *a, **b)) or run
        try:
            return drain(stream, name)
        finally:
            type(stream.writeStream).start = start
            plans.extend(run._jsq.explainInternal(False) for run in runs)

    streams._drained = kept
    try:
        assert journal_queries.basket_stream(spark, "/root/testdata/sf0.001").count() > 0
        assert registry.queries()["st09_pair_machine"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        streams._drained = drain
    assert len(plans) == 5 and any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_silence_calls_the_store_by_key_and_batch_not_by_row():
    class Counted:
        def __init__(self):
            self.calls, self.timers, self.held = 0, set(), None

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.remove(at)

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    alarms = streams.SilenceAlarms(10)
    alarms.handle = alarms.newest = store = Counted()
    told = lambda frames: [tuple(r) for f in frames for r in f.itertuples(index=False)]
    frames = [pd.DataFrame({"millis": [t * 1000 for t in ts]}) for ts in (range(500, 1000), [*range(500), 1020, 1020])]
    assert told(alarms.handleInputRows(("k",), iter(frames), None)) == [("k", 999_000, 1_009_000)]
    assert store.calls == 1 and store.timers == {1_030_000} and store.held == (1_020_000, False)
    assert told(alarms.handleInputRows(("k",), iter([pd.DataFrame({"millis": [1_031_000, 1_000]})]), None)) == [("k", 1_020_000, 1_030_000)]
    assert store.calls == 3 and store.timers == {1_041_000}
    store.held = (1_031_000, True)
    store.timers.clear()
    assert told(alarms.handleInputRows(("k",), iter([pd.DataFrame({"millis": [1_060_000]})]), None)) == [] and store.timers == {1_070_000}
    assert told(alarms.handleInputRows(("k",), iter([pd.DataFrame({"millis": [1_000]})]), None)) == [] and store.timers == {1_070_000}


def test_late_rows_are_of_every_tick(spark, tmp_path):
    """Rows that are of no use as prices are late or repeated like others, and move the newest time."""
    from tidemark.plans import registry

    rows = [(1, "a", 10, 5.0), (2, "a", 30, 0.0), (3, "a", 20, 5.0), (4, "a", 30, None), (5, "a", None, 1.0), (6, "a", 40, -1.0), (7, "b", 5, float("nan")), (8, "a", 39, 5.0)]
    made = spark.createDataFrame([(i, k, t, 0, v) for i, k, t, v in rows], "event_id long, event_type string, ts long, user_id long, value double").withColumn("ts", F.timestamp_seconds("ts"))
    made.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = {r["event_id"]: (r["late"], r["repeated"]) for r in registry.queries()["st03_late_rows"](spark, str(tmp_path)).collect()}
    no, late, again = (False, False), (True, False), (False, True)
    assert got == {1: no, 2: no, 3: late, 4: again, 5: no, 6: no, 7: no, 8: late}


def test_peak_gross_is_the_walk_order_by_order(spark):
    rnd = random.Random(3)
    price = {f"s{i}": rnd.uniform(1, 50) for i in range(5)}
    start = {("p", s): float(rnd.randint(-20, 20)) for s in price}
    orders = [("p" if rnd.random() < 0.8 else "q", i, rnd.choice([*price, "unpriced"]), float(rnd.randint(-9, 9))) for i in range(300)]
    df = spark.createDataFrame([(*o, price.get(o[2])) for o in orders], "path string, i long, symbol string, q double, price double").repartition(4)
    held = spark.createDataFrame([(k, s, v, price[s]) for (k, s), v in start.items()], "path string, symbol string, shares double, price double")
    with partitions(spark, 6):
        got = {r["path"]: (r["start"], r["peak"], r["last"]) for r in book.peak_gross(df, "path", ["i"], held).collect()}
    for path in ("p", "q"):
        now = {s: v for (k, s), v in start.items() if k == path}
        gross = lambda: sum(abs(v) * price.get(s, 0.0) for s, v in now.items())  # noqa: E731,B023
        walk = [gross()]
        for k, _, s, q in orders:
            if k == path:
                now[s] = now.get(s, 0.0) + q
                walk.append(gross())
        assert np.allclose(got[path], (walk[0], max(walk), walk[-1]))


def test_running_sums_of_long_and_short_stretches_equal_a_loop(spark):
    rnd = random.Random(6)
    rows = [(k, i, rnd.uniform(-1, 1)) for k, n in [(None, 900), ("long", 2_000), *((f"s{j}", 2) for j in range(600))] for i in range(n)]
    maps = {"sum": scan.Affine(F.lit(1.0), F.col("v"), F.lit(3.0)), "found": scan.Affine(F.lit(1.0), F.col("v"), F.lit(3.0), before=True)}
    with partitions(spark, 5):
        got = {(r["k"], r["i"]): (r["sum"], r["found"]) for r in scan.affine_scans(spark.createDataFrame(rows, "k string, i long, v double").repartition(3), "k", "i", maps).collect()}
    now = {}
    for k, i, v in rows:
        now[k], was = now.get(k, 3.0) + v, now.get(k, 3.0)
        assert np.allclose(got[k, i], (now[k], was), atol=1e-9)
    assert len(got) == len(rows)


def test_walk_moves_its_own_columns_and_ties_do_not_depend_on_the_layout(spark, monkeypatch):
    """Tied lines of one symbol, in and out: whichever lies first, both sums take them in the same order."""
    moved, sort = [], scan._sorted
    monkeypatch.setattr(scan, "_sorted", lambda rows, *a: moved.append(rows.columns) or sort(rows, *a))
    rows = [("p", 1, f"s{i % 3}", q, 10.0, "x" * 50) for i in range(6) for q in (-3.0, 5.0, 2.0)]
    found = set()
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "path string, i long, symbol string, q double, price double, note string").repartition(1 + seed)
        found.add(tuple(book.peak_gross(df, "path", ["i"]).first()))
    assert found == {("p", 0.0, 240.0, 240.0)} and not any("note" in c for c in moved)
    assert all("price" not in c for c in moved[1::2])


def test_entry_caps_by_hand():
    caps, state = signals.EntryCaps(2, 3), {}
    rows = [(1, 5), (1, 2), (1, 9), (2, 4), (2, 9), (3, 9), (4, 9), (5, 9)]
    assert [caps.step(state, a, b) for a, b in rows] == [(0, 0, True), (1, 1, True), (2, 2, False), (0, 1, True), (1, 2, True), (0, 3, False), (0, 2, True), (0, 2, True)]


def test_nearest_rank_whatever_the_partitions(spark):
    rnd = random.Random(9)
    values = [round(rnd.random(), 2) for _ in range(501)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(5)
    with partitions(spark, 8):
        row = book.nearest_rank(df, "v", "id", (0.5, 0.95)).first()
    s = sorted(values)
    assert tuple(row) == (s[250], s[475], s[500])


def test_distribution_is_exact_beyond_ten_thousand_values(spark):
    rnd = random.Random(4)
    values = {"a": [round(rnd.uniform(0, 5000), 2) for _ in range(30_000)], "b": [2.0, 1.0], "none": [None]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("b", None)]
    with partitions(spark, 7):
        got = {r["k"]: tuple(r)[1:] for r in ledger.distribution(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    s = sorted(values["a"])
    assert got["a"] == (30_000, s[0], s[-1], s[14_999], s[28_499], s[29_699])
    assert got["b"] == (3, 1.0, 2.0, 1.0, 2.0, 2.0) and got["none"] == (1, None, None, None, None, None)


def test_run_that_is_excluded_needs_a_new_signal():
    run, state = runs.BasketRun(), {}
    assert run.step(state, ["a", "b", "c"], [-2.0, 3.0, 0.0], 1.0, 1) == (["a", "b"], [1, -1], [2, 1])
    assert run.step(state, ["a", "b", "c"], [-0.5, 0.5, 0.0], 1.0, 1) == (["b"], [-1], [1])  # a is flat again
    assert run.step(state, ["a", "c"], [-1.5, 0.0], 1.0, 2) == (["a", "b"], [1, -1], [1, 2])  # b has no score and keeps its side
    assert run.step(state, ["b"], [-4.0], 1.0, 2) == (["a", "b"], [1, 1], [2, 1])


def test_equity_report_survives_the_round_trip(spark):
    import datetime as dt

    curve = spark.createDataFrame([("r", dt.date(2024, 1, i + 1), float(i), 100.0 + i) for i in range(9)] + [("x y", dt.date(2024, 1, 1), -1.5, 98.5)], "run_id string, day date, pnl double, equity double")
    rows, numbers = equity_reports.read_equity_report(spark, equity_reports.write_equity_report(curve, runs.run_stats(curve, 100.0)))
    assert sorted(map(tuple, rows.collect())) == sorted((r["run_id"], r["day"], r["equity"], r["pnl"]) for r in curve.collect())
    found = {(r["run_id"], r["key"]): r["value"] for r in numbers.collect()}
    assert found["r", "days"] == 9 and abs(found["r", "total"] - 0.36) < 1e-9 and found["x y", "sharpe"] is None


def test_pair_statistics_of_a_known_pair():
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(0, 0.02, 150)) + 3
    s = np.zeros(150)
    for i in range(1, 150):
        s[i] = 0.8 * s[i - 1] + rng.normal(0, 0.01)
    beta, alpha, r2, stat, p, lags, life, crossings, cv, shift, mean, std, z = stats.pair_statistics(x, 0.5 + 1.3 * x + s)
    assert abs(beta - 1.3) < 0.05 and r2 > 0.95 and p < 0.05 and 1.5 < life < 6 and crossings > 12 and cv < 0.5 and abs(mean - 0.5) < 0.2
    assert stats.pair_statistics(x[:2], x[:2]) == (None,) * 13 and stats.pair_statistics(np.ones(50), x[:50]) == (None,) * 13
    assert stats.adf_statistic(s[:19])[0] != stats.adf_statistic(s[:19])[0]  # too short


def test_pair_gates(spark):
    import datetime as dt

    rng = np.random.default_rng(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(150)]
    a, s = np.exp(np.cumsum(rng.normal(0, 0.02, 150)) + 3), [0.0]
    for e in rng.normal(0, 0.01, 149):
        s.append(0.8 * s[-1] + e)
    rows = [("a", d, float(v)) for d, v in zip(days, a)] + [("b", d, float(v * math.exp(e))) for d, v, e in zip(days, a, s)] + [("c", d, 5.0) for d in days[:50]] + [("d", d, 0.0 if i == 140 else float(i + 1)) for i, d in enumerate(days)]
    closes = spark.createDataFrame(rows, "symbol string, day date, close double")
    pairs_ = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "none"), ("b", "d")], "leg_a string, leg_b string")
    funds = spark.createDataFrame([("d", "b")], "fund string, component string")
    got = {(r["leg_a"], r["leg_b"]): (r["passed"], list(r["reasons"])) for r in stats.validate_pairs(closes, pairs_, components=funds).collect()}
    assert got["a", "c"] == got["a", "none"] == (False, ["short_history"]) and got["a", "d"] == (False, ["bad_price"]) and got["b", "d"] == (False, ["fund_component"])
    assert "not_cointegrated" not in got["a", "b"][1]
    forced = {(r["leg_a"], r["leg_b"]): (r["passed"], list(r["reasons"])) for r in stats.validate_pairs(closes, pairs_, {"force": stats.PROFILES["force"]}, funds).collect()}
    assert forced["b", "d"] == (False, ["bad_price"]) and forced["a", "b"][0]


def test_machine_exits_votes_and_sizes_by_hand():
    c = single.LIMITS
    assert single.exit_rule(90, 100, 3, 2.0, 0.0, c) == "stop_loss" and single.exit_rule(96, 100, 3, 2.0, 0.0, c) is None and single.exit_rule(96, 100, 100, 2.0, 0.0, c) == "max_hold_time"
    assert single.exit_rule(99, 100, 3, 50.0, 0.001, c) == "stop_loss"  # the volatility of returns goes before the range
    assert single.exit_rule(90, 100, 1, 0.0, 0.0, c | {"stop_share": 0.05}) == "stop_loss" and single.exit_rule(120, 100, 1, 0.0, 0.0, c | {"take": 0.1}) == "take_profit"
    buy, sell = single.Signal("buy", 1.0, "x"), single.Signal("sell", 1.0, "x")
    assert single.sized(buy, 50, 0, 0, True, 1, "normal", c) == (None, "kill_switch") and single.sized(single.Signal("buy", 0.005, "x"), 50, 0, 0, False, 1, "normal", c) == (None, "cost_filter")
    assert single.sized(buy, 500, 0, 0, False, 1, "normal", c) == (20.0, None) and single.sized(buy, 500, 0, -250, False, 1, "normal", c) == (5.0, None) and single.sized(buy, 4000, 0, 0, False, 1, "normal", c) == (2.5, None)
    assert single.sized(buy, 1, 0, 0, False, 1, "normal", c) == (100.0, None) and single.sized(buy, 500, 0, 0, False, 0.0, "crisis", c | {"kelly": True}) == (None, "no_edge") and single.sized(buy, 500, 0, 0, False, 1.0, "crisis", c | {"kelly": True}) == (2.0, None)
    assert single.sized(sell, 50, 0, 0, False, 1, "normal", c) == (None, "no_position") and single.sized(sell, 50, 7, 0, False, 1, "normal", c) == (7, None)
    assert 0 < single.kelly_share(0, 0, 0, 0, c) < 0.2 and single.kelly_share(0, 30, 0, 30, c) == 0.0


def test_fold_after_a_join_that_reads_its_rows_where_they_lie(spark):
    """A join turned into a broadcast at run time does not gather its rows by key: those of a key come to one task all the same."""
    # 4k is less than what is estimated for the table of sizes and more than it has; so few rows would be read as one partition
    n, conf = 20_000, {"spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def step(state, row):
        state["n"] = state.get("n", 0) + 1
        return (state["n"],)

    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("ts"), F.concat(F.lit("k"), F.col("id") % 3).alias("symbol"))
        rows = rows.join(rows.groupBy("symbol").agg(F.count("*").alias("size")), "symbol").select("symbol", "ts", "size")
        got = scan.fold(rows, "symbol", ["ts"], step, "symbol string, ts long, size long, n int").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == n
    for k in range(3):
        assert [r["n"] for r in sorted(got, key=lambda r: r["ts"]) if r["symbol"] == f"k{k}"] == list(range(1, len(range(k, n, 3)) + 1))
