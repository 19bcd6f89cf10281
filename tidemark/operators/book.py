"""Target books, orders and fills as long tables (day, symbol, notional or shares)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan


def admit(positions: DataFrame, by: list[str], most: int) -> DataFrame:
    """Active positions with their place by |score|, ties by id; the first ``most`` of a day are admitted."""
    active = positions.where("position <> 0")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.abs("z")), "target"))
    return active.withColumn("place", rank).withColumn("admitted", F.col("place") <= most)


def notional_per_basket(capital: float, leverage: float, most: int) -> float:
    if not (capital > 0 and leverage > 0 and most > 0):
        raise ValueError("capital, leverage and the cap must be above zero")
    return capital * leverage / most


def basket_legs(admitted: DataFrame, baskets: DataFrame, notional: float) -> DataFrame:
    """(day, target, symbol, notional): half of the notional in the target, the other half shared by the peers against it."""
    size = baskets.groupBy("target").agg(F.collect_list("peer").alias("peers"))
    rows = admitted.join(size, "target")
    own = F.array(F.struct(F.col("target").alias("symbol"), F.lit(0.5).alias("w")))
    others = F.transform("peers", lambda p: F.struct(p.alias("symbol"), (-0.5 / F.size("peers")).alias("w")))
    rows = rows.select("day", "target", "position", F.explode(F.concat(own, others)).alias("leg"))
    return rows.select("day", "target", F.col("leg.symbol").alias("symbol"), (F.col("position") * F.col("leg.w") * notional).alias("notional"))


def summed(legs: DataFrame, by: list[str], least: float = 1e-9) -> DataFrame:
    """Legs to a book: notional per symbol, without what cancels out."""
    return legs.groupBy(*by, "symbol").agg(F.sum("notional").alias("notional")).where(F.abs("notional") > least)


def merge_books(*books: DataFrame, by: list[str]) -> DataFrame:
    out = books[0]
    for b in books[1:]:
        out = out.unionByName(b)
    return out.groupBy(*by, "symbol").agg(F.sum("notional").alias("notional"))


def summary(book: DataFrame, by: list[str]) -> DataFrame:
    long, short = F.when(F.col("notional") > 0, F.col("notional")).otherwise(0.0), F.when(F.col("notional") < 0, -F.col("notional")).otherwise(0.0)
    return book.groupBy(*by).agg(F.sum(long).alias("gross_long"), F.sum(short).alias("gross_short"), F.max(F.abs("notional")).alias("max_abs"), F.percentile(F.abs("notional"), 0.5).alias("median_abs"))


def without_shorts_of(positions: DataFrame, active: DataFrame) -> DataFrame:
    """Positions, short baskets of the active sectors (day, sector) left out."""
    return positions.where("position >= 0").unionByName(positions.where("position < 0").join(active, ["day", "sector"], "left_anti"))


def long_only_sleeve(symbols: DataFrame, budget: float, by: list[str]) -> DataFrame:
    """Equal weights over the priced symbols of each day."""
    return symbols.withColumn("notional", F.lit(budget) / F.count("*").over(W.partitionBy(*by)))


def drop_shorts(book: DataFrame, by: list[str], cash: float) -> DataFrame:
    """Long positions alone, scaled down to the cash if they are more."""
    total = F.sum("notional").over(W.partitionBy(*by))
    return book.where("notional > 0").withColumn("total", total).withColumn("notional", F.col("notional") * F.least(F.lit(1.0), F.lit(cash) / F.col("total"))).drop("total")


def mirror_peers(legs: DataFrame, by: list[str]) -> DataFrame:
    """Each basket's short notional is dealt to its longs in proportion."""
    w = W.partitionBy(*by, "target")
    long, short = F.sum(F.when(F.col("notional") > 0, F.col("notional"))).over(w), F.sum(F.when(F.col("notional") < 0, -F.col("notional"))).over(w)
    return legs.withColumns({"__long": long, "__short": F.coalesce(short, F.lit(0.0))}).where("notional > 0").withColumn("notional", F.col("notional") * (1 + F.col("__short") / F.col("__long"))).drop("__long", "__short")


def penalise_shorts(legs: DataFrame, by: list[str], penalty: float = 0.5, purity: float = 0.6) -> DataFrame:
    """Long less penalised short notional per symbol, where longs are at least ``purity`` of longs and penalised shorts.

    Legs of a weak basket are left out before, by its signal."""
    g = legs.groupBy(*by, "symbol").agg(F.sum(F.when(F.col("notional") > 0, F.col("notional")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("notional") < 0, -F.col("notional")).otherwise(0.0)).alias("short"))
    g = g.withColumn("notional", F.col("long") - penalty * F.col("short"))
    return g.where((F.col("notional") > 0) & (F.col("long") >= purity * (F.col("long") + penalty * F.col("short")))).select(*by, "symbol", "notional")


def whole_shares(notional: Column, price: Column) -> Column:
    """Towards zero; nothing under one share."""
    x = notional / price
    n = F.when(x > 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")
    return F.when(F.abs(n) >= 1, n).otherwise(0.0)


def target_shares(book: DataFrame, prices: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Books in shares, and the rows without a price."""
    shares = book.join(prices, on).withColumn("shares", whole_shares(F.col("notional"), F.col("close"))).where("shares <> 0")
    return shares, book.join(prices.select(*on), on, "left_anti")


def orders_between(book: DataFrame) -> DataFrame:
    """From (current_shares, target_shares) to orders (side, qty), none where nothing changes."""
    d = F.coalesce("target_shares", F.lit(0.0)) - F.coalesce("current_shares", F.lit(0.0))
    rows = book.withColumn("qty", F.round(F.abs(d))).withColumn("side", F.when(d > 0, "buy").otherwise("sell"))
    return rows.where("qty > 0")


def staged_orders(book: DataFrame) -> DataFrame:
    """Orders in two phases: 1 reduces, 2 expands; a change of sign is a close and an open."""
    c, t = F.coalesce("current_shares", F.lit(0.0)), F.coalesce("target_shares", F.lit(0.0))
    one = lambda phase, q: F.struct(F.lit(phase).alias("phase"), q.alias("q"))
    parts = F.when(c * t < 0, F.array(one(1, -c), one(2, t))).when(F.abs(t) < F.abs(c), F.array(one(1, t - c))).otherwise(F.array(one(2, t - c)))
    rows = book.withColumn("p", F.explode(parts)).select("*", F.col("p.phase").alias("phase"), F.round(F.abs("p.q")).alias("qty"), F.when(F.col("p.q") > 0, "buy").otherwise("sell").alias("side"))
    return rows.where("qty > 0").drop("p")


def flow_kind(current: Column, target: Column) -> Column:
    return (
        F.when((current == 0) & (target != 0), "open").when((current != 0) & (target == 0), "close").when(current * target < 0, "flip")
        .when(F.abs(target) > F.abs(current), "increase").when(F.abs(target) < F.abs(current), "reduce").otherwise("keep")
    )


def apply_orders(book: DataFrame, orders: DataFrame, by: list[str]) -> DataFrame:
    """Shares after orders; under half a share is none."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    rows = book.select(*by, F.col("current_shares").alias("shares")).unionByName(orders.select(*by, signed.alias("shares")))
    return rows.groupBy(*by).agg(F.sum("shares").alias("shares")).where(F.abs("shares") >= 0.5)


def drift(actual_target: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, delta_shares, delta_notional, bps): actual less target, in basis points of the larger gross, at least 1."""
    rows = actual_target.join(prices, "symbol").select("symbol", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("current_shares", "target_shares")), "close")
    rows = rows.withColumns({"a": F.col("current_shares") * F.col("close"), "b": F.col("target_shares") * F.col("close")})
    scale = rows.agg(F.greatest(F.sum(F.abs("a")), F.sum(F.abs("b")), F.lit(1.0)).alias("scale"))  # one row
    return rows.join(F.broadcast(scale)).select("symbol", (F.col("current_shares") - F.col("target_shares")).alias("delta_shares"), F.abs(F.col("a") - F.col("b")).alias("delta_notional"), (F.abs(F.col("a") - F.col("b")) / F.col("scale") * 1e4).alias("bps"))


def nearest_rank(rows: DataFrame, value: str, tie: str, shares: tuple[float, ...]) -> DataFrame:
    """Order statistics at index round((n - 1) p), in one row: values are numbered by a prefix scan over their global order, so
    that no task holds more than its range."""
    placed = scan.affine_scans(rows.select(value, tie).withColumn("__all", F.lit(0)), "__all", [value, tie], {"__at": scan.Affine(F.lit(1.0), F.lit(1.0), F.lit(-1.0))})
    n = placed.agg((F.max("__at") + 1).alias("__n"))  # one row
    rank = lambda p: F.floor((F.col("__n") - 1) * p + 0.5)
    pick = [F.max(F.when(F.col("__at") == rank(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.join(F.broadcast(n)).agg(*pick, F.max(value).alias("max"))


#: Percent of gross, and median and 95th percentile in basis points, beyond which books have drifted apart.
DRIFT_LIMITS = (10.0, 50.0, 200.0)


def drifted(apart: Column, median: Column, p95: Column) -> Column:
    return (apart > DRIFT_LIMITS[0]) | (median > DRIFT_LIMITS[1]) | (p95 > DRIFT_LIMITS[2])


def equity_curve(books: DataFrame, closes: DataFrame, start: float) -> DataFrame:
    """(day, pnl, equity) of books (day, symbol, shares) held from each day to the next, marked at closes.

    A day's book earns its shares times the change of the next close."""
    after = F.lead("close").over(W.partitionBy("symbol").orderBy("day"))
    to = F.lead("day").over(W.partitionBy("symbol").orderBy("day"))
    moves = closes.select("symbol", "day", to.alias("to"), (after - F.col("close")).alias("move")).where("move is not null")
    pnl = books.join(moves, ["symbol", "day"]).groupBy(F.col("to").alias("day")).agg(F.sum(F.col("shares") * F.col("move")).alias("pnl"))
    return pnl.select("day", "pnl", (F.lit(start) + F.sum("pnl").over(W.orderBy("day"))).alias("equity"))


def exposure_gate(equity: DataFrame, n: int = 21, worst: float = 0.05) -> DataFrame:
    """Scale 1 until there are n points; then 0 after a fall over them or a drawdown beyond the limit."""
    w = W.orderBy("day").rowsBetween(-(n - 1), 0)
    rows = equity.select("day", F.count("*").over(w).alias("n"), (F.col("equity") / F.first("equity").over(w) - 1).alias("ret"), ((F.max("equity").over(w) - F.col("equity")) / F.max("equity").over(w)).alias("drawdown"))
    shut = (F.round("ret", 8) < 0) | (F.round("drawdown", 8) > worst)
    return rows.withColumn("scale", F.when(F.col("n") < n, 1.0).when(shut, 0.0).otherwise(1.0))


def peak_gross(orders: DataFrame, path: str, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """(path, start, peak, last): gross notional along each path of orders (path, symbol, q, price), one order after the other.

    ``start`` has what a path holds before (path, symbol, shares, price). Each order changes one symbol's notional; the change
    is a running sum by path and symbol, the gross one by path, both as prefix scans: a path with very many orders is the
    work of many tasks, which take the walk's own columns along and no others. Orders without a price count nothing, as their
    symbol does. Orders that ``order`` leaves tied go by symbol and quantity, in both sums.
    """
    held = start.select(path, "symbol", F.col("shares").alias("__from"), (F.abs("shares") * F.coalesce("price", F.lit(0.0))).alias("__gross")) if start is not None else None
    rows = orders.select(*dict.fromkeys([path, "symbol", *order, "q", "price"]))
    rows = rows.join(held.select(path, "symbol", "__from"), [path, "symbol"], "left") if held is not None else rows.withColumn("__from", F.lit(0.0))
    rows = rows.withColumn("__leg", F.to_json(F.array(F.col(path).cast("string"), F.col("symbol").cast("string"))))
    rows = scan.affine_scans(rows, "__leg", [*order, "q"], {"__held": scan.Affine(F.lit(1.0), F.col("q").cast("double"), F.coalesce(F.col("__from").cast("double"), F.lit(0.0)))})
    change = (F.abs("__held") - F.abs(F.col("__held") - F.col("q"))) * F.coalesce("price", F.lit(0.0))
    rows = rows.select(*dict.fromkeys([path, *order, "symbol", "q"]), change.alias("__change"))
    rows = scan.affine_scans(rows, path, [*order, "symbol", "q"], {"__run": scan.Affine(F.lit(1.0), F.col("__change"), F.lit(0.0))})
    found = rows.groupBy(path).agg(F.max("__run").alias("__most"), F.sum("__change").alias("__sum"))
    if held is not None:
        found = found.join(held.groupBy(path).agg(F.sum("__gross").alias("start")), path, "full")
    else:
        found = found.withColumn("start", F.lit(0.0))
    first = F.coalesce("start", F.lit(0.0))
    return found.select(path, first.alias("start"), (first + F.greatest(F.lit(0.0), F.coalesce("__most", F.lit(0.0)))).alias("peak"), (first + F.coalesce("__sum", F.lit(0.0))).alias("last"))


def gated(book: DataFrame, gate: DataFrame) -> DataFrame:
    """The positive notionals of a long-only book (day, symbol, notional) times the day's exposure scale, 1 where it is unknown."""
    rows = book.join(gate.select("day", "scale"), "day", "left")
    return rows.withColumn("notional", F.col("notional") * F.coalesce("scale", F.lit(1.0))).where(F.col("notional") > 0).drop("scale")
