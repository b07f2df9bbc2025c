"""Weights that minimise expected tail loss, re-optimised every few dates.

For one rebalance date with return window R (dates x assets) the tail loss of weights w is the
greatest of -y'Rw over tail weights y (sum 1, each at most 1/k, k the number of tail dates).
Minimising it is a bilinear saddle point over two capped simplices, solved here by the
primal-dual method with restarts.

Universes of every size are solved by column generation: a small active set per date gives y, all
assets are priced against y in one distributed pass, the cheapest join the active set, until the
dual bound over all assets is met.  No asset is left out, and no group holds more than the active
set.  A date whose gap cannot be closed gets equal weights.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.series import DAILY, Series, windowed
from tidepanel.functions.tables import materialise
from tidepanel.operators.splits import date_index

TOLERANCE = 1e-6
#: Steps of the solver before a date counts as not solvable.
STEPS = 60_000


# ---------------------------------------------------------------------------------------------
# return windows


@windowed(1, 1)
def _spans(df: DataFrame, s: Series = DAILY) -> DataFrame:
    w = s.window()
    return df.withColumns({"_next": F.lead("idx", 1).over(w), "_prev": F.lag("idx", 1).over(w)})


def return_windows(
    bars: DataFrame, lookback: int = 60, every: int = 20, least: int = 30, s: Series = DAILY
) -> DataFrame:
    """Trailing returns per rebalance number and series: (m, ticker, rets).

    The calendar is the union of dates.  A series without a bar keeps its last return, one that
    has not begun counts 0.  Values travel as stretches of dates, so no grid is built.
    """
    rows = by_date(bars.select(*s.keys, s.order, "asset_ret"), date_index(bars, s), s.order)
    rows = _spans(rows, s=s)
    held = rows.select(
        *s.keys, F.col("idx").alias("a"), (F.coalesce("_next", "n_dates") - 1).alias("b"), "asset_ret", "n_dates"
    )
    before = rows.filter(F.col("_prev").isNull() & (F.col("idx") > 0)).select(
        *s.keys, F.lit(0).alias("a"), (F.col("idx") - 1).alias("b"), F.lit(0.0).alias("asset_ret"), "n_dates"
    )
    start = least - 1
    lo = F.greatest(F.lit(0), F.ceil((F.col("a") - start) / every))
    hi = F.least(F.floor((F.col("b") + lookback - 1 - start) / every), F.floor((F.col("n_dates") - 1 - start) / every))
    parts = held.unionByName(before).withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_lo") <= F.col("_hi"))
    parts = parts.withColumn("m", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("m") * every + start
    first = F.greatest("a", at - (lookback - 1), F.lit(0))
    count = (F.least("b", at) - first + 1).cast("int")
    cells = parts.select("m", *s.keys, F.struct(first.alias("p"), count.alias("n"), F.coalesce("asset_ret", F.lit(0.0)).alias("r")).alias("c"))
    # at most ``lookback`` stretches per group
    grouped = cells.filter(F.col("c.n") > 0).groupBy("m", *s.keys).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    flat = F.flatten(F.transform("cs", lambda c: F.array_repeat(c["r"], c["n"])))
    return grouped.select("m", *s.keys, flat.alias("rets"))


# ---------------------------------------------------------------------------------------------
# one rebalance date


def _project(z: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Nearest point with entries in [0, cap] and the given sum (Newton steps, kept bracketed)."""
    lo, hi = z.min() - cap, z.max()
    tau = (z.sum() - total) / z.size
    for _ in range(60):
        x = np.clip(z - tau, 0.0, cap)
        miss = x.sum() - total
        if abs(miss) < 1e-13:
            break
        lo, hi = (tau, hi) if miss > 0 else (lo, tau)
        free = np.count_nonzero((x > 0.0) & (x < cap))
        step = tau + miss / free if free else np.inf
        tau = step if lo < step < hi else 0.5 * (lo + hi)
    return np.clip(z - tau, 0.0, cap)


def _fill(cost: np.ndarray, total: float, cap: float) -> float:
    """Least total cost of spreading ``total`` over entries of at most ``cap``."""
    ordered = np.sort(cost)
    amounts = np.clip(total - cap * np.arange(cost.size), 0.0, cap)
    return float(ordered @ amounts)


def tail_size(dates: int, alpha: float) -> int:
    """Dates at or below the linearly interpolated (1-alpha) quantile."""
    return int(math.floor((dates - 1) * (1.0 - alpha) + 1e-9)) + 1


def minimise_tail(
    returns: np.ndarray, alpha: float, total: float = 1.0, cap: float = 1.0, base: np.ndarray | None = None, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Weights, tail weights, tail loss and whether its gap is closed, for returns of shape (dates, assets)."""
    dates, assets = returns.shape
    base = np.zeros(dates) if base is None else base
    k = tail_size(dates, alpha)
    norm = np.linalg.norm(returns, 2)
    w, y = np.full(assets, total / assets), np.full(dates, 1.0 / dates)

    def loss(w: np.ndarray) -> float:
        return -float(np.sort(base + returns @ w)[:k].mean())

    def bound(y: np.ndarray) -> float:
        return -float(base @ y) + _fill(-(returns.T @ y), total, cap)

    best_w, best, best_y, dual = w, loss(w), y, bound(y)
    if norm == 0.0:
        return w, y, best, True
    ratio, every = 1.0, 60
    tau, sigma = 0.95 / norm * ratio, 0.95 / norm / ratio
    w_sum, y_sum, n = np.zeros(assets), np.zeros(dates), 0
    for i in range(1, steps + 1):
        w_new = _project(w + tau * (returns.T @ y), total, cap)
        y = _project(y - sigma * (base + returns @ (2.0 * w_new - w)), 1.0, 1.0 / k)
        w = w_new
        w_sum, y_sum, n = w_sum + w, y_sum + y, n + 1
        if i % every == 0:
            for cand_w, cand_y in ((w, y), (w_sum / n, y_sum / n)):
                value, low = loss(cand_w), bound(cand_y)
                if value < best:
                    best, best_w = value, cand_w
                if low > dual:
                    dual, best_y = low, cand_y
            if best - dual <= TOLERANCE:
                break
            if i % (every * 4) == 0:
                w, y = w_sum / n, y_sum / n
                w_sum, y_sum, n = np.zeros(assets), np.zeros(dates), 0
    return best_w, best_y, best, best - dual <= TOLERANCE


def _solve(alpha: float, total: float, cap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        returns = np.stack([np.asarray(r, dtype=float) for r in pdf["rets"]], axis=1)
        base = np.asarray(pdf["base"].iloc[0], dtype=float) if "base" in pdf and pdf["base"].iloc[0] is not None else None
        room = min(cap, total) if cap * returns.shape[1] >= total else total
        w, y, value, met = minimise_tail(returns, alpha, total, room, base)
        return pd.DataFrame({"m": pdf["m"], "ticker": pdf["ticker"], "w": w, "y": [y.tolist()] * len(w), "loss": value, "met": met})

    return run


_SOLVED = "m long, ticker string, w double, y array<double>, loss double, met boolean"


# ---------------------------------------------------------------------------------------------
# all rebalance dates


def cvar_weights(
    bars: DataFrame,
    alpha: float = 0.95,
    lookback: int = 60,
    low: float = 0.0,
    high: float = 0.4,
    every: int = 20,
    least: int = 30,
    s: Series = DAILY,
) -> DataFrame:
    """Optimised weights per rebalance number: (m, ticker, w).

    Bounds that no weights can meet, and dates the solver does not finish, give equal weights.
    """
    windows = materialise(return_windows(bars, lookback, every, least, s), "windows")
    n = bars.select("ticker").distinct().count()
    if n * high < 1.0 - 1e-12 or n * low > 1.0 + 1e-12:
        return windows.select("m", "ticker", F.lit(1.0 / n).alias("w"))
    total, cap = 1.0 - n * low, high - low
    if low > 0.0:
        cells = windows.select("m", F.posexplode("rets").alias("p", "r")).groupBy("m", "p").agg(F.sum("r").alias("r"))
        sums = cells.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("p", "r"))).alias("c"))
        sums = sums.select("m", F.transform("c", lambda x: x["r"] * low).alias("base"))
        windows = materialise(windows.join(F.broadcast(sums), "m"), "windows")
    solve = _solve(alpha, total, cap)
    solved = _generated(windows, solve, total, cap)
    # one row per rebalance date: bounded by the calendar
    met = solved.groupBy("m").agg(F.bool_and("met").alias("_met"))
    out = windows.select("m", "ticker").join(solved.select("m", "ticker", "w"), ["m", "ticker"], "left").join(F.broadcast(met), "m")
    w = F.when(F.col("_met"), F.coalesce("w", F.lit(0.0)) + low).otherwise(1.0 / n)
    return out.select("m", "ticker", w.alias("w"))


def _solved(windows: DataFrame, solve) -> DataFrame:
    """One call per rebalance date.  The work is in the solver, not in bytes, so the dates are
    spread over a fixed number of tasks that the adaptive planner does not merge by size."""
    session = windows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return windows.repartition(tasks, "m").groupBy("m").applyInPandas(solve, _SOLVED)


def _generated(windows: DataFrame, solve, total: float, cap: float) -> DataFrame:
    """Column generation; every round adds assets to the dates whose dual bound is not met yet."""
    wanted = math.ceil(total / cap) + 1
    size = F.size("rets")
    duals = windows.groupBy("m").agg(F.max(size).alias("_t")).select(
        "m", F.transform(F.sequence(F.lit(1), F.col("_t")), lambda i: F.lit(1.0) / F.col("_t")).alias("y")
    )
    duals = duals.withColumn("loss", F.lit(float("inf")))
    active = solved = None
    while True:
        # one row of dual values per rebalance date: bounded by the calendar
        priced = windows.join(F.broadcast(duals), "m")
        cost = F.aggregate(F.zip_with("rets", "y", lambda r, y: -r * y), F.lit(0.0), lambda a, x: a + x)
        priced = priced.select("m", "ticker", "rets", *[c for c in ("base",) if c in windows.columns], "loss", "y", cost.alias("cost"))
        rank = F.row_number().over(Window.partitionBy("m").orderBy("cost", "ticker"))
        cheap = materialise(priced.withColumn("_k", rank).filter(F.col("_k") <= wanted), "cheap")
        amount = F.least(F.greatest(F.lit(total) - (F.col("_k") - 1) * cap, F.lit(0.0)), F.lit(cap))
        offset = F.lit(0.0)
        if "base" in windows.columns:
            offset = F.first(F.aggregate(F.zip_with("base", "y", lambda b, y: -b * y), F.lit(0.0), lambda a, x: a + x))
        bounds = cheap.groupBy("m").agg((F.sum(F.col("cost") * amount) + offset).alias("_dual"), F.first("loss").alias("_loss"))
        open_dates = bounds.filter(F.col("_loss") - F.col("_dual") > 2.0 * TOLERANCE).select("m")
        columns = ["m", "ticker", "rets", *[c for c in ("base",) if c in windows.columns]]
        fresh = cheap.join(F.broadcast(open_dates), "m", "left_semi").select(*columns)
        if active is not None:
            fresh = fresh.join(active.select("m", "ticker"), ["m", "ticker"], "left_anti")
        fresh = materialise(fresh, "fresh")
        if fresh.isEmpty():
            break
        grown = fresh.select("m").distinct()
        active = fresh if active is None else materialise(active.unionByName(fresh), "active")
        again = _solved(active.join(F.broadcast(grown), "m", "left_semi"), solve)
        if solved is not None:
            again = again.unionByName(solved.join(F.broadcast(grown), "m", "left_anti"))
        solved = materialise(again, "solved")
        duals = solved.groupBy("m").agg(F.first("y").alias("y"), F.first("loss").alias("loss"))
    return solved


def cvar_allocation(df: DataFrame, s: Series = DAILY, every: int = 20, least: int = 30, **params) -> DataFrame:
    """Position times the weight of the last rebalance; equal weights before the first.

    df: (keys..., ticker, dt, position, asset_ret); keys beyond the ticker share the weights.
    """
    bars = df if s.keys == ("ticker",) else df.groupBy("ticker", s.order).agg(F.first("asset_ret").alias("asset_ret"))
    bars = materialise(bars.select("ticker", s.order, "asset_ret"), "returns")
    line = Series(order=s.order, block=s.block, slot=s.slot)
    weights = cvar_weights(bars, every=every, least=least, s=line, **params)
    index = date_index(bars, line)
    m = F.floor((F.col("idx") - (least - 1)) / every)
    index = index.select(s.order, F.when(m >= 0, m).cast("long").alias("m"))
    joined = by_date(df, index, s.order).join(weights, ["m", "ticker"], "left")
    joined = with_totals(joined, bars.select("ticker").distinct().agg(F.count(F.lit(1)).alias("_n")))
    w = F.when(F.col("m").isNull(), F.lit(1.0) / F.col("_n")).otherwise(F.coalesce("w", F.lit(0.0)))
    return joined.withColumn("weight", F.col("position") * w).drop("m", "w", "_n")
