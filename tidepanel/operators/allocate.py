"""Allocation of capital across series.

Tables stay long.  Cross-sectional totals are partial aggregates per date joined back on the
date; no date-by-series grid is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.ranks import series_quantiles, tie_order, value_counts
from tidepanel.functions.series import DAILY, EPS, Series, rolling, running, windowed
from tidepanel.operators.returns import ANNUAL

DEFAULT_VOL = 0.2


def _groups(s: Series) -> list[str]:
    """Keys other than the series name (a strategy, a cost mode), within which capital is shared."""
    return [k for k in s.keys if k != "ticker"]


def _universe(df: DataFrame) -> DataFrame:
    return df.select("ticker").distinct().agg(F.count(F.lit(1)).alias("_n_assets"))


def equal_weight(df: DataFrame) -> DataFrame:
    """Position over universe size.  An absent series weighs 0, which its missing row says."""
    return with_totals(df, _universe(df)).withColumn("weight", F.col("position") / F.col("_n_assets")).drop("_n_assets")


@windowed(lambda p: p["window"])
def _inverse_vol(df: DataFrame, window: int, least: int, s: Series = DAILY) -> DataFrame:
    df = rolling(df, s, {"_vol": ("std", "asset_ret", window, least)})
    df = df.withColumn("_vol", F.coalesce(F.col("_vol") * ANNUAL, F.lit(DEFAULT_VOL)))
    df = df.withColumn("_inv", F.lit(1.0) / (F.col("_vol") + EPS))
    start = 1.0 / (DEFAULT_VOL + EPS)
    step = F.col("_inv") - F.coalesce(F.lag("_inv", 1).over(s.window()), F.lit(start))
    return df.withColumn("_step", step).drop("_vol")


def risk_parity(df: DataFrame, window: int = 60, least: int = 20, s: Series = DAILY) -> DataFrame:
    """Position times inverse volatility over the universe total of that date.

    A series without a bar on a date keeps its last volatility (the default before its first) in
    the total.  The total is therefore the start value plus the summed changes up to the date.
    """
    groups = _groups(s)
    rows = _inverse_vol(df, window, least, s=s)
    steps = rows.groupBy(*groups, s.order).agg(F.sum("_step").alias("_step"))
    line = Series(keys=tuple(groups) or ("_all",), order=s.order, block=s.block, slot=s.slot)
    if not groups:
        steps = steps.withColumn("_all", F.lit(1))
    totals = running(steps, line, {"_moved": ("sum", F.col("_step"))})
    totals = totals.select(*groups, s.order, "_moved")
    joined = by_date(rows, totals, s.order) if not groups else rows.join(totals, [*groups, s.order], "left")
    joined = with_totals(joined, _universe(df))
    total = F.col("_n_assets") / (DEFAULT_VOL + EPS) + F.col("_moved")
    out = joined.withColumn("weight", F.col("position") * F.col("_inv") / total)
    return out.drop("_inv", "_step", "_moved", "_n_assets")


def cross_sectional_topk(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Equal weights for the stronger half of the positive signals of each date.

    Fewer than three positives share everything; equal signals are taken in name order.  Ranks
    come from counts per signal value, so one crowded date is not sorted in one task.
    """
    groups = [*_groups(s), s.order]
    active = df.filter(F.col("position") > 0).select(*groups, "ticker", "position")
    counts = value_counts(active, groups, "position")
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("_active"))
    above = counts.join(sizes, groups).select(*groups, "position", "_active", (F.col("_active") - F.col("hi")).alias("_above"))
    ordered = tie_order(active, [*groups, "position"], "ticker", "_tie").join(above, [*groups, "position"])
    picked = F.when(F.col("_active") < 3, F.col("_active")).otherwise(F.floor(F.col("_active") / 2))
    chosen = ordered.withColumn("_k", picked).filter(F.col("_above") + F.col("_tie") < F.col("_k"))
    chosen = chosen.select(*groups, "ticker", (F.lit(1.0) / F.col("_k")).alias("_w"))
    out = df.join(chosen, [*groups, "ticker"], "left")
    return out.withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_w")


def portfolio_cvar(returns: DataFrame, value: str = "ret", alpha: float = 0.95, s: Series = DAILY) -> DataFrame:
    """Expected loss beyond the (1-alpha) quantile, positive; one row per return series."""
    keys = list(s.keys)
    cut = series_quantiles(returns, s, value, {"_cut": 1.0 - alpha})
    tail = returns.join(cut, keys).filter(F.col(value) <= F.col("_cut"))
    return tail.groupBy(*keys).agg((-F.avg(value)).alias("cvar"))


def rebased_prices(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Closes rebased to 100 on dates where every series has one, and their mean ``index_value``."""
    counts = df.groupBy(s.order).agg(F.count("close").alias("_here"))
    full = with_totals(counts, _universe(df)).filter(F.col("_here") == F.col("_n_assets")).select(s.order)
    rows = by_date(df.select(*s.keys, s.order, "close"), full, s.order, "inner")
    first = rows.groupBy(*s.keys).agg(F.min_by("close", s.order).alias("_base"))
    rebased = rows.join(first, list(s.keys)).withColumn("rebased", F.try_divide(F.col("close"), F.col("_base")) * 100.0)
    index = rebased.groupBy(s.order).agg(F.avg("rebased").alias("index_value"))
    return by_date(rebased.drop("_base", "close"), index, s.order)


def order_deltas(weights: DataFrame, holdings: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """Orders that move the holdings to the target weights: (ticker, side, qty).

    weights(ticker, weight), holdings(ticker, qty), prices(ticker, price).  A held name without a
    target is sold, a target without a price is skipped, differences below one share are left.
    """
    held = holdings.select("ticker", F.col("qty").alias("_held"))
    book = weights.join(held, "ticker", "full_outer").join(prices.select("ticker", "price"), "ticker", "left")
    shares = F.floor(F.try_divide(F.lit(equity) * F.col("weight"), F.col("price")))
    target = (
        F.when(F.col("weight").isNull() | (F.col("weight") == 0), F.lit(0))
        .when(F.col("price").isNotNull(), shares)
        # a held name whose price is missing counts as not targeted
        .when(F.col("_held").isNotNull(), F.lit(0))
    )
    diff = target - F.coalesce("_held", F.lit(0.0))
    orders = book.withColumn("_diff", diff).filter(F.abs("_diff") >= 1.0)
    return orders.select(
        "ticker",
        F.when(F.col("_diff") > 0, "buy").otherwise("sell").alias("side"),
        F.floor(F.abs("_diff")).cast("long").alias("qty"),
    )
