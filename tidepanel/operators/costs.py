"""Transaction-cost estimates from volume and volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, EPS, Series, rolling, running, windowed
from tidepanel.operators.returns import ANNUAL, log_ret

CAPITAL = 100_000.0
MOVE = 1e-10


@windowed(lambda p: max(p["adv_window"], p["vol_window"] + 1))
def liquidity_profile(
    df: DataFrame, adv_window: int = 20, vol_window: int = 20, spread_k: float = 0.15, s: Series = DAILY
) -> DataFrame:
    """Average dollar volume, floored volatility and estimated spread."""
    df = df.withColumns({"_dv": F.col("close") * F.col("volume"), "_lr": log_ret(1, s)})
    df = rolling(df, s, {"adv": ("mean", "_dv", adv_window, 1), "_vol": ("std", "_lr", vol_window, 1)})
    vol = F.greatest(F.coalesce(F.col("_vol") * ANNUAL, F.lit(0.20)), F.lit(0.01))
    df = df.withColumn("vol", vol)
    return df.withColumn("spread", F.col("vol") * F.col("close") * spread_k).drop("_dv", "_lr", "_vol")


@windowed(1)
def _changes(df: DataFrame, capital: float, participation: float, s: Series = DAILY) -> DataFrame:
    df = df.withColumn("_change", F.coalesce(F.col("target") - F.lag("target", 1).over(s.window()), F.lit(0.0)))
    order, limit = F.abs("_change") * capital, F.col("adv") * participation
    capped = (F.abs("_change") > MOVE) & (F.col("adv") > 0) & (order > limit)
    df = df.withColumn("capped", F.coalesce(capped, F.lit(False)))
    scaled = F.when(F.col("capped"), F.col("_change") * limit / order).otherwise(F.col("_change"))
    return df.withColumn("change", scaled).withColumn("traded", F.abs("_change") > MOVE).drop("_change")


def adv_cap(
    df: DataFrame, participation: float = 0.05, capital: float = CAPITAL, s: Series = DAILY
) -> DataFrame:
    """Limit changes of ``target`` to a share of the average dollar volume; adds ``position``.

    A capped bar moves on from the position before it, an uncapped bar returns to its target.  So
    the position is the target at the last uncapped bar plus the scaled changes since then.
    """
    df = _changes(df, capital, participation, s=s)
    free = F.when(~F.col("capped"), F.col("target"))
    df = running(df, s, {"_base": ("last", free), "_moved": ("sum", F.when(F.col("capped"), F.col("change")))})
    df = running(df, s, {"_since": ("last", F.when(~F.col("capped"), F.col("_moved")))})
    moved = F.col("_moved") - F.coalesce("_since", F.lit(0.0))
    position = F.when(F.col("capped"), F.coalesce("_base", F.lit(0.0)) + moved).otherwise(F.col("target"))
    return df.withColumn("position", position).drop("_base", "_moved", "_since")


def impact_cost(
    df: DataFrame, capital: float = CAPITAL, exponent: float = 2.0, coefficient: float = 1.0
) -> DataFrame:
    """Half spread plus market impact, on bars that trade; adds ``slippage`` and ``exec_cost``."""
    size = F.abs("change")
    rate = size * capital / (F.col("adv") + EPS)
    half = F.col("spread") / 2.0 / (F.col("close") + EPS)
    slip = half + F.pow(rate, F.lit(exponent)) * coefficient * F.col("vol")
    df = df.withColumn("slippage", slip)
    return df.withColumn("exec_cost", F.when(F.col("traded"), F.col("slippage") * size).otherwise(0.0))


def execution_stats(df: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Changes, capped orders and slippage in basis points per key."""
    slip = F.when(F.col("traded"), F.col("slippage") * 10_000.0)
    stats = df.groupBy(*keys).agg(
        F.count(F.when(F.col("traded"), 1)).alias("total_changes"),
        F.count(F.when(F.col("capped"), 1)).alias("orders_capped"),
        F.coalesce(F.sum(slip), F.lit(0.0)).alias("total_slippage_bps"),
    )
    n = F.col("total_changes")
    return stats.withColumns(
        {
            "pct_capped": F.when(n > 0, F.col("orders_capped") / n).otherwise(0.0),
            "avg_slippage_bps": F.when(n > 0, F.col("total_slippage_bps") / n).otherwise(0.0),
        }
    )
