"""Risk rules on positions.

Every rule reads the returns of the volatility-targeted positions before the guards, so there is
no feedback and plain windows suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, Series, rolling, running, windowed
from tidepanel.operators.returns import ANNUAL


@windowed(21)
def vol_target(df: DataFrame, target: float = 0.15, s: Series = DAILY) -> DataFrame:
    """Scale ``position`` towards a volatility, at most 1.5 times."""
    df = rolling(df, s, {"_vol": ("std", "log_ret_1d", 21, 21)})
    vol = F.greatest(F.coalesce(F.col("_vol") * ANNUAL, F.lit(0.20)), F.lit(0.05))
    scale = F.least(F.greatest(F.lit(target) / vol, F.lit(0.0)), F.lit(1.5))
    return df.withColumn("position", F.col("position") * scale).drop("_vol")


@windowed(1)
def _position_returns(df: DataFrame, s: Series = DAILY) -> DataFrame:
    held = F.coalesce(F.lag("position", 1).over(s.window()), F.lit(0.0))
    return df.withColumn("_pnl", held * F.col("asset_ret"))


def running_pnl(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Compounded return of yesterday's position, its peak and the drawdown from it."""
    df = _position_returns(df, s=s)
    df = running(df, s, {"cum_ret": ("product", F.col("_pnl") + 1.0)})
    df = running(df, s, {"peak": ("max", F.col("cum_ret"))})
    return df.withColumn("drawdown", F.try_divide(F.col("cum_ret"), F.col("peak")) - 1.0).withColumnRenamed("_pnl", "pnl")


@windowed(1)
def drawdown_guard(df: DataFrame, limit: float = -0.15, s: Series = DAILY) -> DataFrame:
    """Halve the position after a bar that closed below the drawdown limit."""
    df = df.withColumn("_dd", F.lag("drawdown", 1).over(s.window()))
    hit = F.coalesce(F.col("_dd") < limit, F.lit(False))
    return df.withColumn("position", F.when(hit, F.col("position") * 0.5).otherwise(F.col("position"))).drop("_dd")


@windowed(lambda p: p["rows"] + 1)
def stop_loss(df: DataFrame, limit: float = -0.05, rows: int = 5, s: Series = DAILY) -> DataFrame:
    """Flat after a bar whose trailing compounded return broke the limit."""
    df = df.withColumn("_g", F.col("pnl") + 1.0)
    df = rolling(df, s, {"_trail": ("prod", "_g", rows, rows)})
    df = df.withColumn("_before", F.lag("_trail", 1).over(s.window()) - 1.0)
    hit = F.coalesce(F.col("_before") < limit, F.lit(False))
    return df.withColumn("position", F.when(hit, 0.0).otherwise(F.col("position"))).drop("_g", "_trail", "_before")


def clip_position(df: DataFrame, bound: float = 1.0) -> DataFrame:
    clipped = F.least(F.greatest(F.col("position"), F.lit(-bound)), F.lit(bound))
    return df.withColumn("position", F.when(F.col("position").isNotNull(), clipped))


def apply_risk(
    df: DataFrame,
    use_vol: bool = True,
    use_drawdown: bool = True,
    use_stop: bool = True,
    target: float = 0.15,
    drawdown: float = -0.15,
    stop: float = -0.05,
    s: Series = DAILY,
) -> DataFrame:
    """All rules in order on ``signal``; needs ``log_ret_1d`` and ``asset_ret``, adds ``position``."""
    df = df.withColumn("position", F.col("signal").cast("double"))
    if use_vol:
        df = vol_target(df, target, s=s)
    df = running_pnl(df, s)
    if use_drawdown:
        df = drawdown_guard(df, drawdown, s=s)
    if use_stop:
        df = stop_loss(df, stop, s=s)
    return clip_position(df).drop("pnl", "cum_ret", "peak", "drawdown")
