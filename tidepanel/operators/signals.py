"""Trading signals in [-1, 1]."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import with_totals
from tidepanel.functions.series import DAILY, EPS, Series, state_scan, transition, windowed
from tidepanel.operators.indicators import close_to_sma
from tidepanel.operators.regime import HIGH_VOL, RANGING, TREND_DOWN, TREND_UP
from tidepanel.operators.returns import rolling_returns


class Strategy(Protocol):
    """Anything that adds a column ``signal`` to a feature table."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def apply_strategies(df: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run several strategies in one pass of a table; the name becomes the key column ``strategy``.

    Columns that a strategy adds besides its signal are not kept.
    """
    own = [c for c in df.columns if c not in ("signal", "strategy")]
    for i, fn in enumerate(strategies.values()):
        df = fn(df).withColumn(f"_sig_{i}", F.col("signal").cast("double")).drop("signal")
    cells = [F.struct(F.lit(name).alias("strategy"), F.col(f"_sig_{i}").alias("signal")) for i, name in enumerate(strategies)]
    rows = df.select(*own, F.explode(F.array(*cells)).alias("_c"))
    return rows.select(*own, "_c.signal", "_c.strategy")


def machine(known: Column, enter_long: Column, enter_short: Column, exit_long: Column, exit_short: Column) -> Column:
    """Transition of a position that must be flat before it can change side; unknown input resets it."""
    from_flat = F.when(enter_long, 1).when(enter_short, -1).otherwise(0)
    from_long = F.when(exit_long, 0).otherwise(1)
    from_short = F.when(exit_short, 0).otherwise(-1)
    return F.when(known, transition(from_short, from_flat, from_long)).otherwise(
        transition(F.lit(0), F.lit(0), F.lit(0))
    )


def momentum_signal(
    df: DataFrame, lookback: int = 21, entry: float = 0.02, exit: float = -0.01, s: Series = DAILY
) -> DataFrame:
    """Follow the return over ``lookback`` rows, with hysteresis."""
    name = f"rolling_ret_{lookback}d"
    had = name in df.columns
    df = df if had else rolling_returns(df, (lookback,), s=s)
    m = F.col(name)
    code = machine(m.isNotNull(), m > entry, m < -entry, m < exit, m > -exit)
    out = state_scan(df, s, code, "signal")
    return out if had else out.drop(name)


def mean_reversion_signal(
    df: DataFrame,
    oversold: float = 30.0,
    overbought: float = 70.0,
    window: int = 20,
    entry: float = -0.03,
    exit: float = 0.02,
    s: Series = DAILY,
) -> DataFrame:
    """Buy dips and sell rises by RSI and distance from the moving average; needs ``rsi``."""
    if "rsi" not in df.columns:
        raise ValueError("column rsi is missing; add the indicators first")
    name = f"close_to_sma_{window}"
    had = name in df.columns
    df = df if had else close_to_sma(df, (window,), s=s)
    r, d = F.col("rsi"), F.col(name)
    code = machine(
        r.isNotNull() & d.isNotNull(),
        (r < oversold) & (d < entry),
        (r > overbought) & (d > -entry),
        (r > overbought) | (d > exit),
        (r < oversold) | (d < -exit),
    )
    out = state_scan(df, s, code, "signal")
    return out if had else out.drop(name)


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ml_signal_proba(
    df: DataFrame,
    model: str,
    confidence: float = 0.55,
    kelly: float = 0.5,
    shorts: bool = False,
    target_vol: float = 0.15,
) -> DataFrame:
    """Fractional Kelly size from a probability, flat without confidence, scaled by volatility."""
    p = F.col(f"proba_{model}")
    size = F.when((p < confidence) & (p > 1.0 - confidence), 0.0).otherwise((p * 2.0 - 1.0) * kelly)
    if "realized_vol_20d" in df.columns:
        scale = F.lit(target_vol) / (F.col("realized_vol_20d") + EPS)
        # an unknown volatility gives an unknown size, which least and greatest would hide
        size = F.when(scale.isNotNull(), size * _clip(scale, 0.2, 3.0))
    return df.withColumn("signal", F.when(size.isNotNull(), _clip(size, -1.0 if shorts else 0.0, 1.0)))


def ml_signal_label(df: DataFrame, model: str, shorts: bool = False) -> DataFrame:
    """1 where the model predicts a rise, else 0 (or -1); 0 everywhere without the model."""
    name = f"pred_{model}"
    if name not in df.columns:
        return df.withColumn("signal", F.lit(0.0))
    return df.withColumn("signal", F.when(F.col(name) > 0, 1.0).otherwise(-1.0 if shorts else 0.0))


def regime_bias(df: DataFrame, shorts: bool = False) -> DataFrame:
    """Flat in high volatility, no trades against the trend, none after a move in a range."""
    regime, signal, ret = F.col("market_regime"), F.col("signal"), F.col("log_ret_1d")
    stop = (
        (regime == HIGH_VOL)
        | ((regime == TREND_UP) & (signal < 0))
        | ((regime == TREND_DOWN) & (signal > 0))
        | ((regime == RANGING) & (signal > 0) & F.coalesce(ret > 0, F.lit(False)))
    )
    if shorts:
        stop = stop | ((regime == RANGING) & (signal < 0) & F.coalesce(ret < 0, F.lit(False)))
    return df.withColumn("signal", F.when(stop, 0.0).otherwise(signal))


def meta_gate(df: DataFrame) -> DataFrame:
    """Flat where the second model distrusts the trade."""
    return df.withColumn("signal", F.when(F.col("meta_pred") == 0, 0.0).otherwise(F.col("signal")))


def ml_signal(df: DataFrame, model: str, shorts: bool = False, **kwargs) -> DataFrame:
    """Size from the model's columns, then regime bias and gate where their columns exist."""
    sized = (
        ml_signal_proba(df, model, shorts=shorts, **kwargs)
        if f"proba_{model}" in df.columns
        else ml_signal_label(df, model, shorts)
    )
    known = f"proba_{model}" in df.columns or f"pred_{model}" in df.columns
    if known and "market_regime" in df.columns:
        sized = regime_bias(sized, shorts)
    return meta_gate(sized) if known and "meta_pred" in df.columns else sized


def latest_target_weights(df: DataFrame, model: str, s: Series = DAILY) -> DataFrame:
    """Target weights from each series' last row, scaled to a total of one: (ticker, weight)."""
    proba, pred = f"proba_{model}", f"pred_{model}"
    used = [c for c in (proba, pred, "meta_pred") if c in df.columns]
    last = df.groupBy(*s.keys).agg(*[F.max_by(c, s.order).alias(c) for c in used], F.max(s.order).alias("_at"))
    if proba in used:
        raw = F.greatest(F.lit(0.0), F.coalesce((F.col(proba) * 2.0 - 1.0) * 0.5, F.lit(0.0)))
    elif pred in used:
        raw = F.when(F.col(pred) > 0, 1.0).otherwise(0.0)
    else:
        raw = F.lit(1.0)
    if "meta_pred" in used:
        raw = F.when(F.col("meta_pred") == 0, 0.0).otherwise(raw)
    raw_rows = last.select(*s.keys, raw.alias("_raw"))
    total = raw_rows.agg(F.sum(F.abs("_raw")).alias("_total"))
    scaled = F.when(F.col("_total") > 0, F.col("_raw") / F.col("_total")).otherwise(F.col("_raw"))
    return with_totals(raw_rows, total).select(*s.keys, scaled.alias("weight"))


def signal_counts(df: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    side = F.signum("signal")
    return df.groupBy(*keys).agg(
        F.count(F.when(side > 0, 1)).alias("n_long"),
        F.count(F.when(side < 0, 1)).alias("n_short"),
        F.count(F.when(side == 0, 1)).alias("n_flat"),
    )


@windowed(lambda p: p["rows"])
def trend_signal(df: DataFrame, rows: int = 20, s: Series = DAILY) -> DataFrame:
    """Long above the moving average, short below it: the smallest rule strategy."""
    mean = F.avg("close").over(s.last(rows))
    n = F.count("close").over(s.last(rows))
    df = df.withColumns({"_m": mean, "_n": n})
    known = F.when(F.col("_n") >= rows, F.signum(F.col("close") - F.col("_m")))
    return df.withColumn("signal", F.coalesce(known, F.lit(0.0))).drop("_m", "_n")
