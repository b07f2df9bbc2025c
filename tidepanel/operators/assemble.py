"""Calendar, cross-section and label columns, and assembly of the feature table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.joins import by_date
from tidepanel.functions.ranks import quantiles
from tidepanel.functions.series import DAILY, Series, rolling, running, windowed
from tidepanel.operators.indicators import technical_all
from tidepanel.operators.macro import attach_macro
from tidepanel.operators.regime import regime_features
from tidepanel.operators.returns import _need_log_ret, returns_all, simple_ret

# Columns that are no model inputs
TARGETS = ("target_fwd_return", "target_direction")
NOT_FEATURES = (
    "ticker",
    "dt",
    "is_outlier",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "target_fwd_return",
    "target_direction",
    "day_of_week",
    "month",
    "quarter",
    "dow_sin",
    "dow_cos",
    "regime_is_trending_up",
    "relative_strength_portfolio",
    "obv",
)
BLOCKED_PREFIXES = ("pred_", "proba_", "meta_")


def calendar_features(df: DataFrame, order: str = "dt") -> DataFrame:
    """Day of week (Monday 0), month and quarter."""
    return df.withColumns({"day_of_week": F.weekday(order), "month": F.month(order), "quarter": F.quarter(order)})


def cyclical_dow(df: DataFrame) -> DataFrame:
    angle = F.col("day_of_week") * (2.0 * math.pi) / 5.0
    return df.withColumns({"dow_sin": F.sin(angle), "dow_cos": F.cos(angle)})


@windowed(0, lambda p: p["horizon"])
def forward_return(df: DataFrame, horizon: int = 1, s: Series = DAILY, out: str = "target_fwd_return") -> DataFrame:
    """Return over the next ``horizon`` rows: a label, never a feature."""
    return df.withColumn(out, F.try_divide(F.lead("close", horizon).over(s.window()), F.col("close")) - 1.0)


def target_direction(df: DataFrame, threshold: float = 0.005) -> DataFrame:
    """1 above the threshold, 0 below its negative, NULL between and at the end."""
    ahead = F.col("target_fwd_return")
    return df.withColumn("target_direction", F.when(ahead > threshold, 1.0).when(ahead < -threshold, 0.0))


@windowed(1)
def _with_simple_return(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return df.withColumn("_ret", simple_ret(1, s))


def universe_avg_return(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Equal-weight mean of simple returns per date over the series present: (dt, portfolio_avg_return)."""
    returns = _with_simple_return(df.select(*s.keys, s.order, "close"), s=s)
    return returns.groupBy(s.order).agg(F.avg("_ret").alias("portfolio_avg_return"))


def relative_strength(df: DataFrame) -> DataFrame:
    return df.withColumn("relative_strength_portfolio", F.col("log_ret_1d") - F.col("portfolio_avg_return"))


@windowed(lambda p: p["window"] + 1)
def corr_with_universe(df: DataFrame, window: int = 20, least: int = 10, s: Series = DAILY) -> DataFrame:
    """Rolling correlation with the universe mean; NULL where one of the two does not vary."""
    df = _need_log_ret(df, s)
    pair = ("log_ret_1d", "portfolio_avg_return")
    return rolling(df, s, {"corr_with_portfolio_20d": ("corr", pair, window, least)})


def union_calendar(df: DataFrame, order: str = "dt") -> DataFrame:
    return df.select(order).distinct()


def warmup_filter(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Keep rows with enough known values over all columns but the keys and the outlier flag."""
    columns = [c for c in df.columns if c not in ("ticker", "dt", "is_outlier")]
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.filter(known / len(columns) >= share)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and not c.startswith(BLOCKED_PREFIXES)]


def impute_terminal(df: DataFrame, columns: list[str] | None = None, s: Series = DAILY) -> DataFrame:
    """Fill features forward within their series, then with 0; targets stay untouched."""
    columns = feature_columns(df) if columns is None else columns
    filled = running(df, s, {f"_f_{c}": ("last", F.col(c)) for c in columns})

    def value(c: str) -> Column:
        kind = df.schema[c].dataType
        zero = F.lit(0.0) if isinstance(kind, T.DoubleType) else F.lit(0).cast(kind)
        return F.coalesce(F.col(f"_f_{c}"), zero).alias(c)

    chosen = set(columns)
    return filled.select(*[value(c) if c in chosen else F.col(c) for c in df.columns])


def describe_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per feature."""
    columns = feature_columns(df) if columns is None else columns
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarters = quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return stats.join(quarters, "feature", "left")


def build_features(
    bars: DataFrame,
    macro: DataFrame | None = None,
    labels: list[str] | None = None,
    horizon: int = 1,
    share: float = 0.8,
    s: Series = DAILY,
) -> DataFrame:
    """The complete feature table of a universe in one plan.

    macro: long bars with column ``label``; labels: the fixed list that becomes columns.
    """
    df = technical_all(bars, s=s)
    df = returns_all(df, s=s)
    df = regime_features(df, s=s)
    df = cyclical_dow(calendar_features(df, s.order))
    df = target_direction(forward_return(df, horizon, s=s))
    # columns per date come last: rows stay narrow through the windows
    df = by_date(df, universe_avg_return(bars, s), s.order)
    df = corr_with_universe(relative_strength(df), s=s)
    if macro is not None:
        df = attach_macro(df, bars, macro, labels, s)
    return warmup_filter(df, share)
