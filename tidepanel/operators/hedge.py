"""Rolling market beta and the hedge built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date
from tidepanel.functions.series import DAILY, EPS, Series, rolling, windowed


@windowed(lambda p: p["window"])
def _pair_beta(df: DataFrame, window: int, s: Series = DAILY) -> DataFrame:
    df = rolling(
        df,
        s,
        {"_cov": ("cov", ("asset_ret", "market_ret"), window, window), "_var": ("var", "market_ret", window, window)},
    )
    return df.withColumn("_beta", F.col("_cov") / (F.col("_var") + EPS)).drop("_cov", "_var")


def rolling_beta(df: DataFrame, market: DataFrame, window: int = 60, s: Series = DAILY) -> DataFrame:
    """Add ``beta`` of ``asset_ret`` to market(dt, market_ret) over rows where both exist, else 1."""
    rows = df.select(*s.keys, s.order, "asset_ret").filter(F.col("asset_ret").isNotNull())
    pairs = by_date(rows, market.filter(F.col("market_ret").isNotNull()), s.order, "inner")
    betas = _pair_beta(pairs, window, s=s).select(*s.keys, s.order, "_beta")
    out = df.join(betas, [*s.keys, s.order], "left")
    return out.withColumn("beta", F.coalesce("_beta", F.lit(1.0))).drop("_beta")


def alpha_decomposition(df: DataFrame, market: DataFrame, s: Series = DAILY) -> DataFrame:
    """Split ``asset_ret`` into beta times market and the rest."""
    out = by_date(df, market, s.order)
    part = F.col("beta") * F.coalesce("market_ret", F.lit(0.0))
    return out.withColumns({"beta_component": part, "alpha": F.col("asset_ret") - part}).drop("market_ret")


def alpha_share(decomposed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean beta and the share of total return that is alpha, in percent (0 without return)."""
    sums = decomposed.groupBy(*keys).agg(
        F.avg("beta").alias("avg_beta"), F.sum("alpha").alias("_a"), F.sum("asset_ret").alias("_t")
    )
    share = F.when(F.col("_t") != 0, F.col("_a") / F.col("_t") * 100.0).otherwise(0.0)
    return sums.withColumn("alpha_pct", share).drop("_a", "_t")


def beta_hedge(weights: DataFrame, betas: DataFrame, keys: tuple[str, ...] = (), order: str = "dt") -> DataFrame:
    """Market position per date that offsets the summed weight times beta: (keys..., dt, hedge)."""
    joined = weights.select(*keys, "ticker", order, "weight").join(
        betas.select("ticker", order, "beta"), ["ticker", order]
    )
    return joined.groupBy(*keys, order).agg((-F.sum(F.col("weight") * F.col("beta"))).alias("hedge"))


@windowed(1)
def _held_hedge(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return df.withColumn("_held", F.coalesce(F.lag("hedge", 1).over(s.window()), F.lit(0.0)))


def hedged_returns(
    portfolio: DataFrame, hedge: DataFrame, market: DataFrame, keys: tuple[str, ...], order: str = "dt"
) -> DataFrame:
    """Portfolio return plus yesterday's hedge times the market: (keys..., dt, ret)."""
    held = _held_hedge(hedge, s=Series(keys=keys, order=order)).select(*keys, order, "_held")
    joined = by_date(portfolio.join(held, [*keys, order], "left"), market, order)
    extra = F.coalesce("_held", F.lit(0.0)) * F.coalesce("market_ret", F.lit(0.0))
    return joined.select(*keys, order, (F.col("ret") + extra).alias("ret"))
