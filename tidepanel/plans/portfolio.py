"""From signals to portfolio reports in one plan; variants are extra key columns, not loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.allocate import cross_sectional_topk, equal_weight, risk_parity
from tidepanel.operators.cvar import cvar_allocation
from tidepanel.operators.hedge import alpha_decomposition, alpha_share, beta_hedge, hedged_returns, rolling_beta
from tidepanel.operators.metrics import allocation_comparison, performance_report, tail_stats
from tidepanel.operators.pnl import (
    FLAT_RATE,
    asset_returns,
    cost_levels,
    net_returns_flat,
    net_returns_impact,
    portfolio_returns,
    positions_from_signals,
)
from tidepanel.operators.risk import apply_risk
from tidepanel.operators.signals import apply_strategies
from tidepanel.operators.splits import assign_folds, calendar_walk_forward

Signal = Callable[[DataFrame], DataFrame]

PANEL = Series(keys=("strategy", "ticker"))
PORTFOLIO = Series(keys=("strategy",))
BENCHMARK = "Buy & Hold"
HEDGED = " (Beta-Neutral)"
BAR_COLUMNS = ("close", "volume", "log_ret_1d", "asset_ret")

ALLOCATIONS: dict[str, Callable[[DataFrame, Series], DataFrame]] = {
    "equal_weight": lambda df, s: equal_weight(df),
    "risk_parity": lambda df, s: risk_parity(df, s=s),
    "cross_sectional": lambda df, s: cross_sectional_topk(df, s),
    "cvar": lambda df, s: cvar_allocation(df, s),
}


def strategy_panel(df: DataFrame, strategies: dict[str, Signal], keep: tuple[str, ...] = BAR_COLUMNS) -> DataFrame:
    """Run every strategy on one pass of the feature table: (strategy, ticker, dt, bar..., signal)."""
    return apply_strategies(df, strategies).select("strategy", "ticker", "dt", *keep, "signal")


def hold(df: DataFrame) -> DataFrame:
    """The benchmark: long everything."""
    return df.withColumn("signal", F.lit(1.0))


def allocated(
    panel: DataFrame, allocation: str | Callable[[DataFrame, Series], DataFrame] = "risk_parity"
) -> DataFrame:
    """Risk rules and allocation; adds ``weight``.  The benchmark is held without rules."""
    rows = materialise(apply_risk(panel, s=PANEL), "risk")
    free = F.col("strategy") == BENCHMARK
    rows = rows.withColumn("position", F.when(free, F.col("signal")).otherwise(F.col("position")))
    fn = ALLOCATIONS[allocation] if isinstance(allocation, str) else allocation
    return fn(rows, PANEL)


def executed(
    weights: DataFrame, rate: float | Column = FLAT_RATE, impact: bool = True, s: Series = PANEL
) -> DataFrame:
    """Net returns of the allocated weights, one bar later."""
    rows = positions_from_signals(weights.drop("position"), "weight", s=s)
    return net_returns_impact(rows, rate, s=s) if impact else net_returns_flat(rows, rate, s=s)


def hedged(portfolio: DataFrame, weights: DataFrame, bars: DataFrame, market: DataFrame) -> DataFrame:
    """Portfolio returns with the market beta taken out, under a second strategy name."""
    betas = rolling_beta(bars.select("ticker", "dt", "asset_ret"), market)
    hedge = beta_hedge(weights, betas, ("strategy",))
    out = hedged_returns(portfolio, hedge, market, ("strategy",))
    return out.withColumn("strategy", F.concat("strategy", F.lit(HEDGED)))


def portfolio_run(
    features: DataFrame,
    market: DataFrame,
    strategies: dict[str, Signal],
    allocation: str = "risk_parity",
    rate: float = FLAT_RATE,
    impact: bool = True,
) -> DataFrame:
    """One report per strategy, its hedged form and the benchmark.

    features: feature table with bars and score columns; market: (dt, market_ret).
    """
    bars = asset_returns(features)
    panel = materialise(strategy_panel(bars, {**strategies, BENCHMARK: hold}), "panel")
    weights = materialise(allocated(panel, allocation), "weights")
    plain = materialise(portfolio_returns(executed(weights, rate, impact), ("strategy",), universe=weights), "portfolio")
    neutral = hedged(
        plain.filter(F.col("strategy") != BENCHMARK), weights.filter(F.col("strategy") != BENCHMARK), bars, market
    )
    both = materialise(plain.unionByName(neutral), "returns")
    return performance_report(both, PORTFOLIO, positions=False)


def hedge_summary(portfolio: DataFrame, market: DataFrame) -> DataFrame:
    """Mean beta of each portfolio to the market and the share of its return that is alpha."""
    rows = portfolio.withColumnRenamed("ret", "asset_ret")
    betas = rolling_beta(rows, market, s=PORTFOLIO)
    return alpha_share(alpha_decomposition(betas, market, PORTFOLIO), ("strategy",))


def walk_forward_reports(
    features: DataFrame, signal: Signal, rate: float = FLAT_RATE, **folds
) -> DataFrame:
    """A report per fold and series on the test slices; positions and returns restart in each."""
    table = calendar_walk_forward(features, **folds)
    rows = assign_folds(features, table).filter(F.col("role") == "test").drop("role")
    s = Series(keys=("fold", "ticker"))
    rows = positions_from_signals(asset_returns(signal(rows), s=s), s=s)
    return performance_report(materialise(net_returns_flat(rows, rate, s=s), "folds"), s)


def compare_allocations(
    panel: DataFrame, first: str = "cvar", second: str = "risk_parity", rate: float = FLAT_RATE
) -> DataFrame:
    """Headline metrics of two allocation methods on the same signals: differences, score, verdict."""
    parts = []
    for method in (first, second):
        weights = materialise(allocated(panel, method), "weights")
        net = portfolio_returns(executed(weights, rate, False), ("strategy",), missing="zero")
        parts.append(net.withColumn("method", F.lit(method)))
    both = materialise(parts[0].unionByName(parts[1]), "methods")
    s = PORTFOLIO.with_keys("method")
    reports = performance_report(both, s, positions=False).join(tail_stats(both, s=s), list(s.keys))
    return allocation_comparison(reports, first, second)


# Metrics compared between cost models
COMPARED = ("sharpe_ratio", "cagr", "max_drawdown", "total_return", "sortino_ratio", "win_rate")


def cost_model_comparison(weights: DataFrame, rate: float = FLAT_RATE) -> DataFrame:
    """Portfolio metrics with a flat rate and with estimated impact, and their differences."""
    parts = [
        portfolio_returns(executed(weights, rate, impact), ("strategy",), universe=weights).withColumn("mode", F.lit(mode))
        for mode, impact in (("flat", False), ("impact", True))
    ]
    s = PORTFOLIO.with_keys("mode")
    both = materialise(parts[0].unionByName(parts[1]), "modes")
    reports = materialise(performance_report(both, s, positions=False), "reports")
    flat, impact = (
        reports.filter(F.col("mode") == m).select("strategy", *[F.col(c).alias(f"{m}_{c}") for c in COMPARED])
        for m in ("flat", "impact")
    )
    joined = flat.join(impact, "strategy")
    return joined.withColumns({f"delta_{c}": F.col(f"impact_{c}") - F.col(f"flat_{c}") for c in COMPARED})


# Total cost rates of the sensitivity table
SENSITIVITY = {"Low (0.1%)": 0.001, "Medium (0.5%)": 0.005, "High (1.0%)": 0.01}


def cost_sensitivity(weights: DataFrame, rates: dict[str, float] = SENSITIVITY) -> DataFrame:
    """Portfolio metrics per strategy and cost level, all levels in one plan."""
    levels = cost_levels(weights, rates)
    rows = executed(levels, F.col("cost_rate"), True, PANEL.with_keys("cost_level"))
    portfolio = portfolio_returns(rows, ("cost_level", "strategy"), universe=levels)
    return performance_report(materialise(portfolio, "levels"), PORTFOLIO.with_keys("cost_level"), positions=False)


def market_returns(market: DataFrame) -> DataFrame:
    """(dt, market_ret) from the bars of the one market series."""
    return asset_returns(market).select("dt", F.col("asset_ret").alias("market_ret"))
