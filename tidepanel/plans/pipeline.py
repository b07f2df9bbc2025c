"""From bars to the portfolio report with fitted models: features, walk-forward scores, gate, signals, positions, figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.assemble import build_features, feature_columns
from tidepanel.operators.clean import clean
from tidepanel.operators.gate import gate_walk_forward
from tidepanel.operators.signals import ml_signal
from tidepanel.operators.walk import walk_forward
from tidepanel.plans.portfolio import Signal, portfolio_run


def scored_universe(
    bars: DataFrame, macro: DataFrame | None = None, labels: Sequence[str] = (), train: int = 252, test: int = 20, trials: int = 0, s: Series = DAILY
) -> DataFrame:
    """Feature table of cleaned bars with out-of-sample scores of every learner and the gate of their ensemble."""
    features = materialise(build_features(clean(bars, s=s), macro, list(labels) or None, s=s), "features")
    scores = walk_forward(features, feature_columns(features), train, test, trials=trials, s=s)
    return gate_walk_forward(scores, "Ensemble", train, test=test, s=s)


def model_strategies(names: Sequence[str] = ("Logistic", "BoostA", "BoostB", "Ensemble")) -> dict[str, Signal]:
    """One strategy per learner: sized by its probability, then regime bias and gate."""
    return {n: lambda df, n=n: ml_signal(df, n) for n in names}


def run_pipeline(
    bars: DataFrame,
    market: DataFrame,
    macro: DataFrame | None = None,
    labels: Sequence[str] = (),
    strategies: dict[str, Signal] | None = None,
    allocation: str = "risk_parity",
    train: int = 252,
    test: int = 20,
    trials: int = 0,
) -> DataFrame:
    """One report per strategy, its hedged form and the benchmark.

    bars: ticker, dt and OHLCV; market: (dt, market_ret); macro: bars with ``label``, of which ``labels`` become columns.
    ``strategies`` are added to the fitted ones.  ``trials`` above 0 tunes the boosted learners inside every fold.
    """
    scored = materialise(scored_universe(bars, macro, labels, train, test, trials), "scored-universe")
    return portfolio_run(scored, market, {**model_strategies(), **(strategies or {})}, allocation)
