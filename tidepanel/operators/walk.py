"""The walk-forward run: all folds, sides and learners in shared jobs, with tuning inside the folds if asked for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators import stored
from tidepanel.operators.boosting import BOOST_A, BOOST_B, Boost, bin_edges, fit_boosting, score_boosting
from tidepanel.operators.fitting import feature_rows, in_folds, scalers, set_sizes, training_sets, with_scores
from tidepanel.operators.logistic import fit_logistic, score_logistic
from tidepanel.operators.meta import classification_report, ensemble_soft, model_sharpe
from tidepanel.operators.splits import fold_table, index_walk_forward
from tidepanel.operators.tuning import PARTS, tune, tuned

# Names and defaults of the boosted learners
BOOSTED = {"BoostA": BOOST_A, "BoostB": BOOST_B}


@dataclass
class Walk:
    """The tables of a run: inputs, folds, training sets and fitted models."""

    base: DataFrame
    features: list[str]
    rows: DataFrame
    assigned: DataFrame
    spans: DataFrame
    sizes: DataFrame
    sets: DataFrame
    scaler: DataFrame
    edges: object
    s: Series = DAILY

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], train: int = 252, test: int = 20, gap_rows: int = 0, s: Series = DAILY) -> Walk:
        base = materialise(df, "walk-input")
        features = list(features)
        rows = feature_rows(base, features, s)
        assigned = materialise(index_walk_forward(base, train, test, gap_rows, s), "assigned")
        spans = materialise(fold_table(assigned, s.order), "spans")
        sizes = set_sizes(rows, assigned, s)
        return cls(
            base, features, rows, assigned, spans, sizes, training_sets(rows, assigned, sizes, s), scalers(rows, assigned, s), bin_edges(rows, len(features)), s
        )

    def logistic(self) -> DataFrame:
        return fit_logistic(self.sets, self.sizes, self.scaler)

    def boosted(self, learners: dict) -> DataFrame:
        return fit_boosting(self.sets, self.sizes, learners, self.edges)

    def test_rows(self) -> DataFrame:
        """Rows of the test windows; a side without a model has none here and keeps the default score."""
        return in_folds(self.rows, self.assigned, "test", self.s)

    def tune(self, base: Boost, trials: int, parts: int = PARTS) -> DataFrame:
        return tune(self.rows, self.assigned, self.edges, base, trials, parts, s=self.s)

    def scores(self, coefficients: DataFrame, trees: DataFrame, names: Sequence[str]) -> DataFrame:
        """pred_ and proba_ of the logistic and the boosted ``names`` for every test row that has models."""
        out = score_logistic(materialise(self.test_rows(), "test"), coefficients, "Logistic")
        for name in names:
            out = score_boosting(out, trees, name)
        return out.drop("x", "y")


def walk_forward(
    df: DataFrame,
    features: Sequence[str],
    train: int = 252,
    test: int = 20,
    gap_rows: int = 0,
    trials: int = 0,
    save_to: str | None = None,
    s: Series = DAILY,
) -> DataFrame:
    """``df`` with out-of-sample scores of Logistic, BoostA, BoostB and their soft Ensemble.

    With ``trials`` the boosted learners are tuned in every fold on its training window, and scores of the default ones are kept
    beside them as BoostA_baseline and BoostB_baseline.  Rows never tested, and sides without a model, have pred 0 and proba one half.
    """
    walk = Walk.of(df, features, train, test, gap_rows, s)
    learners: dict = dict(BOOSTED)
    if trials:
        learners = {n: tuned(walk.tune(p, trials), p) for n, p in BOOSTED.items()} | {f"{n}_baseline": p for n, p in BOOSTED.items()}
    trees, coefficients = walk.boosted(learners), walk.logistic()
    if save_to:
        stored.save(save_to, walk.features, walk.spans, coefficients, trees)
    names = list(learners)
    out = materialise(with_scores(walk.base, walk.scores(coefficients, trees, names), ["Logistic", *names], s), "scored")
    return ensemble_soft(out, ["Logistic", *BOOSTED])


def reports(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Classification report and Sharpe ratio, one row per model."""
    parts = [classification_report(df, n).join(model_sharpe(df, n), "model") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
