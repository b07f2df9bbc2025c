"""Queries that fit models or solve programs; SQL cannot express them, so their rows are checked by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog import views as v
from tidepanel.catalog.base import add
from tidepanel.catalog.trading_queries import panel, scored
from tidepanel.functions.tables import materialise
from tidepanel.operators import cvar, indicators, metrics, models, pnl
from tidepanel.plans import portfolio as pf

FEATURES = ["zscore_5", "zscore_20", "realized_vol_20d", "rolling_ret_21d", "regime_trend_slope", "regime_drawdown", "rsi", "macro_F_trend"]
# small learners keep the checks short; the operators default to the full sizes
SMALL = {
    "Logistic": models.logistic_regression,
    "Forest": models.random_forest(10, 4),
    "BoostA": models.gradient_boosting(4, 2, 0.1),
    "BoostB": models.gradient_boosting(4, 3, 0.05, leaf=20),
}
BOOST = models.gradient_boosting(4, 3, 0.1)


def table(spark: SparkSession, d: str) -> DataFrame:
    df = indicators.rsi(scored(v.bars(spark, d)))
    # a market-wide column, so that the macro share of the importances is not empty
    macro = v.macro(spark, d).filter(F.col("label") == "F").select("dt", (F.col("close") / F.col("open") - 1.0).alias("macro_F_trend"))
    return materialise(df.join(macro, "dt", "left"), "features")


def spans(df: DataFrame) -> tuple[int, int]:
    """Two folds, whatever the length of the calendar."""
    n = df.select("dt").distinct().count()
    return n // 2, n // 4 + 1


def _walk(spark: SparkSession, d: str, learners=SMALL, path: str | None = None) -> DataFrame:
    df = table(spark, d)
    train, test = spans(df)
    return models.walk_forward_predict(df, FEATURES, learners, train, test, save_to=path)


SCORES = "pred_{0} proba_{0}"


def single(name: str):
    return lambda s, d: _walk(s, d, {name: SMALL[name]})


add("logistic_regression", "I2", single("Logistic"), doubles=SCORES.format("Logistic"))
add("random_forest", "I3", single("Forest"), doubles=SCORES.format("Forest"))
add("gradient_boosting_a", "I4", single("BoostA"), doubles=SCORES.format("BoostA"))
add("gradient_boosting_b", "I5", single("BoostB"), doubles=SCORES.format("BoostB"))
add("walk_forward_predict", "I8 I9", _walk, doubles=" ".join(SCORES.format(n) for n in (*SMALL, "Ensemble")))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return models.grid_search(table(spark, d), FEATURES, models.random_forest, {"trees": [5], "depth": [3, 5]}, k=2)


add("grid_search", "I10", _grid, keys="params", ints="trial fold", doubles="score")


def _random(spark: SparkSession, d: str) -> DataFrame:
    trials = [{**t, "trees": 3, "depth": min(t["depth"], 4)} for t in models.random_trials(2)]
    return models.random_search(table(spark, d), FEATURES, trials, k=2)


add("random_search", "I11", _random, keys="params", ints="trial fold", doubles="score")


def _boosted(df: DataFrame) -> tuple[DataFrame, models.Model]:
    rows = models.vectors(df.filter(F.col(models.LABEL).isNotNull()), FEATURES)
    return df, models.fit(rows.select(models.LABEL, "x"), BOOST)


def _importance(spark: SparkSession, d: str) -> DataFrame:
    return models.feature_importance(spark, _boosted(table(spark, d))[1], FEATURES)


add("feature_importance", "I13", _importance, keys="feature is_macro", ints="rank kept", doubles="importance")
add(
    "importance_summary", "I13", lambda s, d: models.importance_summary(_importance(s, d)),
    keys="", ints="n_macro n_macro_top", doubles="avg_macro_rank avg_macro_importance avg_importance",
)
add(
    "permutation_importance", "I14", lambda s, d: models.permutation_importance(*_boosted(table(s, d)), FEATURES),
    keys="feature", ints="prunable", doubles="auc drop",
)


def _gate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d).drop("meta_pred")
    n = df.select("dt").distinct().count()
    return models.meta_walk_forward(df, "S", train=n // 4, warmup=n // 4, test=n // 4 + 1)


add("meta_walk_forward", "I18", _gate, ints="meta_pred", doubles="meta_proba")
REPORT = "accuracy prec recall f1 auc"
add("time_stability", "P1", lambda s, d: models.time_stability(table(s, d), FEATURES, BOOST), keys="label", ints="n_test degrades", doubles=REPORT)
add("feature_subset_stability", "P2", lambda s, d: models.feature_subset_stability(table(s, d), FEATURES, BOOST), keys="label", ints="n_test", doubles=REPORT)
add("label_shuffle_test", "P3", lambda s, d: models.label_shuffle_test(table(s, d), FEATURES, BOOST), keys="verdict", doubles="real shuffled")


def _cvar(spark: SparkSession, d: str) -> DataFrame:
    bars = pnl.asset_returns(v.bars(spark, d)).withColumn("position", F.lit(1.0))
    return cvar.cvar_allocation(bars)


def _cvar_universe(spark: SparkSession, d: str) -> DataFrame:
    """Fifty series: several rounds of the active sets."""
    bars = materialise(pnl.asset_returns(v.bars(spark, d, "bars50")), "bars50")
    return cvar.cvar_weights(bars)


add("cvar_weights", "L4", _cvar, doubles="weight")
add("cvar_weights_generated", "L4", _cvar_universe, keys="ticker", ints="m", doubles="w")
add(
    "allocation_comparison", "O13", lambda s, d: pf.compare_allocations(panel(s, d)),
    keys="strategy verdict", ints="score", doubles=" ".join(f"delta_{c}" for c in metrics.HEADLINE),
)
