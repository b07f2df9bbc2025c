"""Evaluation of model scores and the inputs of the second model that gates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranks import value_counts
from tidepanel.functions.series import DAILY, EPS, Series, rolling, windowed
from tidepanel.operators.returns import ANNUAL

NO_SCORE = 0.5
META_FEATURES = (
    "meta_confidence",
    "meta_confidence_distance",
    "meta_rolling_accuracy",
    "meta_rolling_sharpe",
    "meta_volatility_20d",
    "meta_regime_bullish",
    "meta_regime_bearish",
    "meta_regime_high_vol",
    "meta_regime_low_vol",
    "meta_market_regime",
    "meta_pred_stability",
    "meta_pred_rolling_mean",
    "meta_rolling_winrate",
    "meta_drawdown",
)


def ensemble_soft(df: DataFrame, models: list[str], out: str = "Ensemble") -> DataFrame:
    """Mean probability of the members; a call above one half."""
    mean = sum((F.col(f"proba_{m}") for m in models), F.lit(0.0)) / len(models)
    df = df.withColumn(f"proba_{out}", mean)
    return df.withColumn(f"pred_{out}", F.when(F.col(f"proba_{out}") > 0.5, 1).otherwise(0))


def ensemble_hard(df: DataFrame, models: list[str], out: str = "Vote") -> DataFrame:
    """Majority of calls; a tie goes to the smaller label."""
    votes = sum((F.col(f"pred_{m}") for m in models), F.lit(0))
    return df.withColumn(f"pred_{out}", F.when(votes * 2 > len(models), 1).otherwise(0))


@windowed(lambda p: max(p["accuracy"], p["sharpe"], p["stability"], 20) + 1)
def meta_features(
    df: DataFrame, model: str = "Ensemble", accuracy: int = 20, sharpe: int = 20, stability: int = 10, s: Series = DAILY
) -> DataFrame:
    """Fourteen causal inputs: confidence, recent success, volatility and regime of a model's calls."""
    w = s.window()
    proba, pred = f"proba_{model}", f"pred_{model}"
    df = df.withColumns(
        {
            "_pl": F.lag("target_direction", 1).over(w),
            "_pp": F.lag(pred, 1).over(w).cast("double"),
            "_vol": F.lit(None).cast("double") if "realized_vol_20d" not in df.columns else F.col("realized_vol_20d"),
        }
    )
    earned = F.col("_pp") * F.col("log_ret_1d")
    df = df.withColumns(
        {
            "_hit": F.when(F.col("_pl").isNotNull(), F.coalesce(F.col("_pp") == F.col("_pl"), F.lit(False)).cast("double")),
            "_earned": earned,
            "_win": F.coalesce(earned > 0, F.lit(False)).cast("double"),
            # the bar without a known call counts as active
            "_active": F.coalesce(F.col("_pp") != 0, F.lit(True)).cast("double"),
        }
    )
    specs = {
        "_acc": ("mean", "_hit", accuracy, 5),
        "_em": ("mean", "_earned", sharpe, 5),
        "_es": ("std", "_earned", sharpe, 5),
        "_ps": ("std", proba, stability, 3),
        "_pm": ("mean", proba, stability, 3),
        "_ws": ("sum", "_win", accuracy, 5),
        "_as": ("sum", "_active", accuracy, 5),
    }
    if "realized_vol_20d" not in df.columns:
        specs["_v"] = ("std", "log_ret_1d", 20, 20)
    df = rolling(df, s, specs)
    volatility = F.col("_vol") if "_v" not in df.columns else F.col("_v") * ANNUAL

    def present(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(0)

    df = df.withColumns(
        {
            "meta_confidence": F.col(proba),
            "meta_confidence_distance": F.abs(F.col(proba) - 0.5),
            "meta_rolling_accuracy": F.col("_acc"),
            "meta_rolling_sharpe": F.col("_em") / (F.col("_es") + EPS) * ANNUAL,
            "meta_volatility_20d": volatility,
            "meta_regime_bullish": present("regime_trend_bullish"),
            "meta_regime_bearish": present("regime_trend_bearish"),
            "meta_regime_high_vol": present("regime_is_high_vol"),
            "meta_regime_low_vol": present("regime_is_low_vol"),
            "meta_market_regime": present("market_regime"),
            "meta_pred_stability": F.col("_ps"),
            "meta_pred_rolling_mean": F.col("_pm"),
            "meta_rolling_winrate": F.col("_ws") / (F.col("_as") + EPS),
            "meta_drawdown": present("regime_drawdown"),
        }
    )
    return df.drop("_pl", "_pp", "_vol", "_hit", "_earned", "_win", "_active", *specs)


@windowed(0, 1)
def meta_target(df: DataFrame, model: str = "Ensemble", threshold: float = 0.0, s: Series = DAILY) -> DataFrame:
    """1 if the call earned on the next bar, 0 if not, NULL without a call or at the end."""
    call = F.col(f"pred_{model}")
    df = df.withColumn("_next", call * F.lead("log_ret_1d", 1).over(s.window()))
    label = F.when(F.col("_next").isNotNull() & (call != 0), (F.col("_next") > threshold).cast("double"))
    return df.withColumn("meta_target", label).drop("_next")


def scored_rows(df: DataFrame, model: str) -> DataFrame:
    """Rows the model really scored; the default probability means it did not."""
    return df.filter(F.col(f"proba_{model}") != NO_SCORE)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(df: DataFrame, model: str, keys: tuple[str, ...] = (), scored_only: bool = True) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and confusion counts of a model, per key.

    The AUC is exact: it comes from the ranks of the positive rows, equal scores sharing theirs.
    ``scored_only`` leaves out rows with the default probability, as out-of-sample columns of a
    walk-forward run need it; the scores of a validation fold all count.
    """
    groups = list(keys) or ["model"]
    rows = scored_rows(df, model) if scored_only else df
    rows = rows.filter(F.col("target_direction").isNotNull() & F.col(f"pred_{model}").isNotNull())
    rows = rows.withColumn("model", F.lit(model)) if not keys else rows
    y, p = F.col("target_direction") == 1, F.col(f"pred_{model}") == 1
    counts = rows.groupBy(*groups).agg(
        F.count(F.when(~y & ~p, 1)).alias("tn"),
        F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"),
        F.count(F.when(y & p, 1)).alias("tp"),
    )
    ranked = value_counts(rows, groups, f"proba_{model}", {"_pos": F.count(F.when(y, 1)), "_neg": F.count(F.when(~y, 1))})
    # ranks from 1; of a positive row's rank, the part above its rank among positives are its wins
    rank_sum = F.sum(F.col("_pos") * (F.col("lo") + (F.col("n") + 1) / 2.0))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    wins = ranked.groupBy(*groups).agg((rank_sum - pos * (pos + 1) / 2.0).alias("_wins"), (pos * neg).alias("_pairs"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.join(wins, groups, "left").select(
        *groups,
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        _share(tp, tp + fp).alias("prec"),
        _share(tp, tp + fn).alias("recall"),
        _share(tp * 2, tp * 2 + fp + fn).alias("f1"),
        F.when(F.col("_pairs") > 0, F.col("_wins") / F.col("_pairs")).otherwise(0.5).alias("auc"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


@windowed(1)
def _held_call(df: DataFrame, column: str, out: str, s: Series = DAILY) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.lag(column, 1).over(s.window()).cast("double"), F.lit(0.0)))


def model_sharpe(df: DataFrame, model: str, keys: tuple[str, ...] = (), s: Series = DAILY) -> DataFrame:
    """Annualised mean over deviation of yesterday's call times today's log return."""
    rows = scored_rows(df, model).filter(F.col("target_direction").isNotNull() & F.col(f"pred_{model}").isNotNull())
    rows = _held_call(rows, f"pred_{model}", "_held", s=s).withColumn("_r", F.col("_held") * F.col("log_ret_1d"))
    rows = rows if keys else rows.withColumn("model", F.lit(model))
    mean, std = F.avg("_r"), F.stddev_samp("_r")
    return rows.groupBy(*(keys or ("model",))).agg(
        F.when(std > 1e-10, mean / std * ANNUAL).otherwise(0.0).alias("sharpe")
    )


def tuned_vs_baseline(tuned: DataFrame, baseline: DataFrame, on: str) -> DataFrame:
    """Metrics of both, side by side, with differences; one row per value of ``on``."""
    metrics = ("auc", "sharpe", "accuracy", "f1")
    a = tuned.select(on, *[F.col(m).alias(f"tuned_{m}") for m in metrics])
    b = baseline.select(on, *[F.col(m).alias(f"base_{m}") for m in metrics])
    return a.join(b, on).withColumns({f"delta_{m}": F.col(f"tuned_{m}") - F.col(f"base_{m}") for m in metrics})


def _arm(ret: Column, signal: Column, tag: str) -> list[Column]:
    active = F.when(signal != 0, ret)
    ok = (F.count(ret) >= 10) & (F.coalesce(F.stddev_samp(ret), F.lit(0.0)) >= 1e-10)

    def kept(c: Column) -> Column:
        return F.when(ok, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    return [
        F.count(active).alias(f"{tag}_trades"),
        kept(F.avg(ret) / F.stddev_samp(ret) * ANNUAL).alias(f"{tag}_sharpe"),
        kept(F.product(ret + 1.0) - 1.0).alias(f"{tag}_return"),
        kept(F.try_divide(F.count(F.when(active > 0, 1)), F.count(active))).alias(f"{tag}_win_rate"),
        kept(F.avg(active)).alias(f"{tag}_avg"),
    ]


def meta_impact(df: DataFrame, model: str, keys: tuple[str, ...] = ("ticker",), s: Series = DAILY) -> DataFrame:
    """The model's calls as they are and gated by ``meta_pred``: returns, trades and the gate's own hits."""
    rows = scored_rows(df, model)
    rows = _held_call(rows, f"pred_{model}", "_call", s=s)
    rows = _held_call(rows, "meta_pred", "_gate", s=s)
    rows = meta_target(rows, model, s=s)
    gated = F.when(F.col("_gate") == 0, 0.0).otherwise(F.col("_call"))
    rows = rows.withColumn("_gated", gated).filter(F.col("log_ret_1d").isNotNull())
    y, p = F.col("meta_target") == 1, F.col("meta_pred") == 1
    known = F.col("meta_target").isNotNull() & F.col("meta_pred").isNotNull()
    agg = rows.groupBy(*keys).agg(
        *_arm(F.col("_call") * F.col("log_ret_1d"), F.col("_call"), "orig"),
        *_arm(F.col("_gated") * F.col("log_ret_1d"), F.col("_gated"), "gated"),
        _share(F.count(F.when(known & (y == p), 1)), F.count(F.when(known, 1))).alias("gate_accuracy"),
        _share(F.count(F.when(known & y & p, 1)), F.count(F.when(known & p, 1))).alias("gate_precision"),
        _share(F.count(F.when(known & y & p, 1)), F.count(F.when(known & y, 1))).alias("gate_recall"),
    )
    cut = F.col("orig_trades") - F.col("gated_trades")
    return agg.withColumn("reduction_pct", cut / F.greatest(F.col("orig_trades"), F.lit(1)) * 100.0)


def filter_rate(df: DataFrame, model: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Share of scored rows that the gate turns off."""
    agg = scored_rows(df, model).groupBy(*keys).agg(
        F.count(F.when(F.col("meta_pred") == 0, 1)).alias("n_filtered"), F.count(F.lit(1)).alias("n_predicted")
    )
    return agg.withColumn("filter_rate", F.col("n_filtered") / F.col("n_predicted") * 100.0)


def fit_scaler(train: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """Mean and population deviation per feature and fold, from training rows only."""
    return train.groupBy(by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_d_{c}") for c in features]
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """Standardised features; a constant one becomes 0.  One scaler row per fold, so it is broadcast."""
    joined = df.join(F.broadcast(scaler), by)
    wide = F.lit(1.0)
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 1e-12, F.col(f"_d_{c}")).otherwise(wide)
        for c in features
    }
    return joined.withColumns(scaled).drop(*[f"_m_{c}" for c in features], *[f"_d_{c}" for c in features])
