"""Stress of costs and outliers on a model's positions, and the verdict over all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, TRADING_DAYS, Series, windowed
from tidepanel.operators.metrics import drawdowns
from tidepanel.operators.pnl import cost_levels
from tidepanel.operators.returns import ANNUAL

COSTS = {"0.1%": 0.001, "0.5%": 0.005, "1.0%": 0.01, "2.0%": 0.02}


@windowed(2)
def model_positions(df: DataFrame, pred: str, s: Series = DAILY) -> DataFrame:
    """Yesterday's call as +1 or -1 (0 on the first bar), its gross return and the change."""
    w = s.window()
    side = F.when(F.col(pred) == 1, 1.0).otherwise(-1.0)
    df = df.withColumns({"_side": side, "_r": F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1.0})
    df = df.withColumn("position", F.coalesce(F.lag("_side", 1).over(w), F.lit(0.0)))
    df = df.withColumn("change", F.abs(F.col("position") - F.coalesce(F.lag("position", 1).over(w), F.lit(0.0))))
    return df.withColumn("gross", F.col("position") * F.coalesce("_r", F.lit(0.0))).drop("_side", "_r")


def _plain_sharpe(mean: Column, std: Column) -> Column:
    return F.when(std > 1e-8, mean / std * ANNUAL).otherwise(0.0)


def cost_stress(df: DataFrame, pred: str, costs: dict[str, float] = COSTS, s: Series = DAILY) -> DataFrame:
    """CAGR, Sharpe (population deviation), drawdown and return per series and cost level."""
    rows = cost_levels(model_positions(df, pred, s=s), costs)
    rows = rows.withColumn("ret", F.col("gross") - F.col("change") * F.col("cost_rate"))
    line = s.with_keys("cost_level")
    rows = drawdowns(rows, line)
    agg = rows.groupBy(*line.keys).agg(
        (F.product(F.col("ret") + 1.0) - 1.0).alias("total_return"),
        F.count(F.lit(1)).alias("_n"),
        _plain_sharpe(F.avg("ret"), F.stddev_pop("ret")).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )
    years = F.greatest(F.col("_n") / float(TRADING_DAYS), F.lit(0.01))
    cagr = F.when(F.col("total_return") > -1.0, F.pow(F.col("total_return") + 1.0, F.lit(1.0) / years) - 1.0)
    return agg.withColumn("cagr", cagr.otherwise(-1.0)).drop("_n")


def cost_resilience(stress: DataFrame, keys: tuple[str, ...] = ("ticker",), costs: dict[str, float] = COSTS) -> DataFrame:
    """Verdict per key from the Sharpe at the second and the last cost level."""
    names = list(costs)
    at = {n: F.max(F.when(F.col("cost_level") == n, F.col("sharpe"))) for n in names}
    agg = stress.groupBy(*keys).agg(at[names[1]].alias("sharpe_medium"), at[names[-1]].alias("sharpe_high"))
    verdict = F.when(F.col("sharpe_high") > 0, "SURVIVES").when(F.col("sharpe_medium") > 0, "MEDIUM_ONLY")
    return agg.withColumn("verdict", verdict.otherwise("NOT_RESILIENT"))


def outlier_dependence(df: DataFrame, pred: str, days: int = 5, s: Series = DAILY) -> DataFrame:
    """Sharpe with all days, without the best and without the worst, and how far it collapses.

    Only the extreme days of each series are ranked; the rest enters as sums about the mean.
    """
    keys = list(s.keys)
    rows = model_positions(df, pred, s=s).select(*keys, s.order, "gross")
    full = rows.groupBy(*keys).agg(
        F.count("gross").alias("_n"), F.avg("gross").alias("_m"), F.var_pop("gross").alias("_v")
    )

    def extremes(ascending: bool, tag: str) -> DataFrame:
        order = F.col("gross").asc() if ascending else F.col("gross").desc()
        ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, s.order)))
        picked = ranked.filter(F.col("_k") <= days)
        return picked.groupBy(*keys).agg(F.collect_list("gross").alias(tag))

    joined = full.join(extremes(False, "_top"), keys).join(extremes(True, "_bottom"), keys)

    def without(values: str) -> Column:
        zero = F.lit(0.0)
        s1 = F.aggregate(values, zero, lambda a, x: a + (x - F.col("_m")))
        s2 = F.aggregate(values, zero, lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
        n = F.col("_n") - F.size(values)
        shift = -s1 / n
        var = F.greatest((F.col("_v") * F.col("_n") - s2) / n - shift * shift, zero)
        return _plain_sharpe(F.col("_m") + shift, F.sqrt(var))

    out = joined.select(
        *keys,
        _plain_sharpe(F.col("_m"), F.sqrt("_v")).alias("sharpe_full"),
        without("_top").alias("sharpe_no_best"),
        without("_bottom").alias("sharpe_no_worst"),
    )
    collapse = F.abs(F.col("sharpe_full") - F.col("sharpe_no_best")) / (F.abs("sharpe_full") + 1e-10)
    verdict = F.when(F.col("collapse") > 0.5, "OUTLIER_DEPENDENT").when(F.col("collapse") > 0.25, "MODERATE")
    return out.withColumn("collapse", collapse).withColumn("verdict", verdict.otherwise("ROBUST"))


def shuffle_verdict(real: Column, shuffled: Column) -> Column:
    """FAIL when shuffled labels keep most of the edge, WARN when slightly above chance."""
    return (
        F.when(F.abs(shuffled - 0.5) > F.abs(real - 0.5) * 0.8, "FAIL").when(shuffled > 0.52, "WARN").otherwise("PASS")
    )


def robustness_verdict(facts: DataFrame) -> DataFrame:
    """Issue flags, rating and confidence from the results of all checks, one row per row of facts.

    facts: acc_early, acc_late, acc_full, acc_random, shuffle_verdict, sharpe_medium, sharpe_high,
    outlier_verdict.
    """
    late = F.col("acc_late") < F.col("acc_early") - 0.03
    subset = F.col("acc_random") < F.col("acc_full") - 0.05
    issues = {
        "issue_time": late,
        "issue_features": subset,
        "issue_leak": F.col("shuffle_verdict").isin("FAIL", "WARN"),
        "issue_cost": (F.col("sharpe_medium") <= 0) | (F.col("sharpe_high") <= 0),
        "issue_outliers": F.col("outlier_verdict").isin("OUTLIER_DEPENDENT", "MODERATE"),
    }
    out = facts.withColumns({k: F.coalesce(c, F.lit(False)).cast("int") for k, c in issues.items()})
    out = out.withColumn("n_issues", sum((F.col(k) for k in issues), F.lit(0)))
    fail, n = F.col("shuffle_verdict") == "FAIL", F.col("n_issues")
    rating = (
        F.when(fail, "OVERFITTED / LEAKAGE RISK")
        .when(n >= 3, "WEAK")
        .when(n >= 2, "MODERATE")
        .when(n == 1, "ROBUST (Minor Concerns)")
        .otherwise("ROBUST")
    )
    confidence = F.when(fail | (n >= 3), "Low").when(n >= 2, "Medium").when(n == 1, "Medium-High").otherwise("High")
    return out.withColumns({"rating": rating, "confidence": confidence})
