"""Data-quality checks as tables of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.series import DAILY, Series, windowed
from tidepanel.operators.assemble import BLOCKED_PREFIXES, TARGETS


@windowed(1)
def _steps(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return df.withColumn("_prev", F.lag("dt", 1).over(s.window()))


def check_ordering(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Per ticker: rows, repeated dates and steps back in time along the input order ``seq``."""
    repeated = df.groupBy("ticker", "dt").agg(F.count(F.lit(1)).alias("_n"))
    repeated = repeated.groupBy("ticker").agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_repeated"))
    steps = _steps(df.select("ticker", "dt", seq), s=Series(order=seq))
    back = steps.groupBy("ticker").agg(F.count(F.when(F.col("dt") < F.col("_prev"), 1)).alias("n_backward"))
    good = (F.col("n_repeated") == 0) & (F.col("n_backward") == 0)
    return repeated.join(back, "ticker").withColumn("ordered", good.cast("int"))


def null_scan(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Unknown values per key and feature, where there are any: (keys..., feature, n_null)."""
    wide = df.groupBy(*keys).agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in features])
    return wide.unpivot(list(keys), features, "feature", "n_null").filter(F.col("n_null") > 0)


def worst_features(scan: DataFrame, top: int = 3) -> DataFrame:
    total = scan.groupBy("feature").agg(F.sum("n_null").alias("n_null"))
    return total.orderBy(F.desc("n_null"), "feature").limit(top)


def target_audit(df: DataFrame, least: int = 100) -> DataFrame:
    """Rows, labels, share without label and whether the labels suffice: one row."""
    absent = [c for c in TARGETS if c not in df.columns]
    if absent:
        raise ValueError(f"targets missing: {absent}")
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("target_direction").alias("n_labels"))
    share = F.lit(1.0) - F.try_divide(F.col("n_labels"), F.col("n_rows"))
    return counts.withColumns({"null_share": share, "enough": (F.col("n_labels") >= least).cast("int")})


def leak_columns(features: list[str]) -> list[str]:
    """Targets and model outputs that slipped into a feature list."""
    return [c for c in features if c in TARGETS or c.startswith(BLOCKED_PREFIXES)]


def leak_audit(df: DataFrame, features: list[str]) -> DataFrame:
    """Known values in each leaking column: (name, n_known)."""
    bad = leak_columns(features)
    if not bad:
        return df.sparkSession.createDataFrame([], "name string, n_known long")
    return df.agg(*[F.count(c).alias(c) for c in bad]).unpivot([], bad, "name", "n_known")


def calendar_overlap(df: DataFrame, base: str, least: float = 0.8) -> DataFrame:
    """Share of dates each series has in common with the base series."""
    dates = df.select("ticker", "dt").distinct()
    own = dates.filter(F.col("ticker") == base).select("dt", F.lit(1).alias("_in"))
    joined = by_date(dates, own, "dt")
    size = own.agg(F.count(F.lit(1)).alias("_base"))
    counts = joined.groupBy("ticker").agg(F.count("_in").alias("common"), F.count(F.lit(1)).alias("n_dates"))
    out = with_totals(counts, size)
    out = out.withColumn("overlap", F.col("common") / F.greatest("n_dates", "_base")).drop("_base")
    return out.withColumn("aligned", (F.col("overlap") >= least).cast("int"))


def lookahead_probe(
    build: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: str, columns: list[str], digits: int = 9
) -> DataFrame:
    """Rows before ``cut`` whose features change when closes from ``cut`` on are doubled.

    Empty when no feature reads the future.
    """
    at = F.lit(cut).cast("date")
    bent = bars.withColumn("close", F.when(F.col("dt") >= at, F.col("close") * 2.0).otherwise(F.col("close")))

    def before(df: DataFrame) -> DataFrame:
        rows = build(df).filter(F.col("dt") < at)
        return rows.select("ticker", "dt", *[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])

    return before(bars).exceptAll(before(bent))


def return_invariants(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Violations: cost without a change, positions beyond 1, weights of a date above 1; one row for each ``by``."""
    df = df.withColumn("_one", F.lit(1))
    bars = df.groupBy(*by, "_one").agg(
        F.count(F.when((F.col("exec_cost") != 0) & ~F.col("traded"), 1)).alias("cost_without_change"),
        F.count(F.when(F.abs("position") > 1.0 + 1e-9, 1)).alias("position_beyond_one"),
    )
    sums = df.groupBy(*by, "_one", "dt").agg(F.sum(F.abs("position")).alias("_w"))
    dates = sums.groupBy(*by, "_one").agg(F.count(F.when(F.col("_w") > 1.0 + 1e-9, 1)).alias("weights_above_one"))
    return bars.join(dates, [*by, "_one"]).drop("_one")
