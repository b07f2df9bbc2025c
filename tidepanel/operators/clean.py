"""Cleaning and validation of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, EPS, Series, rolling, running, windowed
from tidepanel.sources.bars import BAR_COLUMNS, PRICE_COLUMNS


def missing_share(df: DataFrame, columns: tuple[str, ...] = BAR_COLUMNS, s: Series = DAILY) -> DataFrame:
    """Worst null share over the columns, per series."""
    shares = [F.avg(F.col(c).isNull().cast("int")) for c in columns]
    return df.groupBy(*s.keys).agg(F.greatest(*shares).alias("missing_share"))


def missing_filter(
    df: DataFrame, max_share: float = 0.05, columns: tuple[str, ...] = BAR_COLUMNS, s: Series = DAILY
) -> DataFrame:
    """Drop series whose worst column misses more than ``max_share``."""
    keep = missing_share(df, columns, s).filter(F.col("missing_share") <= max_share)
    return df.join(keep, list(s.keys), "left_semi")


def fill_forward(df: DataFrame, columns: tuple[str, ...] = BAR_COLUMNS, s: Series = DAILY) -> DataFrame:
    """Carry the last known value; never from the future."""
    filled = running(df, s, {f"_f_{c}": ("last", F.col(c)) for c in columns})
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_interpolate(df: DataFrame, columns: tuple[str, ...] = BAR_COLUMNS, s: Series = DAILY) -> DataFrame:
    """Linear in time between known neighbours; the end holds the last value, the start stays NULL.

    It reads the next known value, so it is for research data, not for live features.
    """
    time = F.unix_seconds(F.col(s.order).cast("timestamp"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), time.alias("t"))) for c in columns}
    both = running(df, s, {f"_p_{c}": ("last", known[c]) for c in columns})
    both = running(both, s, {f"_q_{c}": ("last", known[c]) for c in columns}, reverse=True)

    def value(c: str):
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        share = (time - p["t"]) / (q["t"] - p["t"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(
            p.isNotNull() & q.isNotNull(), p["v"] + share * (q["v"] - p["v"])
        ).otherwise(p["v"])

    return both.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def clamp_high(df: DataFrame) -> DataFrame:
    return df.withColumn("high", F.when(F.col("high") < F.col("low"), F.col("low")).otherwise(F.col("high")))


def drop_negative_prices(df: DataFrame) -> DataFrame:
    negative = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in PRICE_COLUMNS]
    return df.filter(~(negative[0] | negative[1] | negative[2] | negative[3]))


def zero_negative_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))


def validate(df: DataFrame) -> DataFrame:
    return df.transform(clamp_high).transform(drop_negative_prices).transform(zero_negative_volume)


@windowed(lambda p: p["window"])
def flag_outliers(
    df: DataFrame, window: int = 60, threshold: float = 5.0, least: int = 10, s: Series = DAILY
) -> DataFrame:
    """Mark closes far from their rolling mean (the window holds the row itself); none is removed."""
    out = rolling(df, s, {"_m": ("mean", "close", window, least), "_s": ("std", "close", window, least)})
    z = (F.col("close") - F.col("_m")) / (F.col("_s") + EPS)
    return out.withColumn("is_outlier", F.coalesce(F.abs(z) > threshold, F.lit(False))).drop("_m", "_s")


def clean(
    df: DataFrame,
    max_share: float = 0.05,
    fill: str = "ffill",
    window: int = 60,
    threshold: float = 5.0,
    s: Series = DAILY,
) -> DataFrame:
    """Missing filter, filling, validation and outlier flags for the whole universe at once."""
    fill_fn = fill_interpolate if fill == "interpolate" else fill_forward
    kept = missing_filter(df, max_share, s=s)
    return flag_outliers(validate(fill_fn(kept, s=s)), window, threshold, s=s)
