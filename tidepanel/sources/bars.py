"""Reading, deriving and writing bar and feature tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.tables import materialise

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("dt", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICE_COLUMNS = ("open", "high", "low", "close")
BAR_COLUMNS = (*PRICE_COLUMNS, "volume")


def null_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in floating columns: Spark sorts NaN above all numbers and aggregates keep it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_bars(
    spark: SparkSession,
    path: str,
    tickers: list[str] | None = None,
    schema: T.StructType | None = BAR_SCHEMA,
    missing: str = "error",
) -> DataFrame:
    """Scan a bar or feature table; the ticker filter prunes partitions.

    missing: "error" raises when a requested ticker has no rows, "skip" leaves it out.
    schema: None takes the schema of the files (feature tables).
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if tickers is not None:
        df = df.filter(F.col("ticker").isin(*tickers))
        if missing == "error":
            # at most one row per requested name
            found = {r[0] for r in df.select("ticker").distinct().collect()}
            absent = sorted(set(tickers) - found)
            if absent:
                raise FileNotFoundError(f"no bars for {absent} in {path}")
    return null_nan(df)


def normalise_bars(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Lower-case column names, upper-case symbols, drop series without all of OHLCV."""
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    df = df.withColumnsRenamed(names)
    absent = [c for c in BAR_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
    df = df.withColumn("ticker", F.upper(F.lit(ticker) if ticker else F.col("ticker")))
    filled = df.groupBy("ticker").agg(F.least(*[F.count(c) for c in BAR_COLUMNS]).alias("_least"))
    return df.join(filled.filter("_least > 0"), "ticker", "left_semi")


GRAIN_SECONDS = {"1h": 3600, "5m": 300}


def bars_from_events(
    df: DataFrame, key: Column, ts: str, price: Column, qty: Column, grain: str = "1d", tie: str | None = None
) -> DataFrame:
    """OHLCV bars from ticks or orders; one row per (ticker, dt), partially aggregated per task.

    grain: 1d, 1h or 5m.  tie orders events with equal time stamps.
    """
    if grain == "1d":
        dt = F.col(ts).cast("date")
    else:
        step = GRAIN_SECONDS[grain]
        seconds = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step) * step
        dt = F.timestamp_seconds(seconds).cast("timestamp_ntz")
    at = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    ticks = df.select(key.alias("ticker"), dt.alias("dt"), at.alias("at"), price.alias("p"), qty.alias("q"))
    return ticks.groupBy("ticker", "dt").agg(
        F.min_by("p", "at").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "at").alias("close"),
        F.sum("q").alias("volume"),
    )


def write_bars(df: DataFrame, path: str, mode: str = "overwrite", per_ticker: bool = True, days: int = 366) -> None:
    """Write bars or features as one table with a directory per ticker.

    Rows are placed by (ticker, span of days), so a very long series is written by many tasks.
    per_ticker=False keeps the files unpartitioned, for universes with too many names for
    directories; the sort then lets row-group statistics skip by ticker.
    """
    placed = df.repartition("ticker", F.floor(F.unix_date(F.col("dt").cast("date")) / days))
    writer = placed.sortWithinPartitions("ticker", "dt").write.mode(mode)
    (writer.partitionBy("ticker") if per_ticker else writer).parquet(path)


def feature_manifest(df: DataFrame, features: list[str], version: str, params: dict | None = None) -> DataFrame:
    """Metadata of a feature table: one row per ticker, with the feature list and parameters."""
    columns = len(df.columns)
    counts = df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("num_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )
    return counts.withColumns(
        {
            "version": F.lit(version),
            "num_columns": F.lit(columns),
            "feature_columns": F.lit(",".join(features)),
            "params": F.lit(json.dumps(params or {}, sort_keys=True)),
        }
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def dedup_dates(df: DataFrame, tie: str, keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """Keep the row with the lowest ``tie`` per key; merges inside tasks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def incremental_cut(df: DataFrame, existing: DataFrame, key: str = "label", end: str | None = None) -> DataFrame:
    """Rows of ``df`` that ``existing`` does not cover yet.

    A series whose stored data already reach ``end`` is left out as a whole.
    """
    seen = existing.groupBy(key).agg(F.max("dt").alias("_seen"))
    fresh = df.join(seen, key, "left").filter(F.col("_seen").isNull() | (F.col("dt") > F.col("_seen")))
    if end is not None:
        fresh = fresh.filter(F.col("_seen").isNull() | (F.col("_seen") < F.lit(end).cast("date")))
    return fresh.drop("_seen")


def discover_series(df: DataFrame) -> DataFrame:
    """Series present in a table."""
    return df.select("ticker").distinct()


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


#: Bits of the hash that one pass of ``sample_rows`` settles, and passes; the driver gets at most 2 to that power counts.
SAMPLE_BITS, SAMPLE_PASSES = 15, 4


def sample_order(seed: int, keys: tuple[str, ...]) -> Column:
    """Hexadecimal digest of a row's keys and the seed; its order is the order of sampling."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """The n rows that come first in an order fixed by the seed; all rows if there are fewer.

    The n-th digest is found by counts of ever finer ranges, then rows are filtered by it: nothing is sorted, and no
    task gets the sample.  Of rows with the same keys at the border any may stay.
    """
    digits = SAMPLE_BITS * SAMPLE_PASSES // 4
    place = F.conv(F.substring(sample_order(seed, keys), 1, digits), 16, 10).cast("long")
    rows = materialise(df.withColumn("_place", place), "sample")
    low, left = 0, n
    for shift in range(SAMPLE_BITS * (SAMPLE_PASSES - 1), -1, -SAMPLE_BITS):
        own = rows.filter((F.col("_place") >= low) & (F.col("_place") < low + (1 << (shift + SAMPLE_BITS))))
        counts = own.groupBy(F.shiftright(F.col("_place") - low, shift).alias("bin")).count().collect()
        for part, count in sorted((r["bin"], r["count"]) for r in counts):
            if count >= left:
                low += part << shift
                break
            left -= count
        else:
            return rows.drop("_place")
    ahead, border = rows.filter(F.col("_place") < low), rows.filter(F.col("_place") == low)
    return ahead.unionByName(border.limit(left)).drop("_place")
