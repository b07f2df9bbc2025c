"""Input views derived from the given tables, in SQL that Spark and DuckDB both run.

The tables hold no prices.  A price path is built per key from one order per day: the exponential
of the running sum of a centred, bounded daily return.  Rounding keeps the engines equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.series import Series

BARS_SQL = """
select ticker, dt, open,
       round(greatest(open, close) * (1 + abs(ret) / 2), 4) as high,
       round(least(open, close) * (1 - abs(ret) / 2), 4) as low,
       close, round(notional / 100.0, 0) as volume
from (
  select *, coalesce(lag(close) over (partition by ticker order by dt), cast(100 as double)) as open
  from (
    select *, round(100.0 * exp(sum(ret) over (partition by ticker order by dt)), 4) as close
    from (
      select *, round(0.12 * (u - avg(u) over (partition by ticker)), 8) as ret
      from (
        select ticker, dt, notional, p / (p + 245000.0) as u
        from (
          select {key} as ticker, cast(o_orderdate as date) as dt,
                 min_by(o_totalprice, o_orderkey) as p, sum(o_totalprice) as notional
          from orders group by 1, 2) d) e) f) g) h
"""

KEYS = {
    "bars5": "o_orderpriority",
    "bars50": "o_orderpriority || '/' || cast(o_custkey % 10 as varchar(4))",
    "macro": "o_orderstatus",
    "market": "'MKT'",
}
LABELS = ["F", "O", "P"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, view: str = "bars5") -> DataFrame:
    sql = BARS_SQL.format(key=KEYS[view]).replace("from orders", "from {orders}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "macro").withColumnRenamed("ticker", "label")


DIRTY_SQL = """
select ticker, dt,
       case when rn % 401 = 0 then -open else open end as open,
       case when rn % 211 = 0 then low else high end as high,
       case when rn % 211 = 0 then high else low end as low,
       case when rn % 37 = 0 then null else close end as close,
       case when ticker = '2-HIGH' and rn % 10 = 0 then null
            when rn % 307 = 0 then -volume else volume end as volume
from (select *, row_number() over (partition by ticker order by dt) as rn from {bars5}) b
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_SQL, bars5=bars(spark, sf_dir))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("name"), "ts", (F.col("value") + 1.0).alias("price"), F.lit(1.0).alias("qty"), "event_id"
    )


STRATEGY = Series(keys=("strategy", "ticker"))
PORTFOLIO = Series(keys=("strategy",))
