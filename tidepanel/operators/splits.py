"""Time-ordered splits.

Folds are worked out on the distinct dates, then joined to rows by date, so no row is ever
compared with a fold boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.ranks import tie_order
from tidepanel.functions.series import DAILY, Series, running
from tidepanel.functions.tables import materialise


def date_index(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Distinct dates with their 0-based position and the number of dates: (dt, idx, n_dates)."""
    dates = df.select(s.order).distinct().withColumn("_all", F.lit(1))
    line = Series(keys=("_all",), order=s.order, block=s.block, slot=s.slot)
    if line.block_rows(dates):
        indexed = line.numbered(dates).withColumnRenamed("_rn", "idx")
    else:
        indexed = dates.withColumn("idx", F.row_number().over(line.window()) - 1)
    total = dates.agg(F.count(F.lit(1)).alias("n_dates"))
    return with_totals(indexed.drop("_all"), total)


def calendar_walk_forward(
    df: DataFrame,
    n_splits: int = 5,
    train_months: int = 12,
    test_months: int = 3,
    gap_days: int = 5,
    min_train: int = 200,
    order: str = "dt",
) -> DataFrame:
    """Folds counted back from the last date: one row per fold with its bounds and sizes.

    Bounds are inclusive, so neighbouring test windows share a boundary date.
    """
    dates = df.select(order).distinct()
    span = dates.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = with_totals(dates, span).withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = rows.withColumn("_te", F.add_months("_hi", -F.col("_back") * test_months))
    rows = rows.withColumn("_ts", F.add_months("_te", -test_months))
    rows = rows.withColumn("_re", F.date_sub("_ts", gap_days))
    rows = rows.withColumn("_rs", F.greatest(F.add_months("_re", -train_months), F.col("_lo").cast("date")))
    train = F.col(order).between(F.col("_rs"), F.col("_re"))
    test = F.col(order).between(F.col("_ts"), F.col("_te"))
    folds = rows.groupBy((F.lit(n_splits) - F.col("_back")).alias("fold")).agg(
        F.min(F.when(train, F.col(order))).alias("train_start"),
        F.max(F.when(train, F.col(order))).alias("train_end"),
        F.min(F.when(test, F.col(order))).alias("test_start"),
        F.max(F.when(test, F.col(order))).alias("test_end"),
        F.count(F.when(train, 1)).alias("train_size"),
        F.count(F.when(test, 1)).alias("test_size"),
    )
    return folds.filter((F.col("train_size") >= min_train) & (F.col("test_size") > 0))


def assign_folds(df: DataFrame, folds: DataFrame, order: str = "dt") -> DataFrame:
    """Rows of each fold with their role; a row appears once per fold and role it belongs to.

    Bounds become positions in the calendar, and a fold lists the positions between them, so that dates
    and folds meet by equal keys and are never compared.
    """
    pairs = [("train", "train_start", "train_end"), ("test", "test_start", "test_end")]
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(a).alias("_a"), F.col(b).alias("_b")) for r, a, b in pairs]))
    spans = materialise(folds.select("fold", roles.alias("r")).select("fold", "r.*"), "spans")
    # a bound need not be a date of df, so the calendar holds both
    bounds = spans.select(F.explode(F.array("_a", "_b")).alias(order)).dropna()
    calendar = materialise(date_index(df.select(order).unionByName(bounds), Series(order=order)).select(order, "idx"), "calendar")
    ends = [calendar.select(F.col(order).alias(c), F.col("idx").alias(i)) for c, i in (("_a", "_from"), ("_b", "_to"))]
    placed = spans.join(ends[0], "_a").join(ends[1], "_b").filter("_from <= _to")
    members = placed.select("fold", "role", F.explode(F.sequence("_from", "_to")).alias("idx")).join(calendar, "idx").drop("idx")
    return by_date(df, members.select(order, "fold", "role"), order, "inner")


def _expand(index: DataFrame, test_lo: Column, train_lo: Column, train_hi: Column, test: int, start: int, order: str):
    """(dt, fold, role) from fold numbers (from 0) as column arithmetic on ``idx``."""
    last = F.floor((F.col("n_dates") - 1 - start) / test)
    hi = F.least(train_hi, last)
    lo = F.greatest(F.lit(0), train_lo)
    tests = index.filter(F.col("idx") >= start).select(order, (test_lo + 1).alias("fold"), F.lit("test").alias("role"))
    trains = (
        index.withColumns({"_lo": lo, "_hi": hi})
        .filter(F.col("_lo") <= F.col("_hi"))
        .select(order, F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi") + 1)).alias("fold"), F.lit("train").alias("role"))
    )
    return tests.unionByName(trains)


def index_walk_forward(
    df: DataFrame, train: int = 252, test: int = 20, gap_rows: int = 0, s: Series = DAILY
) -> DataFrame:
    """Rolling folds over distinct dates: (dt, fold, role).  The last test window may be short.

    gap_rows leaves out the last dates before the test window; a label that looks h dates ahead
    asks for gap_rows=h.
    """
    idx = F.col("idx")
    return _expand(
        date_index(df, s),
        F.floor((idx - train) / test),
        F.floor((idx + gap_rows - train) / test) + 1,
        F.floor(idx / test),
        test,
        train,
        s.order,
    )


def expanding_walk_forward(
    df: DataFrame, train: int = 252, warmup: int = 20, test: int = 20, gap_rows: int = 0, s: Series = DAILY
) -> DataFrame:
    """Folds that start at ``train + warmup`` and train on everything from row ``train`` on."""
    idx, start = F.col("idx"), train + warmup
    index = date_index(df, s)
    after = F.floor((idx + gap_rows - start) / test) + 1
    return _expand(
        index,
        F.floor((idx - start) / test),
        F.when(idx >= train, after).otherwise(F.lit(2**40)),
        F.lit(2**40),
        test,
        start,
        s.order,
    )


def fold_table(assigned: DataFrame, order: str = "dt") -> DataFrame:
    """Bounds and number of dates per fold of a (dt, fold, role) table."""
    train, test = (F.when(F.col("role") == r, F.col(order)) for r in ("train", "test"))
    return assigned.groupBy("fold").agg(
        F.min(train).alias("train_start"),
        F.max(train).alias("train_end"),
        F.min(test).alias("test_start"),
        F.max(test).alias("test_end"),
        F.count(train).alias("train_size"),
        F.count(test).alias("test_size"),
    )


def global_index(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Add ``_gi``, the position in (date, name) order, and ``_n``, the number of rows.

    Dates get offsets from their counts; inside a date rows are numbered by name.
    """
    counts = df.groupBy(s.order).agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit(1))
    line = Series(keys=("_all",), order=s.order, block=s.block, slot=s.slot)
    offsets = running(counts, line, {"_upto": ("sum", F.col("_c"))})
    offsets = offsets.select(s.order, (F.col("_upto") - F.col("_c")).cast("long").alias("_before"))
    rows = by_date(tie_order(df, [s.order], s.keys[0], "_in"), offsets, s.order)
    rows = rows.withColumn("_gi", F.col("_before") + F.col("_in")).drop("_before", "_in")
    return with_totals(rows, counts.agg(F.sum("_c").alias("_n")))


def time_series_cv(df: DataFrame, k: int = 3, s: Series = DAILY) -> DataFrame:
    """Add ``cv_fold``: the fold (1..k) that tests a row; 0 rows are only trained on.

    Fold j trains on the rows with ``cv_fold < j``.
    """
    rows = global_index(df, s)
    size = F.floor(F.col("_n") / (k + 1))
    past = F.col("_gi") - (F.col("_n") - size * k)
    fold = F.when(past >= 0, F.floor(past / size) + 1).otherwise(0)
    return rows.withColumn("cv_fold", fold.cast("int")).drop("_gi", "_n")


def chronological_thirds(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Add ``period``: Early, Mid or Late by row position (the remainder goes to Late)."""
    rows = global_index(df, s)
    third = F.floor(F.col("_n") / 3)
    period = F.when(F.col("_gi") < third, "Early").when(F.col("_gi") < third * 2, "Mid").otherwise("Late")
    return rows.withColumn("period", period).drop("_gi", "_n")


def fraction_split(df: DataFrame, fraction: float = 0.8, s: Series = DAILY) -> DataFrame:
    """Add ``part``: train for the first share of the rows in time order, else test."""
    rows = global_index(df, s)
    cut = F.floor(F.col("_n") * F.lit(fraction))
    return rows.withColumn("part", F.when(F.col("_gi") < cut, "train").otherwise("test")).drop("_gi", "_n")
