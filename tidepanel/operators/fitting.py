"""Training sets of all folds and sides of the trend in one table.

A set is named by ``fold`` and ``bull``.  Its rows carry the label ``y`` and the features as the array ``x``.
Folds overlap, so a row stands in every fold whose training window holds its date; what a model needs per
set (counts, means, gradients) is an aggregate, and all sets are fitted by the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date
from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.assemble import impute_terminal
from tidepanel.operators.meta import NO_SCORE

LABEL = "target_direction"
SET = ("fold", "bull")
#: Sets need more rows than this, and both classes.
LEAST_ROWS = 10
#: Rows of a set that go to one task.
SALT_ROWS = 100_000


def feature_rows(df: DataFrame, features: Sequence[str], s: Series = DAILY) -> DataFrame:
    """Keys, order, bull, y, x of every row, written; unknown features are filled forward within the series, then with 0."""
    filled = impute_terminal(df, list(features), s)
    bull = F.coalesce(F.col("regime_trend_bullish") == 1, F.lit(False))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return materialise(filled.select(*s.keys, s.order, bull.alias("bull"), F.col(LABEL).cast("double").alias("y"), x.alias("x")), "rows")


def in_folds(rows: DataFrame, assigned: DataFrame, role: str, s: Series = DAILY) -> DataFrame:
    """``rows`` once per fold that has their date in ``role``; ``assigned`` is (order, fold, role)."""
    own = assigned.filter(F.col("role") == role).select(s.order, F.col("fold").cast("int").alias("fold"))
    return by_date(rows, own, s.order, "inner")


def set_sizes(rows: DataFrame, assigned: DataFrame, s: Series = DAILY) -> DataFrame:
    """One row per usable set: fold, bull, n, n_pos; from counts per date, so no row is repeated for it."""
    counts = rows.filter("y is not null").groupBy(s.order, "bull").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"))
    sizes = in_folds(counts, assigned, "train", s).groupBy(*SET).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
    sizes = sizes.filter((F.col("n") > LEAST_ROWS) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")))
    return materialise(sizes, "sizes")


def training_sets(rows: DataFrame, assigned: DataFrame, sizes: DataFrame, s: Series = DAILY) -> DataFrame:
    """fold, bull, row (a hash of the row's keys), y, x of the usable sets, written so that a file holds few sets.

    A set is dealt to as many tasks as its size asks for; ``sizes`` has a row per set and is broadcast.
    """
    sets = in_folds(rows.filter("y is not null"), assigned, "train", s)
    row = F.xxhash64(*s.keys, s.order)
    sets = sets.join(F.broadcast(sizes.select(*SET, "n")), list(SET)).withColumn("row", row)
    salt = F.pmod("row", F.ceil(F.col("n") / SALT_ROWS))
    return materialise(sets.withColumn("_salt", salt).repartition(*SET, "_salt").select(*SET, "row", "y", "x"), "sets")


def scalers(rows: DataFrame, assigned: DataFrame, s: Series = DAILY) -> DataFrame:
    """fold, mean, dev (population) of the features over the labelled training rows of both sides; a constant feature has deviation 1.

    Rows are summed up per date first: folds repeat dates, not rows.  A fold's squares are those within its dates
    and those between their means.
    """
    dates = rows.filter("y is not null").groupBy(s.order).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("m"))
    size = F.col("m.count").cast("double")
    within = array_to_vector(F.transform(vector_to_array("m.variance"), lambda v: v * (size - 1)))
    dates = dates.select(s.order, F.col("m.mean").alias("mean"), within.alias("within"), size.alias("size"))
    stats = in_folds(dates, assigned, "train", s).groupBy("fold").agg(
        Summarizer.metrics("mean", "variance").summary(F.col("mean"), F.col("size")).alias("m"),
        Summarizer.metrics("sum").summary(F.col("within")).alias("w"),
        F.sum("size").alias("n"),
        F.sum(F.col("size") * F.col("size")).alias("n2"),
    )
    # the weighted variance comes per (n - n2 / n)
    between = F.col("n") - F.col("n2") / F.col("n")
    parts = F.arrays_zip(vector_to_array("m.variance").alias("v"), vector_to_array("w.sum").alias("w"), vector_to_array("m.mean").alias("c"))
    # rounding of a constant is far below its size
    dev = F.transform(
        F.transform(parts, lambda z: F.struct(F.sqrt((z["v"] * between + z["w"]) / F.col("n")).alias("d"), F.abs(z["c"]).alias("c"))),
        lambda z: F.when(z["d"] > F.greatest(F.lit(1e-12), z["c"] * 1e-12), z["d"]).otherwise(1.0),
    )
    return materialise(stats.select("fold", vector_to_array("m.mean").alias("mean"), dev.alias("dev")), "scalers")


def with_scores(base: DataFrame, scores: DataFrame, names: Sequence[str], s: Series = DAILY) -> DataFrame:
    """``base`` with pred_ and proba_ columns of every name; rows never scored get 0 and one half."""
    columns = [f"{k}_{n}" for n in names for k in ("pred", "proba")]
    out = base.drop(*columns).join(scores.select(*s.keys, s.order, *columns), [*s.keys, s.order], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if c.startswith("pred") else NO_SCORE)) for c in columns})
