"""Robustness by refitting: every variant is a training set of its own, and all sets are fitted by the same jobs.

A variant is numbered by ``fold`` (with ``bull`` always true), so that boosted trees treat variants as they treat folds.
A variant whose training rows lack a class has no model and no row in the result.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import with_totals
from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.boosting import BOOST_A, Boost, bin_edges, fit_boosting, gains, score_boosting
from tidepanel.operators.fitting import LABEL, SET, feature_rows
from tidepanel.operators.meta import classification_report
from tidepanel.operators.models import SEED, permuted_partner
from tidepanel.operators.robust import shuffle_verdict
from tidepanel.operators.splits import global_index

PERIODS = ("Early", "Mid", "Late")
SUBSETS = ("Full Features", "Top 50% Features", "Random 50% Features")


def _positions(df: DataFrame, features: Sequence[str], s: Series) -> DataFrame:
    """Labelled rows with ``_gi``, their position in time order, and ``_n``, their number."""
    return materialise(global_index(feature_rows(df, features, s).filter("y is not null").drop("bull"), s), "labelled")


def _variant(rows: DataFrame, number: Column, s: Series) -> DataFrame:
    return rows.select(number.cast("int").alias("fold"), F.lit(True).alias("bull"), F.xxhash64(*s.keys, s.order).alias("row"), "y", "x")


def _fit(train: DataFrame, learner: Boost, edges: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Training sizes and trees of the variants."""
    sets = materialise(train, "variants")
    sizes = sets.groupBy(*SET).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"))
    sizes = materialise(sizes.filter((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))), "variant-sizes")
    return sizes, fit_boosting(sets, sizes, {"m": learner}, edges)


def _reports(test: DataFrame, sizes: DataFrame, trees: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Report of every variant with its sizes, named by ``labels`` in the order of their numbers."""
    scored = materialise(score_boosting(test, trees, "m").withColumnRenamed("y", LABEL), "variant-scores")
    report = classification_report(scored, "m", ("fold",), scored_only=False).drop("model")
    report = report.withColumn("n_test", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    names = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("fold"))
    return report.join(F.broadcast(sizes.select("fold", "n", "n_pos")), "fold").withColumn("label", names).drop("fold")


def time_stability(df: DataFrame, features: Sequence[str], learner: Boost = BOOST_A, share: float = 0.7, s: Series = DAILY) -> DataFrame:
    """Metrics on the last 30 % of each third of the history, and whether the last third is clearly weaker: one row per third."""
    rows = _positions(df, features, s)
    third = F.floor(F.col("_n") / 3)
    period = F.least(F.floor(F.col("_gi") / F.greatest(third, F.lit(1))), F.lit(2))
    size = F.when(F.col("_period") == 2, F.col("_n") - 2 * third).otherwise(third)
    rows = rows.withColumn("_period", period).withColumn("_train", F.col("_gi") - F.col("_period") * third < F.floor(size * F.lit(share)))
    number = F.col("_period") + 1
    sizes, trees = _fit(_variant(rows.filter("_train"), number, s), learner, bin_edges(rows, len(features)))
    out = materialise(_reports(_variant(rows.filter("not _train"), number, s), sizes, trees, PERIODS), "periods")
    ends = [F.max(F.when(F.col("label") == p, F.col("accuracy"))).alias(f"_{p}") for p in ("Early", "Late")]
    weaker = out.agg(*ends).select((F.col("_Late") < F.col("_Early") - 0.03).cast("int").alias("degrades"))
    return with_totals(out, weaker)


def _held_out(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    first = F.col("_gi") < F.floor(F.col("_n") * F.lit(share))
    return rows.filter(first), rows.filter(~first)


def _masked(rows: DataFrame, features: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Features outside ``kept`` are 0 throughout, so that no tree can cut on them."""
    own = F.array(*[F.lit(c in set(kept)) for c in features])
    return rows.withColumn("x", F.zip_with("x", own, lambda v, k: F.when(k, v).otherwise(0.0)))


def feature_subset_stability(
    df: DataFrame, features: Sequence[str], learner: Boost = BOOST_A, share: float = 0.8, seed: int = SEED, s: Series = DAILY
) -> DataFrame:
    """Metrics with all features, the half with the larger gains and a random half, on the last fifth of the rows."""
    names = list(features)
    rows = _positions(df, names, s)
    train, test = _held_out(rows, share)
    edges, one = bin_edges(rows, len(names)), F.lit(1)
    sizes, trees = _fit(_variant(train, one, s), learner, edges)
    # a number per feature
    gain = {r["feature"]: r["gain"] for r in gains(trees, names).groupBy("feature").agg(F.sum("gain").alias("gain")).collect()}
    half = len(names) // 2
    halves = [sorted(names, key=lambda c: (-(gain.get(c) or 0.0), c))[:half], random.Random(seed).sample(names, half)]
    more = [_variant(_masked(train, names, h), F.lit(i + 2), s) for i, h in enumerate(halves)]
    other_sizes, other_trees = _fit(more[0].unionByName(more[1]), learner, edges)
    tested = _variant(test, one, s)
    for i in (2, 3):
        tested = tested.unionByName(_variant(test, F.lit(i), s))
    return _reports(tested, sizes.unionByName(other_sizes), trees.unionByName(other_trees), SUBSETS)


def label_shuffle_test(df: DataFrame, features: Sequence[str], learner: Boost = BOOST_A, share: float = 0.8, seed: int = SEED, s: Series = DAILY) -> DataFrame:
    """Accuracy with real and with permuted training labels, their sizes, and the leak verdict: one row."""
    rows = _positions(df, features, s)
    train, test = _held_out(rows, share)
    mixed = permuted_partner(train.drop("_gi", "_n"), "y", "_other", seed, s).withColumn("y", F.col("_other"))
    sets = _variant(train, F.lit(1), s).unionByName(_variant(mixed, F.lit(2), s))
    sizes, trees = _fit(sets, learner, bin_edges(rows, len(features)))
    tested = _variant(test, F.lit(1), s).unionByName(_variant(test, F.lit(2), s))
    out = _reports(tested, sizes, trees, ("real", "shuffled"))
    facts = ("accuracy", "n", "n_pos", "n_test")
    row = out.agg(*[F.max(F.when(F.col("label") == k, F.col(c))).alias(k if c == "accuracy" else f"{c}_{k}") for k in ("real", "shuffled") for c in facts])
    return row.withColumn("verdict", shuffle_verdict(F.col("real"), F.col("shuffled")))
