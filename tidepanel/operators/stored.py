"""Fitted models as tables: saved, listed, loaded and scored by joins.

A folder holds the features in order, the bounds of the folds, the coefficients and the trees, one row per
(model, fold, side).  A row of data is scored by the fold that was the latest at its date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.series import DAILY, Series
from tidepanel.operators.boosting import score_boosting
from tidepanel.operators.fitting import SET
from tidepanel.operators.logistic import score_logistic


def save(path: str, features: Sequence[str], spans: DataFrame, coefficients: DataFrame | None = None, trees: DataFrame | None = None) -> None:
    """Write models of all folds; saving again replaces those of the folds at hand and keeps the others."""
    spark = spans.sparkSession
    spark.createDataFrame(list(enumerate(features)), "i int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    parts = {"folds": spans.withColumn("part", F.col("fold"))}
    if coefficients is not None:
        parts["coefficients"] = coefficients.withColumn("model", F.lit("Logistic")).withColumn("part", F.col("fold"))
    if trees is not None:
        parts["trees"] = trees.withColumn("part", F.col("fold"))
    for name, table in parts.items():
        # a folder per fold, each replaced as a whole
        table.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("part")


def features_of(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in _read(spark, path, "features").orderBy("i").collect()]


def _kinds(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = {}
    for name in ("coefficients", "trees"):
        try:
            found[name] = _read(spark, path, name)
        except Exception as e:  # noqa: BLE001 - only a missing folder means that there are none
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """model, fold, bull, n, n_pos and the fold's bounds of every stored model."""
    parts = [t.select("model", *SET, "n", "n_pos") for t in _kinds(spark, path).values()]
    if not parts:
        raise FileNotFoundError(f"no models in {path}")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.join(F.broadcast(_read(spark, path, "folds")), "fold")


def latest_models(spark: SparkSession, path: str) -> DataFrame:
    """The models of each one's highest fold number (as numbers: fold 10 is later than fold 9)."""
    listed = list_models(spark, path)
    last = listed.groupBy("model", "bull").agg(F.max("fold").alias("fold"))
    return listed.join(F.broadcast(last), ["model", "bull", "fold"], "left_semi")


def load(spark: SparkSession, path: str, model: str, fold: int | None = None) -> DataFrame:
    """The stored rows of a model: of one fold, or of all."""
    for table in _kinds(spark, path).values():
        own = table.filter(F.col("model") == model)
        own = own if fold is None else own.filter(F.col("fold") == fold)
        if own.limit(1).count():
            return own
    raise FileNotFoundError(f"no model {model}, fold {fold}, in {path}")


def fold_at(rows: DataFrame, spans: DataFrame, s: Series = DAILY) -> DataFrame:
    """Add ``fold``: the last one whose test window had begun by the row's date; rows before all of them are left out."""
    starts = spans.agg(F.array_sort(F.collect_list(F.struct("test_start", "fold"))).alias("_starts"))
    dates = with_totals(rows.select(s.order).distinct(), starts)
    begun = F.filter("_starts", lambda x: x["test_start"] <= F.col(s.order))
    dates = dates.select(s.order, F.get(begun, F.size(begun) - 1)["fold"].alias("fold"))
    return by_date(rows, dates.filter("fold is not null"), s.order, "inner")


def score_stored(rows: DataFrame, path: str, model: str, s: Series = DAILY) -> DataFrame:
    """Add pred_ and proba_ of a stored model to ``rows`` (keys, order, bull, x in the stored order of features)."""
    spark = rows.sparkSession
    dated = fold_at(rows, _read(spark, path, "folds"), s)
    own = load(spark, path, model)
    if "trees" in own.columns:
        return score_boosting(dated, own, model)
    return score_logistic(dated, own.drop("model"), model)
