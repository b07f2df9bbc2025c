"""Tuning of boosted learners inside every fold, on its training window alone.

Every fold has a search of its own: after some random draws, a proposal is the candidate that is likeliest under the density of the
good trials compared with that of the others.  A job evaluates one proposal of all folds: expanding cross-validation
over the training dates of each.  What the driver holds is one number per fold, trial and part.
"""

from __future__ import annotations

import math
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date
from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.boosting import Boost, binned, fit_boosting, score_boosting
from tidepanel.operators.fitting import LEAST_ROWS, SET
from tidepanel.operators.meta import classification_report

# The ranges searched (the rate on a log scale)
SPACE = {"depth": (2, 8), "rate": (math.log(0.005), math.log(0.3)), "trees": (50, 500), "subsample": (0.5, 1.0)}
PARTS, STARTUP, CANDIDATES, GOOD, SEED = 3, 5, 24, 0.25, 42
TRIALS = "fold int, trial int, depth int, rate double, trees int, subsample double, auc double"


def _boost(unit: np.ndarray, base: Boost) -> Boost:
    """A point of the unit cube as parameters."""
    v = {k: lo + u * (hi - lo) for (k, (lo, hi)), u in zip(SPACE.items(), unit)}
    whole = {k: int(min(SPACE[k][1], SPACE[k][0] + math.floor(u * (SPACE[k][1] - SPACE[k][0] + 1)))) for k, u in zip(SPACE, unit) if k in ("depth", "trees")}
    return replace(base, depth=whole["depth"], trees=whole["trees"], rate=math.exp(v["rate"]), subsample=float(v["subsample"]))


class Search:
    """Trials of one fold in the unit cube."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        self.values: list[float] = []

    def propose(self) -> np.ndarray:
        if len(self.values) < STARTUP:
            return self.rng.random(len(SPACE))
        order = np.argsort(-np.array(self.values), kind="stable")
        cut = max(1, math.ceil(GOOD * len(order)))
        points = np.array(self.points)
        good, bad = points[order[:cut]], points[order[cut:]]
        width = max(0.1, len(points) ** -0.5)
        picks = good[self.rng.integers(0, len(good), CANDIDATES)] + self.rng.normal(0, width, (CANDIDATES, len(SPACE)))
        # reflected at the walls, so that no mass piles up there
        picks = np.abs(picks) % 2
        picks = np.where(picks > 1, 2 - picks, picks)
        return picks[np.argmax(self._density(picks, good, width) - self._density(picks, bad, width))]

    @staticmethod
    def _density(x: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
        kernel = np.exp(-0.5 * ((x[:, None, :] - at[None, :, :]) / width) ** 2) / width
        # a flat part keeps far points comparable
        return np.log((kernel.sum(axis=1) + 1.0) / (len(at) + 1.0)).sum(axis=1)

    def record(self, point: np.ndarray, value: float) -> None:
        self.points.append(point)
        self.values.append(value)


def parts_of(rows: DataFrame, assigned: DataFrame, parts: int = PARTS, s: Series = DAILY) -> DataFrame:
    """Labelled training rows of every fold with ``part`` (0 .. parts): equal runs of the fold's training dates, so no date is cut."""
    dates = assigned.filter("role = 'train'").select(s.order, F.col("fold").cast("int").alias("fold"))
    # a fold's dates are bounded by its window
    at = F.expr(f"row_number() over (partition by fold order by `{s.order}`) - 1")
    size = F.expr("count(*) over (partition by fold)")
    dates = dates.withColumn("part", F.floor(at * (parts + 1) / size).cast("int"))
    return by_date(rows.filter("y is not null"), dates, s.order, "inner")


def tune(rows: DataFrame, assigned: DataFrame, edges: np.ndarray, base: Boost, trials: int, parts: int = PARTS, seed: int = SEED, s: Series = DAILY) -> DataFrame:
    """Trials of all folds: fold, trial (from 1), the parameters drawn and the mean AUC over the parts, written.

    Part j is scored by a model of the parts before it; a part without two classes on both sides counts one half.
    """
    spark = rows.sparkSession
    cut = parts_of(rows, assigned, parts, s)
    # a fit of its own for every fold and part: named by fold * (parts + 1) + part
    name = lambda j: (F.col("fold") * (parts + 1) + j).cast("int").alias("fold")
    later = F.explode(F.sequence(F.col("part") + 1, F.lit(parts))).alias("j")
    train = cut.filter(F.col("part") < parts).select("*", later)
    train = train.select(name(F.col("j")), F.lit(False).alias("bull"), F.xxhash64(*s.keys, s.order).alias("row"), "y", "x")
    train = materialise(binned(train.repartition(*SET), edges), "parts")
    sizes = train.groupBy(*SET).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))
    sizes = materialise(sizes.filter((F.col("n") > LEAST_ROWS) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))), "sizes")
    valid = cut.filter("part > 0").select(*s.keys, s.order, name(F.col("part")), F.lit(False).alias("bull"), "y", "x")
    valid = materialise(valid, "valid")
    folds = [r["fold"] for r in assigned.select(F.col("fold").cast("int").alias("fold")).distinct().orderBy("fold").collect()]
    searches = {f: Search(seed * 1000 + f) for f in folds}
    found = []
    for trial in range(1, trials + 1):
        points = {f: q.propose() for f, q in searches.items()}
        drawn = {f: _boost(u, base) for f, u in points.items()}
        by_part = {f * (parts + 1) + j: p for f, p in drawn.items() for j in range(1, parts + 1)}
        trees = fit_boosting(train, sizes, {"T": by_part}, edges)
        scored = score_boosting(valid, trees, "T").withColumnRenamed("y", "target_direction")
        aucs = classification_report(scored, "T", ("fold",), scored_only=False).select("fold", "auc").collect()
        auc = {r["fold"]: r["auc"] for r in aucs}
        for f, p in drawn.items():
            value = sum(auc.get(f * (parts + 1) + j, 0.5) for j in range(1, parts + 1)) / parts
            searches[f].record(points[f], value)
            own = asdict(p)
            found.append((f, trial, own["depth"], own["rate"], own["trees"], own["subsample"], float(value)))
    return materialise(spark.createDataFrame(found, TRIALS), "trials")


def best_trials(trials: DataFrame) -> DataFrame:
    """The best trial per fold, the earlier one of equals."""
    return trials.groupBy("fold").agg(F.max_by(F.struct(*trials.columns[1:]), F.struct("auc", -F.col("trial"))).alias("b")).select("fold", "b.*")


def tuned(trials: DataFrame, base: Boost) -> dict[int, Boost]:
    """The learner of each fold; one row per fold."""
    return {r["fold"]: replace(base, depth=r["depth"], rate=r["rate"], trees=r["trees"], subsample=r["subsample"]) for r in best_trials(trials).collect()}
