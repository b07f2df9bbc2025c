"""Logistic regressions of all folds and sides at once, by Newton steps.

Every step is one job: tasks add up loss, gradient and Gram matrix of the sets they hold, the
sums of a set are put together and its k x k system is solved.  Sets that have converged drop out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.operators.fitting import SET

PENALTY, STEPS, TOLERANCE = 1.0, 60, 1e-8
COEFFICIENTS = "fold int, bull boolean, n long, n_pos long, intercept double, coef array<double>, mean array<double>, dev array<double>"


@dataclass
class Fit:
    """One set on its way: accepted weights (intercept last), its loss, the step from there and how much of it is tried."""

    weights: np.ndarray
    tried: np.ndarray
    loss: float = np.inf
    step: np.ndarray | None = None
    share: float = 1.0
    done: bool = False

    def advance(self, loss: float, gradient: float, step: np.ndarray, n: int) -> None:
        """Take the tried weights if the loss did not rise, else try half the step."""
        if not loss <= self.loss + 1e-12 * abs(loss) and self.share > 1e-9:
            self.share /= 2
        else:
            self.weights, self.loss, self.step, self.share = self.tried, loss, step, 1.0
            self.done = gradient < TOLERANCE * max(1.0, n * 1e-5)
        self.tried = self.weights - self.share * self.step


def _sums(sent, scale):
    """Loss, gradient and Gram matrix per set at the weights tried."""

    def run(batches):
        weights, scalers = sent.value, scale.value
        total: dict[int, list] = {}
        for batch in batches:
            fold, bull, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "bull", "y"))
            key = fold.astype(np.int64) * 2 + bull.astype(np.int64)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for k in np.unique(key):
                w = weights.get(int(k))
                if w is None:
                    continue
                own = key == k
                mean, dev = scalers[int(k) // 2]
                z, t = np.column_stack([(x[own] - mean) / dev, np.ones(own.sum())]), y[own]
                m = z @ w
                p = 1.0 / (1.0 + np.exp(-m))
                loss = float((np.logaddexp(0.0, m) - t * m).sum())
                parts = [loss, z.T @ (p - t), (z * (p * (1.0 - p))[:, None]).T @ z]
                if k in total:
                    total[k] = [a + b for a, b in zip(total[k], parts)]
                else:
                    total[k] = parts
        for k, (loss, gradient, gram) in total.items():
            yield pa.RecordBatch.from_pydict({"key": [int(k)], "loss": [loss], "gradient": [gradient.tobytes()], "gram": [gram.tobytes()]})

    return run


def _solve(sent, penalty: float):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        w = sent.value[key]
        k = len(w)
        ridge = np.append(np.full(k - 1, penalty), 0.0)
        loss = sum(table.column("loss").to_pylist()) + 0.5 * float((ridge * w * w).sum())
        gradient = sum(np.frombuffer(g, np.float64) for g in table.column("gradient").to_pylist()) + ridge * w
        gram = sum(np.frombuffer(g, np.float64).reshape(k, k) for g in table.column("gram").to_pylist()) + np.diag(ridge)
        # the last entry keeps the intercept's row solvable when all probabilities are 0 or 1
        gram[-1, -1] += 1e-12
        step = np.linalg.solve(gram, gradient)
        return pa.table({"key": [key], "loss": [loss], "largest": [float(np.abs(gradient).max())], "step": [step.tolist()]})

    return run


def fit_logistic(sets: DataFrame, sizes: DataFrame, scaler: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Coefficients of every set (fold, bull) of ``sets`` (fold, bull, y, x); see ``fitting`` for the tables.

    Minimises the summed loss plus half the squared weights times ``penalty`` on features scaled per
    fold; the intercept is free.  What the driver holds is a vector per set, whose number is bounded by the calendar.
    """
    spark = sets.sparkSession
    found = {r["fold"] * 2 + int(r["bull"]): r for r in sizes.collect()}
    if not found:
        return spark.createDataFrame([], COEFFICIENTS)
    wide = len(scaler.first()["mean"]) + 1
    scale = spark.sparkContext.broadcast({r["fold"]: (np.array(r["mean"]), np.array(r["dev"])) for r in scaler.collect()})
    fits = {k: Fit(np.zeros(wide), np.zeros(wide)) for k in found}
    for _ in range(STEPS):
        open_ = {k: f.tried for k, f in fits.items() if not f.done}
        if not open_:
            break
        sent = spark.sparkContext.broadcast(open_)
        sums = sets.select(*SET, "y", "x").mapInArrow(_sums(sent, scale), "key long, loss double, gradient binary, gram binary")
        for r in sums.groupBy("key").applyInArrow(_solve(sent, penalty), "key long, loss double, largest double, step array<double>").collect():
            fits[r["key"]].advance(r["loss"], r["largest"], np.array(r["step"]), found[r["key"]]["n"])
        sent.unpersist()
    rows = [(k // 2, bool(k % 2), found[k]["n"], found[k]["n_pos"], float(f.weights[-1]), f.weights[:-1].tolist()) for k, f in fits.items()]
    out = spark.createDataFrame(rows, "fold int, bull boolean, n long, n_pos long, intercept double, coef array<double>")
    return materialise(out.join(F.broadcast(scaler), "fold").select(*[c.split()[0] for c in COEFFICIENTS.split(", ")]), "coefficients")


def _standardised(rows: DataFrame) -> DataFrame:
    """Add ``z``, the scaled features, and ``m``, the raw score, to rows joined with their coefficients."""
    z = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "dev", lambda a, b: a / b)
    product = F.zip_with("z", "coef", lambda a, b: a * b)
    return rows.withColumn("z", z).withColumn("m", F.aggregate(product, F.col("intercept"), lambda acc, v: acc + v))


def score_logistic(rows: DataFrame, coefficients: DataFrame, name: str) -> DataFrame:
    """Add pred_ and proba_ to the rows (fold, bull, x) whose set was fitted; coefficients are a row per set."""
    out = rows.join(F.broadcast(coefficients.drop("n", "n_pos")), list(SET))
    out = _standardised(out).withColumn(f"proba_{name}", 1.0 / (1.0 + F.exp(-F.col("m"))))
    out = out.withColumn(f"pred_{name}", (F.col(f"proba_{name}") > 0.5).cast("double"))
    return out.drop("intercept", "coef", "mean", "dev", "z", "m")


def optimality(sets: DataFrame, coefficients: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """fold, bull, n, n_pos and the largest entry of the penalised gradient, recomputed from the coefficients alone."""
    joined = _standardised(sets.join(F.broadcast(coefficients), list(SET)))
    joined = joined.select(*SET, "z", (1.0 / (1.0 + F.exp(-F.col("m"))) - F.col("y")).alias("error"))
    slope = Summarizer.metrics("sum").summary(array_to_vector(F.array_append(F.transform("z", lambda v: v * F.col("error")), F.col("error"))))
    slopes = joined.groupBy(*SET).agg(vector_to_array(slope["sum"]).alias("slope"))
    slopes = slopes.join(F.broadcast(coefficients.select(*SET, "n", "n_pos", "coef")), list(SET))
    whole = F.zip_with("slope", F.array_append("coef", F.lit(0.0)), lambda g, w: F.abs(g + penalty * w))
    return slopes.select(*SET, "n", "n_pos", F.array_max(whole).alias("largest"))
