"""The second model that gates a primary one, fitted for all expanding folds in shared jobs.

All folds train from the same first date on, and the inputs look back only, so they are computed once.  A row
enters training on the date from which a fold can know it: its outcome has come, and its series has enough rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import with_totals
from tidepanel.functions.series import DAILY, Series, windowed
from tidepanel.functions.tables import materialise
from tidepanel.operators.assemble import impute_terminal
from tidepanel.operators.fitting import in_folds, scalers, set_sizes, training_sets
from tidepanel.operators.logistic import fit_logistic, score_logistic
from tidepanel.operators.meta import META_FEATURES, NO_SCORE, meta_features, meta_target, scored_rows
from tidepanel.operators.splits import expanding_walk_forward

#: A fold needs this many training rows; a series this many scored rows and this many with an outcome.
LEAST_ROWS, LEAST_SCORED, LEAST_KNOWN = 50, 10, 5


@windowed(0, 1)
def _due(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """The date on which the outcome of a row's call is known."""
    return df.withColumn("_due", F.lead(s.order, 1).over(s.window()))


def _nth(df: DataFrame, n: int, column: str, out: str, s: Series) -> DataFrame:
    """``column`` of the n-th row of every series that has so many."""
    rows = s.numbered(df) if s.block_rows(df) else df.withColumn("_rn", F.row_number().over(s.window()) - 1)
    return rows.filter(F.col("_rn") == n - 1).select(*s.keys, F.col(column).alias(out))


def _inputs(df: DataFrame, y, s: Series) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in META_FEATURES])
    return df.select(*s.keys, s.order, F.lit(True).alias("bull"), y.alias("y"), x.alias("x"))


def gate_rows(base: DataFrame, assigned: DataFrame, model: str, s: Series = DAILY) -> DataFrame:
    """Training rows: keys, bull (always true), y, x and, as ``order``, the date from which folds can use them.

    Only rows that the model scored inside the training range count, also as history of the inputs.
    """
    first = assigned.filter("role = 'train'").agg(F.min(s.order).alias("_first"))
    known = with_totals(scored_rows(base, model), first).filter(F.col(s.order) >= F.col("_first")).drop("_first")
    rows = materialise(_due(meta_target(meta_features(known, model, s=s), model, s=s), s=s), "gate-known")
    usable = rows.dropna(subset=[*META_FEATURES, "meta_target"])
    out = usable.join(_nth(rows, LEAST_SCORED, s.order, "_tenth", s), list(s.keys)).join(_nth(usable, LEAST_KNOWN, "_due", "_fifth", s), list(s.keys))
    out = out.withColumn(s.order, F.greatest("_due", "_tenth", "_fifth"))
    return materialise(_inputs(out, F.col("meta_target").cast("double"), s), "gate-rows")


def fit_gate(
    base: DataFrame, assigned: DataFrame, model: str = "Ensemble", min_rows: int = LEAST_ROWS, s: Series = DAILY
) -> tuple[DataFrame, DataFrame]:
    """Training sets and coefficients of all folds of ``assigned`` (order, fold, role), whose training starts on one date."""
    rows = gate_rows(base, assigned, model, s)
    sizes = set_sizes(rows, assigned, s).filter(F.col("n") >= min_rows)
    sets = training_sets(rows, assigned, sizes, s)
    return sets, fit_logistic(sets, sizes, scalers(rows, assigned, s))


def gate_walk_forward(
    df: DataFrame,
    model: str = "Ensemble",
    train: int = 252,
    warmup: int = 20,
    test: int = 20,
    min_rows: int = LEAST_ROWS,
    gap_rows: int = 0,
    s: Series = DAILY,
) -> DataFrame:
    """``df`` with ``meta_pred`` and ``meta_proba`` from expanding folds.

    Rows of a fold that cannot be fitted, and rows never tested, trust every call (1 and one half).
    """
    base = materialise(df, "gate-input")
    assigned = materialise(expanding_walk_forward(base, train, warmup, test, gap_rows, s), "gate-folds")
    _, coefficients = fit_gate(base, assigned, model, min_rows, s)
    history = _inputs(impute_terminal(meta_features(base, model, s=s), list(META_FEATURES), s), F.lit(None).cast("double"), s)
    scored = score_logistic(in_folds(history, assigned, "test", s), coefficients, "gate")
    gate = scored.select(*s.keys, s.order, F.col("pred_gate").alias("meta_pred"), F.col("proba_gate").alias("meta_proba"))
    joined = base.drop("meta_pred", "meta_proba").join(gate, [*s.keys, s.order], "left")
    return joined.withColumns({"meta_pred": F.coalesce("meta_pred", F.lit(1.0)), "meta_proba": F.coalesce("meta_proba", F.lit(NO_SCORE))})
