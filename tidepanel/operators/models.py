"""Classifiers on feature tables: distributed fits of pyspark.ml, folds submitted side by side."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators.assemble import impute_terminal
from tidepanel.operators.meta import (
    META_FEATURES,
    NO_SCORE,
    apply_scaler,
    classification_report,
    ensemble_soft,
    fit_scaler,
    meta_features,
    meta_target,
    scored_rows,
)
from tidepanel.operators.robust import shuffle_verdict
from tidepanel.operators.splits import (
    chronological_thirds,
    expanding_walk_forward,
    fold_table,
    fraction_split,
    global_index,
    index_walk_forward,
    time_series_cv,
)

LABEL = "target_direction"
SEED = 42
MIN_REGIME_ROWS = 10
PARALLEL = 4

Learner = Callable[[int], Estimator]


def logistic_regression(n: int) -> Estimator:
    """L2 penalty of weight one against the summed loss, which is 1/n against the mean loss."""
    return LogisticRegression(
        featuresCol="x", labelCol=LABEL, maxIter=2000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False
    )


def random_forest(trees: int = 200, depth: int = 7, leaf: int = 5) -> Learner:
    return lambda n: RandomForestClassifier(
        featuresCol="x", labelCol=LABEL, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED
    )


def gradient_boosting(trees: int = 100, depth: int = 3, rate: float = 0.1, leaf: int = 1, subsample: float = 1.0) -> Learner:
    return lambda n: GBTClassifier(
        featuresCol="x", labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=rate,
        minInstancesPerNode=leaf, subsamplingRate=subsample, seed=SEED,
    )


# The two boosted models and the members of the ensemble
def default_learners() -> dict[str, Learner]:
    return {
        "Logistic": logistic_regression,
        "Forest": random_forest(),
        "BoostA": gradient_boosting(100, 3, 0.1),
        "BoostB": gradient_boosting(100, 5, 0.05, leaf=20),
    }


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``x``; unknown values are 0."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    return df.withColumn("x", array_to_vector(F.array(*cells)))


def fit(train: DataFrame, learner: Learner) -> Model | None:
    """A fitted model, or None when there are too few rows or one class only."""
    n, classes = train.agg(F.count(F.lit(1)), F.count_distinct(LABEL)).first()
    if n <= MIN_REGIME_ROWS or classes < 2:
        return None
    return learner(n).fit(train)


def score(df: DataFrame, model: Model | None, name: str) -> DataFrame:
    """Add ``pred_{name}`` and ``proba_{name}``; without a model 0 and one half."""
    if model is None:
        return df.withColumns({f"pred_{name}": F.lit(0.0), f"proba_{name}": F.lit(NO_SCORE)})
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    out = out.withColumns({f"proba_{name}": F.when(F.isnan(p), NO_SCORE).otherwise(p), f"pred_{name}": F.col("prediction")})
    return out.drop("rawPrediction", "probability", "prediction")


def regime_models(train: DataFrame, learners: dict[str, Learner]) -> dict[tuple[str, bool], Model | None]:
    """One model per learner and side of the trend; warm-up rows count as not bullish."""
    sides = {b: train.filter((F.col("regime_trend_bullish") == 1) == F.lit(b)) for b in (True, False)}
    return {(name, b): fit(sides[b], learner) for name, learner in learners.items() for b in sides}


def score_by_regime(df: DataFrame, models: dict[tuple[str, bool], Model | None]) -> DataFrame:
    """Route rows to the model of their side of the trend."""
    parts = []
    for b in (True, False):
        part = df.filter((F.col("regime_trend_bullish") == 1) == F.lit(b))
        for (name, side), model in models.items():
            if side == b:
                part = score(part, model, name)
        parts.append(part)
    return parts[0].unionByName(parts[1])


def _fold_rows(folds: DataFrame) -> list:
    """Fold bounds on the driver: one row per fold, so their number is bounded by the calendar."""
    return folds.orderBy("fold").collect()


def _between(df: DataFrame, a, b) -> DataFrame:
    return df.filter(F.col("dt").between(F.lit(a), F.lit(b)))


def walk_forward_predict(
    df: DataFrame,
    features: Sequence[str],
    learners: dict[str, Learner] | None = None,
    train: int = 252,
    test: int = 20,
    gap_rows: int = 0,
    parallel: int = PARALLEL,
    save_to: str | None = None,
    s: Series = DAILY,
) -> DataFrame:
    """Out-of-sample scores of regime models refitted per fold, and their soft ensemble.

    Each fold reads its own range of dates from one table (the filter reaches the files); fits of
    several folds run at once.  Rows never tested keep the default score.
    """
    learners = learners or default_learners()
    base = materialise(df, "model-input")
    inputs = materialise(impute_terminal(base, list(features), s), "model-features")
    folds = _fold_rows(fold_table(index_walk_forward(base, train, test, gap_rows, s)))
    names = list(learners)

    def one(fold) -> DataFrame | None:
        rows = _between(inputs, fold.train_start, fold.train_end).filter(F.col(LABEL).isNotNull())
        rows = rows.withColumn("fold", F.lit(fold.fold))
        scaler = materialise(fit_scaler(rows, list(features)), "scaler")
        fitted = vectors(apply_scaler(rows, scaler, list(features)), features).select("regime_trend_bullish", LABEL, "x")
        fitted = fitted.cache()
        models = regime_models(fitted, learners)
        fitted.unpersist()
        if all(m is None for m in models.values()):
            return None
        if save_to:
            save_models(base.sparkSession, save_to, fold.fold, models, features)
        target = _between(inputs, fold.test_start, fold.test_end)
        target = apply_scaler(target.withColumn("fold", F.lit(fold.fold)), scaler, list(features))
        keys = vectors(target, features).select(*s.keys, s.order, "regime_trend_bullish", "fold", "x")
        return materialise(score_by_regime(keys, models).drop("x", "regime_trend_bullish"), "scores")

    with ThreadPoolExecutor(parallel) as pool:
        parts = [p for p in pool.map(one, folds) if p is not None]
    out_columns = [f"{k}_{n}" for n in names for k in ("pred", "proba")]
    if not parts:
        blank = {c: F.lit(0.0 if c.startswith("pred") else NO_SCORE) for c in out_columns}
        return ensemble_soft(base.withColumns(blank), names)
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    scores = ensemble_soft(scores, names)
    columns = [*out_columns, "pred_Ensemble", "proba_Ensemble"]
    joined = base.drop(*columns).join(scores.select(*s.keys, s.order, *columns), [*s.keys, s.order], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if c.startswith("pred") else NO_SCORE)) for c in columns})


def meta_walk_forward(
    df: DataFrame,
    model: str = "Ensemble",
    train: int = 252,
    warmup: int = 20,
    test: int = 20,
    min_rows: int = 50,
    gap_rows: int = 0,
    parallel: int = PARALLEL,
    s: Series = DAILY,
) -> DataFrame:
    """Gate of a primary model: ``meta_pred`` and ``meta_proba`` from expanding folds.

    Training rolls over the scored rows of the training range only; test inputs use the history.
    A fold that cannot be fitted trusts every call (1 and one half).
    """
    base = materialise(df, "meta-input")
    folds = _fold_rows(fold_table(expanding_walk_forward(base, train, warmup, test, gap_rows, s)))
    names = list(META_FEATURES)
    history = materialise(impute_terminal(meta_features(base, model, s=s), names, s), "meta-history")

    def one(fold) -> DataFrame | None:
        rows = scored_rows(_between(base, fold.train_start, fold.train_end), model)
        enough = rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 10")
        rows = rows.join(enough, list(s.keys), "left_semi")
        rows = meta_target(meta_features(rows, model, s=s), model, s=s)
        rows = rows.dropna(subset=[*names, "meta_target"]).select(*s.keys, *names, F.col("meta_target").alias(LABEL))
        enough = rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 5")
        rows = materialise(rows.join(enough, list(s.keys), "left_semi").withColumn("fold", F.lit(fold.fold)), "meta-train")
        n, classes = rows.agg(F.count(F.lit(1)), F.count_distinct(LABEL)).first()
        if n < min_rows or classes < 2:
            return None
        scaler = materialise(fit_scaler(rows, names), "meta-scaler")
        fitted = logistic_regression(n).fit(vectors(apply_scaler(rows, scaler, names), names))
        target = _between(history, fold.test_start, fold.test_end)
        target = apply_scaler(target.withColumn("fold", F.lit(fold.fold)), scaler, names)
        scored = score(vectors(target, names).select(*s.keys, s.order, "x"), fitted, "gate")
        return scored.select(
            *s.keys, s.order, F.col("pred_gate").alias("meta_pred"), F.col("proba_gate").alias("meta_proba")
        )

    with ThreadPoolExecutor(parallel) as pool:
        parts = [p for p in pool.map(one, folds) if p is not None]
    default = {"meta_pred": F.lit(1.0), "meta_proba": F.lit(NO_SCORE)}
    rest = base.drop("meta_pred", "meta_proba")
    if not parts:
        return rest.withColumns(default)
    gate = parts[0]
    for p in parts[1:]:
        gate = gate.unionByName(p)
    joined = rest.join(gate, [*s.keys, s.order], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in default.items()})


# ---------------------------------------------------------------------------------------------
# search


def _cv_rows(df: DataFrame, features: Sequence[str], k: int, s: Series) -> DataFrame:
    rows = time_series_cv(_labelled(df, features, s), k, s).withColumn("fold", F.lit(0))
    scaled = apply_scaler(rows, fit_scaler(rows, list(features)), list(features))
    return materialise(vectors(scaled, features).select(*s.keys, s.order, LABEL, "cv_fold", "x"), "cv")


def _search(
    spark: SparkSession, rows: DataFrame, trials: list[dict], make: Callable[..., Learner], metric: str, k: int, parallel: int
) -> DataFrame:
    def one(job: tuple[int, int]) -> tuple:
        trial, fold = job
        model = fit(rows.filter(F.col("cv_fold") < fold), make(**trials[trial]))
        tested = score(rows.filter(F.col("cv_fold") == fold), model, "m")
        report = classification_report(tested, "m", scored_only=False).first()
        value = getattr(report, metric) if report else None
        return trial, json.dumps(trials[trial], sort_keys=True), fold, value

    jobs = [(t, f) for t in range(len(trials)) for f in range(1, k + 1)]
    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(one, jobs))
    return spark.createDataFrame(results, "trial int, params string, fold int, score double")


def grid_search(
    df: DataFrame, features: Sequence[str], make: Callable[..., Learner], grid: dict[str, list],
    k: int = 3, parallel: int = PARALLEL, s: Series = DAILY,
) -> DataFrame:
    """Accuracy of every parameter combination on expanding folds: (trial, params, fold, score)."""
    trials: list[dict] = [{}]
    for name, values in grid.items():
        trials = [{**t, name: x} for t in trials for x in values]
    return _search(df.sparkSession, _cv_rows(df, features, k, s), trials, make, "accuracy", k, parallel)


def random_trials(n: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from the boosted models' search space (the rate is drawn on a log scale)."""
    rng = random.Random(seed)
    return [
        {
            "depth": rng.randint(2, 8),
            "rate": math.exp(rng.uniform(math.log(0.005), math.log(0.3))),
            "trees": rng.randint(50, 500),
            "subsample": rng.uniform(0.5, 1.0),
        }
        for _ in range(n)
    ]


def random_search(
    df: DataFrame, features: Sequence[str], trials: list[dict], make: Callable[..., Learner] = gradient_boosting,
    k: int = 3, parallel: int = PARALLEL, s: Series = DAILY,
) -> DataFrame:
    """AUC of drawn parameters on expanding folds: (trial, params, fold, score)."""
    return _search(df.sparkSession, _cv_rows(df, features, k, s), trials, make, "auc", k, parallel)


def best_trial(results: DataFrame) -> DataFrame:
    mean = results.groupBy("trial", "params").agg(F.avg("score").alias("score"))
    return mean.orderBy(F.desc("score"), "trial").limit(1)


# ---------------------------------------------------------------------------------------------
# importance


def feature_importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """One row per feature with importance, rank, macro flag and whether it passes the cut."""
    values = model.featureImportances.toArray()
    rows = [(c, float(x), c.startswith("macro_")) for c, x in zip(features, values)]
    df = spark.createDataFrame(rows, "feature string, importance double, is_macro boolean")
    df = df.withColumn("_one", F.lit(1))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("importance"), "feature")))
    return ranked.withColumn("kept", (F.col("importance") > 0.005).cast("int")).drop("_one")


def importance_summary(importance: DataFrame, top: int = 20) -> DataFrame:
    """Number, share of the top and mean rank of the macro features."""
    macro = F.col("is_macro")
    return importance.agg(
        F.count(F.when(macro, 1)).alias("n_macro"),
        F.count(F.when(macro & (F.col("rank") <= top), 1)).alias("n_macro_top"),
        F.avg(F.when(macro, F.col("rank"))).alias("avg_macro_rank"),
        F.avg(F.when(macro, F.col("importance"))).alias("avg_macro_importance"),
        F.avg("importance").alias("avg_importance"),
    )


def _stride(n: int, seed: int) -> tuple[int, int]:
    """Multiplier and offset of a permutation i -> (a*i + b) mod n."""
    rng = random.Random(seed)
    a = max(1, int(n * 0.6180339887) + rng.randrange(1, max(2, n // 7)))
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1, rng.randrange(n)


def permuted_partner(df: DataFrame, column: str, out: str, seed: int = SEED, s: Series = DAILY) -> DataFrame:
    """Add ``out``: the value of ``column`` from another row, under a seeded permutation of all rows.

    Rows are numbered across tasks; the partner's number is arithmetic, so one equi-join does it.
    """
    rows = materialise(global_index(df, s), "numbered")
    n = rows.count()
    a, b = _stride(n, seed)
    # decimal arithmetic keeps the product exact for any number of rows
    at = F.expr(f"cast((cast(_gi as decimal(38,0)) * {a} + {b}) % {n} as bigint)")
    other = rows.select(F.col("_gi").alias("_at"), F.col(column).alias(out))
    return rows.withColumn("_at", at).join(other, "_at").drop("_at", "_gi", "_n")


def permutation_importance(
    df: DataFrame, model: Model, features: Sequence[str], seed: int = SEED, s: Series = DAILY
) -> DataFrame:
    """AUC lost when one feature is taken from another row: (feature, auc, drop, prunable).

    One join brings the partner's values; all features are scored in one job.
    """
    rows = vectors(df.filter(F.col(LABEL).isNotNull()), features).withColumn("a", vector_to_array("x"))
    rows = permuted_partner(rows.select(*s.keys, s.order, LABEL, "a"), "a", "z", seed, s)
    cases = F.sequence(F.lit(-1), F.lit(len(features) - 1))
    spread = rows.withColumn("case", F.explode(cases))
    mixed = F.transform("a", lambda v, i: F.when(i == F.col("case"), F.get("z", i)).otherwise(v))
    scored = score(spread.withColumn("x", array_to_vector(mixed)).select("case", LABEL, "x"), model, "m")
    aucs = classification_report(scored, "m", ("case",), scored_only=False).select("case", "auc")
    whole = F.broadcast(aucs.filter("case = -1").select(F.col("auc").alias("_whole"), F.lit(1).alias("_one")))
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("case"))
    out = aucs.filter("case >= 0").withColumn("_one", F.lit(1)).join(whole, "_one")
    out = out.select(name.alias("feature"), "auc", (F.col("_whole") - F.col("auc")).alias("drop"))
    return out.withColumn("prunable", (F.abs("drop") < 1e-4).cast("int"))


# ---------------------------------------------------------------------------------------------
# persistence


def save_models(
    spark: SparkSession, path: str, fold: int, models: dict[tuple[str, bool], Model | None], features: Sequence[str]
) -> None:
    """Write fitted models under model=/fold=/side= and a row of metadata for each."""
    rows = []
    for (name, bull), model in models.items():
        if model is None:
            continue
        side = "bull" if bull else "bear"
        where = f"{path}/models/model={name}/fold={fold}/side={side}"
        PipelineModel(stages=[model]).write().overwrite().save(where)
        rows.append((name, side, ",".join(features), where))
    if rows:
        meta = spark.createDataFrame(rows, "model string, side string, features string, path string")
        # a folder per fold: folds are saved at the same time, and a repeated one replaces its rows
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata/fold={int(fold)}")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.parquet(f"{path}/metadata")
    return listed.select("model", F.col("fold").cast("int").alias("fold"), "side", "features", "path")


def latest_models(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the highest fold number per model and side."""
    listed = list_models(spark, path)
    return listed.groupBy("model", "side").agg(
        F.max("fold").alias("fold"), F.max_by("path", "fold").alias("path"), F.max_by("features", "fold").alias("features")
    )


def load_model(spark: SparkSession, path: str, model: str, side: str = "bull", fold: int | None = None) -> PipelineModel:
    rows = latest_models(spark, path) if fold is None else list_models(spark, path).filter(F.col("fold") == fold)
    row = rows.filter((F.col("model") == model) & (F.col("side") == side)).select("path").first()
    if row is None:
        raise FileNotFoundError(f"no model {model}/{side} in {path}")
    return PipelineModel.load(row.path)


# ---------------------------------------------------------------------------------------------
# robustness by refitting


def _trained_report(train: DataFrame, test: DataFrame, features: Sequence[str], learner: Learner, label: str) -> DataFrame:
    names = list(features)
    train, test = (d.withColumn("fold", F.lit(0)) for d in (train, test))
    scaler = fit_scaler(train, names)
    fitted = vectors(apply_scaler(train, scaler, names), names).select(LABEL, "x").cache()
    model = fit(fitted, learner)
    fitted.unpersist()
    scored = score(vectors(apply_scaler(test, scaler, names), names).select(LABEL, "x"), model, "m")
    report = classification_report(scored, "m", scored_only=False).drop("model")
    return report.withColumn("label", F.lit(label)).withColumn("n_test", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def _labelled(df: DataFrame, features: Sequence[str], s: Series) -> DataFrame:
    """Labelled rows, gaps of the features filled forward within their series, then with 0."""
    rows = df.filter(F.col(LABEL).isNotNull()).select(*s.keys, s.order, LABEL, *features)
    return impute_terminal(rows, list(features), s)


def time_stability(df: DataFrame, features: Sequence[str], learner: Learner | None = None, s: Series = DAILY) -> DataFrame:
    """Metrics on the last 30 % of each third of the history; flags a clearly weaker last third."""
    learner = learner or gradient_boosting()
    rows = materialise(chronological_thirds(_labelled(df, features, s), s), "thirds")
    parts = []
    for period in ("Early", "Mid", "Late"):
        third = materialise(fraction_split(rows.filter(F.col("period") == period).drop("period"), 0.7, s), "third")
        train, test = (third.filter(F.col("part") == p) for p in ("train", "test"))
        parts.append(_trained_report(train, test, features, learner, period))
    out = materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]), "periods")
    acc = out.agg(
        F.max(F.when(F.col("label") == "Early", F.col("accuracy"))).alias("_e"),
        F.max(F.when(F.col("label") == "Late", F.col("accuracy"))).alias("_l"),
        F.lit(1).alias("_one"),
    )
    joined = out.withColumn("_one", F.lit(1)).join(F.broadcast(acc), "_one")
    return joined.withColumn("degrades", (F.col("_l") < F.col("_e") - 0.03).cast("int")).drop("_one", "_e", "_l")


def feature_subset_stability(
    df: DataFrame, features: Sequence[str], learner: Learner | None = None, seed: int = SEED, s: Series = DAILY
) -> DataFrame:
    """Metrics with all features, the more important half and a random half."""
    learner = learner or gradient_boosting()
    names = list(features)
    rows = materialise(fraction_split(_labelled(df, names, s), 0.8, s), "split")
    train, test = (rows.filter(F.col("part") == p) for p in ("train", "test"))
    scaler_rows = train.fillna(0, subset=names).withColumn("fold", F.lit(0))
    fitted = fit(vectors(apply_scaler(scaler_rows, fit_scaler(scaler_rows, names), names), names).select(LABEL, "x"), learner)
    weight = dict(zip(names, fitted.featureImportances.toArray())) if fitted is not None else {}
    half = len(names) // 2
    top = sorted(names, key=lambda c: -weight.get(c, 0.0))[:half]
    subsets = {"Full Features": names, "Top 50% Features": top, "Random 50% Features": random.Random(seed).sample(names, half)}
    parts = [_trained_report(train, test, cols, learner, label) for label, cols in subsets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def label_shuffle_test(
    df: DataFrame, features: Sequence[str], learner: Learner | None = None, seed: int = SEED, s: Series = DAILY
) -> DataFrame:
    """Accuracy with real and with permuted training labels, and the leak verdict: one row."""
    learner = learner or gradient_boosting()
    rows = materialise(fraction_split(_labelled(df, features, s), 0.8, s), "split")
    train, test = (rows.filter(F.col("part") == p) for p in ("train", "test"))
    mixed = permuted_partner(train, LABEL, "_other", seed, s).withColumn(LABEL, F.col("_other")).drop("_other")
    real = _trained_report(train, test, features, learner, "real").select(F.col("accuracy").alias("real"), F.lit(1).alias("_one"))
    shuffled = _trained_report(materialise(mixed, "shuffled"), test, features, learner, "shuffled")
    shuffled = shuffled.select(F.col("accuracy").alias("shuffled"), F.lit(1).alias("_one"))
    joined = real.join(shuffled, "_one").drop("_one")
    return joined.withColumn("verdict", shuffle_verdict(F.col("real"), F.col("shuffled")))
