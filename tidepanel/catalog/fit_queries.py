"""Models fitted at their default sizes on all features.

A fitted weight cannot be had from SQL, but what must hold for it can: which sets have a model, how many rows each
saw, and that stored coefficients, leaves and scores agree with sums recomputed from the rows.  The twins take
those facts from the calendar and the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog import views as v
from tidepanel.catalog.base import add
from tidepanel.catalog.feature_queries import _ALL, ALL_SQL, build
from tidepanel.catalog.oracle import with_
from tidepanel.catalog.trading_queries import _META as META_SQL
from tidepanel.catalog.trading_queries import market, scored
from tidepanel.functions.tables import materialise, new_path
from tidepanel.operators import attribution, boosting, gate, logistic, meta, refits, stored, tuning, walk
from tidepanel.operators.assemble import NOT_FEATURES, feature_columns
from tidepanel.operators.splits import expanding_walk_forward
from tidepanel.plans.pipeline import run_pipeline

TRAIN, TEST = 252, 20
#: Wider windows for the searches: each trial fits every part of every fold.
WIDE_TRAIN, WIDE_TEST, TRIALS = 504, 400, 6


N_FEATURES = len([c.partition(":")[0] for c in _ALL if c.partition(":")[0] not in NOT_FEATURES])


def features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    df = materialise(build(spark, d), "features")
    return df, feature_columns(df)


def walk_of(spark: SparkSession, d: str, train: int = TRAIN, test: int = TEST) -> walk.Walk:
    df, names = features(spark, d)
    return walk.Walk.of(df, names, train, test)


def facts(train: int = TRAIN, test: int = TEST) -> str:
    """WITH clause: ft (rows), di (dates), fo (folds), se (usable sets) and ts (test rows that have a model)."""
    return ALL_SQL[0] + f""", ft as materialized (
    select ticker, dt, target_direction as y, coalesce(regime_trend_bullish = 1, false) as bull from ({ALL_SQL[1]}) a
), di as materialized (
    select dt, row_number() over (order by dt) - 1 as idx, count(*) over () as dates from (select distinct dt from ft) x
), fo as materialized (
    select f as fold, {test} * (f - 1) as a, {train} + {test} * (f - 1) as b, {train} + {test} * f as c
    from range(1, 1 + greatest(0, cast(ceil((select max(dates) - {train} from di) / cast({test} as double)) as bigint))) r(f)
), se as materialized (
    select fold, bull, count(*) as n, cast(sum(y) as bigint) as n_pos, min(dt) as lo, max(dt) as hi
    from fo join di on idx >= a and idx < b join ft using (dt) where y is not null
    group by fold, bull having count(*) > 10 and sum(y) > 0 and sum(y) < count(*)
), ts as materialized (
    select fold, bull, ticker, dt, y from fo join di on idx >= b and idx < c join ft using (dt) join se using (fold, bull)
)"""


def _logistic(spark: SparkSession, d: str) -> DataFrame:
    w = walk_of(spark, d)
    return logistic.optimality(w.sets, w.logistic()).withColumn("optimal", (F.col("largest") < 1e-6).cast("int"))


add("logistic_optimum", "I2 I8", _logistic, (facts(), "select *, 1 as optimal from se"), keys="bull", ints="fold n n_pos optimal")


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    w = walk_of(spark, d)
    trees = w.boosted(walk.BOOSTED)
    parts = [boosting.leaf_check(w.sets, trees, n, p).withColumn("model", F.lit(n)) for n, p in walk.BOOSTED.items()]
    out = parts[0].unionByName(parts[1])
    return out.withColumns({"exact": (F.col("worst") < 1e-6).cast("int"), "improved": (F.col("loss") < F.col("start_loss")).cast("int")})


add(
    "boosting_leaves", "I4 I5 I8", _leaves,
    (facts(), "select model, se.*, 100 as trees, 1 as exact, 1 as improved from se, (values ('BoostA'), ('BoostB')) m(model)"),
    keys="model bull", ints="fold n n_pos trees exact improved",
)


def _walked(spark: SparkSession, d: str) -> DataFrame:
    df, names = features(spark, d)
    out = walk.walk_forward(df, names)
    members = ["Logistic", *walk.BOOSTED]
    scored = [(F.col(f"proba_{n}") > 0) & (F.col(f"proba_{n}") < 1) & (F.col(f"proba_{n}") != 0.5) & ((F.col(f"proba_{n}") > 0.5).cast("double") == F.col(f"pred_{n}")) for n in members]
    mean = sum((F.col(f"proba_{n}") for n in members), F.lit(0.0)) / len(members)
    return out.select(
        "ticker", "dt", *[c.cast("int").alias(f"scored_{n}") for n, c in zip(members, scored)],
        (F.abs(F.col("proba_Ensemble") - mean) < 1e-12).cast("int").alias("ensemble"),
    )


add(
    "walk_forward_scores", "I8 I9 I6", _walked,
    (facts(), "select ticker, dt, k as scored_Logistic, k as scored_BoostA, k as scored_BoostB, 1 as ensemble from (select ft.ticker, ft.dt, cast(ts.dt is not null as int) as k "
     "from ft left join ts on ts.ticker = ft.ticker and ts.dt = ft.dt)"),
    ints="scored_Logistic scored_BoostA scored_BoostB ensemble",
)


def _stored(spark: SparkSession, d: str) -> tuple[walk.Walk, str]:
    w, path = walk_of(spark, d), new_path(spark, "models")
    stored.save(path, w.features, w.spans, w.logistic(), w.boosted(walk.BOOSTED))
    return w, path


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return stored.list_models(spark, _stored(spark, d)[1])


_MODELS = "(values ('Logistic'), ('BoostA'), ('BoostB')) m(model)"
add(
    "stored_models", "I15", _listed,
    (facts(), f"""
select model, se.fold, bull, n, n_pos, min(x.dt) as train_start, max(x.dt) as train_end, min(y.dt) as test_start, max(y.dt) as test_end
from se join fo using (fold) join di x on x.idx >= a and x.idx < b join di y on y.idx >= b and y.idx < c, {_MODELS} group by all"""),
    keys="model bull train_start train_end test_start test_end", ints="fold n n_pos",
)
add(
    "model_metadata", "I15", lambda s, d: stored.latest_models(s, _stored(s, d)[1]).withColumn("side", F.when(F.col("bull"), "bull").otherwise("bear")),
    (facts(), f"select model, case when bull then 'bull' else 'bear' end as side, max(fold) as fold from se, {_MODELS} group by all"),
    keys="model side", ints="fold",
)


def _stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows scored from the stored tables; where a row lies in a test window, equal to the walk-forward scores."""
    w, path = _stored(spark, d)
    names = ["Logistic", *walk.BOOSTED]
    direct = w.scores(stored.load(spark, path, "Logistic"), stored.load(spark, path, "BoostA").unionByName(stored.load(spark, path, "BoostB")), walk.BOOSTED)
    direct = direct.select("ticker", "dt", *[F.col(f"proba_{n}").alias(f"direct_{n}") for n in names])
    out = w.rows.select("ticker", "dt")
    for n in names:
        out = out.join(materialise(stored.score_stored(w.rows, path, n).select("ticker", "dt", f"proba_{n}"), "scored"), ["ticker", "dt"])
    out = out.join(direct, ["ticker", "dt"], "left")
    same = [F.coalesce(F.abs(F.col(f"proba_{n}") - F.col(f"direct_{n}")) < 1e-12, F.col(f"proba_{n}").between(0, 1)) for n in names]
    return out.select("ticker", "dt", *[c.cast("int").alias(f"same_{n}") for n, c in zip(names, same)])


add(
    "stored_scores", "I15", _stored_scores,
    (facts(), """
select ticker, dt, 1 as same_Logistic, 1 as same_BoostA, 1 as same_BoostB
from (select ft.*, max(fold) as fold from ft join di using (dt) join fo on idx >= b group by all) l join se using (fold, bull)"""),
    ints="same_Logistic same_BoostA same_BoostB",
)


def _attributed(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Every test row against the default boosted learner of its set."""
    w = walk_of(spark, d)
    rows = materialise(w.test_rows(), "test")
    return materialise(attribution.attribute(rows, w.boosted({"BoostA": walk.BOOST_A}), "BoostA"), "attributed"), w.features


def _additive(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _attributed(spark, d)
    gap = F.abs(F.col("raw") - F.col("mean") - F.aggregate("phi", F.lit(0.0), lambda a, x: a + x))
    return out.select("ticker", "dt", "bull", "fold", (gap < 1e-9).cast("int").alias("additive"), F.size("phi").alias("n_features"))


add(
    "tree_attribution", "I14", _additive,
    (facts(), f"select *, 1 as additive, {N_FEATURES} as n_features from ts"), keys="ticker dt bull", ints="fold additive n_features",
)
add(
    "attribution_importance", "I14 I13", lambda s, d: attribution.importance(*_attributed(s, d)), keys="feature", ints="rank prunable", doubles="mean_abs",
)


def _tuning(spark: SparkSession, d: str) -> DataFrame:
    w = walk_of(spark, d, WIDE_TRAIN, WIDE_TEST)
    out = w.tune(walk.BOOST_A, TRIALS)
    lo, hi = tuning.SPACE["rate"]
    inside = F.col("depth").between(2, 8) & F.log("rate").between(lo - 1e-9, hi + 1e-9) & F.col("trees").between(50, 500) & F.col("subsample").between(0.5, 1)
    return out.withColumn("inside", (inside & F.col("auc").between(0, 1)).cast("int"))


add(
    "tuning_in_fold", "I11", _tuning,
    (facts(WIDE_TRAIN, WIDE_TEST), f"select fold, trial, 1 as inside from fo, range(1, {TRIALS + 1}) t(trial)"),
    keys="", ints="fold trial inside",
)


def _tuned(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the tuned learner and of the default one kept beside it, and what tuning changed."""
    df, names = features(spark, d)
    out = walk.walk_forward(df, names, WIDE_TRAIN, WIDE_TEST, trials=2)
    both = [walk.reports(out, [n]).withColumn("model", F.lit("BoostA")) for n in ("BoostA", "BoostA_baseline")]
    tested = both[0].select("model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_tested"))
    delta = meta.tuned_vs_baseline(*both, on="model").join(tested, "model")
    return delta.withColumn("complete", (F.abs(F.col("delta_auc") - (F.col("tuned_auc") - F.col("base_auc"))) < 1e-12).cast("int"))


add(
    "tuned_with_baseline", "I9 I11 I12", _tuned,
    (facts(WIDE_TRAIN, WIDE_TEST), "select 'BoostA' as model, count(y) as n_tested, 1 as complete from ts"), keys="model", ints="n_tested complete",
)


# --- the gate and the whole path ----------------------------------------------------------------


def _known(nulls: str) -> str:
    return " and ".join(f"{c} is not null" for c in meta.META_FEATURES) + nulls


#: WITH clause of the gate's folds on the closed-form scores: se (fitted folds) and fo (all)
GATE_SQL = with_("scored") + f""", di as materialized (
    select dt, row_number() over (order by dt) - 1 as idx, count(*) over () as dates from (select distinct dt from scored) x
), kn as materialized (
    select * replace (lead(log_ret_1d) over (partition by ticker order by dt) as next_ret)
    from (select s.* from scored s join di using (dt) where idx >= 252 and proba_S <> 0.5) k
), mt as materialized (
    select *, lead(dt) over (partition by ticker order by dt) as due, row_number() over (partition by ticker order by dt) as k from ({META_SQL.replace("from scored", "from kn")}) m
), us as materialized (
    select ticker, dt, due, meta_target, row_number() over (partition by ticker order by dt) as k from mt where {_known(" and meta_target is not null")}
), en as materialized (
    select us.ticker, us.meta_target, greatest(us.due, t.dt, f.due) as dt from us join mt t on t.ticker = us.ticker and t.k = 10 join us f on f.ticker = us.ticker and f.k = 5
), fo as materialized (
    select f as fold, 272 + 20 * (f - 1) as b, 272 + 20 * f as c
    from range(1, 1 + greatest(0, cast(ceil((select max(dates) - 272 from di) / cast(20 as double)) as bigint))) r(f)
), se as materialized (
    select fold, count(*) as n, cast(sum(meta_target) as bigint) as n_pos from fo join di on idx < b join en using (dt)
    group by fold having count(*) >= 50 and sum(meta_target) > 0 and sum(meta_target) < count(*)
)"""


def _gate_optimum(spark: SparkSession, d: str) -> DataFrame:
    base = materialise(scored(v.bars(spark, d)), "scored")
    folds = materialise(expanding_walk_forward(base, TRAIN, 20, TEST), "folds")
    return logistic.optimality(*gate.fit_gate(base, folds, "S")).withColumn("optimal", (F.col("largest") < 1e-6).cast("int"))


add("gate_optimum", "I18", _gate_optimum, (GATE_SQL, "select *, 1 as optimal from se"), keys="", ints="fold n n_pos optimal")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Which rows a fitted gate scored; its call follows its probability, the others trust every call."""
    out = gate.gate_walk_forward(scored(v.bars(spark, d)), "S")
    p, call = F.col("meta_proba"), F.col("meta_pred")
    fitted = (p > 0) & (p < 1) & (p != 0.5)
    sound = F.when(fitted, call == (p > 0.5).cast("double")).otherwise(call == 1)
    return out.select("ticker", "dt", fitted.cast("int").alias("fitted"), sound.cast("int").alias("sound"))


add(
    "gate_scores", "I18", _gated,
    (GATE_SQL, "select s.ticker, s.dt, cast(se.fold is not null as int) as fitted, 1 as sound from scored s join di using (dt) left join fo on idx >= b and idx < c left join se using (fold)"),
    ints="fitted sound",
)


def _pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole path on all features; its figures depend on the fits, its dates and bounds do not."""
    out = run_pipeline(v.bars(spark, d), market(spark, d), v.macro(spark, d), v.LABELS)
    sound = F.col("max_drawdown").between(-1, 0) & F.col("win_rate").between(0, 1) & (F.col("annualized_volatility") > 0) & (F.col("total_return") > -1)
    return out.withColumn("sound", sound.cast("int"))


add(
    "pipeline_report", "F16 I8 I9 I18 J3 N8 O10", _pipeline_report,
    (ALL_SQL[0] + f", ft as materialized ({ALL_SQL[1]}), full_dates as (select dt from ft group by dt having count(*) = (select count(distinct ticker) from ft))", """
select n || h as strategy, min(dt) as start_date, max(dt) as end_date, 1 as sound
from full_dates, (values ('Logistic'), ('BoostA'), ('BoostB'), ('Ensemble'), ('Buy & Hold')) m(n), (values (''), (' (Beta-Neutral)')) x(h)
where n <> 'Buy & Hold' or h = '' group by 1"""),
    keys="strategy start_date end_date", ints="sound",
)


# --- robustness by refitting --------------------------------------------------------------------

#: WITH clause: po (labelled rows in time order with the number of rows)
PLACED_SQL = ALL_SQL[0] + f""", ft as materialized (select ticker, dt, target_direction as y from ({ALL_SQL[1]}) a), po as materialized (
    select *, row_number() over (order by dt, ticker) - 1 as g, count(*) over () as total from ft where y is not null
)"""
_FIFTH = "count(case when g < floor(total * cast(0.8 as double)) then 1 end) as n, cast(sum(case when g < floor(total * cast(0.8 as double)) then y end) as bigint) as n_pos, count(case when g >= floor(total * cast(0.8 as double)) then 1 end) as n_test"


def _sound(df: DataFrame) -> DataFrame:
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "prec", "recall", "f1", "auc")]
    return df.withColumn("sound", (shares[0] & shares[1] & shares[2] & shares[3] & shares[4]).cast("int"))


add(
    "time_stability_refit", "P1", lambda s, d: _sound(refits.time_stability(*features(s, d))),
    (PLACED_SQL, """
select label, count(case when train then 1 end) as n, cast(sum(case when train then y end) as bigint) as n_pos, count(case when not train then 1 end) as n_test, 1 as sound
from (select *, g - p * (total // 3) < floor(case when p = 2 then total - 2 * (total // 3) else total // 3 end * cast(0.7 as double)) as train,
    case p when 0 then 'Early' when 1 then 'Mid' else 'Late' end as label from (select *, least(g // (total // 3), 2) as p from po) a) b group by label"""),
    keys="label", ints="n n_pos n_test sound",
)
add(
    "feature_subset_refit", "P2", lambda s, d: _sound(refits.feature_subset_stability(*features(s, d))),
    (PLACED_SQL, f"select label, {_FIFTH}, 1 as sound from po, (values ('Full Features'), ('Top 50% Features'), ('Random 50% Features')) m(label) group by label"),
    keys="label", ints="n n_pos n_test sound",
)
add(
    # a permutation keeps the number of positive labels
    "label_shuffle_refit", "P3", lambda s, d: refits.label_shuffle_test(*features(s, d)),
    (PLACED_SQL, f"select n as n_real, n as n_shuffled, n_pos as n_pos_real, n_pos as n_pos_shuffled, n_test as n_test_real, n_test as n_test_shuffled from (select {_FIFTH} from po) x"),
    keys="", ints="n_real n_shuffled n_pos_real n_pos_shuffled n_test_real n_test_shuffled",
)
