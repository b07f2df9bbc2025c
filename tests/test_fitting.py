"""Fits of all folds against plain numpy and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.tables import new_path
from tidepanel.operators import attribution, boosting, fitting, logistic, splits, stored, tuning, walk

FEATURES = ["f0", "f1", "f2", "flat"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two series, labels that depend on two features, gaps, and days without label."""
    rng = np.random.default_rng(5)
    rows = []
    for t in ("A", "B"):
        for i in range(90):
            x = rng.normal(size=3)
            y = float(rng.random() < 1 / (1 + math.exp(-(2 * x[0] - x[1] * x[1] + 0.5))))
            rows.append((t, i, *[float(v) for v in x[:2]], None if i % 11 == 0 else float(x[2]), 3.0, None if i % 13 == 0 else y, float(rng.random() < 0.6)))
    df = spark.createDataFrame(rows, "ticker string, i int, f0 double, f1 double, f2 double, flat double, target_direction double, regime_trend_bullish double")
    return df.withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i").cache()


@pytest.fixture(scope="module")
def run(panel):
    return walk.Walk.of(panel, FEATURES, 50, 15)


@pytest.fixture(scope="module")
def sets(run):
    return run.sets.toPandas()


def matrices(sets, fold, bull):
    own = sets[(sets.fold == fold) & (sets.bull == bull)]
    return np.array(own.x.tolist()), own.y.to_numpy(), own.row.to_numpy()


def test_sets_are_the_folds(run, panel, sets):
    sizes = {(r["fold"], r["bull"]): (r["n"], r["n_pos"]) for r in run.sizes.collect()}
    assert sorted(sizes) == [(f, b) for f in (1, 2, 3) for b in (False, True)]
    days = sorted({r["dt"] for r in panel.select("dt").collect()})
    plain = panel.toPandas()
    for (fold, bull), (n, pos) in sizes.items():
        window = days[15 * (fold - 1) : 50 + 15 * (fold - 1)]
        own = plain[plain.dt.isin(window) & plain.target_direction.notna() & ((plain.regime_trend_bullish == 1) == bull)]
        assert (n, pos) == (len(own), int(own.target_direction.sum()))
        assert len(sets[(sets.fold == fold) & (sets.bull == bull)]) == n


def test_logistic_is_the_optimum(run, sets):
    found = {(r["fold"], r["bull"]): r for r in run.logistic().collect()}
    assert len(found) == 6
    for (fold, bull), r in found.items():
        both = np.array(sets[sets.fold == fold].x.tolist())
        mean, dev = both.mean(axis=0), both.std(axis=0)
        dev[dev < 1e-12] = 1
        assert np.allclose(r["mean"], mean) and np.allclose(r["dev"], dev)
        x, y, _ = matrices(sets, fold, bull)
        w, z = np.array(r["coef"]), (x - mean) / dev
        error = 1 / (1 + np.exp(-(z @ w + r["intercept"]))) - y
        assert np.abs(z.T @ error + w).max() < 1e-6 and abs(error.sum()) < 1e-6
    assert run and logistic.optimality(run.sets, run.logistic()).agg(F.max("largest")).first()[0] < 1e-6


def test_half_steps_when_the_loss_rises():
    fit = logistic.Fit(np.zeros(1), np.zeros(1))
    fit.advance(5.0, 1.0, np.array([-8.0]), 10)
    assert fit.tried[0] == 8
    fit.advance(9.0, 1.0, np.array([1.0]), 10)
    assert fit.weights[0] == 0 and fit.tried[0] == 4 and not fit.done


LEARNERS = {"A": boosting.Boost(12, 3, 0.3), "B": boosting.Boost(11, 4, 0.2, leaf=4, weight=1e-3, l2=0.0, subsample=0.7)}


def test_level_by_level_is_the_same_as_whole_sets(run):
    columns = ["model", "fold", "bull", "n", "n_pos", "depth", "base", "trees"]
    whole = boosting.fit_boosting(run.sets, run.sizes, LEARNERS, run.edges).select(columns).orderBy(*columns[:3]).collect()
    levels = boosting.fit_boosting(run.sets, run.sizes, LEARNERS, run.edges, group_rows=0).select(columns).orderBy(*columns[:3]).collect()
    mixed = boosting.fit_boosting(run.sets, run.sizes, LEARNERS, run.edges, group_rows=50).select(columns).orderBy(*columns[:3]).collect()
    assert len(whole) == 12 and whole == levels == mixed


def test_first_cut_is_the_best(run, sets):
    p = boosting.Boost(1, 1, 1.0)
    for r in boosting.fit_boosting(run.sets, run.sizes, {"A": p}, run.edges).collect():
        x, y, _ = matrices(sets, r["fold"], r["bull"])
        q = y.mean()
        g, h = q - y, np.full(len(y), q * (1 - q))
        value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = {}
        for f, e in itertools.product(range(x.shape[1]), range(run.edges.shape[1])):
            left = x[:, f] <= run.edges[f, e]
            if left.any() and (~left).any() and min(h[left].sum(), h[~left].sum()) >= 1:
                gains[f, e] = 0.5 * (value(left) + value(~left) - value(np.ones(len(y), bool)))
        tree = r["trees"][0]
        best = max(gains.values(), default=0)
        assert tree["gain"][1] == pytest.approx(max(best, 0), abs=1e-6)
        if tree["feature"][1] >= 0:
            left = x[:, tree["feature"][1]] <= tree["threshold"][1]
            assert [tree["value"][2], tree["value"][3]] == pytest.approx([-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)], abs=1e-6)


def test_leaves_and_losses_from_the_table(run):
    p = boosting.Boost(15, 3, 0.3)
    trees = boosting.fit_boosting(run.sets, run.sizes, {"A": p}, run.edges)
    for r in boosting.leaf_check(run.sets, trees, "A", p).collect():
        assert r["trees"] == 15 and r["worst"] < 1e-6 and r["loss"] < r["start_loss"]


def shapley(tree, x):
    """Contributions by all subsets of features, unknown cuts averaged by their shares of rows."""

    def value(node, known):
        f = tree["feature"][node]
        if f < 0:
            return tree["value"][node]
        low, high = 2 * node, 2 * node + 1
        if f in known:
            return value(low if x[f] <= tree["threshold"][node] else high, known)
        return sum(tree["rows"][c] / tree["rows"][node] * value(c, known) for c in (low, high))

    features = range(len(x))
    out = []
    for i in features:
        others = [f for f in features if f != i]
        total = 0.0
        for k in range(len(others) + 1):
            for s in itertools.combinations(others, k):
                total += math.factorial(k) * math.factorial(len(others) - k) / math.factorial(len(x)) * (value(1, {*s, i}) - value(1, set(s)))
        out.append(total)
    return value(1, set()), out


def test_attribution_is_shapley(run):
    trees = boosting.fit_boosting(run.sets, run.sizes, {"B": LEARNERS["B"]}, run.edges)
    by_set = {(r["fold"], r["bull"]): r for r in trees.collect()}
    rows = run.test_rows()
    out = attribution.attribute(rows, trees, "B").join(rows.select("ticker", "dt", "x"), ["ticker", "dt"]).collect()
    assert len(out) == rows.count()
    for r in out[:8]:
        own = by_set[r["fold"], r["bull"]]
        parts = [shapley(t, r["x"]) for t in own["trees"]]
        assert r["mean"] == pytest.approx(own["base"] + sum(m for m, _ in parts))
        assert list(r["phi"]) == pytest.approx(np.sum([phi for _, phi in parts], axis=0).tolist())
    assert all(r["raw"] == pytest.approx(r["mean"] + sum(r["phi"])) for r in out)
    ranked = {r["feature"]: r for r in attribution.importance(attribution.attribute(rows, trees, "B"), FEATURES).collect()}
    assert ranked["flat"]["prunable"] == 1 and ranked["f0"]["rank"] == 1


def test_groups_of_rows_do_not_change_attribution(run, monkeypatch):
    trees = boosting.fit_boosting(run.sets, run.sizes, {"A": LEARNERS["A"]}, run.edges)
    sums = lambda: sorted((r["ticker"], r["dt"], round(sum(abs(v) for v in r["phi"]), 9)) for r in attribution.attribute(run.test_rows(), trees, "A").collect())
    whole = sums()
    monkeypatch.setattr(attribution, "GROUP_ROWS", 3)
    monkeypatch.setattr(attribution, "CELLS", 10)
    assert sums() == whole


def test_stored_models(spark, run):
    path = new_path(spark, "models")
    coefficients, trees = run.logistic(), boosting.fit_boosting(run.sets, run.sizes, LEARNERS, run.edges)
    stored.save(path, FEATURES, run.spans, coefficients, trees)
    assert stored.features_of(spark, path) == FEATURES
    listed = stored.list_models(spark, path)
    assert listed.count() == 18 and {r["model"] for r in listed.collect()} == {"Logistic", "A", "B"}
    # saved again: replaced, not added
    stored.save(path, FEATURES, run.spans.filter("fold = 3"), coefficients.filter("fold = 3"), trees.filter("fold = 3"))
    assert stored.list_models(spark, path).count() == 18
    assert {r["fold"] for r in stored.latest_models(spark, path).collect()} == {3}
    with pytest.raises(FileNotFoundError):
        stored.load(spark, path, "absent")
    direct = {(r["ticker"], r["dt"]): r["proba_A"] for r in boosting.score_boosting(run.test_rows(), trees, "A").collect()}
    again = {(r["ticker"], r["dt"]): r["proba_A"] for r in stored.score_stored(run.rows, path, "A").collect()}
    assert direct == again


def test_fold_numbers_are_numbers(spark):
    path = new_path(spark, "models")
    spans = spark.sql("select f as fold, date_add(date'2020-01-01', f) as train_start, date_add(date'2020-01-01', f) as train_end, date_add(date'2020-01-01', f) as test_start, date_add(date'2020-01-01', f) as test_end from (select explode(array(2, 9, 10)) as f)")
    rows = spark.sql("select f as fold, true as bull, cast(f as long) as n, 1L as n_pos, 0.0D as intercept, array(1.0D) as coef, array(0.0D) as mean, array(1.0D) as dev from (select explode(array(2, 9, 10)) as f)")
    stored.save(path, ["x"], spans, rows)
    assert [r["fold"] for r in stored.latest_models(spark, path).collect()] == [10]
    data = spark.sql("select 'A' as ticker, d as dt, true as bull, array(2.0D) as x from (select explode(sequence(date'2020-01-02', date'2020-01-15')) as d)")
    folds = {str(r["dt"])[-2:]: r["fold"] for r in stored.fold_at(data, spans).collect()}
    assert folds == {**{f"{i:02d}": 2 for i in range(3, 10)}, "10": 9, **{str(i): 10 for i in range(11, 16)}}


def test_search_learns():
    def value(u):
        return -float(((u - np.array([0.2, 0.8, 0.5, 0.3])) ** 2).sum())

    late, random = [], []
    for seed in range(6):
        search = tuning.Search(seed)
        for _ in range(40):
            u = search.propose()
            assert ((u >= 0) & (u <= 1)).all()
            search.record(u, value(u))
        late.append(np.mean(search.values[-15:]))
        random.append(np.mean(search.values[: tuning.STARTUP]))
    assert np.mean(late) > np.mean(random) / 2


def test_parameters_cover_their_ranges():
    drawn = [tuning._boost(u, boosting.BOOST_A) for u in np.random.default_rng(1).random((400, 4))]
    assert {p.depth for p in drawn} == set(range(2, 9)) and min(p.trees for p in drawn) >= 50 and max(p.trees for p in drawn) <= 500
    assert all(0.005 <= p.rate <= 0.3 and 0.5 <= p.subsample <= 1 for p in drawn)


def test_tuning_stays_in_the_training_window(run, monkeypatch):
    monkeypatch.setitem(tuning.SPACE, "trees", (2, 5))
    monkeypatch.setattr(tuning, "STARTUP", 2)
    trials = run.tune(boosting.BOOST_A, 3, parts=2)
    rows = trials.collect()
    assert sorted((r["fold"], r["trial"]) for r in rows) == [(f, t) for f in (1, 2, 3) for t in (1, 2, 3)]
    best = tuning.tuned(trials, boosting.BOOST_A)
    for f in (1, 2, 3):
        top = max((r for r in rows if r["fold"] == f), key=lambda r: (r["auc"], -r["trial"]))
        assert (best[f].depth, best[f].trees, best[f].rate) == (top["depth"], top["trees"], top["rate"])
    parts = tuning.parts_of(run.rows, run.assigned, 2)
    bounds = {r["fold"]: r for r in run.spans.collect()}
    for r in parts.groupBy("fold").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.max("part").alias("p")).collect():
        assert bounds[r["fold"]]["train_start"] <= r["a"] and r["b"] <= bounds[r["fold"]]["train_end"] and r["p"] == 2
    per_date = parts.groupBy("fold", "dt").agg(F.count_distinct("part").alias("k")).agg(F.max("k")).first()[0]
    assert per_date == 1


def test_walk_forward_scores_test_windows_only(panel, monkeypatch):
    monkeypatch.setattr(walk, "BOOSTED", {"BoostA": boosting.Boost(5, 2, 0.3), "BoostB": boosting.Boost(4, 3, 0.2)})
    out = walk.walk_forward(panel, FEATURES, 50, 15).toPandas()
    assert len(out) == panel.count()
    days = sorted(out.dt.unique())
    early = out[out.dt.isin(days[:50])]
    assert (early.proba_Logistic == 0.5).all() and (early.pred_BoostB == 0).all()
    late = out[~out.dt.isin(days[:50])]
    assert (late.proba_Logistic != 0.5).all()
    assert np.allclose(out.proba_Ensemble, (out.proba_Logistic + out.proba_BoostA + out.proba_BoostB) / 3)


def test_no_folds(spark, panel):
    out = walk.walk_forward(panel.filter("dt < date'2020-02-01'"), FEATURES, 50, 15)
    assert out.filter("proba_Ensemble <> 0.5").count() == 0 and out.count() > 0
    assert splits.index_walk_forward(panel.limit(0), 50, 15).count() == 0 and fitting.LEAST_ROWS == 10
