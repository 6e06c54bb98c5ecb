"""Shapley values against their definition, and the nested search on a small table."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import ml


def tree_value(leaves, x, known):
    """The expected value of a tree's leaves with some features known, leaf by leaf."""
    out = 0.0
    for value, path in leaves:
        p = 1.0
        for f, (low, high, share) in path.items():
            p *= float(low < x[f] <= high) if f in known else share
        out += value * p
    return out


def test_shapley_values_are_what_they_are_defined_as():
    # two trees over three features; a path may split a feature twice
    trees = [
        [
            (1.0, {0: (-np.inf, 0.5, 0.4)}), (2.0, {0: (0.5, np.inf, 0.6), 1: (-np.inf, 0.2, 0.3)}),
            (-3.0, {0: (0.5, np.inf, 0.6), 1: (0.2, np.inf, 0.7)}),
        ]
    ]
    trees.append([(0.5, {2: (-np.inf, 0.1, 0.2)}), (4.0, {2: (0.1, 0.9, 0.8 * 0.5)}), (-1.0, {2: (0.9, np.inf, 0.8 * 0.5)})])
    weights, rng = [1.0, 0.1], np.random.default_rng(1)
    x = rng.random((20, 3))
    got, base = ml.shap_of(x, weights, trees)
    for row, values in zip(x, got, strict=True):
        game = lambda known, row=row: sum(w * tree_value(t, row, known) for w, t in zip(weights, trees, strict=True))
        assert abs(game(set()) - base) < 1e-12 and abs(base + values.sum() - game({0, 1, 2})) < 1e-12
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(
                math.factorial(n) * math.factorial(2 - n) / 6 * (game({*s, f}) - game(set(s))) for n in range(3) for s in itertools.combinations(rest, n)
            )
            assert abs(values[f] - want) < 1e-12


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(1)
    rows = []
    for g in range(8):
        for _ in range(40):
            y = int(rng.random() < (0.4 if g < 3 else 0.0))
            rows.append((g, "home" if g < 6 else "away", y, y + rng.gauss(0, 0.5), rng.random(), None))
    return spark.createDataFrame(rows, "cv_group_id int, region string, true_label int, a double, b double, c double")


def test_search_scores_every_group_once(groups):
    configs = [
        ml.configurations()[0],
        dict(model_name="small_trees", kind="boosted", balanced=False, complexity=3, settings={"depth": 2, "rate": 0.3, "trees": 3}),
    ]
    out, chosen = ml.search(groups, ["a", "b", "c"], configs, folds=2)
    assert [c["fold"] for c in chosen] == [0, 1, 2] and all(
        c["threshold"] in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8) for c in chosen
    )
    n = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert n == {k: 40 for k in range(3)}
    p = out.groupBy("true_label").agg(F.avg("predicted_probability").alias("p")).orderBy("true_label").collect()
    assert p[1].p > p[0].p + 0.2
    # no balanced model on oversampled rows
    assert ml.fitted(groups, groups, ["a"], "true_label", ml.configurations()[1], True) is None


def test_transfer_needs_five_units(groups):
    gate = {r.direction: r for r in ml.holdout_gate(groups, "region", ["home"], ["away"], "cv_group_id").collect()}
    assert (gate["forward"].train_units, gate["forward"].test_units, gate["reverse"].eligible) == (3, 0, False)
    assert ml.transfer(groups, ["a"], "region", ["home"], ["away"], "cv_group_id") is None
    t = ml.transfer(
        groups.withColumn("region", F.when(F.col("cv_group_id") % 2 == 0, "home").otherwise("away")), ["a", "c"], "region", ["home"],
        ["away"], "cv_group_id", least=1,
    )
    assert {r.direction for r in t.collect()} == {"forward", "reverse"} and all(r.roc_auc > 0.7 for r in t.collect())


def test_configurations_are_in_the_order_of_the_scan():
    names = [c["model_name"] for c in ml.configurations()]
    assert len(names) == 31 and names[:4] == [
        "LogisticRegression", "LogisticRegression_Balanced", "HistGB", "HistGB_Balanced",
    ] and names[4] == "XGB_d2_lr0.03_n100" and names[-1] == "XGB_d4_lr0.1_n400"


def test_equal_rows_are_fitted_once(groups):
    """Copies change neither model nor ranking, and are not carried along row by row."""
    rows = groups.select("region", "true_label", F.round("a", 1).alias("a"), F.when(F.col("b") > 0.3, F.round("b", 1)).alias("b"))
    many = rows.crossJoin(groups.sparkSession.range(6)).drop("id")
    assert (n := ml.counted(many, ["region"], ["a", "b"]).count()) == rows.distinct().count() < many.count() / 6
    one, _ = ml.fit_predict(rows, rows, ["a", "b"], balanced=True)
    six, _ = ml.fit_predict(many, rows, ["a", "b"], balanced=True)
    p = [[r.p for r in t.select(F.col("predicted_probability").alias("p")).orderBy("p").collect()] for t in (one, six)]
    assert np.allclose(*p, atol=1e-6)
    kept = rows.crossJoin(groups.sparkSession.range(1)).drop("id")
    plans = {"all": (lambda t, f: f, lambda t: t)}
    a, b = (ml.region_strategies(t, ["a", "b"], "region", "true_label", plans) for t in (kept, many))
    assert a.count() == b.count() == n and b.agg(F.sum(ml.ROWS)).first()[0] == many.count()
    ranked = [ml.ranking(t, ["fold"], rows=ml.ROWS).orderBy("fold").collect() for t in (a, b)]
    for x, y in zip(*ranked, strict=True):
        assert (6 * x.positives, 6 * x.negatives) == (y.positives, y.negatives)
        assert (x.roc_auc is None) == (y.roc_auc is None) and (x.roc_auc is None or abs(x.roc_auc - y.roc_auc) < 1e-6)
    m, w = ml.impute_values(many, ["a", "b"]), ml.impute_values(ml.counted(many, [], ["a", "b"]), ["a", "b"], rows=ml.ROWS)
    assert m == w


def test_leaves_are_many_tasks(spark):
    """Few bytes of points are much work: tasks are not joined by their bytes."""
    points = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    near, sizes = ml.neighbours(points, ["a", "b"], k=3, block=50)
    assert len(sizes) > 4 and near.where("_d = 0").count() == 400
    plan = near._jdf.queryExecution().logical().toString()
    assert plan.count("RepartitionByExpression [_leaf") == 2


def regional(spark, n=1200):
    """Rows of four regions, one of them NULL, with missing values, scores that tie and a column that a strategy makes."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        a, b = float(rng.integers(0, 9)), None if rng.random() < 0.3 else float(rng.integers(-4, 5)) / 2
        rows.append((["N", "S", "T", None][k % 4], a, b, 7.0, int(a + (b or 0) + rng.normal() * 3 > 4)))
    return spark.createDataFrame(rows, "region string, a double, b double, c double, true_label int")


PLANS = {
    "all": (lambda t, f: f, lambda t: t),
    "made": (lambda t, f: ["a", "flag"], lambda t: t.withColumn("flag", F.col("b").isNull().cast("int"))),
    "moved": (lambda t, f: ["a", "b"], lambda t: t.withColumn("b", F.col("b") * 2)),
    "none": (lambda t, f: [], lambda t: t),
}


def test_regions_are_fitted_together(spark, monkeypatch):
    """Each model is that of fit_predict() on its own; the passes do not grow with the models."""
    df, features = regional(spark), ["a", "b", "c"]
    want = []
    c = ml.counted(df, ["region"], features)
    for name, (pick, prepare) in PLANS.items():
        for r in "NST":
            train, test = prepare(c.where(F.col("region") != r)), prepare(c.where(F.col("region") == r))
            if own := pick(train, features):
                want += [(name, r, x.predicted_probability) for x in ml.fit_predict(train, test, own, rows=ml.ROWS)[0].collect()]
    passes, summed = [], ml.summed
    monkeypatch.setattr(ml, "fit_predict", None)
    monkeypatch.setattr(ml, "summed", lambda *a: passes.append(a) or summed(*a))
    scored = ml.region_strategies(df, features, "region", "true_label", PLANS)
    assert len(passes) < 12 and scored.count() == len(want) and scored.agg(F.sum(ml.ROWS)).first()[0] == 3 * 900
    for x in scored.groupBy("strategy", "fold").agg(F.collect_list("predicted_probability").alias("p")).collect():
        mine = sorted(p for s, r, p in want if (s, r) == (x.strategy, x.fold))
        assert np.allclose(sorted(x.p), mine, atol=1e-5)


def test_region_rankings_equal_the_ranking_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(ml, "SHARE", 1)  # a start from a share of the rows too
    monkeypatch.setattr(ml, "RANGES", 5)
    df, features = regional(spark), ["a", "b", "c"]
    got = ml.region_rankings(df, features, "region", "true_label", PLANS).orderBy("strategy", "fold").collect()
    want = ml.ranking(ml.region_strategies(df, features, "region", "true_label", PLANS), ["strategy", "fold"], rows=ml.ROWS)
    want = want.orderBy("strategy", "fold").collect()
    assert len(got) == len(want) == 9
    for x, y in zip(got, want, strict=True):
        assert (x.strategy, x.fold, x.positives, x.negatives) == (y.strategy, y.fold, y.positives, y.negatives)
        assert abs(x.roc_auc - y.roc_auc) < 1e-6 and abs(x.pr_auc - y.pr_auc) < 1e-6


def test_models_of_one_class_and_of_no_rows(spark):
    plans = {"all": PLANS["all"]}
    one = spark.createDataFrame([(r, float(k), 1 if r == "N" else k % 2) for r in "NS" for k in range(20)], "region string, a double, true_label int")
    p = {r.fold: r.p for r in ml.region_strategies(one, ["a"], "region", "true_label", plans).groupBy("fold").agg(F.min("predicted_probability").alias("p")).collect()}
    assert p["S"] == 1.0 and 0 < p["N"] < 1  # trained on positives alone, as Spark's own model
    alone = ml.region_rankings(one.where("region = 'N'"), ["a"], "region", "true_label", plans)
    assert alone is None or alone.count() == 0


def test_rows_that_differ_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(ml, "MANY", 0)
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("true_label"))
    kept = ml.counted(df, [], ["a", "b"])
    assert kept.agg(F.count("*"), F.sum(ml.ROWS), F.max(ml.ROWS)).first()[:] == (5000, 5000, 1)
    assert ml.counted(df, [], ["a"]).agg(F.count("*"), F.sum(ml.ROWS)).first()[:] == (14, 5000)
