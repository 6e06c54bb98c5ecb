"""Queries: models and what is fitted round them. Seeds are fixed, but no SQL says what a model should score."""

from pyspark.sql import functions as F

from tarnwatch.operators import boosting, ml, shift
from tarnwatch.plans import standins as S
from tarnwatch.plans.alignment import rounded
from tarnwatch.plans.register import registry

QUERIES, ORACLES, query = registry()
X = ["l_quantity", "l_extendedprice", "l_discount"]


def rows(spark, d):
    s = S.shifted(spark, d)
    label = ((F.col("l_quantity") + F.col("unit") % 10) > 40).cast("int")
    return s.withColumns({"true_label": label, "test": F.col("unit") % 4 == 0})


@query(
    S.ctes("shifted") + ", m as (select quantile_cont(l_discount, 0.5) as m from shifted), f as (select unit, l_quantity, coalesce(l_discount, m) as x "
    "from shifted, m), z as (select avg(x) as a, stddev_pop(x) as s from f) select unit, l_quantity, round((x - a) / s, 6) as z from "
    "f, z"
)
def k05_impute_and_scale(spark, d):
    s = S.shifted(spark, d).select("unit", "l_quantity", F.col("l_discount").alias("z"))
    s = ml.impute(s, ml.impute_values(s, ["z"]))
    return rounded(ml.standardise(s, ml.scale_values(s, ["z"])), "z")


@query(
    S.ctes("shifted") + ", r as (select case when l_quantity + unit % 10 > 40 then 1 else 0 end as true_label from shifted), g as (select true_label, "
    "count(*) as n from r group by 1), t as (select sum(n) as a, count(*) as k from g) select true_label, count(*) as rows, "
    "round(any_value(a / (k * n)), 6) as weight from r join g using (true_label), t group by 1"
)
def k11_class_weights(spark, d):
    w = ml.class_weights(rows(spark, d), "true_label")
    return w.groupBy("true_label").agg(F.count("*").alias("rows"), F.round(F.max("weight"), 6).alias("weight"))


def fitted(spark, d, kind, **settings):
    r = rows(spark, d)
    return ml.fit_predict(r.where("not test"), r.where("test"), X, kind=kind, **settings)


# At the optimum the weighted mean of (p - y) x plus the penalty's slope is 0 for every coefficient.
@query("select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'intercept']) as feature, true as stationary")
def k08_logistic(spark, d):
    r = rows(spark, d)
    train = r.where("not test")
    values = ml.impute_values(train, X)
    scales = ml.scale_values(ml.impute(train, values), X)
    ready = ml.class_weights(ml.standardise(ml.impute(train, values), scales), "true_label")
    scored, model = ml.fit_predict(train, train, X, balanced=True)
    b = dict(zip(X, map(float, model.coefficients), strict=True))
    z = sum((F.lit(c) * F.col(f) for f, c in b.items()), F.lit(float(model.intercept)))
    miss = (1 / (1 + F.exp(-z)) - F.col("true_label")) * F.col("weight")
    slopes = ready.agg(
        *[(F.sum(miss * F.col(f)) / F.sum("weight") + 1e-3 * b[f]).alias(f) for f in X], (F.sum(miss) / F.sum("weight")).alias("intercept"),
    )
    return slopes.unpivot([], [*X, "intercept"], "feature", "slope").select("feature", (F.abs("slope") < 1e-3).alias("stationary"))


@query(
    S.ctes("shifted") + ", r as (select case when l_quantity + unit % 10 > 40 then 1 else 0 end as y, unit % 4 = 0 as test from shifted) select count(*) "
    "filter (y = 1) as positives, count(*) filter (y = 0) as negatives, true as better_than_chance from r where test"
)
def k09_boosted_trees(spark, d):
    from tarnwatch.operators.metrics import ranking

    scored, _ = fitted(spark, d, "boosted", trees=5)
    return ranking(scored, []).select("positives", "negatives", (F.col("roc_auc") > 0.6).alias("better_than_chance"))


def level_sql(table: str) -> str:
    """The best split of each node of a table (node, g, h and the features), every value a bin of its own."""
    return (
        f"select * from (select node, feature, v as edge, missing_left, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) "
        "as gain, row_number() over (partition by node order by round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), "
        "6) desc, feature, v, missing_left desc) as r from (select node, feature, v, missing_left, ga, ha, coalesce(gb, 0) + case when missing_left then "
        "gm else 0 end as gl, coalesce(hb, 0) + case when missing_left then hm else 0 end as hl from (select *, sum(g) over f as ga, sum(h) over f as ha, "
        "coalesce(sum(g) filter (v is null) over f, 0) as gm, coalesce(sum(h) filter (v is null) over f, 0) as hm, sum(g) filter (v is not null) over b "
        "as gb, sum(h) filter (v is not null) over b as hb from (select node, feature, v, sum(g) as g, sum(h) as h from (select node, g, h, "
        "unnest([0, 1, 2]) as feature, unnest([l_quantity::double, l_discount::double, digit::double]) as v from "
        f"{table}) group by all) window f as (partition by node, feature), b as (partition by node, feature order by v nulls first rows between unbounded "
        "preceding and 1 preceding)), unnest([true, false]) m(missing_left) where v is not null) where hl >= 1 and ha - hl >= 1) where r = 1"
    )


def side_sql() -> str:
    return "case when x is null then case when missing_left then 1 else 2 end when x < edge then 1 else 2 end"


# The first two levels of the first tree, gains and all; a third of the quantities is missing.
@query(
    S.ctes("shifted") + ", r as (select case when unit % 3 <> 0 then l_quantity end as l_quantity, l_discount, unit % 10 as digit, case when l_quantity + unit % 10 > 40 then 1 else 0 end as y from shifted), "
    "m as (select avg(y) as p from r), r0 as (select 0 as node, r.*, p - y as g, p * (1 - p) as h from r, m), s0 as (" + level_sql("r0") + "), "
    "r1 as (select " + side_sql() + " as node, l_quantity, l_discount, digit, g, h from (select r0.*, edge, missing_left, case s0.feature when 0 then "
    "l_quantity when 1 then l_discount else digit end as x from r0, s0)), s1 as (" + level_sql("r1") + ") select node, ['l_quantity', 'l_discount', "
    "'digit'][feature + 1] as feature, round(edge, 6) as edge, missing_left, round(gain, 4) as gain from (select * from s0 union all select * from s1) "
    "where gain > 1e-6"
)
def k09_histogram_boosting(spark, d):
    r = rows(spark, d).withColumns({"digit": F.col("unit") % 10, "l_quantity": F.when(F.col("unit") % 3 != 0, F.col("l_quantity"))})
    tree = boosting.fit(r, ["l_quantity", "l_discount", "digit"], trees=1, depth=2).trees[0]
    made = [(k, f, round(e, 6), left, round(g, 4)) for k, (f, e, left, g) in tree.splits.items()]
    return spark.createDataFrame(made, "node int, feature string, edge double, missing_left boolean, gain double")


@query(
    "select 'XGB_d' || d || '_lr' || r || '_n' || n as model_name, 3 as complexity from unnest([2, 3, 4]) a(d), unnest(['0.03', "
    "'0.05', '0.1']) b(r), unnest([100, 200, 400]) c(n) union all select unnest(['LogisticRegression', "
    "'LogisticRegression_Balanced', 'HistGB', 'HistGB_Balanced']), unnest([1, 1, 2, 2])"
)
def k09_configurations(spark, d):
    return spark.createDataFrame([(c["model_name"], c["complexity"]) for c in ml.configurations()], "model_name string, complexity int")


def oversampled(spark, d):
    return ml.smote(rows(spark, d).select(*X[:2], "true_label"), X[:2])


# As many positives as negatives, the new ones between positives.
@query(
    S.ctes("shifted") + ", r as (select case when l_quantity + unit % 10 > 40 then 1 else 0 end as true_label from shifted), n as (select count(*) "
    "filter (true_label = 1) as p, count(*) filter (true_label = 0) as n from r) select unnest([0, 1]) as true_label, unnest([n, "
    "greatest(p, n)]) as rows, true as within from n"
)
def k07_smote(spark, d):
    box = rows(spark, d).where("true_label = 1").agg(*[f(c).alias(f"{n}_{c}") for c in X[:2] for n, f in (("lo", F.min), ("hi", F.max))])
    inside = [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in X[:2]]
    met = oversampled(spark, d).join(F.broadcast(box), how="cross")
    return met.groupBy("true_label").agg(
        F.count("*").alias("rows"), F.bool_and((F.col("true_label") == 0) | (inside[0] & inside[1])).alias("within"),
    )


# Shapley values of both kinds of models add up to the margin, row by row.
@query(
    S.ctes("shifted") + " select unnest(['linear', 'trees']) as model, count(*) filter (unit % 4 = 0) as rows, true as additive from shifted"
)
def k17_importance(spark, d):
    from pyspark.ml.functions import vector_to_array

    r = ml.counted(rows(spark, d), ["test"], X)
    test, out = r.where("test"), None
    for name, kind in (("linear", "logistic"), ("trees", "boosted")):
        train = r.where("not test")
        values = ml.impute_values(train, X, rows=ml.ROWS)
        a, b = ml.impute(train, values), ml.impute(test, values)
        scales = ml.scale_values(a, X, ml.ROWS)
        a, b = (ml.standardise(t, scales) for t in (a, b)) if kind == "logistic" else (a, b)
        a = a.withColumns({"label": F.col("true_label").cast("double"), "weight": F.col(ml.ROWS).cast("double")})
        model = ml.estimator(kind, True, trees=5).fit(ml.assemble(a, X))
        raw = model.transform(ml.assemble(b, X)).withColumn("raw", F.get(vector_to_array("rawPrediction"), F.lit(1))).select(*X, "raw", ml.ROWS)
        s = ml.shap(raw, model, X, ml.ROWS).agg(F.sum(ml.ROWS).alias("rows"), (F.max(F.abs(F.col("margin") - F.col("raw"))) < 1e-6).alias("additive"))
        s = s.select(F.lit(name).alias("model"), "rows", "additive")
        out = s if out is None else out.unionByName(s)
    return out


@query(
    S.ctes("shifted") + ", u as (select unit, max(case when domain = 'R' then 1 else 0 end) as y from shifted group by 1) select count(*) filter (y = 1) "
    "as positives, count(*) filter (y = 0) as negatives, true as is_auc from u"
)
def k16_domain_classifier(spark, d):
    s = S.shifted(spark, d).withColumn("returned", F.col("domain") == "R").drop("domain")
    return ml.domain_classifier(s, X, "returned", "unit").select("positives", "negatives", F.col("roc_auc").between(0, 1).alias("is_auc"))


@query(
    S.ctes("shifted") + ", r as (select domain, case when l_quantity + unit % 10 > 40 then 1 else 0 end as y from shifted) select strategy, domain as "
    "fold, count(*) filter (y = 1) as positives, count(*) filter (y = 0) as negatives, true as is_auc from r, unnest(['common_core', "
    "'with_indicators', 'all']) s(strategy) group by all"
)
def k22_region_strategies(spark, d):
    core = lambda t, f: [r.feature for r in shift.common_core(t, f, "domain", rows=ml.ROWS).where("included").orderBy("feature").collect()]
    flags = lambda t: shift.add_missing_flags(t, X)
    same = lambda t: t
    plans = {
        "common_core": (core, same), "with_indicators": (lambda t, f: [*core(t, f), "l_discount_missing"], flags),
        "all": (lambda t, f: shift.present_columns(t, f), same),
    }
    out = ml.region_rankings(rows(spark, d), X, "domain", "true_label", plans)
    return out.select("strategy", "fold", "positives", "negatives", F.col("roc_auc").between(0, 1).alias("is_auc"))


@query(
    S.ctes("shifted") + ", r as (select domain, unit, case when l_quantity + unit % 10 > 40 then 1 else 0 end as y from shifted), n as (select "
    "count(distinct unit) filter (y = 1 and domain = 'A') as h, count(distinct unit) filter (y = 1 and domain in ('N', 'R')) as w "
    "from r) select unnest(['forward', 'reverse']) as direction, unnest([h, w]) as train_units, unnest([w, h]) as test_units, "
    "unnest([h >= 5 and w >= 5, h >= 5 and w >= 5]) as eligible from n"
)
def k20_holdout_gate(spark, d):
    return ml.holdout_gate(rows(spark, d), "domain", ["A"], ["N", "R"], "unit")


@query(
    S.ctes("shifted") + ", r as (select domain, case when l_quantity + unit % 10 > 40 then 1 else 0 end as y from shifted) select unnest(['forward', "
    "'reverse']) as direction, unnest([count(*) filter (y = 1 and domain <> 'A'), count(*) filter (y = 1 and domain = 'A')]) as "
    "positives, unnest([count(*) filter (y = 0 and domain <> 'A'), count(*) filter (y = 0 and domain = 'A')]) as negatives, true as "
    "adds_up from r"
)
def k20_transfer(spark, d):
    t = ml.transfer(rows(spark, d), X, "domain", ["A"], ["N", "R"], "unit")
    return t.select(
        "direction", "positives", "negatives",
        ((F.col("tp") + F.col("fn") == F.col("positives")) & (F.col("fp") + F.col("tn") == F.col("negatives"))).alias("adds_up"),
    )


# The scan over candidates in order: each is held against the best so far.
CHOICE = """c as (select model_name, fold, count(*) filter (predicted_class = 1 and true_label = 1) as tp, count(*) filter (predicted_class = 1) as said, count(*) filter (true_label = 1) as pos from scores group by all),
m as (select row_number() over (order by model_name, fold) as r, model_name || fold as name, round(tp / said, 9) as pr, round(2 * tp / (said + pos), 9) as f1, round(tp / pos, 9) as rec, fold as cx from c),
w as (with recursive w(r, name, pr, f1, rec, cx) as (select r, name, pr, f1, rec, cx from m where r = 1 union all
select m.r, case when take then m.name else w.name end, case when take then m.pr else w.pr end, case when take then m.f1 else w.f1 end, case when take then m.rec else w.rec end, case when take then m.cx else w.cx end from w join m on m.r = w.r + 1,
lateral (select case when abs(m.pr - w.pr) > 0.005 then m.pr > w.pr when abs(m.f1 - w.f1) > 0.005 then m.f1 > w.f1 when abs(m.rec - w.rec) > 0.005 then m.rec > w.rec else m.cx < w.cx end as take)) select * from w)"""


@query(S.ctes("scores") + ", " + CHOICE + " select name as model_name from w order by r desc limit 1")
def k14_scanned_choice(spark, d):
    from tarnwatch.operators.metrics import confusion, rates

    m = rates(confusion(S.scores(spark, d), ["model_name", "fold"], threshold=0.5)).orderBy("model_name", "fold").collect()
    best = ml.choose(
        [
            {
                "name": f"{r.model_name}{r.fold}", "pr_auc": round(r.precision, 9), "f1": round(r.f1, 9), "recall": round(r.recall, 9),
                "complexity": r.fold,
            } for r in m
        ]
    )
    return spark.createDataFrame([(best["name"],)], "model_name string")


@query()
def k15_rounded_choice(spark, d):
    from tarnwatch.operators.metrics import confusion, rates

    m = rates(confusion(S.scores(spark, d), ["model_name"], threshold=0.5)).withColumns(
        {"pr_auc": F.col("precision"), "complexity": F.length("model_name")}
    )
    return ml.choose_rounded(m.select("model_name", "pr_auc", "f1", "recall", "complexity"))


ORACLES["k15_rounded_choice"] = S.ctes("scores") + ", c as (select model_name, count(*) filter (predicted_class = 1 and true_label = 1) as tp, count(*) filter (predicted_class = 1) as said, count(*) filter (true_label = 1) as pos from scores group by 1) select model_name, tp / said as pr_auc, 2 * tp / (said + pos) as f1, tp / pos as recall, cast(length(model_name) as int) as complexity from c order by round(tp / said, 3) desc, round(2 * tp / (said + pos), 3) desc, round(tp / pos, 3) desc, 5, 1 limit 1"
