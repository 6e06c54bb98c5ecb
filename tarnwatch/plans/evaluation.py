"""Queries: metrics, splits, distribution shift, audits."""

from pyspark.sql import functions as F

from tarnwatch.operators import checks, metrics, shift, splits, upsert
from tarnwatch.plans import standins as S
from tarnwatch.plans.alignment import rounded
from tarnwatch.plans.register import registry

QUERIES, ORACLES, query = registry()
FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]

COUNTS = "count(*) filter ({h} and true_label = 1) as tp, count(*) filter ({h} and true_label <> 1) as fp, count(*) filter (not {h} and true_label = 1) as fn, count(*) filter (not {h} and true_label <> 1) as tn"
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) as balanced_accuracy"""
RANKED = """, g as (select {by}, predicted_probability as s, count(*) filter (true_label = 1) as p, count(*) filter (true_label <> 1) as n from {t} group by all),
c as (select *, sum(p) over (partition by {by} order by s desc) as tp, sum(n) over (partition by {by} order by s desc) as fp from g)
select {by}, round(case when sum(p) > 0 and sum(n) > 0 then sum(n * (2 * (tp - p) + p)) / (2.0 * sum(p) * sum(n)) end, 6) as roc_auc, round(case when sum(p) > 0 then sum(p * (tp / (tp + fp))) / sum(p) end, 6) as pr_auc, cast(sum(p) as bigint) as positives, cast(sum(n) as bigint) as negatives from c group by {by}"""


@query(
    S.ctes("scores") + f", c as (select model_name, fold, {COUNTS.format(h='predicted_probability >= 0.5')} from scores group by all) select model_name, "
    f"fold, tp, fp, fn, tn, {RATES} from c"
)
def e14_classification_metrics(spark, d):
    out = metrics.rates(metrics.confusion(S.scores(spark, d), ["model_name", "fold"], threshold=0.5))
    return rounded(out, "precision", "recall", "f1", "specificity", "fpr", "balanced_accuracy")


@query(S.ctes("scores") + RANKED.format(by="model_name", t="scores"))
def e16_ranking_metrics(spark, d):
    return rounded(metrics.ranking(S.scores(spark, d), ["model_name"]), "roc_auc", "pr_auc")


@query(
    S.ctes("scores") + ", e as (select model_name, matched_event_id, bool_or(predicted_class = 1) as f from scores where true_label = 1 and "
    "matched_event_id is not null group by all) select model_name, count(*) as events, count(*) filter (f) as detected, "
    "round(avg(f::int), 6) as event_recall from e group by 1"
)
def e18_event_recall(spark, d):
    return rounded(metrics.event_recall(S.scores(spark, d), ["model_name"]), "event_recall")


@query(
    S.ctes("scores") + f" select model_name, fold, count(*) as n, {COUNTS.format(h='predicted_class = 1')} from scores group by grouping sets "
    "((model_name, fold), (model_name))"
)
def e19_fold_and_pooled(spark, d):
    return metrics.fold_and_pooled(S.scores(spark, d), ["model_name"], "fold")


@query(
    S.ctes("scores") + ", c as (select model_name, fold, " + COUNTS.format(h="predicted_class = 1") + " from scores group by all), m as (select model_name, fold as horizon_days, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, tp / "
    "nullif(tp + fp, 0) as pr_auc from c), r as (select *, row_number() over (partition by horizon_days order by pr_auc desc nulls "
    "last, model_name) as r from m) select horizon_days, model_name, round(pr_auc, 6) as pr_auc, round(f1, 6) as f1, coalesce(pr_auc "
    "> 0.15 and f1 > 0.1, false) as accepted from r where r = 1"
)
def e20_best_configuration(spark, d):
    c = metrics.rates(metrics.confusion(S.scores(spark, d), ["model_name", "fold"], threshold=0.5))
    r = c.select("model_name", F.col("fold").alias("horizon_days"), "f1", F.col("precision").alias("pr_auc"))
    return rounded(metrics.best_configuration(r).select("horizon_days", "model_name", "pr_auc", "f1", "accepted"), "pr_auc", "f1")


@query(
    S.ctes("scores") + ", b as (select model_name, lake_uid, round(avg(predicted_probability), 6) as predicted_probability, max(case when "
    "matched_event_id like 'e1%' then 1 else 0 end) as true_label from scores group by all)" + RANKED.format(by="model_name", t="b")
)
def e26_unit_balanced_auc(spark, d):
    s = S.scores(spark, d).withColumn("true_label", F.coalesce(F.col("matched_event_id").like("e1%"), F.lit(False)).cast("int"))
    return rounded(
        metrics.ranking(rounded(metrics.balanced_mean(s, ["model_name"], "lake_uid"), "predicted_probability"), ["model_name"]), "roc_auc",
        "pr_auc",
    )


@query(
    S.ctes("scores") + ", s as (select *, timestamp '2024-02-01' as event_ts from scores), e as (select matched_event_id, min(case when true_label = 1 "
    "and predicted_class = 1 then reference_timestamp end) as first_alert, max(event_ts) as t, count(*) filter (true_label = 1) as "
    "positive_rows, count(*) filter (true_label = 0 and predicted_class = 1) as false_alerts from s where matched_event_id is not "
    "null group by 1) select matched_event_id, first_alert, cast(floor((epoch_us(t) - epoch_us(first_alert)) / 3600000000.0::double "
    "/ 24) as bigint) as lead_time_days, case when positive_rows = 0 then 'NO_USABLE_POSITIVE_ROWS' when first_alert is not null "
    "then 'YES' else 'NO' end as detected, positive_rows, false_alerts from e"
)
def f14_earliest_alert(spark, d):
    return metrics.alerts(S.scores(spark, d).withColumn("event_ts", F.lit("2024-02-01").cast("timestamp_ntz")))


@query(
    S.ctes("scores") + ", t as (select s.*, x.threshold from scores s, (values (0.1::double), (0.2::double), (0.3::double), (0.4::double), "
    "(0.5::double), (0.6::double), (0.7::double), (0.8::double)) x(threshold)), c as (select model_name, threshold, " + COUNTS.format(h="predicted_probability >= threshold") + " from t group by all), f as (select model_name, threshold, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from c), r "
    "as (select *, row_number() over (partition by model_name order by round(f1, 12) desc, threshold) as r from f) select "
    "model_name, threshold, round(f1, 6) as f1 from r where r = 1"
)
def k13_threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(S.scores(spark, d), ["model_name"]), "f1")


LONG = S.ctes("shifted") + ", x as (select domain, unit, feature, v from (select domain, unit, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as feature, unnest([l_quantity, l_extendedprice, l_discount]) as v from shifted))"


@query(
    LONG + ", g as (select feature, avg(v) filter (domain = 'A') as ma, avg(v) filter (domain = 'R') as mb, var_pop(v) filter (domain = "
    "'A') as va, var_pop(v) filter (domain = 'R') as vb from x group by 1) select feature, round(case when sqrt((va + vb) / 2) = 0 "
    "then 0 else abs(ma - mb) / sqrt((va + vb) / 2) end, 6) as smd from g"
)
def e08_standardised_mean_difference(spark, d):
    return rounded(shift.smd(S.shifted(spark, d), FEATURES, "domain", "A", "R"), "smd")


@query(
    LONG + ", g as (select feature, v, count(*) filter (domain = 'A') as a, count(*) filter (domain = 'R') as b from x where v is not null "
    "and domain in ('A', 'R') group by all), w as (select feature, abs(sum(a) over (partition by feature order by v) / sum(a) over "
    "(partition by feature) - sum(b) over (partition by feature order by v) / sum(b) over (partition by feature)) as gap, lead(v) "
    "over (partition by feature order by v) - v as width from g) select feature, round(sum(gap * coalesce(width, 0)), 5) as "
    "wasserstein from w group by 1"
)
def e09_wasserstein(spark, d):
    return shift.wasserstein(S.shifted(spark, d), FEATURES, "domain", "A", "R").withColumn("wasserstein", F.round("wasserstein", 5))


@query(
    S.ctes("shifted") + " select domain, " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p}), 6) as p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    ) + " from shifted group by 1"
)
def e10_percentiles(spark, d):
    return rounded(
        shift.percentiles(S.shifted(spark, d), ["domain"], "l_extendedprice"), *[f"p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99)],
    )


@query(LONG + " select domain, feature, round(avg((v is not null)::int), 6) as availability from x group by all")
def e06_availability(spark, d):
    return rounded(shift.availability(S.shifted(spark, d), ["domain"], FEATURES), "availability")


@query(
    LONG + ", a as (select domain, feature, avg((v is not null)::int) as availability from x group by all) select feature, "
    "round(min(availability), 6) as lo, round(max(availability), 6) as hi, min(availability) >= 0.8 and round(max(availability) - "
    "min(availability), 12) <= 0.2 as included from a group by 1"
)
def c26_common_core(spark, d):
    return rounded(shift.common_core(S.shifted(spark, d), FEATURES, "domain"), "lo", "hi")


@query(
    S.ctes("shifted") + ", m as (select 'returned' as domain, * exclude domain from shifted where domain = 'R' union all select 'returned_or_accepted', "
    "* exclude domain from shifted where domain in ('R', 'A')) select domain, count(*) as rows, count(distinct unit) as units, "
    "count(*) filter (true_label = 1) as positives, count(*) filter (true_label = 0) as controls, round(avg(((l_quantity is "
    "null)::int + (l_extendedprice is null)::int + (l_discount is null)::int) / 3), 6) as missingness from m group by 1"
)
def e31_domain_profile(spark, d):
    return rounded(
        shift.domain_profile(
            S.shifted(spark, d), {"returned": ["R"], "returned_or_accepted": ["R", "A"]}, "domain", "unit", "true_label", FEATURES,
        ),
        "missingness",
    )


@query(
    S.ctes("scores") + " select model_name, min(predicted_probability) as lo, round(avg(predicted_probability), 6) as mean, max(predicted_probability) "
    "as hi, round(avg((predicted_probability >= 0.5)::int), 6) as above, " + ", ".join(
        f"round(quantile_cont(predicted_probability, {p}), 6) as p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    ) + " from scores group by 1"
)
def e36_score_profile(spark, d):
    return rounded(
        shift.score_profile(S.scores(spark, d), ["model_name"]), "mean", "above", *[f"p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99)],
    )


@query(
    LONG + ", g as (select feature, avg(v) filter (domain = 'A') as ma, avg(v) filter (domain = 'R') as mb, var_pop(v) filter (domain = "
    "'A') as va, var_pop(v) filter (domain = 'R') as vb, avg((v is null)::int) as missing from x group by 1) select feature, "
    "cast(length(feature) as bigint) as importance, round(abs(ma - mb) / sqrt((va + vb) / 2), 6) as smd, round(missing, 6) as "
    "missing from g"
)
def i16_importance_shift(spark, d):
    s = S.shifted(spark, d)
    a = shift.availability(s.withColumn("one", F.lit(1)), ["one"], FEATURES).select("feature", (1 - F.col("availability")).alias("missing"))
    m = shift.smd(s, FEATURES, "domain", "A", "R")
    return rounded(
        shift.importance_shift(m.select("feature", F.length("feature").cast("long").alias("importance")), m, a), "smd", "missing",
    )


@query(
    S.ctes("shifted") + " select domain, count(*) as rows, cast(sum((l_discount is null)::int) as bigint) as missing from shifted group by 1"
)
def c23_missing_flags(spark, d):
    s = shift.add_missing_flags(S.shifted(spark, d), ["l_discount"])
    return s.groupBy("domain").agg(F.count("*").alias("rows"), F.sum("l_discount_missing").alias("missing"))


@query("select count(l_quantity) as l_quantity, count(l_extendedprice) as l_extendedprice from lineitem")
def c24_drop_all_null(spark, d):
    s = S.shifted(spark, d).withColumn("empty", F.lit(None).cast("double"))
    kept = shift.present_columns(s, ["l_quantity", "empty", "l_extendedprice"])
    return s.agg(*[F.count(c).alias(c) for c in kept])


@query(
    S.ctes("scores") + ", f as (select lake_uid as fold, min(matched_event_id) as split_name from scores where true_label = 1 group by 1) select "
    "f.fold, f.split_name, s.lake_uid = f.fold as is_test, count(*) as rows from scores s, f group by all"
)
def k01_leave_one_group_out(spark, d):
    s = S.scores(spark, d).drop("fold")
    return splits.fold_sizes(s, splits.group_folds(s, y="true_label"))


@query("select year(o_orderdate) > 1998 as is_test, count(*) as rows from orders group by 1")
def k02_chronological_split(spark, d):
    return splits.chronological(S.table(spark, d, "orders"), "o_orderdate", 1998).groupBy("is_test").agg(F.count("*").alias("rows"))


# Groups in falling spread of their class counts, each to the fold that keeps the classes' shares most even.
FOLDS = """g as (select lake_uid, count(*) filter (coalesce(matched_event_id like 'e1%', false)) as pos, count(*) - pos as neg from scores group by 1),
t as (select greatest(sum(neg), 1) as tn, greatest(sum(pos), 1) as tp from g),
o as (select *, row_number() over (order by -abs(neg - pos) / 2.0::double, cast(lake_uid as varchar)) as r from g),
walk as (with recursive w(r, lake_uid, f, ns, ps) as (select 0::bigint, null::bigint, null::int, [0::double, 0, 0], [0::double, 0, 0] union all
select o.r, o.lake_uid, best.f, list_transform(w.ns, lambda x, i: x + case when i - 1 = best.f then o.neg else 0 end), list_transform(w.ps, lambda x, i: x + case when i - 1 = best.f then o.pos else 0 end)
from w join o on o.r = w.r + 1, t, lateral (select f from (select cast(f as int) as f, list_transform(w.ns, lambda x, i: (x + case when i - 1 = f then o.neg else 0 end) / t.tn) as a, list_transform(w.ps, lambda x, i: (x + case when i - 1 = f then o.pos else 0 end) / t.tp) as b,
w.ns[f + 1] + w.ps[f + 1] as size from range(3) v(f)) order by round((list_stddev_pop(a) + list_stddev_pop(b)) / 2, 12), size, f limit 1) best) select lake_uid, f from w where r > 0)"""


@query(
    S.ctes("scores") + ", " + FOLDS + " select f as fold, sum(pos + neg)::bigint as rows, sum(pos)::bigint as positives, count(*) as groups from walk join g using "
    "(lake_uid) group by 1"
)
def k03_stratified_groups(spark, d):
    s = S.scores(spark, d).drop("fold").withColumn(
        "true_label", F.coalesce(F.col("matched_event_id").like("e1%"), F.lit(False)).cast("int"),
    )
    out = splits.stratified_groups(s, y="true_label")
    return out.groupBy("fold").agg(
        F.count("*").alias("rows"), F.count_if(F.col("true_label") == 1).alias("positives"), F.countDistinct("lake_uid").alias("groups"),
    )


@query(
    "select r.r_name as fold, r2.r_name = r.r_name as is_test, count(*) as rows from customer c join nation n on n_nationkey = "
    "c_nationkey join region r2 on n_regionkey = r2.r_regionkey, region r where r.r_regionkey in (select n_regionkey from nation "
    "join customer on n_nationkey = c_nationkey) group by all"
)
def k04_leave_one_region_out(spark, d):
    n = S.table(spark, d, "nation").join(F.broadcast(S.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = S.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return splits.regions(c, "r_name").groupBy("fold", "is_test").agg(F.count("*").alias("rows"))


@query(
    S.ctes("scores") + ", w as (select *, 1.0::double / count(*) over (partition by lake_uid) as w from scores), t as (select count(*) as n, "
    "count(distinct true_label) as k from w), c as (select true_label, sum(w) as s from w group by 1) select w.true_label, count(*) "
    "as rows, round(sum(w.w * t.n / (t.k * c.s)), 4) as weight from w join c using (true_label), t group by 1"
)
def k12_sample_weights(spark, d):
    return splits.sample_weights(S.scores(spark, d)).groupBy("true_label").agg(
        F.count("*").alias("rows"), F.round(F.sum("weight"), 4).alias("weight"),
    )


@query(
    S.ctes("scores") + ", g as (select nullif(lake_uid, 0) as g, count(*) as n, count(*) filter (matched_event_id like 'e1%') as p from scores group by "
    "1) select count(*) filter (g is not null) as groups, count(*) filter (g is not null and p > 0) as positive_groups, count(*) "
    "filter (g is not null and p = 0) as negative_only_groups, cast(coalesce(sum(n) filter (g is null), 0) as bigint) as "
    "null_group_rows from g"
)
def k23_group_integrity(spark, d):
    s = S.scores(spark, d).withColumns(
        {
            "true_label": F.coalesce(F.col("matched_event_id").like("e1%"), F.lit(False)).cast("int"),
            "lake_uid": F.when(F.col("lake_uid") != 0, F.col("lake_uid")),
        }
    )
    return splits.group_integrity(s, y="true_label")


@query(
    "select event_type, count(*) as rows, count(distinct user_id) as users, round(sum(value), 4) as total, round(avg(value), 6) as "
    "mean, min(value) as lo, max(value) as hi from events group by 1"
)
def e01_group_aggregates(spark, d):
    e = S.table(spark, d, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"),
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )


@query("select o_orderpriority, count(*) as rows, count(*) filter (o_orderstatus = 'F') as finished from orders group by 1")
def e05_conditional_counts(spark, d):
    return S.table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )


@query(
    "select 'c_acctbal' as column, avg((c_acctbal is null)::int) as null_rate from customer union all select 'odd', avg((c_custkey % "
    "2 = 0)::int) from customer"
)
def e06_null_rates(spark, d):
    c = S.table(spark, d, "customer").withColumn("odd", F.when(F.col("c_custkey") % 2 != 0, 1))
    return checks.null_rates(c, ["c_acctbal", "odd"])


@query(
    "with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, "
    "o_orderkey) as r from orders) select o_custkey, o_orderkey, o_totalprice from r where r = 1"
)
def e21_first_row(spark, d):
    return upsert.first_by_key(
        S.table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")],
    ).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) = 1)")
def e23_singleton_groups(spark, d):
    return checks.singletons(S.table(spark, d, "orders"), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(
    "select o_custkey, string_agg(o_orderkey, '|' order by o_orderdate, o_orderkey) as members, max_by(o_orderpriority, "
    "(o_totalprice, o_orderkey)) as strongest from orders group by 1"
)
def e24_ordered_members(spark, d):
    m = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), "|",
    )
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(
        m.alias("members"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("strongest"),
    )


FLAG = "select user_id % 9 as g, case when event_id % 7 = 0 then null else event_id % 2 = 0 end as a from events"


@query(
    f"with x as ({FLAG}) select g, 'a' as flag, count(*) filter (a) as trues, count(*) filter (not a) as falses, count(*) filter (a "
    "is null) as nulls from x group by 1"
)
def e32_flag_sets(spark, d):
    e = S.table(spark, d, "events").select(
        (F.col("user_id") % 9).alias("g"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 2 == 0).alias("a"),
    )
    return checks.flag_sets(e, "g", ["a"]).drop("values")


@query(
    "select 'c_acctbal' as column, min(c_acctbal) as lo, max(c_acctbal) as hi, count(*) filter (isinf(c_acctbal)) as infinite, "
    "count(*) filter (c_acctbal < 0) as negative, count(*) filter (c_acctbal is null) as nulls from customer"
)
def e32_value_ranges(spark, d):
    return checks.value_ranges(S.table(spark, d, "customer"), ["c_acctbal"])


# Feeds under ids moved by 5 and by 11, so that some entities lack one or both.
@query(
    S.ctes("f_weather", "f_snow")
    + ", w as (select lake_uid + 5 as lake_uid, count(*) as n from f_weather group by 1), s as (select lake_uid + 11 as lake_uid, "
    "count(*) as n from f_snow group by 1) "
    "select lake_uid, coalesce(w.n, 0) as weather, coalesce(s.n, 0) as snow, concat_ws(',', case when w.n > 0 then 'weather' end, "
    "case when s.n > 0 then 'snow' end) as modalities from (select distinct user_id as lake_uid from events) left join w using "
    "(lake_uid) left join s using (lake_uid)"
)
def e30_modality_coverage(spark, d):
    e = S.table(spark, d, "events").select(F.col("user_id").alias("lake_uid"))
    out = checks.coverage(
        e, {n: S.feed(spark, d, n).withColumn("lake_uid", F.col("lake_uid") + k) for n, k in (("weather", 5), ("snow", 11))},
    )
    return out.withColumn("modalities", F.array_join("modalities", ","))


@query("select o_orderstatus as source, o_orderpriority as dedup_status, count(*) as rows from orders group by all")
def e29_reconciliation_counts(spark, d):
    return S.table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("dedup_status"),
    ).agg(F.count("*").alias("rows"))


@query(
    "select count(*) as rows, count(distinct o_orderkey) as ids, count(o_orderstatus) as with_status, count(*) = count(distinct "
    "o_orderkey) as ids_unique, count(*) = count(o_orderstatus) as adds_up from orders"
)
def e35_match_accounting(spark, d):
    return checks.accounting(S.table(spark, d, "orders"), "o_orderstatus", "o_orderkey")


@query(
    "select user_id, day, count(*) as rows from (select user_id, cast(ts as date) as day from events) group by all order by user_id "
    "desc, day limit 50"
)
def f11_sort_and_limit(spark, d):
    e = S.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    return e.orderBy(F.col("user_id").desc(), "day").limit(50)


@query(
    "select id, price, status from (select o_orderkey as id, o_totalprice as price, null as status from orders union all select "
    "o_orderkey, null, o_orderstatus from orders)"
)
def g01_union_ragged(spark, d):
    o = S.table(spark, d, "orders")
    return upsert.union_ragged(
        o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")),
        o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
    )


@query("select distinct user_id, cast(ts as date) as day from events")
def g02_union_distinct(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return e.union(e).distinct()


@query(
    "select user_id, day from (select distinct user_id from events), (select unnest(generate_series(date '2024-01-01', date "
    "'2024-01-30', interval 1 day))::date as day) except select user_id, cast(ts as date) from events where event_type = 'view'"
)
def g03_except_dates(spark, d):
    need = S.grid(spark, d).select(F.col("lake_uid").alias("user_id"), F.to_date("reference_timestamp").alias("day"))
    return need.subtract(S.table(spark, d, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day")))


@query(
    "select user_id from events where event_type = 'error' and value > 97 intersect select user_id from events where event_type = "
    "'view' and value > 97"
)
def g04_intersect_groups(spark, d):
    e = S.table(spark, d, "events").where("value > 97")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'view'").select("user_id"))


@query("select s_suppkey::varchar as lake_uid, s_nationkey as country, s_acctbal as elevation_m, s_name as extra from supplier")
def c01_canonical(spark, d):
    """Canonical columns first, in their order; others after them."""
    from tarnwatch.operators import inventory

    s = S.table(spark, d, "supplier").select(
        F.col("s_name").alias("extra"), F.col("s_acctbal").alias("elevation_m"), F.col("s_nationkey").alias("country"),
        F.col("s_suppkey").cast("string").alias("lake_uid"),
    )
    out = inventory.canonical(s)
    assert out.columns == ["lake_uid", "country", "elevation_m", "extra"]
    return out


@query(
    "select event_type, count(*) as rows, count(*) filter (event_id % 2 = 0) as current, count(*) filter (event_id % 2 <> 0) as "
    "cached from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-11 23:59:59' group by 1"
)
def c22_date_range(spark, d):
    from tarnwatch.operators import predicates

    e = S.table(spark, d, "events").withColumn("run_id", (F.col("event_id") % 2).cast("string")).where(
        predicates.in_dates("ts", "2024-01-05", "2024-01-11")
    )
    return e.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("run_id") == "0").alias("current"), F.count_if(F.col("run_id") != "0").alias("cached"),
    )


@query("select count(l_quantity) as l_quantity, count(l_shipdate) as l_shipdate, count(l_extendedprice) as l_extendedprice from lineitem")
def c25_columns_like(spark, d):
    x = S.table(spark, d, "lineitem")
    return x.agg(*[F.count(c).alias(c) for c in shift.columns_like(x.columns, ("l_quant", "l_shipd"), ("price",))])


@query("select unnest(['l_comment_of_the_future', 'l_quantity']) as name, unnest([false, true]) as forbidden")
def c27_forbidden_columns(spark, d):
    x = S.table(spark, d, "lineitem")
    names = ["l_quantity", "l_comment_of_the_future"]
    bad = checks.forbidden(x, names)
    return spark.createDataFrame([(n, n in bad) for n in names], "name string, forbidden boolean")


@query(
    "select case when event_id % 3 = 0 then 'temporal' when event_id % 3 = 1 then 'availability' else 'static' end as family, "
    "count(*) as rows from events group by 1"
)
def c29_feature_families(spark, d):
    from tarnwatch.operators import predicates

    f = F.element_at(
        F.array(F.lit("precip_sum_7d"), F.lit("weather_coverage"), F.lit("elevation_m")), (F.col("event_id") % 3 + 1).cast("int"),
    )
    e = S.table(spark, d, "events").select(f.alias("feature"))
    return e.groupBy(predicates.family().alias("family")).agg(F.count("*").alias("rows"))


@query(
    "select case event_id % 4 when 0 then 3 when 1 then 7 when 2 then 14 else 30 end as horizon_days, count(*) as rows from events "
    "where event_type in ('error', 'view') group by 1"
)
def c32_validation_rows(spark, d):
    from tarnwatch.operators import predicates

    h = F.element_at(F.array(*map(F.lit, (3, 7, 14, 30))), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "POSITIVE").when(
        F.col("event_type") == "view", "NEGATIVE_ELIGIBLE",
    ).otherwise("EVENT_WINDOW_EXCLUDED")
    e = S.table(spark, d, "events").select(h.alias("horizon_days"), status.alias("label_status"))
    out = None
    for n in (3, 7, 14, 30):
        own = e.where(predicates.cross_validation_rows(n)).groupBy("horizon_days").agg(F.count("*").alias("rows"))
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "select event_id % 7 as run, case when max(case when event_type = 'error' then event_id end) is null then 'UNKNOWN' else 'S' || "
    "(max(case when event_type = 'error' then event_id end) % 5) end as status from events group by 1"
)
def i17_run_status(spark, d):
    """The last status line of each stage's log."""
    line = F.when(
        F.col("event_type") == "error", F.concat(F.lit("[STATUS] S"), (F.col("event_id") % 5).cast("string")),
    ).otherwise("working")
    log = S.table(spark, d, "events").select((F.col("event_id") % 7).alias("run"), F.col("event_id").alias("n"), line.alias("line"))
    return checks.run_status(log, "run")


@query("select k as run, k % 2 = 1 and k // 2 % 2 = 1 and k // 4 % 2 = 1 and k // 8 % 2 = 1 as complete from range(16) t(k)")
def i17_completion(spark, d):
    """Sixteen runs in which each of four kinds of stage came out well or failed."""
    stages = ("dem", "modis", "quality_control", "leakage_test")
    rows = [(k, s, ("PARTIAL" if i else "SUCCESS") if k >> i & 1 else "FAILED") for k in range(16) for i, s in enumerate(stages)]
    return checks.completion(spark.createDataFrame(rows, "run long, stage string, status string"), ["run"])


@query(
    "select c_custkey as id, case when c_custkey % 7 = c_custkey % 5 then round(2.0 * least(3 + c_custkey % 4, 3 + c_custkey % 6) / "
    "(6 + c_custkey % 4 + c_custkey % 6), 6)::double else 0 end as ratio from customer"
)
def h03_name_similarity(spark, d):
    """Names of one letter each, of different lengths."""
    from tarnwatch.operators import resolve

    word = lambda k, n: F.repeat(F.char(97 + F.col("c_custkey") % k), (3 + F.col("c_custkey") % n).cast("int"))
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), word(7, 4).alias("a"), word(5, 6).alias("b"))
    return c.select("id", F.round(resolve.name_ratio()("a", "b"), 6).alias("ratio"))


@query(
    "select o_custkey, count(*) as n, list_sum(list_transform(list_sort(list(o_totalprice)), lambda x: floor(x)))::bigint as floors, "
    "max_by(o_orderpriority, o_orderkey) as last from orders group by 1"
)
def h11_arrays_and_maps(spark, d):
    o = S.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("o_totalprice")).alias("p"),
        F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m"),
    )
    floors = F.aggregate(F.transform("p", lambda x: F.floor(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return o.select(
        "o_custkey", F.size("p").cast("long").alias("n"), floors.alias("floors"), F.col("m")[F.array_max(F.map_keys("m"))].alias("last"),
    )
