"""Queries: grids, as-of alignment, windows, upserts, features, labels, matrix."""

import uuid

from pyspark.sql import functions as F

from tarnwatch.functions.storage import folder
from tarnwatch.operators import buckets, checks, features, labels, timeops, upsert
from tarnwatch.plans import standins as S
from tarnwatch.plans.register import registry

QUERIES, ORACLES, query = registry()
LAUNCH = {"weather": "2024-01-05", "satellite": "2024-01-20"}


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def feeds(spark, d, names=tuple(S.FEEDS)):
    return {n: S.feed(spark, d, n) for n in names}


def asof_sql(name: str) -> str:
    return f"asof left join f_{name} {name} on g.lake_uid = {name}.lake_uid and g.reference_timestamp >= {name}.observation_timestamp"


def age_sql(n: str) -> str:
    return f"(epoch_us(g.reference_timestamp) - epoch_us({n}.observation_timestamp)) / 3600000000.0::double"


ALIGNED = S.ctes("grid", *[f"f_{n}" for n in S.FEEDS]) + ", aligned as (select g.lake_uid, g.reference_timestamp, " + ", ".join(
    f"{n}.observation_timestamp as {n}_timestamp, {age_sql(n)} as {n}_observation_age_hours, coalesce({age_sql(n)} <= 24, false) as "
    f"actual_{n}_observation, coalesce({age_sql(n)} > {m}, false) as {n}_stale, {n}.observation_id as {n}_observation_id, case when "
    f"not coalesce({age_sql(n)} > {m}, false) then {n}.value end as {n}_value"
    for n, m in timeops.MAX_AGE_H.items()
) + " from grid g " + " ".join(asof_sql(n) for n in S.FEEDS) + ")"


def aligned(spark, d):
    return timeops.align(S.grid(spark, d), feeds(spark, d))


@query(
    ALIGNED + " select reference_timestamp, " + ", ".join(
        f"cast(count({n}_timestamp) as bigint) as {n}_matched, cast(count(*) filter (actual_{n}_observation) as bigint) as "
        f"{n}_actual, cast(count(*) filter ({n}_stale) as bigint) as {n}_stale" for n in S.FEEDS
    ) + " from aligned group by reference_timestamp"
)
def i03_align_counts(spark, d):
    a = aligned(spark, d)
    return a.groupBy("reference_timestamp").agg(
        *[
            e for n in S.FEEDS for e in (
                F.count(f"{n}_timestamp").alias(f"{n}_matched"), F.count_if(f"actual_{n}_observation").alias(f"{n}_actual"),
                F.count_if(f"{n}_stale").alias(f"{n}_stale"),
            )
        ]
    )


@query(
    ALIGNED + " select lake_uid, reference_timestamp, " + ", ".join(
        f"{n}_timestamp, round({n}_observation_age_hours, 6) as {n}_observation_age_hours, actual_{n}_observation, {n}_stale, "
        f"{n}_observation_id, {n}_value" for n in S.FEEDS
    ) + " from aligned"
)
def i03_align(spark, d):
    return rounded(aligned(spark, d), *[f"{n}_observation_age_hours" for n in S.FEEDS])


@query(
    S.ctes("grid", "f_weather") + " select g.lake_uid, g.reference_timestamp, w.observation_id, w.value from grid g asof left join f_weather w on g.lake_uid = "
    "w.lake_uid and g.reference_timestamp >= w.observation_timestamp"
)
def d05_asof_backward(spark, d):
    return timeops.asof(S.grid(spark, d), feeds(spark, d, ("weather",))).select(
        "lake_uid", "reference_timestamp", "weather.observation_id", "weather.value",
    )


@query(S.ctes("grid") + " select * from grid")
def i01_reference_grid(spark, d):
    return S.grid(spark, d)


@query(
    S.ctes("hazards") + " select distinct lake_uid, unnest(generate_series(date_trunc('day', event_ts) - interval 45 day, date_trunc('day', event_ts) + "
    "interval 45 day, interval 1 day))::timestamp as reference_timestamp from hazards"
)
def i02_event_grid(spark, d):
    return timeops.event_grid(S.hazards(spark, d))


def frame_sql(days: int, closed: bool = False) -> str:
    lo = f"interval {days} day" if closed else f"interval '{days - 1} days 23:59:59.999999'"
    return f"over (partition by lake_uid order by observation_timestamp range between {lo} preceding and current row)"


def before_sql(table: str, value: str, days: int) -> str:
    return f"(select max_by({value}, observation_timestamp) from {table} p where p.lake_uid = o.lake_uid and p.observation_timestamp <= o.observation_timestamp - interval {days} day)"


WEATHER_SQL = ", ".join(
    f"round({'avg' if k == 'mean' else k}({c}) {frame_sql(n)}, 6) as {name}" for name, (k, c, n) in features.WEATHER.items()
)


@query(
    S.ctes("weather") + f", w as (select observation_id, lake_uid, {WEATHER_SQL} from weather), b as (select o.observation_id, " + ", ".join(f"round(o.temperature_2m_c - p{n}.temperature_2m_c, 6) as temperature_change_{n}d" for n in (1, 7)) + " from weather o " + " ".join(
        f"asof left join weather p{n} on o.lake_uid = p{n}.lake_uid and o.observation_timestamp - interval {n} day >= "
        f"p{n}.observation_timestamp" for n in (1, 7)
    ) + ") select w.*, b.temperature_change_1d, b.temperature_change_7d from w join b using (observation_id)"
)
def i05_weather_features(spark, d):
    out = features.engineer_weather(S.weather(spark, d))
    names = [*features.WEATHER, "temperature_change_1d", "temperature_change_7d"]
    return rounded(out.select("observation_id", "lake_uid", *names), *names)


@query(
    S.ctes("f_satellite") + ", o as (select * from f_satellite) select o.observation_id, " + ", ".join(f"round(o.value - p{n}.value, 6) as lake_area_change_{n}d" for n in (7, 30, 90, 365)) + ", t.lake_area_trend_30d, t.lake_area_trend_90d from o " + " ".join(f"asof left join f_satellite p{n} on o.lake_uid = p{n}.lake_uid and o.observation_timestamp - interval {n} day >= p{n}.observation_timestamp" for n in (7, 30, 90, 365)) + " join (select observation_id, " + ", ".join(
        f"case when count(value) {frame_sql(n, True)} >= 3 then round(regr_slope(value, epoch_us(observation_timestamp) / "
        f"86400000000.0::double) {frame_sql(n, True)}, 4) end as lake_area_trend_{n}d" for n in (30, 90)
    ) + " from f_satellite) t on o.observation_id = t.observation_id"
)
def i06_satellite_features(spark, d):
    out = features.engineer_satellite(S.feed(spark, d, "satellite", "lake_area_km2"))
    changes, trends = [f"lake_area_change_{n}d" for n in (7, 30, 90, 365)], [f"lake_area_trend_{n}d" for n in (30, 90)]
    return rounded(out.select("observation_id", *changes, *trends), *changes).withColumns({c: F.round(c, 4) for c in trends})


@query(
    S.ctes("f_weather") + f" select observation_id, round(avg(value) {frame_sql(3)}, 6) as mean_3d, round(sum(value) {frame_sql(7)}, 6) as sum_7d, "
    f"min(value) {frame_sql(3)} as min_3d, max(value) {frame_sql(3)} as max_3d, cast(count(value) {frame_sql(30)} as bigint) as "
    "count_30d from f_weather"
)
def f01_rolling_windows(spark, d):
    out = timeops.rolling(
        S.feed(spark, d, "weather"),
        {
            "mean_3d": ("mean", "value", 3), "sum_7d": ("sum", "value", 7), "min_3d": ("min", "value", 3), "max_3d": ("max", "value", 3),
            "count_30d": ("count", "value", 30),
        },
    )
    return rounded(out.drop("lake_uid", "observation_timestamp", "value"), "mean_3d", "sum_7d")


@query(
    S.ctes("f_snow") + " select lake_uid, reference_timestamp from (with recursive k(lake_uid, t) as (select lake_uid, min(observation_timestamp) from "
    "f_snow group by lake_uid union all select k.lake_uid, (select min(s.observation_timestamp) from f_snow s where s.lake_uid = "
    "k.lake_uid and s.observation_timestamp >= k.t + interval 24 hour) from k where k.t is not null) select lake_uid, t as "
    "reference_timestamp from k where t is not null)"
)
def f13_greedy_spacing(spark, d):
    return timeops.greedy_spacing(S.feed(spark, d, "snow").withColumnRenamed("observation_timestamp", "reference_timestamp"))


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (partition by l_orderkey, "
    "l_linenumber order by case when l_shipdate >= timestamp '1998-01-01' then 1 else 0 end desc, l_shipdate desc, l_partkey desc, "
    "l_suppkey desc, l_quantity desc) as r from lineitem) where r = 1"
)
def b01_upsert_keep_last(spark, d):
    x = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    new = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    order = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return upsert.upsert(x.where(~new), x.where(new), ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


# The old lines make the table, the new ones come in two more versions, the last of them a second time.
@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate from (select *, row_number() over (partition by l_orderkey, "
    "l_linenumber order by case when l_shipdate >= timestamp '1998-06-01' then 2 when l_shipdate >= timestamp '1998-01-01' then 1 else 0 end desc, "
    "l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc) as r from lineitem) where r = 1"
)
def b01_bucketed(spark, d):
    x = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    at, part = lambda t: F.lit(t).cast("timestamp_ntz"), F.col("l_shipdate")
    order = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    path = folder(spark, "bucketed-" + uuid.uuid4().hex)
    late = (part >= at("1998-01-01")) & (part < at("1998-06-01"))
    for k, rows in enumerate((F.coalesce(part < at("1998-01-01"), F.lit(True)), late, part >= at("1998-06-01"), part >= at("1998-06-01"))):
        buckets.upsert(x.where(rows), path, ["l_orderkey", "l_linenumber"], order, label=f"load:{min(k, 2)}")
    return buckets.read(spark, path)


# A third of the orders replaces the rest's customers where its own is even; the odd ones are new customers.
@query(
    "with old as (select * from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, o_custkey + case when o_custkey % 2 = "
    "0 then 0 else 10000000 end as o_custkey, o_totalprice from orders where o_orderkey % 3 = 0) "
    "select o_orderkey, o_custkey, o_totalprice from old where o_custkey not in (select o_custkey from new) union all select "
    "o_orderkey, o_custkey, o_totalprice from new"
)
def b02_replace_keys(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = F.col("o_custkey") + F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(10_000_000)
    return upsert.replace_keys(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0").withColumn("o_custkey", customer), "o_custkey")


@query(
    "with a as (select o_orderkey as id, o_totalprice as price from orders), b as (select o_orderkey + case when o_orderkey % 2 = 0 "
    "then 0 else 10000000 end as id, o_orderstatus as status from orders) "
    "select id, price, status from (select *, row_number() over (partition by id order by gen desc) as r from (select id, price, "
    "null as status, 0 as gen from a union all select id, null, status, 1 from b)) where r = 1"
)
def b04_merge_idempotent(spark, d):
    o = S.table(spark, d, "orders")
    half = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(10_000_000)
    a, b = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
    ), o.select(half.alias("id"), F.col("o_orderstatus").alias("status"))
    once = upsert.upsert(a, b, ["id"])
    return upsert.upsert(once, b, ["id"])


@query("select count(*) as rows, true as repeats, true as notices from orders")
def k19_table_digest(spark, d):
    """The digest of a table is that of the same rows in another order, and not that of changed rows."""
    o = S.table(spark, d, "orders")
    a, b = upsert.table_digest(o), upsert.table_digest(o.repartition(7, "o_custkey"))
    c = upsert.table_digest(o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == 1, 1).otherwise(0)))
    met = a.join(
        b.withColumnsRenamed({"rows": "r2", "digest": "d2"}), how="cross",
    ).join(c.withColumnsRenamed({"rows": "r3", "digest": "d3"}), how="cross")
    return met.select("rows", (F.col("digest") == F.col("d2")).alias("repeats"), (F.col("digest") != F.col("d3")).alias("notices"))


@query(S.ctes("weather", "f_satellite") + """, w as (select lake_uid, count(*) as n, avg(temperature_2m_c) as m, stddev_samp(temperature_2m_c) as s, avg(precipitation_mm) as p, min(observation_timestamp) as lo, max(observation_timestamp) as hi from weather where temperature_2m_c is not null group by 1),
s as (select lake_uid, count(*) as n, avg(value) as m, stddev_samp(value) as s, min(observation_timestamp) as lo, max(observation_timestamp) as hi from f_satellite where value is not null group by 1)
select l.lake_uid, round(case when s.n >= 15 then s.m end, 6) as baseline_area_km2, round(case when s.n >= 15 then s.s end, 6) as area_std_km2, round(case when w.n >= 15 then w.m end, 6) as baseline_temperature_c, round(case when w.n >= 15 then w.s end, 6) as temperature_std_c, round(case when w.n >= 15 then w.p end, 6) as baseline_precipitation_mm,
least(w.lo, s.lo) as baseline_period_start, greatest(w.hi, s.hi) as baseline_period_end, coalesce(w.n, 0) as sample_count_wx, coalesce(s.n, 0) as sample_count_sat, case when coalesce(w.n, 0) >= 15 or coalesce(s.n, 0) >= 15 then 'good' else 'insufficient_sample' end as baseline_quality_flag
from (select distinct user_id as lake_uid from events) l left join w using (lake_uid) left join s using (lake_uid)""")
def i07_baselines(spark, d):
    e = S.table(spark, d, "events").select(F.col("user_id").alias("lake_uid"))
    out = features.baselines(e, S.weather(spark, d), S.feed(spark, d, "satellite", "lake_area_km2"), 15, 15)
    return rounded(out, "baseline_area_km2", "area_std_km2", "baseline_temperature_c", "temperature_std_c", "baseline_precipitation_mm")


@query(
    S.ctes("hazards", "f_weather", "f_satellite") + ", g as (select distinct lake_uid, unnest(generate_series(date_trunc('day', event_ts) - interval 45 day, date_trunc('day', "
    "event_ts) + interval 45 day, interval 1 day))::timestamp as reference_timestamp from hazards) select g.lake_uid, "
    "g.reference_timestamp, weather.observation_timestamp as weather_timestamp, round(" + age_sql("weather") + ", 6) as weather_age_hours, weather.value as temperature, satellite.observation_timestamp as satellite_timestamp, round(" + age_sql("satellite") + ", 6) as satellite_age_hours, satellite.value as area, g.reference_timestamp < timestamp '2024-01-05' as "
    "sensor_weather_unavailable, g.reference_timestamp < timestamp '2024-01-20' as sensor_satellite_unavailable from g " + asof_sql("weather") + " " + asof_sql("satellite")
)
def i04_historical_archive(spark, d):
    out = features.historical_archive(
        S.hazards(spark, d), {"weather": S.feed(spark, d, "weather", "temperature"), "satellite": S.feed(spark, d, "satellite", "area")},
        LAUNCH,
    )
    return rounded(out, "weather_age_hours", "satellite_age_hours")


@query(S.ctes("hazards", "f_weather", "f_satellite") + """, need as (select event_id, lake_uid, source, greatest(date_trunc('day', event_ts)::date - 45, launch) as lo, date_trunc('day', event_ts)::date + 45 as hi from hazards, (values ('weather', date '2024-01-05'), ('satellite', date '2024-01-20')) v(source, launch)),
days as (select event_id, lake_uid, source, unnest(generate_series(lo, hi, interval 1 day))::date as day from need where lo <= hi),
have as (select distinct lake_uid, 'weather' as source, observation_timestamp::date as day from f_weather union select distinct lake_uid, 'satellite', observation_timestamp::date from f_satellite)
select d.event_id, d.lake_uid, d.source, min(case when h.day is null then d.day end) as fetch_from, max(case when h.day is null then d.day end) as fetch_to, count(*) filter (h.day is null) as missing_days, count(h.day) as covered_days from days d left join have h using (lake_uid, source, day) group by all""")
def i11_missing_intervals(spark, d):
    covered = None
    for s in LAUNCH:
        f = S.feed(spark, d, s).select("lake_uid", F.lit(s).alias("source"), F.col("observation_timestamp").alias("day"))
        covered = f if covered is None else covered.unionByName(f)
    return features.missing_intervals(S.hazards(spark, d), covered, LAUNCH)


LABEL_SQL = S.ctes("grid", "hazards", "f_weather") + f""", aged as (select g.lake_uid, g.reference_timestamp, {age_sql('weather')} as weather_age_hours from grid g {asof_sql('weather')}),
met as (select a.*, h.horizon_days from aged a, (values (3), (7), (14)) h(horizon_days)),
labelled as (select m.lake_uid, m.reference_timestamp, m.horizon_days,
  count(*) filter (e.event_ts > m.reference_timestamp and e.event_ts <= m.reference_timestamp + to_days(m.horizon_days)) as n,
  min_by(e.event_id, (e.event_ts, e.event_id)) filter (e.event_ts > m.reference_timestamp and e.event_ts <= m.reference_timestamp + to_days(m.horizon_days)) as matched_event_id,
  coalesce(bool_or(e.event_ts - interval 5 day <= m.reference_timestamp and m.reference_timestamp <= e.event_ts + interval 5 day), false) as zone, any_value(m.weather_age_hours) as age
  from met m left join hazards e on e.lake_uid = m.lake_uid group by all),
labels_ as (select *, case when n > 0 then 'POSITIVE' when zone then 'EVENT_WINDOW_EXCLUDED' when lake_uid % 11 = 0 then 'GEOGRAPHICALLY_UNRESOLVED' when age is null or age > 72 then 'INSUFFICIENT_FEATURE_COVERAGE' else 'NEGATIVE_ELIGIBLE' end as label_status from labelled)"""


def labelled(spark, d):
    aged = timeops.align(S.grid(spark, d), {"weather": S.feed(spark, d, "weather")}).select(
        "lake_uid", "reference_timestamp", F.col("weather_observation_age_hours").alias("weather_age_hours"),
    )
    vague = S.table(spark, d, "events").where("user_id % 11 = 0").select(F.col("user_id").alias("lake_uid"))
    return labels.label(aged, S.hazards(spark, d), vague, (3, 7, 14), 5, 5)


@query(
    LABEL_SQL + " select lake_uid, reference_timestamp, horizon_days, reference_timestamp as horizon_start, reference_timestamp + "
    "to_days(horizon_days) as horizon_end, label_status, case when n > 0 then 1 else 0 end as event_within_horizon, "
    "matched_event_id, n as event_count_within_horizon from labels_"
)
def i08_labels(spark, d):
    return labelled(spark, d)


@query(LABEL_SQL + """, met2 as (select p.lake_uid, p.horizon_days, p.reference_timestamp as positive_ts, p.matched_event_id as positive_event_id, c.reference_timestamp as control_ts, abs(month(c.reference_timestamp) - month(p.reference_timestamp)) as md,
  abs(floor((epoch_us(c.reference_timestamp) - epoch_us(p.reference_timestamp)) / 86400000000.0::double))::bigint as dd from labels_ p join labels_ c on p.lake_uid = c.lake_uid and p.horizon_days = c.horizon_days where p.label_status = 'POSITIVE' and c.label_status = 'NEGATIVE_ELIGIBLE'),
ranked as (select *, row_number() over (partition by lake_uid, horizon_days, positive_ts order by least(md, 12 - md), dd, control_ts) as r from met2)
select substr(sha256(positive_event_id || '_' || lake_uid || '_' || strftime(control_ts, '%Y-%m-%d') || '_' || horizon_days), 1, 12) as control_id, positive_event_id, lake_uid, positive_ts, control_ts as control_reference_timestamp, horizon_days, cast(month(control_ts) as int) as matching_month, cast(year(control_ts) as int) as matching_year, dd as temporal_distance_days, cast(r as int) as selection_rank from ranked where r <= 3""")
def i09_controls(spark, d):
    return labels.controls(labelled(spark, d))


MATRIX = [(n, {"avg": "avg", "max": "max", "min": "min", "sum": "sum"}[f.__name__], c, days) for n, (c, f, days) in labels.FEATURES.items()]


@query(
    LABEL_SQL + ", " + S.SQL["weather"] + " select l.lake_uid, l.reference_timestamp, l.horizon_days, l.label_status, " + ", ".join(
        f"round({f}({c}) filter (w.observation_timestamp > l.reference_timestamp - interval {days} day), 6) as {n}" for n, f, c, days in MATRIX
    ) + ", count(w.lake_uid) as weather_coverage_30d, l.lake_uid % 7 as terrain_slope from labels_ l left join weather w on w.lake_uid = "
    "l.lake_uid and w.observation_timestamp > l.reference_timestamp - interval 30 day and w.observation_timestamp <= "
    "l.reference_timestamp where l.horizon_days = 7 group by all"
)
def i10_feature_matrix(spark, d):
    rows = labelled(spark, d).where("horizon_days = 7").select("lake_uid", "reference_timestamp", "horizon_days", "label_status")
    terrain = S.table(spark, d, "events").select(F.col("user_id").alias("lake_uid")).distinct().withColumn("terrain_slope", F.col("lake_uid") % 7)
    return rounded(labels.feature_matrix(rows, S.weather(spark, d), terrain), *labels.FEATURES)


MATCHED_SQL = "m as (select event_id, user_id as lake_uid, case when event_id % 13 = 0 then 'not a date' else strftime(ts, '%Y-%m-%d') end as event_date, case when event_id % 5 = 0 then 'MANUAL_REVIEW' else 'HIGH_CONFIDENCE_MATCH' end as match_status, case event_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as event_confidence from events where event_type = 'error')"


def matched(spark, d):
    e = S.table(spark, d, "events").where("event_type = 'error'")
    return e.select(
        "event_id", F.col("user_id").alias("lake_uid"),
        F.when(F.col("event_id") % 13 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"),
        F.when(F.col("event_id") % 5 == 0, "MANUAL_REVIEW").otherwise("HIGH_CONFIDENCE_MATCH").alias("match_status"),
        F.when(F.col("event_id") % 3 == 0, "HIGH").when(F.col("event_id") % 3 == 1, "MEDIUM").otherwise("LOW").alias("event_confidence"),
    )


ELIGIBLE_SQL = S.ctes("f_weather") + f""", {MATCHED_SQL}, x as (select *, try_cast(event_date as date)::timestamp as day_, match_status = 'HIGH_CONFIDENCE_MATCH' and event_confidence in ('HIGH', 'MEDIUM') as ok from m),
n as (select x.event_id, count(w.lake_uid) as n from x left join f_weather w on w.lake_uid = x.lake_uid and w.observation_timestamp between x.day_ - interval 2 day and x.day_ + interval 2 day group by 1),
elig as (select x.*, n.n, case when not ok then 'TEMPORALLY_UNLABELABLE' when day_ is null then 'INVALID_DATE' when n.n = 0 then 'TEMPORALLY_UNLABELABLE' else 'LABELABLE' end as st, case when not ok then 'not_high_confidence' when day_ is null then 'unparseable_date' when n.n = 0 then 'no_weather_in_window' else 'ok' end as reason from x join n using (event_id))"""


@query(
    ELIGIBLE_SQL + " select event_id, lake_uid, event_date, st as temporal_eligibility_status, reason, case when day_ is null then 'UNKNOWN' else "
    "'DATE' end as event_time_precision, n as observations from elig"
)
def i12_temporal_eligibility(spark, d):
    return labels.temporal_eligibility(matched(spark, d), S.feed(spark, d, "weather"), 2)


@query(
    ELIGIBLE_SQL + ", audit as (select * from elig where event_id % 4 <> 0) select m.event_id, m.lake_uid, m.match_status, a.st as "
    "temporal_eligibility_status, case when a.st is null then case when m.match_status = 'MANUAL_REVIEW' then "
    "'EXCLUDED_MANUAL_REVIEW' else 'EXCLUDED_NO_LAKE' end when a.st = 'LABELABLE' then 'ELIGIBLE_POSITIVE' else 'EXCLUDED_' || a.st "
    "end as eligibility_status from m left join audit a using (event_id)"
)
def c16_eligibility_status(spark, d):
    m = matched(spark, d)
    audit = labels.temporal_eligibility(m, S.feed(spark, d, "weather"), 2).where("event_id % 4 <> 0")
    return labels.eligible_events(m.select("event_id"), m, audit)


@query(
    S.ctes("hazards", "f_gpm") + " select h.event_id, h.lake_uid, h.event_ts, count(g.lake_uid) as observations from hazards h left join f_gpm g on g.lake_uid = "
    "h.lake_uid and g.observation_timestamp between h.event_ts - interval 3 day and h.event_ts + interval 3 day group by all"
)
def d18_window_coverage(spark, d):
    return labels.window_coverage(S.hazards(spark, d), S.feed(spark, d, "gpm"), 3)


# Observations under ids moved by 3, so that some entities have none.
@query(
    S.ctes("hazards", "f_gpm")
    + ", s as (select lake_uid + 3 as lake_uid, min(observation_timestamp) as observation_min, max(observation_timestamp) as "
    "observation_max, count(*) as observation_count from f_gpm group by 1) "
    "select h.*, s.observation_min, s.observation_max, s.observation_count, case when s.observation_count is null then 'MISSING' "
    "when h.event_ts between s.observation_min and s.observation_max then 'OVERLAPS' else 'NO_OVERLAP' end as overlap_status from "
    "hazards h left join s using (lake_uid)"
)
def i15_event_overlap(spark, d):
    return labels.overlap_status(S.hazards(spark, d), S.feed(spark, d, "gpm").withColumn("lake_uid", F.col("lake_uid") + 3))


@query(
    ALIGNED + " " + " union all ".join(
        f"select '{n}' as source, count(*) filter ({n}_timestamp > reference_timestamp) as violations from aligned" for n in S.FEEDS
    )
)
def i13_leakage_check(spark, d):
    return labels.leakage(aligned(spark, d), list(S.FEEDS))


@query(
    ALIGNED + " " + " union all ".join(
        f"select '{n}_valid' as metric, count({n}_timestamp) as value from aligned union all select '{n}_stale', count(*) filter "
        f"({n}_stale) from aligned" for n in S.FEEDS
    )
)
def i14_quality_report(spark, d):
    return checks.quality_report(aligned(spark, d), list(S.FEEDS))


@query("select l_orderkey, l_linenumber, count(*) as count from lineitem group by all having count(*) > 1")
def f10_duplicate_grain(spark, d):
    return checks.duplicate_grain(S.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l.* from (select distinct user_id as lake_uid from events where user_id % 2 = 0) l")
def a22_run_scope(spark, d):
    scope = S.table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("lake_uid"))
    return S.grid(spark, d).join(scope, "lake_uid", "left_semi").select("lake_uid").distinct()
