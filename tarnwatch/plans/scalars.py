"""Queries: predicates, text, time, hashes, JSON."""

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as X
from tarnwatch.operators import predicates as P
from tarnwatch.plans import standins as S
from tarnwatch.plans.register import registry

QUERIES, ORACLES, query = registry()


@query(
    "select event_id, case when event_id % 10 = 0 or event_id % 7 = 0 then 'rejected' else 'good' end as flag, case when event_id % "
    "10 = 0 or event_id % 7 = 0 then 'missing_values' else 'ok' end as reason, case when value / 100 > 0.8 then 'good' else "
    "'acceptable' end as scene, value <= 50 and event_id % 50 >= 20 as usable, event_id % 4 <> 0 and value - 10 >= 0 as rain_ok from "
    "events"
)
def c05_quality_flags(spark, d):
    e = S.table(spark, d, "events").withColumns(
        {
            "t": F.when(F.col("event_id") % 10 != 0, F.col("value")), "p": F.when(F.col("event_id") % 7 != 0, F.col("value")),
            "f": F.col("value") / 100, "n": F.col("event_id") % 50,
            "r": F.when(F.col("event_id") % 4 != 0, F.col("value") - 10).otherwise(F.lit(float("nan"))),
        }
    )
    flag, reason = P.weather_quality("t", "p")
    return e.select(
        "event_id", flag.alias("flag"), reason.alias("reason"), P.scene_quality("f").alias("scene"),
        P.usable_scene("value", "n").alias("usable"), P.usable_precipitation("r").alias("rain_ok"),
    )


@query(
    "select c_custkey, case when c_custkey % 50 between 6 and 37.5 and 60 + c_custkey % 50 between 68 and 98 then 'normal' else "
    "'outside_expected_range' end as flag, case when c_custkey % 2 = 0 and c_custkey % 50 - 25 < 0 then c_custkey % 50 - 25 + 360 "
    "else c_custkey % 50 - 25 end as lon from customer"
)
def c08_coordinate_flag(spark, d):
    k = F.col("c_custkey")
    c = S.table(spark, d, "customer").select(
        "c_custkey", (k % 50).alias("latitude"), (60 + k % 50).alias("longitude"), (k % 50 - 25).alias("x"),
        F.when(k % 2 == 0, 359.5).otherwise(179.5).alias("top"),
    )
    return c.select("c_custkey", P.coordinate_flag().alias("flag"), P.grid_longitude("x", "top").alias("lon"))


@query(
    "select n_nationkey, regexp_matches(lower(n_name || ' ' || r_name), 'india|china|asia') as mentions, "
    "coalesce(contains(lower(r_name), 'asia'), false) or coalesce(regexp_matches(lower(n_name), 'france|brazil'), false) as inside "
    "from nation join region on n_regionkey = r_regionkey"
)
def c09_keyword_geography(spark, d):
    n = S.table(spark, d, "nation").join(F.broadcast(S.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        "n_nationkey", P.mentions(["n_name", "r_name"], ("india", "china", "asia")).alias("mentions"),
        P.in_country("r_name", "n_name", "asia", ("france", "brazil")).alias("inside"),
    )


REFS = ["https://doi.org/1", "The Daily Times", "", "nan", "someone said", "Survey of rivers", None, "my blog"]
REF_SQL = "list_extract(['https://doi.org/1', 'The Daily Times', '', 'nan', 'someone said', 'Survey of rivers', null, 'my blog'], cast(event_id % 8 + 1 as int))"


@query(
    f"with x as (select event_id, {REF_SQL} as r from events) select event_id, case when r is null or trim(r) = '' or lower(trim(r)) "
    "= 'nan' then 'UNVERIFIED' when regexp_matches(lower(r), 'doi|journal|university|survey') then 'HIGH' when "
    "regexp_matches(lower(r), 'news|blog|times') then 'LOW' else 'MEDIUM' end as reliability, case when r is not null then 'HIGH' "
    "else 'MEDIUM' end as scientific, nullif(nullif(trim(r), ''), 'nan') as clean from x"
)
def c11_source_reliability(spark, d):
    refs = F.array(*[F.lit(r) for r in REFS])
    e = S.table(spark, d, "events").withColumn("r", F.get(refs, (F.col("event_id") % 8).cast("int")))
    return e.select(
        "event_id", P.reliability("r").alias("reliability"), P.scientific("r").alias("scientific"), X.text_or_null("r").alias("clean"),
    )


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'Nepal' when 1 then 'Bhutan' else n_name end as country from nation")
def c13_recode(spark, d):
    k = F.col("n_nationkey") % 3
    return S.table(spark, d, "nation").select(
        "n_nationkey", P.country_name(F.when(k == 0, "NP").when(k == 1, "BT").otherwise(F.col("n_name"))).alias("country"),
    )


@query(
    "with x as (select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'MANUAL_REVIEW' else "
    "'HIGH_CONFIDENCE_MATCH' end as m, case when event_id % 6 <> 0 then cast(ts as date) + cast(event_id % 3 * -400 as int) end as "
    "d, list_extract(['YEAR', 'DATE', 'DATETIME', 'MONTH'], cast(event_id % 4 + 1 as int)) as p, list_extract(['HIGH', 'LOW', "
    "'MEDIUM', null], cast(event_id // 7 % 4 + 1 as int)) as c from events) select event_id, case when coalesce(m, 'UNMATCHED') <> "
    "'HIGH_CONFIDENCE_MATCH' then 'TEMPORALLY_UNLABELABLE' when not coalesce(c in ('HIGH', 'MEDIUM'), false) then "
    "'TEMPORALLY_UNLABELABLE' when d is null then 'INVALID_DATE' when p in ('YEAR', 'MONTH') then 'TEMPORALLY_UNLABELABLE' else "
    "'LABELABLE' end as status from x"
)
def c15_temporal_cascade(spark, d):
    k = F.col("event_id")
    e = S.table(spark, d, "events").select(
        "event_id", F.when(k % 5 == 1, "MANUAL_REVIEW").when(k % 5 > 1, "HIGH_CONFIDENCE_MATCH").alias("m"),
        F.when(k % 6 != 0, F.date_add(F.to_date("ts"), (k % 3 * -400).cast("int"))).alias("date"),
        F.get(F.array(*map(F.lit, ("YEAR", "DATE", "DATETIME", "MONTH"))), (k % 4).cast("int")).alias("p"),
        F.get(F.array(F.lit("HIGH"), F.lit("LOW"), F.lit("MEDIUM"), F.lit(None)), (F.floor(k / 7) % 4).cast("int")).alias("c"),
    )
    return e.select("event_id", P.temporal_status("m", "c", "date", "p").alias("status"))


@query(
    "select event_id, case event_id % 4 when 0 then 'confirmed' when 1 then 'manual_review' else 'unresolved' end as taxonomy, case "
    "when event_id % 3 = 0 then null else value end as payload from events"
)
def c28_taxonomy_and_staleness(spark, d):
    k = F.col("event_id") % 4
    e = S.table(spark, d, "events").withColumns(
        {
            "match_method": F.when(k == 0, "polygon_intersection").when(k == 1, "distance_buffer_5km").when(k == 2, "UNMATCHED"),
            "stale": F.col("event_id") % 3 == 0, "payload": F.col("value"),
        }
    )
    return e.withColumns(P.null_when_stale(["payload"], "stale")).select("event_id", P.taxonomy().alias("taxonomy"), "payload")


@query(
    "with x as (select p_partkey, 'xgb_d' || (p_size % 7) || '_lr0.' || (p_size % 9 + 1) || '_n' || p_size || case when p_size % 2 = "
    "0 then '_Balanced' else '' end as m from part) select p_partkey, try_cast(regexp_extract(lower(m), '_d([0-9]+)', 1) as int) as "
    "depth, try_cast(regexp_extract(lower(m), '_lr([0-9.]+)', 1) as double) as rate, try_cast(regexp_extract(lower(m), '_n([0-9]+)', "
    "1) as int) as trees, contains(lower(m), 'balanced') as balanced, case when p_partkey % 3 = 0 then 'temporal' when p_partkey % 3 "
    "= 1 then 'availability' else 'static' end as family from x"
)
def c31_model_names(spark, d):
    k = F.col("p_size")
    p = S.table(spark, d, "part").select(
        "p_partkey",
        F.concat(
            F.lit("xgb_d"), k % 7, F.lit("_lr0."), k % 9 + 1, F.lit("_n"), k, F.when(k % 2 == 0, "_Balanced").otherwise(""),
        ).alias("m"),
        F.get(
            F.array(*map(F.lit, ("temp_mean_3d", "gpm_available", "terrain_slope"))), (F.col("p_partkey") % 3).cast("int"),
        ).alias("feature"),
    )
    return p.select("p_partkey", *[e.alias(n) for n, e in P.model_settings("m").items()], P.family().alias("family"))


@query(
    "select event_id, case when coalesce(v, 0) > 50 then 1 else 0 end as alarm, least(greatest(coalesce(v, 0) / 100, 0), 1) as soft "
    "from (select event_id, case when event_id % 5 <> 0 then value * 1.5 end as v from events)"
)
def k10_heuristics(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value") * 1.5).alias("v"))
    return e.select("event_id", P.heuristic("v").alias("alarm"), P.soft_heuristic("v").alias("soft"))


@query(
    "select event_id, substr(sha256(user_id::varchar || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '_' || event_type), 1, 16) as "
    "observation_id from events"
)
def h01_sha_ids(spark, d):
    return S.table(spark, d, "events").select(
        "event_id", X.sha_id("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type").alias("observation_id"),
    )


@query(
    "select c_custkey, trim(replace(lower('  ' || c_name || '° '), '°', '')) as name, case when length(c_custkey::varchar) < 4 then "
    "lpad(c_custkey::varchar, 4, '0') else c_custkey::varchar end as padded, case when c_custkey % 3 <> 0 then 'lake ' || (c_custkey "
    "% 9) end as named from customer"
)
def h02_strings(spark, d):
    c = S.table(spark, d, "customer")
    n = F.when(F.col("c_custkey") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Lake "), F.col("c_custkey") % 9))
    return c.select(
        "c_custkey", X.normal_name(F.concat(F.lit("  "), F.col("c_name"), F.lit("° "))).alias("name"),
        X.zfill("c_custkey", 4).alias("padded"), X.named(n).alias("named"),
    )


@query(
    "with x as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, "
    "'%Y-%m-%dT%H:%M:%S') when 2 then 'nan' else 'soon' end as t, ts from events) select event_id, try_cast(case when event_id % 4 < "
    "2 then replace(t, 'T', ' ') end as timestamp) as parsed, case event_id % 4 when 0 then 'DATE' when 1 then 'DATETIME' else "
    "'UNKNOWN' end as precision, date_trunc('day', ts)::timestamp as day, make_date(2000 + event_id % 20, case when event_id % 3 <> "
    "0 then event_id % 12 + 1 else 1 end, case when event_id % 3 = 1 then event_id % 28 + 1 else 1 end) as assembled, case event_id "
    "% 3 when 0 then 'YEAR' when 1 then 'DATE' else 'MONTH' end as parts from x"
)
def h04_event_times(spark, d):
    k = F.col("event_id")
    e = S.table(spark, d, "events").select(
        "event_id", "ts",
        F.when(k % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(
            k % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        ).when(k % 4 == 2, "nan").otherwise("soon").alias("t"),
        (2000 + k % 20).alias("y"), F.when(k % 3 != 0, k % 12 + 1).alias("m"), F.when(k % 3 == 1, k % 28 + 1).alias("dd"),
    )
    return e.select(
        "event_id", X.event_time("t").alias("parsed"), X.time_precision("t").alias("precision"), X.day("ts").alias("day"),
        X.parts_date("y", "m", "dd").alias("assembled"), X.parts_precision("y", "m", "dd").alias("parts"),
    )


@query(
    "select event_id, cast(props ->> '$.k' as bigint) as k, json_object('event_id', event_id, 'type', event_type) ->> '$.type' as "
    "kind from events"
)
def h09_json(spark, d):
    e = S.table(spark, d, "events")
    blob = F.to_json(F.struct("event_id", F.col("event_type").alias("type")))
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object(blob, "$.type").alias("kind"),
    )


@query(
    "select c_custkey, try_cast(case when c_custkey % 4 = 0 then 'n/a' when c_custkey % 4 = 1 then null else c_acctbal::varchar end "
    "as double) as number, coalesce(case when c_custkey % 4 > 1 then c_acctbal end <= 24, false) as fresh from customer"
)
def c04_numbers(spark, d):
    k = F.col("c_custkey")
    c = S.table(spark, d, "customer").withColumn("t", F.when(k % 4 == 0, "n/a").when(k % 4 > 1, F.col("c_acctbal").cast("string")))
    return c.select("c_custkey", X.number("t").alias("number"), F.coalesce(X.number("t") <= 24, F.lit(False)).alias("fresh"))


@query(
    "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey left join nation on n_nationkey = "
    "c_nationkey and n_nationkey % 2 = 0"
)
def d03_chained_joins(spark, d):
    n = S.table(spark, d, "nation").where("n_nationkey % 2 = 0")
    o = S.table(spark, d, "orders").join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query(
    "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) and o_custkey in "
    "(select c_custkey from customer where c_mktsegment = 'BUILDING')"
)
def d23_semi_and_anti(spark, d):
    c = S.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    o = S.table(spark, d, "orders")
    return o.join(c.where("c_acctbal < 0"), "o_custkey", "left_anti").join(
        c.where("c_mktsegment = 'BUILDING'"), "o_custkey", "left_semi",
    ).select("o_orderkey")


@query(
    "select north, west, south, east, cast(year(m) as int) as year, cast(month(m) as int) as month from (select distinct "
    "ceil(round((27 + s_suppkey % 3 + 0.13) * 10, 9)) / 10 as north, floor(round((86 + s_suppkey % 2 + 0.17) * 10, 9)) / 10 as west, "
    "floor(round((27 + s_suppkey % 3 + 0.02) * 10, 9)) / 10 as south, ceil(round((86 + s_suppkey % 2 + 0.29) * 10, 9)) / 10 as east "
    "from supplier), (select unnest(generate_series(date '2023-12-01', date '2024-02-01', interval 1 month)) as m)"
)
def a11_month_requests(spark, d):
    from tarnwatch.sources.remote import month_requests

    k = F.col("s_suppkey")
    b = S.table(spark, d, "supplier").select(
        (27 + k % 3 + F.lit(0.13)).alias("north"), (86 + k % 2 + F.lit(0.17)).alias("west"), (27 + k % 3 + F.lit(0.02)).alias("south"),
        (86 + k % 2 + F.lit(0.29)).alias("east"), F.lit("2023-12-17").cast("date").alias("start"),
        F.lit("2024-02-03").cast("date").alias("stop"),
    )
    return month_requests(b)


ORACLES["a11_month_requests"] = ORACLES["a11_month_requests"].replace("0.13)", "0.13::double)").replace("0.17)", "0.17::double)").replace("0.02)", "0.02::double)").replace("0.29)", "0.29::double)")


@query(
    "select (rn - 1) // 50 as chunk, sum(s_suppkey)::bigint as total, count(*) as n from (select s_suppkey, row_number() over (order "
    "by s_suppkey) as rn from supplier) group by 1"
)
def a19_chunked_ids(spark, d):
    from tarnwatch.sources.remote import in_chunks

    out = in_chunks(S.table(spark, d, "supplier"), "s_suppkey", 50)
    return out.select(
        "chunk", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("ids").cast("bigint").alias("n"),
    )
