"""The given tables in the shapes that the operators take, in Spark and, as text, in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.operators.timeops import reference_grid

FEEDS = {"weather": "view", "satellite": "click", "snow": "signup", "gpm": "purchase"}
START, END = "2024-01-01", "2024-01-30"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def feed(spark, d, name: str, value: str = "value") -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type") == FEEDS[name])
    return e.select(
        F.col("user_id").alias("lake_uid"), F.col("event_id").alias("observation_id"), F.col("ts").alias("observation_timestamp"),
        F.col("value").alias(value),
    )


def weather(spark, d) -> DataFrame:
    """Two measures and a third with gaps, from one value."""
    w = feed(spark, d, "weather", "temperature_2m_c")
    return w.withColumns(
        {
            "precipitation_mm": F.col("temperature_2m_c") * 2,
            "snowfall_mm": F.when(F.col("observation_id") % 3 != 0, F.col("temperature_2m_c") / 4),
        }
    )


def hazards(spark, d, least: float = 60.0) -> DataFrame:
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") > least))
    return e.select(F.col("user_id").alias("lake_uid"), F.col("event_id"), F.col("ts").alias("event_ts"))


def grid(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("lake_uid")).distinct()
    return reference_grid(e, F.lit(START), F.lit(END))


def scores(spark, d) -> DataFrame:
    """Predictions of two models in three folds, with ties."""
    e = table(spark, d, "events")
    p = F.round(F.pmod(F.col("event_id") * 37 + F.floor("value"), F.lit(101)) / 100.0, 2)
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("model_name"), (F.col("user_id") % 3).alias("fold"),
        F.col("user_id").alias("lake_uid"), F.col("ts").alias("reference_timestamp"),
        (F.col("event_type") == "error").cast("int").alias("true_label"), p.alias("predicted_probability"),
        (p >= 0.5).cast("int").alias("predicted_class"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("event_id") % 97).cast("string"))).alias("matched_event_id"),
    )


def shifted(spark, d) -> DataFrame:
    """Order lines as domains (return flags) with gaps in one feature."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_returnflag").alias("domain"), F.col("l_orderkey").alias("unit"), "l_quantity", "l_extendedprice",
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_discount")).alias("l_discount"),
        (F.col("l_linestatus") == "F").cast("int").alias("true_label"),
    )


def sites(spark, d, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Points by whole-number arithmetic on keys, so that both engines agree."""
    t = table(spark, d, name)
    k = F.col(key)
    return t.select(
        k.alias("id"), k.alias("idx"), (27.0 + (k * 7919 % 2000) / 1000.0).alias("lat"), (86.0 + (k * 104729 % 2000) / 1000.0).alias("lon"),
    )


W = "select user_id as lake_uid, event_id as observation_id, ts as observation_timestamp, value from events where event_type = "
SQL = {
    "grid": f"grid as (select lake_uid, unnest(generate_series(timestamp '{START}', timestamp '{END}', interval 1 day)) as "
    "reference_timestamp from (select distinct user_id as lake_uid from events))",
    "hazards": "hazards as (select user_id as lake_uid, event_id, ts as event_ts from events where event_type = 'error' and value > 60)",
    "weather": "weather as (select lake_uid, observation_id, observation_timestamp, value as temperature_2m_c, value * 2 as precipitation_mm, "
    f"case when observation_id % 3 <> 0 then value / 4 end as snowfall_mm from ({W}'view'))",
    "scores": """scores as (select *, case when predicted_probability >= 0.5 then 1 else 0 end as predicted_class from (select case when event_id % 2 = 0 then 'a' else 'b' end as model_name, user_id % 3 as fold, user_id as lake_uid, ts as reference_timestamp,
        case when event_type = 'error' then 1 else 0 end as true_label, round(((event_id * 37 + cast(floor(value) as bigint)) % 101) / 100.0, 2) as predicted_probability,
        case when event_type = 'error' then 'e' || (event_id % 97) end as matched_event_id from events))""",
    "shifted": "shifted as (select l_returnflag as domain, l_orderkey as unit, l_quantity, l_extendedprice, case when l_suppkey % 4 <> 0 then "
    "l_discount end as l_discount, case when l_linestatus = 'F' then 1 else 0 end as true_label from lineitem)",
    "customers": "customers as (select c_custkey as id, 27.0::double + (c_custkey * 7919 % 2000) / 1000.0::double as lat, 86.0::double + "
    "(c_custkey * 104729 % 2000) / 1000.0::double as lon from customer)",
    "suppliers": "suppliers as (select s_suppkey as id, 27.0::double + (s_suppkey * 7919 % 2000) / 1000.0::double as lat, 86.0::double + "
    "(s_suppkey * 104729 % 2000) / 1000.0::double as lon from supplier)",
}
for _n, _e in FEEDS.items():
    SQL[f"f_{_n}"] = f"f_{_n} as ({W}'{_e}')"


def ctes(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
