"""Engineered features, baselines, the historical archive and the gaps that ingestion still has to fill."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import hours_between
from tarnwatch.operators import timeops

WEATHER = {
    "temperature_mean_3d": ("mean", "temperature_2m_c", 3),
    "temperature_mean_7d": ("mean", "temperature_2m_c", 7),
    "temperature_mean_30d": ("mean", "temperature_2m_c", 30),
    "temperature_min_3d": ("min", "temperature_2m_c", 3),
    "temperature_max_3d": ("max", "temperature_2m_c", 3),
    "precipitation_24h": ("sum", "precipitation_mm", 1),
    "precipitation_72h": ("sum", "precipitation_mm", 3),
    "precipitation_7d": ("sum", "precipitation_mm", 7),
    "precipitation_30d": ("sum", "precipitation_mm", 30),
    "snowfall_7d": ("sum", "snowfall_mm", 7),
    "snowfall_30d": ("sum", "snowfall_mm", 30),
}
#: First day on which a sensor delivers.
LAUNCH = {"modis": "2000-02-24", "sentinel2": "2015-06-23", "gpm": "2000-06-01"}


def engineer_weather(obs: DataFrame) -> DataFrame:
    """Rolling sums and means, and temperature changes over 1 and 7 days; every spec shares the entity's sort."""
    out = timeops.rolling(obs, {n: s for n, s in WEATHER.items() if s[1] in obs.columns})
    return timeops.change(out, {f"temperature_change_{d}d": ("temperature_2m_c", d) for d in (1, 7)})


def engineer_satellite(obs: DataFrame) -> DataFrame:
    """Area changes over 7, 30, 90 and 365 days and area trends over 30 and 90."""
    out = timeops.change(obs, {f"lake_area_change_{d}d": ("lake_area_km2", d) for d in (7, 30, 90, 365)})
    return timeops.trend(out, {f"lake_area_trend_{d}d": ("lake_area_km2", d) for d in (30, 90)})


def baselines(
    entities: DataFrame, weather: DataFrame, satellite: DataFrame, least_weather: int = 30, least_satellite: int = 5, key: str = "lake_uid",
    ts: str = "observation_timestamp",
) -> DataFrame:
    """Means and sample deviations, NULL below a source's least count; the period covers both sources."""

    def stats(df, column, least, mean, std, count, extra=()):
        good = df.where(F.col(column).isNotNull())
        n = F.count("*")
        more = [F.when(n >= least, F.avg(c)).alias(a) for c, a in extra]
        return good.groupBy(key).agg(
            n.alias(count), F.when(n >= least, F.avg(column)).alias(mean), F.when(n >= least, F.stddev_samp(column)).alias(std), *more,
            F.min(ts).alias(f"{count}_from"), F.max(ts).alias(f"{count}_to"),
        )

    w = stats(
        weather, "temperature_2m_c", least_weather, "baseline_temperature_c", "temperature_std_c", "sample_count_wx",
        [("precipitation_mm", "baseline_precipitation_mm")],
    )
    s = stats(satellite, "lake_area_km2", least_satellite, "baseline_area_km2", "area_std_km2", "sample_count_sat")
    out = entities.select(key).distinct().join(w, key, "left").join(s, key, "left")
    met = (F.coalesce("sample_count_wx", F.lit(0)) >= least_weather) | (F.coalesce("sample_count_sat", F.lit(0)) >= least_satellite)
    return out.select(
        key, "baseline_area_km2", "area_std_km2", "baseline_temperature_c", "temperature_std_c", "baseline_precipitation_mm",
        F.least("sample_count_wx_from", "sample_count_sat_from").alias("baseline_period_start"),
        F.greatest("sample_count_wx_to", "sample_count_sat_to").alias("baseline_period_end"),
        F.coalesce("sample_count_wx", F.lit(0)).alias("sample_count_wx"),
        F.coalesce("sample_count_sat", F.lit(0)).alias("sample_count_sat"),
        F.when(met, "good").otherwise("insufficient_sample").alias("baseline_quality_flag"),
    )


def launch_flags(df: DataFrame, ts: str = "reference_timestamp", launch: dict | None = None) -> DataFrame:
    return df.withColumns({f"sensor_{s}_unavailable": F.col(ts) < F.lit(d).cast("timestamp_ntz") for s, d in (launch or LAUNCH).items()})


def historical_archive(events: DataFrame, sources: dict[str, DataFrame], launch: dict | None = None) -> DataFrame:
    """Days round the events with each source's last observation, its age in hours and the launch flags."""
    grid = timeops.event_grid(events)
    out = timeops.asof(grid, sources)
    picked = [F.col(c) for c in grid.columns]
    for name, df in sources.items():
        at = F.col(name)["observation_timestamp"]
        picked += [at.alias(f"{name}_timestamp"), hours_between("reference_timestamp", at).alias(f"{name}_age_hours")]
        picked += [F.col(name)[c].alias(c) for c in df.columns if c not in ("lake_uid", "observation_timestamp", "observation_id")]
    return launch_flags(out.select(*picked), launch=launch)


def missing_intervals(
    events: DataFrame, covered: DataFrame, launch: dict, before: int = 45, after: int = 45, at: str = "event_ts",
) -> DataFrame:
    """(event, source) -> span of the days that its window lacks, with hit and miss counts.

    covered: (lake_uid, source, day). A source's window starts at its launch; one that ends before it is left out.
    """
    sources = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(d).cast("date").alias("launch")) for s, d in launch.items()]))
    d = F.to_date(at)
    need = events.where(F.col(at).isNotNull()).withColumn("_s", sources).select(
        "event_id", "lake_uid", F.col("_s.source").alias("source"), F.greatest(F.date_sub(d, before), F.col("_s.launch")).alias("lo"),
        F.date_add(d, after).alias("hi"),
    ).where("lo <= hi")
    days = need.withColumn("day", F.explode(F.sequence("lo", "hi")))
    have = covered.select("lake_uid", "source", F.to_date("day").alias("day")).distinct().withColumn("hit", F.lit(1))
    seen = days.join(have, ["lake_uid", "source", "day"], "left")
    miss = F.col("hit").isNull()
    return seen.groupBy("event_id", "lake_uid", "source").agg(
        F.min(F.when(miss, F.col("day"))).alias("fetch_from"), F.max(F.when(miss, F.col("day"))).alias("fetch_to"),
        F.count_if(miss).alias("missing_days"), F.count("hit").alias("covered_days"),
    )
