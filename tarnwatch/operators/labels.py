"""Horizon labels with exclusion zones, matched controls, eligibility and the point-in-time feature matrix."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import DAY_US, days_apart, event_time, month_distance, sha_id, time_precision, us
from tarnwatch.operators.upsert import first_by_key

HORIZONS = (3, 7, 14, 30)
POSITIVE, EXCLUDED, UNRESOLVED, INSUFFICIENT, NEGATIVE = "POSITIVE", "EVENT_WINDOW_EXCLUDED", "GEOGRAPHICALLY_UNRESOLVED", "INSUFFICIENT_FEATURE_COVERAGE", "NEGATIVE_ELIGIBLE"


def near_events(
    rows: DataFrame, events: DataFrame, before: int, after: int, key: str = "lake_uid", ts: str = "reference_timestamp",
    at: str = "event_ts",
) -> DataFrame:
    """rows with the events of their entity from `before` days before to `after` days after them (an equi-join on
    entity and time bucket, so an entity with many events never meets all its rows)."""
    width = max(before, after, 1) * DAY_US
    e = events.select(F.col(key), F.col("event_id"), F.col(at).alias("_at"), us(at).alias("_e")).where("_e is not null")
    e = e.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_e") / width) + k for k in (-1, 0, 1)])))
    r = rows.withColumns({"_t": us(ts)}).withColumn("_bucket", F.floor(F.col("_t") / width))
    return r.join(e, [key, "_bucket"]).where(
        (F.col("_e") >= F.col("_t") - before * DAY_US) & (F.col("_e") <= F.col("_t") + after * DAY_US)
    ).drop("_bucket")


def label(
    grid: DataFrame, events: DataFrame, ambiguous: DataFrame | None = None, horizons=HORIZONS, pre: int = 30, post: int = 30,
    most_age_h: float = 72.0, key: str = "lake_uid", ts: str = "reference_timestamp",
) -> DataFrame:
    """A row per grid row and horizon h, by the first that holds: POSITIVE (an event in (t, t+h]), excluded
    (an event e with e - pre <= t <= e + post), unresolved entity, weather age NULL or over the limit, negative.

    grid (key, ts, weather_age_hours); events (key, event_id, event_ts). The nearest event in the horizon is matched,
    ties by event_id.
    """
    hs = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days")
    met = near_events(grid.select(key, ts).distinct(), events, post, max(pre, *horizons), key, ts)
    ahead = F.col("_e") > F.col("_t")
    within = ahead & (F.col("_e") <= F.col("_t") + F.col("horizon_days") * F.lit(DAY_US))
    zone = (F.col("_e") <= F.col("_t") + pre * DAY_US) & (F.col("_e") >= F.col("_t") - post * DAY_US)
    hit = F.when(within, F.struct("_e", "event_id"))
    seen = met.select("*", hs).groupBy(key, ts, "horizon_days").agg(
        F.count_if(within).alias("_n"), F.min(hit).alias("_hit"), F.coalesce(F.bool_or(zone), F.lit(False)).alias("_zone"),
    )
    out = grid.select("*", hs).join(seen, [key, ts, "horizon_days"], "left")
    vague = F.lit(False)
    if ambiguous is not None:
        out = out.join(ambiguous.select(key).distinct().withColumn("_vague", F.lit(True)), key, "left")
        vague = F.coalesce("_vague", F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    return out.select(
        key, ts, "horizon_days", F.col(ts).alias("horizon_start"),
        (F.timestamp_add("DAY", F.col("horizon_days"), F.col(ts))).alias("horizon_end"),
        status(n, F.coalesce("_zone", F.lit(False)), vague, most_age_h).alias("label_status"), (n > 0).cast("int").alias("event_within_horizon"), F.col("_hit.event_id").alias("matched_event_id"),
        n.cast("long").alias("event_count_within_horizon"),
    )


def status(n: Column, zone: Column, vague: Column, most_age_h: float) -> Column:
    """The first label that holds, for n events within the horizon."""
    return F.when(n > 0, POSITIVE).when(zone, EXCLUDED).when(vague, UNRESOLVED).when(
        F.col("weather_age_hours").isNull() | (F.col("weather_age_hours") > most_age_h), INSUFFICIENT,
    ).otherwise(NEGATIVE)


def controls(labels: DataFrame, k: int = 3, key: str = "lake_uid", ts: str = "reference_timestamp") -> DataFrame:
    """The k negatives of each positive's entity and horizon that match it best: by cyclic month distance, then by
    days apart, then the earlier. A positive meets the negatives of its own entity and horizon, which an entity's days
    bound."""
    positive = labels.where(F.col("label_status") == POSITIVE).select(
        key, "horizon_days", F.col(ts).alias("positive_ts"), F.col("matched_event_id").alias("positive_event_id"),
    )
    negative = labels.where(F.col("label_status") == NEGATIVE).select(key, "horizon_days", F.col(ts).alias("control_ts"))
    met = positive.join(negative, [key, "horizon_days"])
    distance = days_apart("control_ts", "positive_ts")
    w = W.partitionBy(key, "horizon_days", "positive_ts").orderBy(month_distance("control_ts", "positive_ts"), distance, "control_ts")
    met = met.withColumn("selection_rank", F.row_number().over(w)).where(F.col("selection_rank") <= k)
    return met.select(
        sha_id("positive_event_id", key, F.date_format("control_ts", "yyyy-MM-dd"), "horizon_days", size=12).alias("control_id"),
        "positive_event_id", key, "positive_ts",
        F.col("control_ts").alias("control_reference_timestamp"), "horizon_days", F.month("control_ts").alias("matching_month"),
        F.year("control_ts").alias("matching_year"),
        distance.alias("temporal_distance_days"), "selection_rank",
    )


def window_coverage(
    events: DataFrame, obs: DataFrame, days: int = 45, key: str = "lake_uid", ts: str = "observation_timestamp",
) -> DataFrame:
    """Each event with the count of its entity's observations in [e - days, e + days]."""
    seen = near_events(obs.select(key, ts), events, days, days, key, ts).groupBy("event_id").agg(F.count("*").alias("n"))
    return events.join(seen, "event_id", "left").withColumn("observations", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def temporal_eligibility(matched: DataFrame, weather: DataFrame, days: int = 45) -> DataFrame:
    """matched (event_id, lake_uid, event_date text, match_status, event_confidence) -> status and reason, in order:
    not a confident match, date that does not parse, no weather in the window, else LABELABLE."""
    m = matched.withColumn("event_ts", event_time("event_date"))
    m = window_coverage(m, weather, days)
    confident = eligible_match()
    status = F.when(~confident, "TEMPORALLY_UNLABELABLE").when(F.col("event_ts").isNull(), "INVALID_DATE").when(
        F.col("observations") == 0, "TEMPORALLY_UNLABELABLE",
    ).otherwise("LABELABLE")
    reason = F.when(~confident, "not_high_confidence").when(F.col("event_ts").isNull(), "unparseable_date").when(
        F.col("observations") == 0, "no_weather_in_window",
    ).otherwise("ok")
    return m.select(
        "event_id", "lake_uid", "event_date", status.alias("temporal_eligibility_status"), reason.alias("reason"),
        time_precision("event_date").alias("event_time_precision"), "observations",
    )


def eligible_match() -> Column:
    return F.coalesce((F.col("match_status") == "HIGH_CONFIDENCE_MATCH") & F.col("event_confidence").isin("HIGH", "MEDIUM"), F.lit(False))


def eligible_events(events: DataFrame, matches: DataFrame, audit: DataFrame) -> DataFrame:
    """events with matches and audit (both left joins): ELIGIBLE_POSITIVE, EXCLUDED_MANUAL_REVIEW, EXCLUDED_NO_LAKE or
    EXCLUDED_<temporal status>."""
    e = events.join(matches.select("event_id", "lake_uid", "match_status"), "event_id", "left").join(
        audit.select("event_id", "temporal_eligibility_status"), "event_id", "left",
    )
    status = F.when(
        F.col("temporal_eligibility_status").isNull(),
        F.when(F.col("match_status") == "MANUAL_REVIEW", "EXCLUDED_MANUAL_REVIEW").otherwise("EXCLUDED_NO_LAKE"),
    )
    status = status.when(
        F.col("temporal_eligibility_status") == "LABELABLE", "ELIGIBLE_POSITIVE",
    ).otherwise(F.concat(F.lit("EXCLUDED_"), F.col("temporal_eligibility_status")))
    return e.withColumn("eligibility_status", status)


def overlap_status(
    events: DataFrame, obs: DataFrame, key: str = "lake_uid", ts: str = "observation_timestamp", at: str = "event_ts",
) -> DataFrame:
    """Whether each event lies within its entity's observed span."""
    span = obs.groupBy(key).agg(
        F.min(ts).alias("observation_min"), F.max(ts).alias("observation_max"), F.count("*").alias("observation_count"),
    )
    e = events.join(span, key, "left")
    status = F.when(F.col("observation_count").isNull(), "MISSING").when(
        F.col(at).between(F.col("observation_min"), F.col("observation_max")), "OVERLAPS",
    ).otherwise("NO_OVERLAP")
    return e.withColumn("overlap_status", status)


FEATURES = {f"temp_mean_{d}d": ("temperature_2m_c", F.avg, d) for d in HORIZONS} | {
    "temp_max_7d": ("temperature_2m_c", F.max, 7), "temp_min_7d": ("temperature_2m_c", F.min, 7),
} | {f"precip_sum_{d}d": ("precipitation_mm", F.sum, d) for d in HORIZONS} | {"precip_max_7d": ("precipitation_mm", F.max, 7)}


def feature_matrix(
    labels: DataFrame, obs: DataFrame, terrain: DataFrame | None = None, dedupe_obs: bool = False, key: str = "lake_uid",
    ref: str = "reference_timestamp", ts: str = "observation_timestamp",
) -> DataFrame:
    """labels with trailing features over (ref - w, ref]: one union and RANGE frames, so no label meets its rows in a
    join. No value gives NULL, coverage 0. dedupe_obs counts rows of one time once."""
    if dedupe_obs:
        obs = first_by_key(obs, [key, ts], [F.col(c) for c in obs.columns if c not in (key, ts)])
    values = ["temperature_2m_c", "precipitation_mm"]
    points = labels.select(key, ref).distinct()
    both = points.select(
        key, us(ref).alias("_t"), F.lit(1).alias("_side"), F.col(ref), *[F.lit(None).cast("double").alias(c) for c in values],
    )
    both = both.unionByName(obs.select(key, us(ts).alias("_t"), F.lit(0).alias("_side"), *values), allowMissingColumns=True)
    frame = lambda days: W.partitionBy(key).orderBy("_t").rangeBetween(1 - days * DAY_US, 0)
    made = {n: f(c).over(frame(days)) for n, (c, f, days) in FEATURES.items()}
    made["weather_coverage_30d"] = F.count(F.when(F.col("_side") == 0, 1)).over(frame(30))
    out = labels.join(both.withColumns(made).where("_side = 1").select(key, ref, *made), [key, ref])
    return out if terrain is None else out.join(terrain, key, "left")


def leakage(aligned: DataFrame, sources: list[str], ref: str = "reference_timestamp") -> DataFrame:
    """Per source the rows whose observation is later than the row's time."""
    counts = aligned.agg(*[F.count_if(F.col(f"{s}_timestamp") > F.col(ref)).alias(s) for s in sources])
    return counts.unpivot([], sources, "source", "violations")
