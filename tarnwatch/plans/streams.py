"""Queries over streams: each reads a folder of files as a stream, runs to its end and returns what the sink holds."""

import time
import uuid

from pyspark.sql import functions as F

from tarnwatch.functions.scalars import instant, wall
from tarnwatch.functions.storage import folder, stored
from tarnwatch.operators import buckets, features, timeops
from tarnwatch.plans import alignment
from tarnwatch.plans import standins as S
from tarnwatch.plans.register import registry
from tarnwatch.streaming import streams as L
from tarnwatch.streaming import trailing as T

QUERIES, ORACLES, query = registry()

RENAMED = "user_id as lake_uid, event_id as observation_id, ts as observation_timestamp, value, event_type"
CHANGED = 10_000_000


def renamed(e):
    return e.select(
        F.col("user_id").alias("lake_uid"), F.col("event_id").alias("observation_id"),
        F.col("ts").cast("timestamp").alias("observation_timestamp"), "value", "event_type",
    )


def source(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return renamed(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*"))


def in_order(spark, parts):
    """A stream of the given tables, one a batch, in this order."""
    at = folder(spark, "arrivals-" + uuid.uuid4().hex)
    start = int(time.time() * 1000) - 60_000
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{at}/part={k}")
        # the source reads files by time of change, which a file system may keep in whole seconds
        fs, folder_ = buckets.file_system(spark, f"{at}/part={k}")
        for f in fs.listStatus(folder_):
            fs.setTimes(f.getPath(), start + 2000 * k, -1)
    s = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return s.parquet(at)


def run(writer, at):
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def finished(df, spark, mode="append"):
    """Written as Parquet under the shared folder, then read."""
    at = folder(spark, "stream-" + uuid.uuid4().hex)
    run(df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out"), at)
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def whole(df, spark):
    """The state of an aggregation when the files are read, with what the watermark would still hold open."""
    at = folder(spark, "stream-" + uuid.uuid4().hex)
    spark.createDataFrame([], df.schema).write.parquet(f"{at}/out")
    run(df.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out")), at)
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def rounded(df):
    """Times without a zone, as in the tables; sums and means to what both engines agree on."""
    return df.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")} | {
            c: F.round(c, k) for c, k in (("total", 4), ("mean", 6)) if c in df.columns
        }
    )


# Arrivals: the events up to the 15th, then those from the 14th on (a day of repeats), then late rows with ids of their own.
# A row is late by the watermark that the arrival before the last one left.
@query(
    f"select event_id as observation_id, user_id as lake_uid from events union all select event_id + {CHANGED}, user_id from events "
    "where event_id % 10 = 0 and ts > (select date_trunc('millisecond', max(ts)) - interval 2 day from events where ts < '2024-01-15')"
)
def l_dedup_within_watermark(spark, d):
    e = renamed(spark.read.parquet(f"{d}/events.parquet"))
    late = e.where("observation_id % 10 = 0").withColumn("observation_id", F.col("observation_id") + CHANGED)
    arrivals = in_order(spark, [e.where("observation_timestamp < '2024-01-15'"), e.where("observation_timestamp >= '2024-01-14'"), late])
    return finished(L.deduplicated(arrivals), spark).select("observation_id", "lake_uid")


# The same horizon as a watermark: only sources' rows that are not stale by then count.
@query(
    "with late as (select event_type, event_id + 10000000 as id, ts from events where event_id % 4 = 0), w as (select event_type, "
    "max(ts) as top from events group by 1) "
    "select event_type as source, count(*) as rows from (select event_type from events union all select event_type from late join w "
    "using (event_type) "
    "where late.ts > date_trunc('millisecond', top) - case event_type when 'view' then interval 48 hour when 'click' then interval "
    "720 hour when 'signup' then interval 240 hour else interval 48 hour end) group by 1"
)
def l_staleness_horizons(spark, d):
    e = renamed(spark.read.parquet(f"{d}/events.parquet"))
    hours = {"view": 48, "click": 720, "signup": 240, "purchase": 48, "error": 48}
    out = None
    for kind, h in hours.items():
        own = e.where(F.col("event_type") == kind)
        late = own.where("observation_id % 4 = 0").withColumn("observation_id", F.col("observation_id") + CHANGED)
        got = finished(L.deduplicated(in_order(spark, [own, own, late]), late=f"{h} hours"), spark)
        out = got if out is None else out.unionByName(got)
    return out.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("rows"))


@query(
    "select user_id as lake_uid, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, count(*) as rows, "
    "round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by all"
)
def l_daily_windows(spark, d):
    return rounded(whole(L.daily(source(spark, d), "value"), spark))


@query(
    "with w as (select *, date_trunc('day', ts) - to_days(cast(k as int)) as start from events, range(3) r(k)) "
    "select user_id as lake_uid, start, start + interval 3 day as end, count(*) as rows, round(sum(value), 4) as total, "
    "round(avg(value), 6) as mean from w group by all"
)
def l_sliding_windows(spark, d):
    return rounded(whole(L.windows(source(spark, d), "value", "3 days", "1 day"), spark))


@query(
    "with g as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as new from events window w as "
    "(partition by user_id order by ts)), "
    "s as (select *, sum(new) over (partition by user_id order by ts) as n from g) "
    "select user_id as lake_uid, min(ts) as start, max(ts) + interval 6 hour as end, count(*) as rows from s group by user_id, n"
)
def l_sessions(spark, d):
    return rounded(whole(L.sessions(source(spark, d), "6 hours"), spark))


@query(
    "select lake_uid, observation_timestamp from (with recursive k(lake_uid, t) as (select user_id, min(ts) from events group by 1 "
    "union all "
    "select k.lake_uid, (select min(e.ts) from events e where e.user_id = k.lake_uid and e.ts >= k.t + interval 24 hour) from k "
    "where k.t is not null) "
    "select lake_uid, t as observation_timestamp from k where t is not null)"
)
def l_spaced(spark, d):
    return finished(L.spaced(source(spark, d)), spark).withColumn(
        "observation_timestamp", F.col("observation_timestamp").cast("timestamp_ntz"),
    )


# All events, then a fifth of them again with another value: the table holds the last.
@query(
    "select event_id as observation_id, user_id as lake_uid, case when event_id % 5 = 0 then value + 1000 else value end as value "
    "from events"
)
def l_upsert_sink(spark, d):
    at = folder(spark, "upsert-" + uuid.uuid4().hex)
    e = renamed(spark.read.parquet(f"{d}/events.parquet")).select("observation_id", "lake_uid", "value")
    again = e.where("observation_id % 5 = 0").withColumn("value", F.col("value") + 1000)
    s = in_order(spark, [e, again])
    run(s.writeStream.foreachBatch(L.upsert_sink(f"{at}/table", ["observation_id"], "value")), at)
    return buckets.read(spark, f"{at}/table")


# Late rows of one entity in five: the days whose trailing features they change.
@query(
    'select user_id as lake_uid, min(ts) as "from", max(ts) + interval 30 day as "to" from events where user_id % 5 = 0 group by 1'
)
def l_late_backfill(spark, d):
    e = renamed(spark.read.parquet(f"{d}/events.parquet"))
    at = folder(spark, "late-" + uuid.uuid4().hex)
    arrivals = in_order(spark, [e.where("lake_uid % 5 <> 0"), e.where("lake_uid % 5 = 0")])

    def note(batch, n):
        if n:  # the second arrival is the late one
            L.affected(batch).write.mode("append").parquet(f"{at}/spans")

    run(arrivals.writeStream.foreachBatch(note), at)
    return spark.read.parquet(f"{at}/spans").select("lake_uid", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("from", "to")])


# Weather of a fifth of the entities comes late, was wrong or was dated wrongly at first, then that of another fifth comes late:
# only those entities' features and moments are computed again, and equal those of the whole tables.
@query(
    f"select i.*, m.n, m.mean, m.deviation from ({alignment.ORACLES['i05_weather_features']}) i join (select user_id as lake_uid, count(value) "
    "as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as deviation from events where event_type = 'view' group by 1) m "
    "using (lake_uid)"
)
def l_recomputed(spark, d):
    at = folder(spark, "recomputed-" + uuid.uuid4().hex)
    w = S.weather(spark, d)
    own, k, t = F.col("lake_uid") % 5, F.col("observation_id"), F.col("observation_timestamp")
    missing = (own == 0) & (k % 7 == 0) | (own == 1) & (k % 3 == 0)
    wrong, shifted = (own == 0) & (k % 11 == 0), (own == 0) & (k % 13 == 0)
    first = w.where(~missing).withColumns(
        {"temperature_2m_c": F.when(wrong, F.col("temperature_2m_c") + 1000).otherwise(F.col("temperature_2m_c")),
         "observation_timestamp": F.when(shifted, F.timestamp_add("DAY", F.lit(-3), t)).otherwise(t)},
    )
    s = in_order(spark, [first, w.where((own == 0) & (missing | wrong | shifted)), w.where((own == 1) & missing)])
    run(s.writeStream.foreachBatch(L.maintain_sink(at, features.engineer_weather, 30, "temperature_2m_c", "temperature_2m_c")), at)
    made, m = buckets.read(spark, f"{at}/features"), buckets.read(spark, f"{at}/moments")
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))))
    m = m.select("lake_uid", "n", F.round("mean", 6).alias("mean"), F.round(spread, 6).alias("deviation"))
    names = [*features.WEATHER, "temperature_change_1d", "temperature_change_7d"]
    return alignment.rounded(made.select("observation_id", "lake_uid", *names), *names).join(m, "lake_uid")


LAST = "2024-12-31"  # of a row that only moves the watermark past all others


def arrivals(df, ts, id=None):
    """df's rows out of order in three arrivals, up to four days late each; then a row far ahead; then rows that are too late."""
    days = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)) - F.unix_date(F.lit(S.START).cast("date"))
    delay = F.pmod(F.xxhash64(*df.columns), F.lit(3)) * 2
    when = F.least(F.lit(2), F.floor((days + delay) / 10))
    rows = stored(df.withColumn("_when", when), "arriving")
    parts = [rows.where(F.col("_when") == k).drop("_when") for k in range(3)]
    # of an entity of its own: a row without a key never reaches the watermark of a join
    own = {ts: F.lit(LAST).cast("timestamp"), "lake_uid": F.lit(-1)}
    ahead = df.sparkSession.range(1).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    again = [] if id is None else [parts[0].where(F.col(id) % 10 == 0).withColumn(id, F.col(id) + CHANGED)]
    return [*parts, ahead, *again]


# The batch features of each weather row, given out as the watermark passes it.
@query(alignment.ORACLES["i05_weather_features"])
def l_trailing(spark, d):
    w = S.weather(spark, d).withColumn("observation_timestamp", instant("observation_timestamp"))
    changes = {f"temperature_change_{k}d": ("temperature_2m_c", k) for k in (1, 7)}
    rows = T.trailing(in_order(spark, arrivals(w, "observation_timestamp", "observation_id")), features.WEATHER, changes, "5 days")
    with T.rocks(spark):
        out = finished(rows, spark)
    return alignment.rounded(out.drop("observation_timestamp"), *features.WEATHER, *changes)


# Grid days and hazards each arrive out of order; events that come once the watermark has passed them change nothing.
@query(alignment.ORACLES["i08_labels"])
def l_labels(spark, d):
    grid = timeops.align(S.grid(spark, d), {"weather": S.feed(spark, d, "weather")}).select(
        "lake_uid", instant("reference_timestamp").alias("reference_timestamp"), F.col("weather_observation_age_hours").alias("weather_age_hours"),
    )
    hazards = S.hazards(spark, d).withColumn("event_ts", instant("event_ts"))
    vague = S.table(spark, d, "events").where("user_id % 11 = 0").select(F.col("user_id").alias("lake_uid"))
    streams = in_order(spark, arrivals(grid, "reference_timestamp")), in_order(spark, arrivals(hazards, "event_ts", "event_id"))
    out = finished(L.labelled(*streams, vague, (3, 7, 14), 5, 5, late="5 days"), spark)
    return out.withColumns({c: wall(c) for c in ("reference_timestamp", "horizon_start", "horizon_end")})
