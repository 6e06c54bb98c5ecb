"""Streaming twins of the batch operators."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import DAY_US
from tarnwatch.operators import buckets as store
from tarnwatch.operators import labels as L
from tarnwatch.operators import maintain


def deduplicated(stream: DataFrame, key: str = "observation_id", ts: str = "observation_timestamp", late: str = "2 days") -> DataFrame:
    """The first row of each key, with state only for the watermark's span."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily(stream: DataFrame, value: str, key: str = "lake_uid", ts: str = "observation_timestamp", late: str = "2 days") -> DataFrame:
    """A row an entity and day."""
    return windows(stream, value, "1 day", None, key, ts, late)


def windows(
    stream: DataFrame, value: str, width: str, slide: str | None, key: str = "lake_uid", ts: str = "observation_timestamp",
    late: str = "2 days",
) -> DataFrame:
    """Sums and means in tumbling or sliding windows; late rows within the watermark count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "total", "mean",
    )


def sessions(stream: DataFrame, gap: str, key: str = "lake_uid", ts: str = "observation_timestamp", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("rows")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows",
    )


def labelled(
    grid: DataFrame, events: DataFrame, ambiguous: DataFrame | None = None, horizons=L.HORIZONS, pre: int = 30, post: int = 30,
    most_age_h: float = 72.0, late: str = "2 days", key: str = "lake_uid", ts: str = "reference_timestamp", at: str = "event_ts",
) -> DataFrame:
    """`labels.label` of two streams: a grid row's labels come out once no event can come any more that they look at.

    Both streams have a watermark; an interval join holds a grid row for its longest horizon and an event for `post` days, rows
    without events come out of the outer join with nulls. Events later than `late` change no label. Grid rows (key, ts,
    weather_age_hours) and events are unique (`deduplicated` first); rows without a time vanish. ambiguous is a plain table.
    """
    g = grid.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), "weather_age_hours").withWatermark("_ts", late)
    e = events.select(F.col(key).alias("_ek"), F.col(at).alias("_at"), "event_id").withWatermark("_at", late)
    ahead = max(pre, *horizons)
    near = (F.col("_at") >= F.col("_ts") - F.expr(f"interval {post} days")) & (F.col("_at") <= F.col("_ts") + F.expr(f"interval {ahead} days"))
    met = g.join(e, (F.col("_k") == F.col("_ek")) & near, "left").withColumns({"_t": F.unix_micros("_ts"), "_e": F.unix_micros("_at")})
    zone = (F.col("_e") <= F.col("_t") + pre * DAY_US) & (F.col("_e") >= F.col("_t") - post * DAY_US)
    facts = [F.coalesce(F.bool_or(zone), F.lit(False)).alias("_zone")]
    for h in horizons:
        within = (F.col("_e") > F.col("_t")) & (F.col("_e") <= F.col("_t") + h * DAY_US)
        facts += [F.count_if(within).alias(f"_n{h}"), F.min(F.when(within, F.struct("_e", "event_id"))).alias(f"_hit{h}")]
    seen = met.groupBy("_k", "_ts", "weather_age_hours").agg(*facts)
    vague = F.lit(False)
    if ambiguous is not None:
        seen = seen.join(ambiguous.select(F.col(key).alias("_vk")).distinct(), F.col("_k") == F.col("_vk"), "left")
        vague = F.col("_vk").isNotNull()
    each = [F.struct(F.lit(h).alias("h"), F.col(f"_n{h}").alias("n"), F.col(f"_hit{h}.event_id").alias("id")) for h in horizons]
    rows = seen.withColumn("_vague", vague).withColumn("_x", F.explode(F.array(*each)))
    n = F.col("_x.n")
    return rows.select(
        F.col("_k").alias(key), F.col("_ts").alias(ts), F.col("_x.h").alias("horizon_days"), F.col("_ts").alias("horizon_start"),
        F.timestamp_micros(F.unix_micros("_ts") + F.col("_x.h") * F.lit(DAY_US)).alias("horizon_end"),
        L.status(n, F.col("_zone"), F.col("_vague"), most_age_h).alias("label_status"), (n > 0).cast("int").alias("event_within_horizon"),
        F.col("_x.id").alias("matched_event_id"), n.cast("long").alias("event_count_within_horizon"),
    )


def spaced(stream: DataFrame, hours: float = 24, key: str = "lake_uid", ts: str = "observation_timestamp") -> DataFrame:
    """Rows at least `hours` after the entity's last kept row, in order of time within a batch; older rows than that
    last one are dropped, as they would change what was already given out."""
    gap = pd.Timedelta(hours=hours)

    def keep(group, batches: Iterator[pd.DataFrame], state):
        last = pd.Timestamp(state.get[0]) if state.exists else None
        kept = []
        for t in sorted(x for b in batches for x in b[ts]):
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame({key: [group[0]] * len(kept), ts: kept})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, {ts} timestamp", "last timestamp", "append", "NoTimeout")


def upsert_sink(path: str, keys: list[str], order: str, buckets: int = 16):
    """A foreachBatch function that keeps a keyed table (operators.buckets) current; a repeated batch changes nothing, and a batch
    rewrites only the buckets that its keys fall in."""

    def run(batch: DataFrame, number: int) -> None:
        store.upsert(batch, path, keys, [F.col(order).desc()], buckets, label=f"sink:{number}")

    return run


def maintain_sink(path: str, compute: Callable[[DataFrame], DataFrame], days: float, value: str, order: str, buckets: int = 16):
    """A foreachBatch function that keeps observations, features and moments (operators.maintain) current as late rows come."""

    def run(batch: DataFrame, number: int) -> None:
        maintain.absorb(batch, path, f"sink:{number}", compute, days, value, [F.col(order).desc()], buckets)

    return run


def affected(late: DataFrame, key: str = "lake_uid", ts: str = "observation_timestamp", days: int = 30) -> DataFrame:
    """(key, from, to): the span whose trailing features a late row changes."""
    return late.groupBy(key).agg(F.min(ts).alias("from"), F.timestamp_add("DAY", F.lit(days), F.max(ts)).alias("to"))
