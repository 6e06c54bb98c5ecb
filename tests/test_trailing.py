"""Streams by state: trailing features against the batch operators on odd rows, the size of their state, labels that wait for events."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import instant, wall
from tarnwatch.functions.storage import folder
from tarnwatch.operators import labels, timeops
from tarnwatch.plans.streams import finished, in_order, run
from tarnwatch.streaming import streams as L
from tarnwatch.streaming import trailing as T

ROWS = "lake_uid string, observation_id long, at string, v double, w float"
WINDOWS = {
    "mean_2d": ("mean", "v", 2), "sum_1d": ("sum", "v", 1), "min_3d": ("min", "v", 3), "max_3d": ("max", "v", 3), "n_2d": ("count", "w", 2),
    "sum_half": ("sum", "w", 0.5),
}
CHANGES = {"d_1d": ("v", 1), "d_5d": ("v", 5)}


def frame(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("observation_timestamp", F.to_timestamp_ntz("at")).drop("at")
    return df.withColumn("observation_timestamp", instant("observation_timestamp"))


def streamed(spark, *parts, late="2 days"):
    far = frame(spark, [("far", -1, "2031-01-01 00:00:00", None, None)])
    with T.rocks(spark):
        return finished(T.trailing(in_order(spark, [*parts, far]), WINDOWS, CHANGES, late), spark).withColumn("observation_timestamp", wall("observation_timestamp"))


def batch(df):
    df = df.where("observation_timestamp is not null").withColumn("observation_timestamp", wall("observation_timestamp"))
    out = timeops.change(timeops.rolling(df, WINDOWS), CHANGES)
    return out.select("lake_uid", "observation_id", "observation_timestamp", *[F.col(c).cast("double").alias(c) for c in [*WINDOWS, *CHANGES]])


def rows(df):
    def text(v):
        return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df.collect())


def test_equals_the_batch_features_on_odd_rows(spark):
    rng = random.Random(5)
    values = [None, math.nan, math.inf, -math.inf, 0.0, 1.5, -2.25, 1e6]
    made = []
    for k in range(160):
        day, entity = rng.randrange(12), rng.choice(["a", "a", "b", None])
        at = f"2023-12-{27 + day} 12:00:00" if day < 5 else f"2024-01-{day - 4:02d} {rng.choice(['00:00:00', '12:00:00', '12:00:00.000001'])}"
        made.append((entity, rng.choice([None, k]), at, rng.choice(values), rng.choice([None, 1.0, 2.5])))
    made += made[:5] + [("a", 900, None, 1.0, 1.0)]
    # each row up to a day and a half out of order
    order = sorted(made, key=lambda r: (r[2] or "", 0))
    cut = [order[:50:1] + order[50:70:2], order[51:70:2] + order[70:120], order[120:]]
    got = streamed(spark, *[frame(spark, c) for c in cut], late="20 days")
    assert rows(got) == rows(batch(frame(spark, made)))


def test_rows_that_come_too_late_are_dropped(spark):
    early = frame(spark, [("a", 1, "2024-01-01 00:00:00", 1.0, 1.0), ("a", 2, "2024-01-10 00:00:00", 5.0, 1.0)])
    late = frame(spark, [("a", 3, "2024-01-01 01:00:00", 100.0, 1.0), ("a", 4, "2024-01-09 00:00:00", 2.0, 1.0)])
    # a batch filters by the watermark that the one before it ran with
    got = {r.observation_id: r for r in streamed(spark, early, early.where("false"), late).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[2].mean_2d, got[2].sum_1d, got[2].d_1d, got[4].d_5d) == (3.5, 5.0, 3.0, 1.0)


def test_empty_stream(spark):
    assert streamed(spark, frame(spark, [])).count() == 0


def test_state_holds_the_widest_window_only(spark):
    """A year of a row a day: never more days in state than the widest window, the watermark's span and the batch's own."""
    parts = [
        frame(spark, [("a", d, str(np.datetime64("2023-01-01") + d) + " 06:00:00", float(d), 1.0) for d in range(lo, lo + 20)])
        for lo in range(0, 200, 20)
    ]
    at = folder(spark, "bounded")
    made = T.trailing(in_order(spark, parts), WINDOWS, CHANGES, "2 days")
    with T.rocks(spark):
        run(made.writeStream.format("parquet").option("path", f"{at}/out"), at)
        state = spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", "days").load()
        days = state.select(F.explode("map_value")).count() if "map_value" in state.columns else state.count()
    assert 0 < days <= 5 + 2 + 2
    assert spark.read.schema(made.schema).parquet(f"{at}/out").count() >= 195


def test_windows_by_halves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    lo = rng.integers(0, 499, 300)
    hi = np.minimum(500, lo + rng.integers(1, 200, 300))
    assert np.array_equal(T.extremes(x, lo, hi, np.fmin), [x[a:b].min() for a, b in zip(lo, hi)])
    assert np.array_equal(T.extremes(x, lo, hi, np.maximum), [x[a:b].max() for a, b in zip(lo, hi)])
    assert np.allclose(T.total(x, np.zeros(500, bool), lo, hi), [x[a:b].sum() for a, b in zip(lo, hi)])


def grid(spark, days):
    df = spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00", a) for k, d, a in days], "lake_uid long, at string, weather_age_hours double")
    return df.select("lake_uid", instant(F.to_timestamp_ntz("at")).alias("reference_timestamp"), "weather_age_hours")


def events(spark, found):
    df = spark.createDataFrame([(k, i, at) for k, i, at in found], "lake_uid long, event_id long, at string")
    return df.select("lake_uid", "event_id", instant(F.to_timestamp_ntz("at")).alias("event_ts"))


def test_labels_wait_for_their_events(spark):
    """An event that comes late but within the watermark changes labels, one behind it does not; the rest equals the batch labels."""
    days = [(k, d, 10.0 if d % 4 else None) for k in (1, 2, 3) for d in range(1, 29)]
    far_grid = spark.createDataFrame([(-1, "2030-01-01")], "lake_uid long, at string").select(
        "lake_uid", F.to_timestamp("at").alias("reference_timestamp"), F.lit(None).cast("double").alias("weather_age_hours"),
    )
    far = events(spark, [(-1, -1, "2030-01-01 00:00:00")])
    on_time = [(1, 10, "2024-01-06 00:00:00"), (1, 11, "2024-01-20 12:00:00"), (2, 12, "2024-01-25 00:00:00"), (None, 13, "2024-01-04 00:00:00")]
    late, behind = [(2, 14, "2024-01-16 00:00:00")], [(3, 15, "2024-01-02 00:00:00")]
    g = [grid(spark, [x for x in days if x[1] <= 14]), grid(spark, [x for x in days if x[1] > 14]), far_grid, far_grid.where("false")]
    e = [events(spark, on_time[:2] + on_time[3:]), events(spark, on_time[2:3] + late), far, events(spark, behind)]
    vague = spark.createDataFrame([(3,), (3,)], "lake_uid long")
    got = finished(L.labelled(in_order(spark, g), in_order(spark, e), vague, (3, 7), 5, 4, late="10 days"), spark)
    plain = grid(spark, days).withColumn("reference_timestamp", wall("reference_timestamp"))
    seen = events(spark, on_time + late).withColumn("event_ts", wall("event_ts"))
    want = labels.label(plain, seen, vague, (3, 7), 5, 4)
    got = got.withColumns({c: wall(c) for c in ("reference_timestamp", "horizon_start", "horizon_end")}).select(*want.columns)
    assert rows(got) == rows(want)
    assert {r.label_status for r in want.select("label_status").distinct().collect()} == {
        labels.POSITIVE, labels.EXCLUDED, labels.UNRESOLVED, labels.INSUFFICIENT, labels.NEGATIVE,
    }


def test_no_later_row_changes_a_feature(spark):
    """What is given out for a time does not depend on any row after it."""
    first = [("a", d, f"2024-01-{d:02d} 00:00:00", float(d), 1.0) for d in range(1, 11)]
    more = [("a", 50 + d, f"2024-01-{d:02d} 12:00:00", 1e6, 9.0) for d in range(10, 20)]
    alone, both = streamed(spark, frame(spark, first)), streamed(spark, frame(spark, first + more))
    assert rows(both.where("observation_id < 50")) == rows(alone)


class Counted:
    """Stands for a handle and its states; counts the calls that would cross to the JVM."""

    def __init__(self):
        self.calls = 0

    def __getattr__(self, name):
        def call(*_):
            self.calls += 1
            return False if name == "containsKey" else None

        return (lambda *_: self) if name.endswith("State") else call


def test_a_batch_of_many_days_takes_few_state_calls():
    made, state = T.Trailing(["_v0"], {"m": ("mean", "_v0", 30)}, {}, "struct<t:bigint,id:bigint,_v0:double>"), Counted()
    made.init(state)
    rows = [{"_t": d * 86_400_000_000, "_id": d, "_v0": 1.0} for d in range(30)]
    assert list(made.handleInputRows(("a",), iter(rows), None)) == [] and state.calls <= 4
