"""Derived tables after late rows and corrections: what is read, what comes out, what a repeated batch does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import buckets, features, maintain

SCHEMA = "lake_uid long, observation_id long, observation_timestamp timestamp_ntz, temperature_2m_c double, precipitation_mm double, snowfall_mm double"


def made(rng, entities, n, start=0):
    return [
        (rng.choice(entities), start + k, dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 400)), rng.choice([None, rng.uniform(-20, 20)]), rng.random(), None)
        for k in range(n)
    ]


def absorb(spark, path, rows, label):
    df = spark.createDataFrame(rows, SCHEMA)
    return maintain.absorb(df, path, label, features.engineer_weather, 30, "temperature_2m_c", [F.col("temperature_2m_c").desc()], 16)


def rows(df):
    def text(v):
        return "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v).replace("-0.000000", "0.000000") for v in r) for r in df.select(*sorted(df.columns)).collect())


def whole(spark, final):
    df = spark.createDataFrame(final, SCHEMA)
    return features.engineer_weather(df), maintain.moments(df, "temperature_2m_c")


def check(spark, path, final):
    f, m = whole(spark, final)
    assert rows(buckets.read(spark, f"{path}/features")) == rows(f)
    got = {r.lake_uid: r for r in buckets.read(spark, f"{path}/moments").collect()}
    for r in m.collect():
        assert got[r.lake_uid].n == r.n
        assert got[r.lake_uid].mean == pytest.approx(r["mean"], abs=1e-9)
        assert got[r.lake_uid].m2 == pytest.approx(r.m2, abs=1e-6, rel=1e-9)


def test_late_rows_and_corrections_equal_the_full_computation(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/t"
    first = made(rng, range(12), 400)
    absorb(spark, path, first, "s:0")
    # late rows, a value that changes, one that vanishes, a time that moves by months, an entity that is new, rows without time or key
    fixed = [(*first[5][:3], 7.0, 1.0, None), (*first[6][:3], None, 1.0, None), (*first[7][:2], dt.datetime(2023, 9, 9), 3.0, 1.0, None)]
    late = made(rng, [2, 99], 30, 1000)
    bad = [(1, 5000, None, 1.0, 1.0, None), (None, 5001, dt.datetime(2023, 1, 1), 1.0, 1.0, None)]
    assert absorb(spark, path, [*late, *fixed, *bad], "s:1") == {"observations": 2, "features": 2, "moments": 2}
    final = {r[:2]: r for r in [*first, *late, *fixed]}
    check(spark, path, list(final.values()))


def test_a_change_reaches_past_the_window_to_the_next_row(spark, tmp_path):
    """Rows half a year apart: the late one is what the next row's successor looks back to."""
    path, day = f"file://{tmp_path}/t", lambda m, d: dt.datetime(2023, m, d)
    first = [(1, 1, day(1, 1), 1.0, 0.0, None), (1, 2, day(7, 1), 5.0, 0.0, None), (1, 3, day(7, 4), 9.0, 0.0, None)]
    absorb(spark, path, first, "s:0")
    late = [(1, 4, day(3, 1), 2.0, 0.0, None)]
    absorb(spark, path, late, "s:1")
    check(spark, path, first + late)
    got = {r.observation_id: r.temperature_change_7d for r in buckets.read(spark, f"{path}/features").collect()}
    assert got == {1: None, 2: 3.0, 3: 7.0, 4: 1.0}


def test_only_affected_entities_are_read(spark, tmp_path):
    rng, path = random.Random(4), f"file://{tmp_path}/t"
    first = made(rng, range(200), 3000)
    absorb(spark, path, first, "s:0")
    late = spark.createDataFrame([(7, 9000, dt.datetime(2023, 6, 1), 1.0, 1.0, None)], SCHEMA)
    version = buckets.upsert(late, f"{path}/observations", ["lake_uid", "observation_id"], None, 16, "s:1", ["lake_uid"])
    before, now, near = maintain.changed(late, f"{path}/observations", version)
    folder = buckets.manifest(spark, f"{path}/observations")["folders"][str(buckets.placed_in({"keys": ["lake_uid"], "buckets": 16}, late)[0])]
    assert all(folder in f for f in near.inputFiles())
    assert (before.count(), now.count()) == (0, 1)
    read = maintain.reach(near, maintain.spans(now, near, 30))
    mine = sorted(r[2] for r in first if r[0] == 7)
    lo = max(t for t in mine if t <= dt.datetime(2023, 5, 2))
    hi = min(t for t in mine if t > dt.datetime(2023, 6, 1)) + dt.timedelta(days=30)
    assert {r.lake_uid for r in read.collect()} == {7}
    assert read.count() == sum(lo <= t <= hi for t in mine) + 1 < len(mine)


def test_a_batch_that_stopped_half_way_is_finished_once(spark, tmp_path, monkeypatch):
    rng, path = random.Random(6), f"file://{tmp_path}/t"
    first, late = made(rng, range(4), 120), made(rng, range(2), 20, 1000)
    absorb(spark, path, first, "s:0")

    class Stop(Exception):
        pass

    for place in ("spans", "moved"):  # after the observations; after the features
        def stop(*_):
            raise Stop

        with monkeypatch.context() as m:
            m.setattr(maintain, place, stop)
            with pytest.raises(Stop):
                absorb(spark, path, late, "s:1")
    for _ in range(2):
        absorb(spark, path, late, "s:1")
    check(spark, path, first + late)


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    assert absorb(spark, f"file://{tmp_path}/t", [], "s:0") == {}


def test_moments_are_taken_out_again(spark):
    rows_ = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 9.0), (2, None), (3, 5.0)], "lake_uid long, v double")
    state, part = maintain.moments(rows_, "v"), rows_.where("v in (4.0, 5.0)")
    got = {r.lake_uid: (r.n, round(r["mean"], 9), round(r.m2, 9)) for r in maintain.moved(state, part, part.where("false"), "v").collect()}
    assert got == {1: (2, 5.5, 24.5), 3: (0, 0.0, 0.0)}
