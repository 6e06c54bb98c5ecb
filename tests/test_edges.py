"""Hand-written frames for the boundaries that the operators' semantics turn on."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import scalars as X
from tarnwatch.operators import checks, features, geo, inventory, labels, metrics, ml, raster, resolve, splits, timeops, upsert
from tarnwatch.sources import remote, tables

D0 = dt.datetime(2024, 1, 1)


def day(n, **k):
    return D0 + dt.timedelta(days=n, **k)


def obs(spark, rows, value="value"):
    return spark.createDataFrame(
        [(1, i, t, v) for i, (t, v) in enumerate(rows)],
        f"lake_uid long, observation_id long, observation_timestamp timestamp_ntz, {value} double",
    )


def grid(spark, times):
    return spark.createDataFrame([(1, t) for t in times], "lake_uid long, reference_timestamp timestamp_ntz")


def test_asof_takes_rows_not_values(spark):
    o = obs(spark, [(day(1), 1.0), (day(3), 3.0), (day(4), None)])
    got = timeops.asof(
        grid(spark, [day(n) for n in (0, 1, 2, 3, 5)]), {"w": o},
    ).select("reference_timestamp", "w.value", "w.observation_id").orderBy("reference_timestamp").collect()
    assert [r.value for r in got] == [None, 1.0, 1.0, 3.0, None]
    assert [r.observation_id for r in got] == [None, 0, 0, 1, 2]


def test_asof_ties_go_by_id(spark):
    o = spark.createDataFrame(
        [(1, 9, day(1), 9.0), (1, 10, day(1), 10.0)],
        "lake_uid long, observation_id long, observation_timestamp timestamp_ntz, value double",
    )
    assert timeops.asof(grid(spark, [day(2)]), {"w": o}).select("w.value").first()[0] == 10.0


def test_staleness_limits(spark):
    o = obs(spark, [(day(0), 1.0)])
    refs = [day(0, hours=h) for h in (24, 24.01, 48, 48.01)]
    got = timeops.align(grid(spark, refs), {"weather": o}).orderBy("reference_timestamp").collect()
    assert [r.actual_weather_observation for r in got] == [True, False, False, False]
    assert [r.weather_stale for r in got] == [False, False, False, True]
    assert [r.weather_value for r in got] == [1.0, 1.0, 1.0, None]
    none = timeops.align(grid(spark, [day(-1)]), {"weather": o}).first()
    assert none.actual_weather_observation is False and none.weather_stale is False


def test_rolling_is_open_on_the_left(spark):
    o = obs(spark, [(day(1), 1.0), (day(2), 2.0), (day(4), 4.0), (day(5), 8.0)])
    got = timeops.rolling(o, {"s": ("sum", "value", 3)}).orderBy("observation_timestamp").collect()
    assert [r.s for r in got] == [1.0, 3.0, 6.0, 12.0]
    o = obs(spark, [(day(1), None), (day(2), 2.0)])
    assert [r.s for r in timeops.rolling(o, {"s": ("sum", "value", 3)}).orderBy("observation_timestamp").collect()] == [None, 2.0]


def test_trend_needs_three_points(spark):
    o = obs(spark, [(day(n), 2.0 * n) for n in range(3)])
    got = [r.t for r in timeops.trend(o, {"t": ("value", 30)}).orderBy("observation_timestamp").collect()]
    assert got[:2] == [None, None] and abs(got[2] - 2) < 1e-9
    same = obs(spark, [(day(1), float(n)) for n in range(3)])
    assert {r.t for r in timeops.trend(same, {"t": ("value", 30)}).collect()} == {None}


def test_change_keeps_a_null_row(spark):
    o = obs(spark, [(day(0), 1.0), (day(1), None), (day(8), 9.0)])
    got = timeops.change(o, {"c": ("value", 7)}).orderBy("observation_timestamp").collect()
    assert got[-1].c is None


def test_greedy_spacing_is_not_a_lag(spark):
    hours = [0, 20, 30, 50, 54]
    got = timeops.greedy_spacing(grid(spark, [day(0, hours=h) for h in hours])).orderBy("reference_timestamp").collect()
    assert [(r.reference_timestamp - D0).total_seconds() / 3600 for r in got] == [0, 30, 54]


def test_greedy_spacing_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(u, day(0, minutes=rng.randrange(20000))) for u in range(5) for _ in range(60)]
    want = []
    for u in range(5):
        last = None
        for t in sorted({t for v, t in rows if v == u}):
            if last is None or t - last >= dt.timedelta(hours=24):
                want.append((u, t))
                last = t
    got = timeops.greedy_spacing(spark.createDataFrame(rows, "lake_uid long, reference_timestamp timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == want


def labelled(spark, events, refs, ages=None, horizons=(3,)):
    g = spark.createDataFrame(
        [(1, t, 0.0 if ages is None else a) for t, a in zip(refs, ages or [0.0] * len(refs), strict=True)],
        "lake_uid long, reference_timestamp timestamp_ntz, weather_age_hours double",
    )
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate(events)], "lake_uid long, event_id long, event_ts timestamp_ntz")
    return {r.reference_timestamp: r for r in labels.label(g, e, horizons=horizons).collect()}


def test_label_boundaries(spark):
    e = day(100)
    refs = {
        "edge": e - dt.timedelta(days=3), "past edge": e - dt.timedelta(days=3, seconds=1), "at": e, "after": e + dt.timedelta(days=30),
        "far": e + dt.timedelta(days=31), "before": e - dt.timedelta(days=30), "far before": e - dt.timedelta(days=31),
    }
    got = labelled(spark, [e], list(refs.values()))
    status = {n: got[t].label_status for n, t in refs.items()}
    assert status == {
        "edge": "POSITIVE", "past edge": "EVENT_WINDOW_EXCLUDED", "at": "EVENT_WINDOW_EXCLUDED", "after": "EVENT_WINDOW_EXCLUDED",
        "far": "NEGATIVE_ELIGIBLE", "before": "EVENT_WINDOW_EXCLUDED", "far before": "NEGATIVE_ELIGIBLE",
    }


def test_label_takes_the_nearest_event_and_checks_age(spark):
    r = labelled(spark, [day(3), day(2)], [day(0)])[day(0)]
    assert (r.event_count_within_horizon, r.matched_event_id) == (2, 1)
    got = labelled(spark, [], [day(0), day(1), day(2)], [72.0, 72.01, None])
    assert [got[day(n)].label_status for n in range(3)] == ["NEGATIVE_ELIGIBLE"] + ["INSUFFICIENT_FEATURE_COVERAGE"] * 2


def test_month_and_day_distances(spark):
    t = spark.createDataFrame(
        [(dt.datetime(2024, a, 1), dt.datetime(2024, b, 1)) for a, b in ((1, 12), (6, 8), (1, 7))] + [(D0, D0 - dt.timedelta(hours=12))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = t.select(X.month_distance("a", "b"), X.days_apart("b", "a")).collect()
    assert [r[0] for r in got[:3]] == [1, 2, 6] and got[3][1] == 1


def test_upsert_keeps_the_last(spark):
    old, new = spark.createDataFrame([("A", 1, 0)], "k string, v int, n int"), spark.createDataFrame(
        [("A", 2, 0), ("A", 3, 1)], "k string, v int, n int",
    )
    assert [r.v for r in upsert.upsert(old, new, ["k"], [F.col("n").desc()]).collect()] == [3]
    assert upsert.upsert(old, old, ["k"]).count() == 1


def test_overwrite_may_read_its_target(spark, tmp_path):
    at = str(tmp_path / "t")
    upsert.overwrite(spark.range(3), at)
    upsert.overwrite(spark.read.parquet(at).where("id > 0"), at)
    assert spark.read.parquet(at).count() == 2


def test_digest_ignores_order_not_repeats(spark):
    a, b = spark.range(5), spark.range(5).orderBy(F.col("id").desc())
    d = lambda t: upsert.table_digest(t).first()
    assert d(a) == d(b) != d(a.union(a))


def test_baseline_least_samples(spark):
    def wx(n):
        return spark.createDataFrame(
            [(1, i, day(i), 1.0, 2.0) for i in range(n)],
            "lake_uid long, observation_id long, observation_timestamp timestamp_ntz, temperature_2m_c double, precipitation_mm double",
        )

    def sat(n):
        return obs(spark, [(day(i), 1.0) for i in range(n)], "lake_area_km2")

    one = spark.createDataFrame([(1,)], "lake_uid long")
    flag = lambda w, s: features.baselines(one, wx(w), sat(s)).first().baseline_quality_flag
    assert [flag(29, 4), flag(30, 4), flag(29, 5)] == ["insufficient_sample", "good", "good"]


def test_missing_intervals(spark):
    e = spark.createDataFrame([(7, 1, day(3))], "event_id long, lake_uid long, event_ts timestamp_ntz")
    covered = spark.createDataFrame([(1, "s", day(2)), (1, "s", day(4))], "lake_uid long, source string, day timestamp_ntz")
    r = features.missing_intervals(e, covered, {"s": "2000-01-01", "later": "2030-01-01"}, 2, 2).collect()
    assert [(str(x.fetch_from), str(x.fetch_to), x.missing_days, x.covered_days) for x in r] == [("2024-01-02", "2024-01-06", 3, 2)]


def test_geography(spark):
    r = spark.range(1).select(
        X.haversine_km(F.lit(27.9), F.lit(86.9), F.lit(27.91), F.lit(86.9)),
        X.haversine_km(F.lit(27.9), F.lit(86.9), F.lit(27.95), F.lit(86.9)),
        *[X.utm_epsg(F.lit(30.0), F.lit(x)) for x in (78.0, 86.9, 90.0)], X.mercator_x(F.lit(80.0)), X.mercator_y(F.lit(30.0)),
        *X.utm_xy(F.lit(27.9881), F.lit(86.925), 45),
    ).first()
    assert round(r[0], 4) == 1.1119 and round(r[1], 4) == 5.5597 and list(r[2:5]) == [32644, 32645, 32646]
    assert round(r[5], 3) == 8905559.263 and round(r[6], 3) == 3503549.844
    assert abs(r[7] - 492625.3) < 5 and abs(r[8] - 3095886.6) < 50


def test_circular_mean(spark):
    r = spark.createDataFrame([(1.0,), (359.0,), (None,), (float("nan"),)], "a double").agg(X.circular_mean("a")).first()[0]
    assert min(r, 360 - r) < 1e-9


def test_polygons(spark):
    ring = lambda *p: [{"x": x, "y": y} for x, y in p]
    shell, hole = ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)), ring((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))
    t = spark.createDataFrame(
        [([shell, hole], 3.0, 3.0), ([shell, hole], 1.5, 1.5), ([shell, hole], 7.0, 4.0), ([ring((0.0, 0.0), (1.0, 1.0))], 0.0, 0.0)],
        "polygon array<array<struct<x:double,y:double>>>, x double, y double",
    )
    cx, cy = geo.centroid("polygon")
    r = t.select(
        geo.contains("polygon", "x", "y"), geo.distance("polygon", "x", "y"), geo.area("polygon"), geo.valid("polygon"), cx, cy,
    ).collect()
    assert [x[0] for x in r] == [True, False, False, False]
    assert r[0][1] == 0 and abs(r[1][1] - 0.5) < 1e-12 and r[2][1] == 3.0
    assert r[0][2] == 15.0 and [x[3] for x in r] == [True, True, True, False] and (r[0][4], r[0][5]) == (2.0, 2.0)


def test_wkb_round_trip(spark):
    p = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]]
    t = spark.createDataFrame([(p,), (None,)], f"p {tables.RINGS}")
    r = t.select(tables.wkb_rings()(tables.to_wkb()("p")).alias("q")).collect()
    assert [[q.asDict() for q in ring] for ring in r[0].q] == p and r[1].q is None


def test_aspect_is_the_ascent():
    z = np.arange(25).reshape(5, 5) // 5 * 10.0
    slope, aspect = raster.slope_aspect(z, 10, 10)
    assert np.allclose(aspect, 180) and np.allclose(slope, 45) and np.allclose(raster.slope_aspect(z, 10, 10, True)[1], 0)


def test_terrain_takes_whole_tiles(spark, tmp_path):
    from tarnwatch.plans import spatial

    values = {1: [7.5, 1.0, 3.0], 2: [float(i * i % 17) for i in range(12)], 3: [float(i * 31 % 101) for i in range(64)]}
    rows = [(i, u, v) for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = {r.tile: r for r in spatial.h08_terrain(spark, str(tmp_path)).collect()}
    assert set(out) == set(values) and out[1].mean_slope_deg is None
    for u, vs in values.items():
        z = np.floor(np.array(vs))
        assert np.isclose(out[u].elevation_m, z.mean())
        if len(z) > 5:
            z = np.concatenate([z, np.full(-len(z) % 5, np.nan)]).reshape(-1, 5)
            slope, _ = raster.slope_aspect(z, 30, 30)
            assert np.isclose(
                out[u].mean_slope_deg, np.nanmean(slope), atol=1e-5,
            ) and np.isclose(out[u].max_slope_deg, np.nanmax(slope), atol=1e-5)


def dedup_loop(rows):
    """(leader of each) by the plain greedy loop."""
    from math import asin, cos, radians, sin, sqrt

    def km(a, b):
        p, q = radians(a[2]), radians(b[2])
        return 2 * 6371 * asin(sqrt(sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[3] - a[3]) / 2) ** 2))

    def name(x):
        n = (x[4] or "").lower().replace("°", "").strip()
        return n if n not in ("", "nan", "none", "unknown") else None

    out = {}
    for i, a in enumerate(rows):
        if a[0] in out:
            continue
        out[a[0]] = a[0]
        for b in rows[i + 1 :]:
            if b[0] in out:
                continue
            d = km(a, b)
            date = a[1] is not None and a[1] == b[1]
            year = a[1] is not None and b[1] is not None and a[1].year == b[1].year
            score = (3 if d < 2 else 1 if d < 10 else 0) + (4 if date else 2 if year else 0) + (3 if name(a) and name(a) == name(b) else 0)
            if score >= 6 or d < 2 and date:
                out[b[0]] = a[0]
    return out


def test_leaders_equal_the_loop(spark):
    rng = random.Random(3)
    rows = [
        (
            i, dt.date(2000 + rng.randrange(2), 1 + rng.randrange(2), 1 + rng.randrange(2)) if rng.random() > 0.1 else None,
            27 + rng.randrange(12) * 0.008, 86 + rng.randrange(3) * 0.01, rng.choice(["Lake A", "lake a°", "B", "unknown", None]),
        ) for i in range(80)
    ]
    e = spark.createDataFrame(rows, "idx long, event_date date, latitude double, longitude double, lake_name string")
    got = {r.idx: r.leader for r in resolve.leaders(e, resolve.pair_scores(e)).collect()}
    assert got == dedup_loop(rows)


def test_difflib_ratio(spark):
    t = spark.createDataFrame([("dig tsho", "digtsho"), ("luggye", "lugge tsho"), (None, "x")], "a string, b string")
    r = [x[0] for x in t.select(resolve.name_ratio()("a", "b")).collect()]
    assert round(r[0], 4) == 0.9333 and r[1] == 0.625 and r[2] is None


def test_ranking_of_ties_and_one_class(spark):
    rows = [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)]
    r = metrics.ranking(spark.createDataFrame(rows, "true_label int, predicted_probability double"), []).first()
    assert (r.roc_auc, r.pr_auc) == (0.5, 0.5)
    r = metrics.ranking(spark.createDataFrame([(0, 0.1)], "true_label int, predicted_probability double"), []).first()
    assert r.roc_auc is None and r.pr_auc is None


def test_rates_without_alarms(spark):
    c = metrics.rates(spark.createDataFrame([(0, 0, 2, 3)], "tp long, fp long, fn long, tn long")).first()
    assert (c.precision, c.f1) == (0.0, 0.0)
    assert metrics.rates(spark.createDataFrame([(0, 0, 0, 3)], "tp long, fp long, fn long, tn long"), True).first().recall is None


def test_stratified_groups(spark):
    assert set(splits.assign_groups([(g, (10, 2)) for g in range(6)], 3).values()) == {0, 1, 2}
    t = spark.createDataFrame([(g, int(g == 0)) for g in range(3)], "lake_uid long, event_within_horizon int")
    assert splits.stratified_groups(t) is None


def test_smote_balances(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), 1) for a, b in rng.random((20, 2))] + [(float(a), float(b), 0) for a, b in rng.random((60, 2)) + 3]
    out = ml.smote(spark.createDataFrame(rows, "a double, b double, true_label int"), ["a", "b"])
    n = {r.true_label: r["count"] for r in out.groupBy("true_label").count().collect()}
    assert n[1] == 60 and out.where("true_label = 1 and (a > 1 or b > 1)").isEmpty()


def test_smote_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.integers(0, 4, (100, 2)), np.full((30, 2), 9.0)]).astype(float)
    near, sizes = ml.neighbours(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], 5, 20)
    assert len(sizes) > 10 and sum(s for _, s in sizes) == len(x)
    got = {}
    for r in near.collect():
        got.setdefault((r.a, r.b), []).extend([r._d] * r._n)
    for p in x:
        want = np.sort(((x - p) ** 2).sum(1))[1:6]
        assert np.allclose(sorted(got[tuple(p)])[:5], want)


def test_smote_takes_the_nearest_of_all(spark):
    # pairs 1 apart, each pair 100 from the next; more positives than a block holds
    rows = [(100.0 * (i // 2) + i % 2, 0.0, 1) for i in range(200)] + [(0.0, 50.0, 0)] * 601
    out = ml.smote(spark.createDataFrame(rows, "a double, b double, true_label int"), ["a", "b"], k=1, block=20)
    a = [r.a for r in out.where("true_label = 1").collect()]
    assert len(a) == 601 and all(v % 100 <= 1 for v in a)


def test_smote_query_keeps_every_row(spark, tmp_path):
    from tarnwatch.plans import learning

    rows = [("R", i, i % 50, float(i), 0.1, 1, "F") for i in range(300)]
    spark.createDataFrame(
        rows,
        "l_returnflag string, l_orderkey long, l_quantity long, l_extendedprice double, l_discount double, l_suppkey long, "
        "l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    have = {r.l_extendedprice for r in learning.oversampled(spark, str(tmp_path)).where("l_extendedprice = floor(l_extendedprice)").collect()}
    assert have >= {r[3] for r in rows}


def test_streams_give_their_last_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from tarnwatch.plans import streams

    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(hours=5 * i + i % 7), float(i), "view") for i in range(140)]
    spark.createDataFrame(
        rows, "event_id long, user_id long, ts timestamp, value double, event_type string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    e = spark.read.parquet(f"{tmp_path}/events.parquet")
    for name, w in (
        ("l_daily_windows", F.window("ts", "1 day")), ("l_sliding_windows", F.window("ts", "3 days", "1 day")),
        ("l_sessions", F.session_window("ts", "6 hours")),
    ):
        want = e.groupBy("user_id", w.alias("w")).agg(F.count("*")).select("user_id", "w.start", "w.end", "count(1)").collect()
        got = streams.QUERIES[name](spark, str(tmp_path)).select("lake_uid", "start", "end", "rows").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), name


def test_choice_scans_in_order():
    row = lambda n, pr, f1, recall, size: {"n": n, "pr_auc": pr, "f1": f1, "recall": recall, "complexity": size}
    assert ml.choose([row(1, 0.50, 0.4, 0.1, 1), row(2, 0.503, 0.5, 0.1, 9), row(3, 0.507, 0.1, 0.9, 1)])["n"] == 2
    assert ml.choose([row(1, 0.5, 0.4, 0.3, 2), row(2, 0.5, 0.4, 0.3, 1), row(3, 0.5, 0.4, 0.31, 9)])["n"] == 3
    assert ml.choose([]) is None


def test_null_flags_and_columns(spark):
    t = spark.createDataFrame([(1.0, float("nan")), (None, 2.0)], "A double, b double")
    assert X.resolve(t, ["x", "a"]) == "A" and X.resolve(t, ["x"]) is None
    assert X.clean(t).where("b is null").count() == 1
    assert checks.forbidden(t, ["b", "q"]) == ["b"]
    assert checks.run_complete(
        {"dem": "SUCCESS", "gpm": "PARTIAL", "quality_control": "SUCCESS", "leakage_test": "SUCCESS"}
    ) and not checks.run_complete({"dem": "SUCCESS"})
    assert inventory.canonical(t.withColumn("lake_uid", F.lit("x"))).columns == ["lake_uid", "A", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("Latitude,Longitude,Lake,Year\n1,2,caf\xe9,3\n", encoding="latin-1")
    (tmp_path / "c.csv").write_text("lat,lon,lake,year\n")
    assert tables.discover_csv([str(tmp_path / f"{n}.csv") for n in "abc"]).endswith("b.csv")
    assert tables.csv_latin1(spark, str(tmp_path / "b.csv")).first().Lake == "caf\xe9"
    g = spark.createDataFrame([("n", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}')], "name string, geometry_json string")
    tables.write_geojson(g, str(tmp_path / "g.json"))
    back = tables.geojson(spark, str(tmp_path / "g.json"))
    assert back.first().name == "n" and back.select(geo.area(tables.polygon_of("coordinates"))).first()[0] == 0.5
    assert tables.parquet(spark, str(tmp_path / "none"), "a int").count() == 0
    tables.freeze({"a": str(tmp_path / "a.csv")}, str(tmp_path / "m.json"))
    tables.verify({"a": str(tmp_path / "a.csv")}, str(tmp_path / "m.json"))
    (tmp_path / "a.csv").write_text("changed")
    with pytest.raises(ValueError):
        tables.verify({"a": str(tmp_path / "a.csv")}, str(tmp_path / "m.json"))
    assert tables.markdown(g.select("name"), "T").splitlines()[-1] == "|n|"


def test_downloads(tmp_path):
    at, calls = str(tmp_path / "f"), []
    fetch = lambda url: calls.append(url) or [b"a", b"b"]
    assert remote.download("u", at, fetch) and not remote.download("u", at, fetch) and len(calls) == 1
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert remote.retried(flaky, sleep=lambda _: None) == "ok"
    assert remote.outward(27.13, 86.17, 27.02, 86.29) == (27.2, 86.1, 27.0, 86.3)
    assert remote.first_existing(["tp", "x"], ["precip", "tp"]) == "tp"
