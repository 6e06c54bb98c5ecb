"""Ranks and sums by ranges, ties of long ids, polygon overlays and greedy spacing against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import ranges, storage
from tarnwatch.operators import geo, overlay, resolve, splits, timeops


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for _ in range(400)] + [("a", 7, 1)] * 300
    rows = sorted({(g, v, n, k) for k, (g, v, n) in enumerate(rows)}, key=str)
    df = spark.createDataFrame(rows, "g string, v int, n int, k int")
    got = {(r.g, r.k): (r.s, r._next) for r in ranges.running(df, ["g"], ["v", "k"], {"s": "n"}, following="k").collect()}
    for g in ("a", "b", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])), 0
        for i, r in enumerate(own):
            total += r[2]
            assert got[g, r[3]] == (total, own[i + 1][3] if i + 1 < len(own) else None)
    assert [r.n for r in ranges.numbered(df, [F.col("k").desc()], "n").orderBy("n").select("n").collect()] == list(range(1, len(rows) + 1))
    with pytest.raises(ValueError):
        ranges.running(df, [], [F.col("v").desc()], {"s": "n"}, following="k")


def test_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(30))) for g in "ab" for _ in range(101)] + [(None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r.g: r.q for r in ranges.percentiles(df, ["g"], "v", at).collect()}
    for g in "ab":
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g], at))
    assert got[None] == [1.0] * len(at) and got["none"] == [None] * len(at)
    assert ranges.percentiles(df.where("false"), [], "v", [0.5]).first().q == [None]


def test_asof_ties_of_long_ids(spark):
    """Ids of 40 characters that differ in the last ones, and numbers that text would order otherwise."""
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, t)], "lake_uid long, reference_timestamp timestamp_ntz")
    same = "S2A_MSIL2A_" + "x" * 28
    for order in (1, -1):
        text = [(1, t, same + c, v) for c, v in (("a", 1.0), ("b", 2.0))][::order]
        whole = [(1, t, n, v) for n, v in ((9, 1.0), (10, 2.0), (-11, 3.0))][::order]
        a = spark.createDataFrame(text, "lake_uid long, observation_timestamp timestamp_ntz, observation_id string, v double")
        b = spark.createDataFrame(whole, "lake_uid long, observation_timestamp timestamp_ntz, observation_id long, v double")
        r = timeops.asof(left, {"a": a, "b": b}).first()
        assert r.a.v == 2.0 and r.b.observation_id == 10


def test_numbers_beyond_six_places(spark):
    old = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(1, 4)], "id long, lat double, lon double")
    new = spark.createDataFrame([("TARN_999999", 80.0, 0.0)], "uid string, lat double, lon double")
    assert sorted(r.uid for r in geo.link_epochs(old, new).collect()) == ["TARN_1000000", "TARN_1000001", "TARN_1000002"]
    many = spark.range(1_000_001).select(
        "id", (F.col("id") % 170 - 85).cast("double").alias("lat"), (F.col("id") % 300 / 2 - 75).alias("lon"),
    )
    uids = geo.link_epochs(many, new, 0.001).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u")).first()
    assert uids.n == uids.u == 1_000_001


def test_greedy_spacing_over_many_batches(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(e, t0 + dt.timedelta(minutes=rng.randrange(60_000))) for e in (1, 2, None) for _ in range(300)] + [(1, None)]
    df = spark.createDataFrame(rows, "lake_uid long, reference_timestamp timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((str(r[0]), r[1]) for r in timeops.greedy_spacing(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for e in (1, 2, None):
        last = None
        for t in sorted(t for k, t in rows if k == e and t):
            if last is None or t - last >= dt.timedelta(hours=24):
                want.append((str(e), t))
                last = t
    assert got == sorted(want)


def grid_area(polygons, n=400):
    """Share of a 10 by 10 square's grid points in the union of polygons."""
    at = (np.arange(n) + 0.5) * 10 / n
    points = np.array([(x, y) for x in at for y in at])
    return np.any([overlay.within(overlay.sides(p), points) for p in polygons], axis=0).mean() * 100


def star(rng, cx, cy):
    turns = sorted(rng.random() * 2 * np.pi for _ in range(9))
    return [[(cx + rng.uniform(0.5, 2.5) * np.cos(t), cy + rng.uniform(0.5, 2.5) * np.sin(t)) for t in turns]]


def test_overlays_of_odd_shapes_equal_a_grid():
    rng = random.Random(2)
    for _ in range(6):
        shapes = [star(rng, rng.uniform(3, 7), rng.uniform(3, 7)) for _ in range(4)]
        made = overlay.union(shapes)
        whole = sum(overlay.signed_area(r) for p in made for r in p)
        assert abs(whole - grid_area(shapes)) < 0.3
        sides = [overlay.sides(p) for p in shapes]
        assert abs(sum(overlay.overlap_area(p, sides) for p in made) - whole) < 1e-6 * max(whole, 1)
        both = overlay.overlap_area(shapes[0], sides[1:2])
        a, b = grid_area(shapes[:1]), grid_area(shapes[1:2])
        assert abs(both - (a + b - grid_area(shapes[:2]))) < 0.3


def test_union_of_neighbours_and_rings():
    square = lambda x, y, w=1.0: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    # a border in common goes, a ring of squares keeps its hole, apart stays apart
    assert [len(p[0]) for p in overlay.union([square(0, 0), square(1, 0)])] == [4]
    ring = overlay.union([square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    assert len(ring) == 1 and len(ring[0]) == 2 and abs(sum(map(overlay.signed_area, ring[0])) - 8) < 1e-9
    assert len(overlay.union([square(0, 0), square(5, 5)])) == 2 and overlay.union([]) == []
    assert overlay.gap(overlay.sides(square(0, 0)), overlay.sides(square(3, 0))) == 2.0 and overlay.gap(
        overlay.sides(square(0, 0, 9)), overlay.sides(square(3, 3)),
    ) == 0.0


def test_nearest_site_however_far(spark):
    rng = random.Random(6)
    place = lambda: (rng.uniform(0, 5e6), rng.uniform(0, 5e5))
    e = [(i, i % 2, *place()) for i in range(40)] + [(99, 7, 0.0, 0.0)]
    s = [(i, i % 2, *place()) for i in range(15)]
    flat = [(i, c, [[{"x": x + a, "y": y + b} for a, b in ((0, 0), (9, 0), (9, 9), (0, 9))]]) for i, c, x, y in s]
    got = {
        r.a_id: (r.b_id, r.distance_m) for r in resolve.nearest_site(
            spark.createDataFrame(e, "a_id long, country int, _x double, _y double"),
            spark.createDataFrame(flat, "b_id long, country int, _flat array<array<struct<x:double,y:double>>>"),
        ).collect()
    }
    for i, c, x, y in e[:-1]:
        d = {j: np.hypot(max(sx - x, x - sx - 9, 0), max(sy - y, y - sy - 9, 0)) for j, k, sx, sy in s if k == c}
        best = min(d, key=d.get)
        assert got[i][0] == best and abs(got[i][1] - d[best]) < 1e-6
    assert 99 not in got


def test_folds_of_groups(spark):
    rows = [(1, 1, "e2"), (1, 0, None), (2, 0, None), (3, 1, "e1"), (None, 0, None)]
    df = spark.createDataFrame(rows, "lake_uid long, event_within_horizon int, matched_event_id string")
    sizes = {(r.fold, r.is_test): r.rows for r in splits.fold_sizes(df, splits.group_folds(df)).collect()}
    assert sizes == {(1, True): 2, (1, False): 3, (3, True): 1, (3, False): 4}
    assert sorted(r.is_test for r in splits.fold(df, 1).collect()) == [False, False, False, True, True]


def test_stored_tables_are_released(spark):
    n = len(storage._written)
    t = storage.stored(spark.range(5), "release")
    assert t.count() == 5 and len(storage._written) == n + 1
    assert storage.release(spark) >= 1 and not storage._written
    with pytest.raises(Exception):  # noqa: B017
        t.count()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, **c):
            self.c = c

        def get(self, key, default=None):
            return self.c.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://m:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.folder(Session(), "x")
