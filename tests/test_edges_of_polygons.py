"""Repair of polygons whose areas are known, and of random ones against even-odd areas from a fine raster."""

import random
import re

import pytest

from tarnwatch.functions.storage import stored
from tarnwatch.operators import edges, overlay

POLYGONS = "id long, polygon array<array<struct<x:double,y:double>>>"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


CASES = {
    1: ([square(0, 0, 4)], "valid_original", 16),
    2: ([[(0, 0), (4, 4), (4, 0), (0, 4)]], "repaired", 8),  # bow-tie
    3: ([[(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)]], "repaired", 16),  # spike
    4: ([square(0, 0, 4) * 2], "unrepairable", 0),  # a ring twice over cancels
    5: ([square(0, 0, 10), square(1, 1, 4), square(3, 3, 4)], "repaired", 100 - 16 - 16 + 8),  # overlapping holes
    6: ([square(0, 0, 10), square(1, 1, 4)], "valid_original", 84),
    7: ([square(0, 0, 10), square(8, 8, 4)], "repaired", 100 - 4 + 12),  # a hole across the shell
    8: ([[(0, 0), (5, 0)]], "unrepairable", 0),
    9: (None, "valid_original", 0),
    10: ([[]], "unrepairable", 0),
    11: ([[(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2)]], "repaired", 8),  # touches itself
    12: ([square(0, 0, 10), square(20, 20, 2)], "repaired", 104),  # a hole outside
    13: ([[(0, 0), (8, 0), (8, 8), (0, 8)], [(4, 0), (6, 4), (2, 4)]], "valid_original", 56),  # a hole that touches the shell
    14: ([[(0.1, 0.1), (0.7, 0.1), (0.7, 0.4), (0.1, 0.4)] + [(0.1, 0.1)]], "valid_original", 0.18),  # closed explicitly
}


def rows(cases):
    return [(k, None if p is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for k, p in cases]


def test_known_areas(spark):
    got = {r.id: r for r in edges.repair(spark.createDataFrame(rows((k, p) for k, (p, *_) in CASES.items()), POLYGONS)).collect()}
    assert len(got) == len(CASES)
    for k, (p, status, area) in CASES.items():
        assert got[k].status == status, k
        if status == "repaired":
            made = [[(q.x, q.y) for q in r] for r in got[k].repaired]
            assert overlay.region_area(made) == pytest.approx(area), k
            assert sum(abs(overlay.signed_area(r)) for r in made) >= area - 1e-9
    assert len(got[2].repaired) == 2 and len(got[11].repaired) == 2
    assert got[5].area_change == pytest.approx(8 / 68, abs=1e-6) and got[3].area_change == 0


def test_random_polygons(spark):
    rnd = random.Random(4)
    cases = [(k, [[(rnd.random() * 10, rnd.random() * 10) for _ in range(rnd.randint(3, 14))] for _ in range(rnd.randint(1, 2))]) for k in range(12)]
    cases.append((99, [[(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(40)]]))  # many touches and overlaps
    got = {r.id: r for r in edges.repair(spark.createDataFrame(rows(cases), POLYGONS)).collect()}
    for k, p in cases:
        want = overlay.region_area([[(float(x), float(y)) for x, y in r] for r in p])
        if got[k].status == "repaired":
            made = [[(q.x, q.y) for q in r] for r in got[k].repaired]
            assert overlay.region_area(made) == pytest.approx(want, rel=1e-6), k
            assert sum(overlay.signed_area(r) for r in made) == pytest.approx(want, rel=1e-6), k
            assert not overlay_crossings(made), k


def overlay_crossings(rings):
    """Crossings that are left, of sides that share no corner."""
    s = overlay.sides(rings)
    i, j, x, y = overlay.crossings(s, s)
    ends = lambda k: {tuple(s[k, :2]), tuple(s[k, 2:])}
    corners = s.reshape(-1, 2)
    return [(a, b) for a, b, p, q in zip(i, j, x, y) if a < b and not ends(a) & ends(b) and abs(corners - (p, q)).max(1).min() > 1e-6]


GROUPED = "g string, polygon array<array<struct<x:double,y:double>>>"


def test_dissolved_groups(spark):
    """Shared borders, overlaps, an island in a lake, parts that touch in a corner, equal polygons; and a group that is one task's no more."""
    groups = {
        "grid": [[square(x, y, 1)] for x in range(6) for y in range(6) if (x, y) not in ((1, 1), (3, 3))],
        "island": [[square(0, 0, 10), square(1, 1, 8)], [square(3, 3, 2)]],
        "corner": [[square(0, 0, 1)], [square(1, 1, 1)], [square(0, 0, 1)]],
        "cross": [[[(0, 4), (9, 4), (9, 5), (0, 5)]], [[(4, 0), (5, 0), (5, 9), (4, 9)]]],
        "within": [[square(0, 0, 9)], [square(2, 2, 3)]],
        None: [[square(0.1, 0.1, 0.2)], None],
    }
    data = [(g, p) for g, ps in groups.items() for _, p in rows(enumerate(ps))]
    got = {}
    for r in edges.dissolve(spark.createDataFrame(data, GROUPED), ["g"]).collect():
        got.setdefault(r.g, []).append((r.part, [[(q.x, q.y) for q in ring] for ring in r.polygon]))
    shape = {g: [(k, [(len(r), round(overlay.signed_area(r), 6)) for r in p]) for k, p in sorted(v)] for g, v in got.items()}
    assert shape["grid"] == [(0, [(4, 36.0), (4, -1.0), (4, -1.0)])]
    assert shape["island"] == [(0, [(4, 100.0), (4, -64.0)]), (1, [(4, 4.0)])]
    assert shape["corner"] == [(0, [(4, 1.0)]), (1, [(4, 1.0)])]
    assert shape["cross"] == [(0, [(12, 17.0)])] and shape["within"] == [(0, [(4, 81.0)])] and shape[None] == [(0, [(4, 0.04)])]


def test_random_unions(spark):
    rnd = random.Random(9)
    polygons = [[[(x + rnd.random() * 3, y + rnd.random() * 3) for _ in range(rnd.randint(3, 6))]] for x, y in ((rnd.random() * 6, rnd.random() * 6) for _ in range(25))]
    data = [("a", p) for _, p in rows(enumerate(polygons))]
    made = [[[(q.x, q.y) for q in ring] for ring in r.polygon] for r in edges.dissolve(spark.createDataFrame(data, GROUPED), ["g"]).collect()]
    everything = [[(-1, -1), (12, -1), (12, 12), (-1, 12)]]
    want = overlay.overlap_area(everything, [overlay.sides(p) for p in polygons])
    assert sum(overlay.signed_area(r) for p in made for r in p) == pytest.approx(want, rel=1e-6)


def test_nothing(spark):
    assert edges.dissolve(spark.createDataFrame([], GROUPED), ["g"]).count() == 0
    assert edges.repair(spark.createDataFrame([], POLYGONS)).count() == 0


def test_edges_of_small_files_meet_in_many_tasks(spark):
    """Few bytes of edges make many pairs: neither a broadcast nor the file's one split may make them one task."""
    squares = [(k, [[(0.0, 0.0), (1.0 + k, 1.0), (1.0 + k, 0.0), (0.0, 1.0)]]) for k in range(64)]
    e = stored(edges.edge_rows(spark.createDataFrame(rows(squares), POLYGONS)).coalesce(1), "one-file")
    made = edges.crossings(e)
    met = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[id#\d+L?, _cell#", met) and met.count("REPARTITION_BY_NUM") == 2
    assert made.select("id").distinct().count() == 64
