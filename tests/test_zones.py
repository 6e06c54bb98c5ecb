"""Zonal statistics against every pixel's centre."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import overlay, zones

POLYGONS = "id long, polygon array<array<struct<x:double,y:double>>>"
TILES = "tile_row int, tile_col int, height int, width int, value array<double>"


def test_equals_every_pixel(spark):
    rnd, cell, west, north, h, w, down, across = random.Random(6), 0.5, 10.0, 50.0, 4, 6, 5, 4
    values = {(r, c): None if rnd.random() < 0.1 else float(rnd.randint(-9, 9)) for r in range(h * down) for c in range(w * across)}
    tiles = [(i, j, h, w, [values[i * h + r, j * w + c] for r in range(h) for c in range(w)]) for i in range(down) for j in range(across)]
    polygons = []
    for k in range(30):
        x, y, s = west + rnd.random() * 12, north - rnd.random() * 10, rnd.random() * 6
        star = [(x + rnd.uniform(-s, s), y + rnd.uniform(-s, s)) for _ in range(rnd.randint(3, 8))]
        hole = [(x - s / 5, y - s / 5), (x + s / 5, y - s / 5), (x + s / 5, y + s / 5), (x - s / 5, y + s / 5)]
        polygons.append((k, [star, hole] if k % 2 else [star]))
    polygons += [
        (100, [[(0, 0), (1, 0), (1, 1)]]), (101, None), (102, [[(10.1, 49.9), (10.2, 49.9), (10.2, 49.8)]]),
        (103, [[(10, 50), (11, 50), (11, 49), (10, 49)]]),
    ]
    rows = [(k, None if p is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for k, p in polygons]
    got = {r.id: r for r in zones.zone_stats(spark.createDataFrame(tiles, TILES), spark.createDataFrame(rows, POLYGONS), west, north, cell).collect()}
    for k, p in polygons:
        sides = overlay.sides(p)
        held = [v for (r, c), v in values.items() if len(sides) and overlay.inside(sides, west + (c + 0.5) * cell, north - (r + 0.5) * cell)]
        known = [v for v in held if v is not None]
        assert (k in got) == bool(held), k
        if held:
            r = got[k]
            assert (r.pixels, r.valid) == (len(held), len(known))
            if known:
                assert (r.low, r.high, r.median) == (
                    min(known), max(known), statistics.median(known),
                ) and r.mean == pytest.approx(sum(known) / len(known))
    assert got[103].pixels == 4


def test_nothing(spark):
    polygons = spark.createDataFrame([], POLYGONS)
    assert zones.zone_stats(spark.createDataFrame([], TILES), polygons, 0.0, 0.0, 1.0).count() == 0
    assert zones.runs(polygons.where(F.lit(True)), 0.0, 0.0, 1.0).count() == 0
