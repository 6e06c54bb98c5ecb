"""Adaptive cells against all pairs, with crowded cells and points that coincide."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import geo, quadtree, resolve


def town(rnd, n):
    """Points of which half coincide and a quarter are crowded together."""
    out = []
    for k in range(n):
        if k % 2:
            x, y = 5.25, 5.25
        elif k % 4:
            x, y = 5 + rnd.random() / 10, 5 + rnd.random() / 10
        else:
            x, y = rnd.random() * 40 - 20, rnd.random() * 40 - 20
        out.append((k, x, y))
    return out


@pytest.mark.parametrize("depth", [1, 4])
def test_meets_all_boxes(spark, depth):
    rnd = random.Random(depth)
    points = town(rnd, 600) + [(1000, -20.0, 20.0)]
    boxes = [(k, (x := rnd.random() * 40 - 20), x + rnd.random() * 30 - 1, (y := rnd.random() * 40 - 20), y + rnd.random() * 5) for k in range(40)]
    boxes += [(40, 5.25, 5.25, 5.25, 5.25), (41, -20.0, 20.0, -20.0, 20.0)]
    boxes = [b for b in boxes if b[1] <= b[2]]
    p = spark.createDataFrame(points, "p long, _x double, _y double")
    b = spark.createDataFrame(boxes, "b long, _x0 double, _x1 double, _y0 double, _y1 double")
    got = sorted((r.p, r.b) for r in quadtree.meet(p, b, 10.0, share=50, least=20, depth=depth).select("p", "b").collect())
    assert got == sorted((i, j) for i, x, y in points for j, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)


def test_a_town_is_spread_over_tasks(spark):
    """100,000 points in one old cell: no leaf and salt has more than the bound."""
    p = spark.range(100_000).select(
        F.col("id").alias("p"), (F.lit(7.0) + F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1))).alias("_x"), (F.lit(7.0) + F.col("id") % 2 * F.rand(2)).alias("_y"),
    )
    b = spark.createDataFrame([(1, 6.0, 9.0, 6.0, 9.0)], "b long, _x0 double, _x1 double, _y0 double, _y1 double")
    met = quadtree.meet(p, b, 10.0)
    assert met.count() == 100_000
    split, levels, total = quadtree.directory(p, 10.0)
    assert total == 100_000 and max(levels) == quadtree.DEPTH and split.agg(F.max("parts")).first()[0] == 20
    sizes = met.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_sides_of_odd_polygons(spark):
    hole = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D)), array(named_struct('x', 1D, 'y', 1D), named_struct('x', 2D, 'y', 1D), named_struct('x', 2D, 'y', 2D), named_struct('x', 1D, 'y', 2D)))"
    polygons = spark.sql(f"select 1L as polygon_id, {hole} as polygon union all select 2L, null union all select 3L, array(array(named_struct('x', 0D, 'y', 0D)))")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0), (4, None, 1.0), (1, 0.5, 0.5)], "point_id long, x double, y double")
    assert [tuple(r) for r in geo.point_in_polygon(points, polygons).collect()] == [(1, 1), (1, 1)]


def test_near_sites_of_nothing(spark):
    events = spark.createDataFrame([], "a_id long, a_lat double, a_lon double")
    sites = spark.createDataFrame([], "b_id long, polygon array<array<struct<x:double,y:double>>>")
    assert resolve.near_sites(events, sites, 1000.0).count() == 0
