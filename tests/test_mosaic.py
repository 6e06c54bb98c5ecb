"""Bilinear reprojection: seams of tiles do not show, missing pixels and tiles count for nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import mosaic

TILES = "tile_row int, tile_col int, height int, width int, value array<double>"


def cut(values, rows, columns, h, w):
    return [(i, j, h, w, [values[i * h + r][j * w + c] for r in range(h) for c in range(w)]) for i in range(rows // h) for j in range(columns // w)]


def bilinear(values, v, u):
    r, c, total, known = int(v // 1), int(u // 1), 0.0, 0.0
    for i in (0, 1):
        for j in (0, 1):
            if 0 <= r + i < len(values) and 0 <= c + j < len(values[0]) and (x := values[r + i][c + j]) is not None:
                w = (1 - abs(v - r - i)) * (1 - abs(u - c - j))
                total, known = total + w * x, known + w
    return total / known if known > 0 else None


@pytest.mark.parametrize("shape", [(12, 12), (4, 3), (1, 1), (6, 12)])
def test_seams_do_not_show(spark, shape):
    rnd = random.Random(8)
    values = [[None if rnd.random() < 0.15 else rnd.random() * 9 for _ in range(12)] for _ in range(12)]
    tiles = spark.createDataFrame(cut(values, 12, 12, *shape), TILES)
    turn = lambda x, y: (0.8 * x + 0.3 * y, -0.2 * x + 0.9 * y)
    got = {(r.row, r.col): r.value for r in mosaic.reproject(tiles, (0.0, 12.0, 1.0), (-4.0, 16.0, 0.7), 25, 30, turn, block=7).collect()}
    for r in range(25):
        for c in range(30):
            x, y = turn(-4.0 + (c + 0.5) * 0.7, 16.0 - (r + 0.5) * 0.7)
            want = bilinear(values, 12.0 - y - 0.5, x - 0.5)
            assert ((r, c) in got) == (want is not None)
            assert want is None or got[r, c] == pytest.approx(want)


def test_a_missing_tile_and_no_tiles(spark):
    values = [[float(r + c) for c in range(8)] for r in range(8)]
    tiles = spark.createDataFrame(cut(values, 8, 8, 4, 4), TILES)
    same = lambda x, y: (x, y)
    out = mosaic.reproject(tiles.where("tile_row = 0 or tile_col = 0"), (0.0, 8.0, 1.0), (0.0, 8.0, 1.0), 8, 8, same)
    assert {(r.row, r.col): r.value for r in out.collect()} == {(r, c): float(r + c) for r in range(8) for c in range(8) if r < 4 or c < 4}
    assert mosaic.reproject(tiles.where(F.lit(False)), (0.0, 8.0, 1.0), (0.0, 8.0, 1.0), 8, 8, same).count() == 0
