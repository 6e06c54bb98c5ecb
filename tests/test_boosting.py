"""Histogram boosting against exact boosting in plain loops, missing values, odd tables."""

import math
import random

import pytest

from tarnwatch.operators import boosting

SCHEMA = "a double, b double, c double, true_label int"


def made(n=240, seed=1):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a, b = float(rng.randrange(12)), rng.choice([None, math.nan, float(rng.randrange(5))])
        missing = b is None or b != b
        y = int(missing and a > 5 or not missing and a + 2 * b + rng.gauss(0, 2) > 9)
        out.append((a, b, None, y))
    return out


def plain(rows, trees, depth, rate=0.1, l2=1.0, least=1.0):
    """Margins of the rows by exact boosting: every value of a and b is tried as an edge, missing values on either side."""
    x = [[r[0], None if r[1] is None or r[1] != r[1] else r[1]] for r in rows]
    y = [r[3] for r in rows]
    m = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in m]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        score = lambda rows_: sum(g[i] for i in rows_) ** 2 / (sum(h[i] for i in rows_) + l2)
        groups = [list(range(len(y)))]
        for _ in range(depth):
            after = []
            for own in groups:
                best = None
                for f in (0, 1):
                    for edge in sorted({x[i][f] for i in own} - {None}):
                        for left_missing in (True, False):
                            left = [i for i in own if (left_missing if x[i][f] is None else x[i][f] < edge)]
                            right = [i for i in own if i not in set(left)]
                            if sum(h[i] for i in left) < least or sum(h[i] for i in right) < least:
                                continue
                            gain = score(left) + score(right) - score(own)
                            k = (-round(gain, 6), f, edge, not left_missing)
                            if gain > 1e-6 and (best is None or k < best[0]):
                                best = k, left, right
                after += [own] if best is None else [best[1], best[2]]
            groups = after
        for own in groups:
            w = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + l2)
            for i in own:
                m[i] += w
    return m


def test_equals_exact_boosting(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.fit(df, ["a", "b", "c"], trees=4, depth=2, keep=2)
    got = sorted((*map(str, r[:2]), r.m) for r in df.select("a", "b", model.margin().alias("m")).collect())
    want = sorted((*map(str, r[:2]), m) for r, m in zip(rows, plain(rows, 4, 2)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def test_missing_values_go_where_their_labels_are(spark):
    for missing_label in (0, 1):
        rows = [(float(k % 10), None, None, int(k % 10 >= 5)) for k in range(100)] + [(v, None, None, missing_label) for v in [None, math.nan] * 20]
        df = spark.createDataFrame(rows, SCHEMA)
        tree = boosting.fit(df, ["a"], trees=1, depth=1).trees[0]
        name, edge, missing_left, _ = tree.splits[0]
        assert (name, edge, missing_left) == ("a", 5.0, missing_label == 0)
        p = {r.a: r.p for r in boosting.Model(0.0, [tree]).predict(df, "p").collect() if r.a is None or r.a == r.a}
        assert p[None] == (p[9.0] if missing_label else p[0.0])


def test_many_values_fall_into_few_bins(spark):
    rng = random.Random(2)
    rows = [(v := rng.random(), None, None, int(v > 0.5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(boosting.edges(df, ["a"], 16)["a"]) <= 17
    _, edge, _, _ = boosting.fit(df, ["a"], trees=1, depth=1, bins=16).trees[0].splits[0]
    assert abs(edge - 0.5) < 0.05


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert boosting.fit(empty, ["a"]) == boosting.Model(0.0, [])
    one_class = spark.createDataFrame([(1.0, None, None, 1), (2.0, None, None, 1), (3.0, None, None, None)], SCHEMA)
    model = boosting.fit(one_class, ["a", "c"], trees=2)
    assert all(r.predicted_probability > 0.99 for r in model.predict(one_class).collect())
    no_values = spark.createDataFrame([(None, None, None, 1), (None, None, None, 0)], SCHEMA)
    assert boosting.fit(no_values, ["a"]).trees == []
    infinite = spark.createDataFrame([(math.inf, None, None, 1), (-math.inf, None, None, 0), (0.0, None, None, 0)] * 20, SCHEMA)
    p = {r.a: r.predicted_probability for r in boosting.fit(infinite, ["a"], trees=3).predict(infinite).collect()}
    assert p[-math.inf] < p[0.0] == p[math.inf]  # edges are finite: infinities lie in the outer bins
