"""Many points and polygons at one place: places meet once, and every row is still there."""

import math
import random

from pyspark.sql import functions as F

from tarnwatch.operators import edges, geo, resolve

SQUARE = "array(array(struct(x - r as x, y - r as y), struct(x + r as x, y - r as y), struct(x + r as x, y + r as y), struct(x - r as x, y + r as y)))"
CROWD = 60_000


def crowd(spark, p, n=CROWD):
    """n points at each of two places 111 m apart."""
    return spark.range(2 * n).select(
        F.col("id").alias(f"{p}_id"), (27 + (F.col("id") % 2) * 0.001).alias(f"{p}_lat"), F.lit(86.0).alias(f"{p}_lon"),
    )


def scattered(spark, seed, n, p):
    """n points on few places, some without coordinates."""
    rnd = random.Random(seed)
    rows = [(k, rnd.choice([None, 27.0, 27.001, 27.002, 27.05]), rnd.choice([86.0, 86.001, 86.04])) for k in range(n)]
    return rows, spark.createDataFrame(rows, f"{p}_id long, {p}_lat double, {p}_lon double")


def flat(lat, lon):
    return math.radians(lon) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137.0


def near(a, b, metres):
    return None not in (a[1], b[1]) and math.dist(flat(*a[1:]), flat(*b[1:])) <= metres


def test_places_meet_once(spark):
    """120,000 by 120,000 points are four pairs of places, for both metrics."""
    a, b = crowd(spark, "a"), crowd(spark, "b")
    for metric in ("mercator", "haversine"):
        assert geo.near_places(a, b, 500, metric).count() == 4
    assert geo.nearest(a, b, 500).agg(F.sum("b_id"), F.count("b_id")).first()[:] == (CROWD, 2 * CROWD)


def test_near_duplicates_of_a_crowd(spark):
    p = crowd(spark, "a").select(F.col("a_id").alias("id"), F.col("a_id").alias("idx"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"))
    got = geo.near_duplicates(p, 500).agg(F.count("duplicate_of"), F.max("duplicate_of"), F.count("*")).first()
    assert got[:] == (2 * CROWD - 1, 0, 2 * CROWD)


def test_pairs_equal_the_loop(spark):
    ra, a = scattered(spark, 1, 60, "a")
    rb, b = scattered(spark, 2, 50, "b")
    want = sorted((x[0], y[0]) for x in ra for y in rb if near(x, y, 400))
    got = geo.within_distance(a.withColumn("more", F.lit("m")), b, 400)
    assert got.columns == ["a_id", "a_lat", "a_lon", "more", "b_id", "b_lat", "b_lon", "distance_m"]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want
    ranks = {(r.a_id, r.b_id): r.candidate_rank for r in resolve.candidate_queue(a, b, 400).collect()}
    assert sorted(ranks) == want
    for i in {i for i, _ in want}:
        assert sorted(k for (j, _), k in ranks.items() if j == i) == list(range(1, sum(j == i for j, _ in want) + 1))
    audit = {r.audit_class: r.rows for r in resolve.unmatched_audit(a, b, 400).collect()}
    assert sum(audit.values()) == 60 and audit["NO_USABLE_GEOGRAPHY"] == sum(x[1] is None for x in ra)


def test_pairs_are_dealt_to_many_tasks(spark):
    """400 places are dealt to 16 tasks, though their few bytes would fill one; 2,500 points of a place are more than a pack."""
    a = spark.range(400).selectExpr("id as a_id", "27D + id * 0.01D as a_lat", "86D as a_lon")
    b = spark.range(2502).selectExpr("id as b_id", "27D + greatest(0, id - 2499) * 0.01D as b_lat", "86D as b_lon")
    rounded = lambda m: F.round(m, 1)
    got = geo.within_distance(a, a.toDF("b_id", "b_lat", "b_lon"), 500, given=rounded)
    assert got.select(F.spark_partition_id()).distinct().count() > 8 and got.where("distance_m = 0").count() == 400
    got = geo.within_distance(a.where("a_id < 3").unionByName(a.where("a_id = 0").withColumn("a_id", F.lit(9).cast("long"))), b, 1200, given=rounded)
    held = {(r.a_id, r.distance_m): r.n for r in got.groupBy("a_id", "distance_m").agg(F.countDistinct("b_id").alias("n")).collect()}
    step = round(math.dist(flat(27.0, 86.0), flat(27.01, 86.0)), 1), round(math.dist(flat(27.01, 86.0), flat(27.02, 86.0)), 1)
    assert step[0] > 1200 and held == {(0, 0.0): 2500, (9, 0.0): 2500, (1, 0.0): 1, (2, 0.0): 1}
    queue = resolve.candidate_queue(a.where("a_id = 0"), b, 1200)
    assert sorted(r.candidate_rank for r in queue.collect()) == list(range(1, 2501))


def test_no_second_shuffle_of_doubles(spark):
    """-0.0 and 0.0 are one place; rows without one are left out and not dealt to one task."""
    a = spark.createDataFrame([(1, -0.0, 86.0), (2, 0.0, 86.0), (3, None, 86.0), (4, None, None)], "a_id long, a_lat double, a_lon double")
    found = spark.createDataFrame([(0.0, 86.0, 7), (None, 86.0, 8), (None, None, 9)], "a_lat double, a_lon double, b_id long")
    got = geo.dealt(a, found, ["a_lat", "a_lon"])
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(1, 7), (2, 7)]
    assert "ENSURE_REQUIREMENTS" not in got._jdf.queryExecution().executedPlan().toString()


def test_epochs_of_a_crowd(spark):
    """Every old point has the least uid of its place."""
    side = lambda p, n: crowd(spark, p, n).select(*[F.col(f"{p}_{c}").alias(c) for c in ("id", "lat", "lon")])
    new = side("b", CROWD).withColumn("uid", F.format_string("TARN_%06d", "id"))
    got = geo.link_epochs(side("a", CROWD), new, 50).groupBy("uid").count().collect()
    assert sorted(r[:] for r in got) == [("TARN_000000", CROWD), ("TARN_000001", CROWD)]


def polygons(spark, n):
    """n squares at one place, three different shapes."""
    return spark.range(n).selectExpr("id", "86D as x", "27D as y", "0.01D * (1 + id % 3) as r").selectExpr("id as polygon_id", f"{SQUARE} as polygon")


def test_equal_polygons_meet_a_place_once(spark):
    n = 3000
    points = crowd(spark, "a", n).selectExpr("a_id as point_id", "a_lon + 0.0151 as x", "a_lat as y")
    shapes, named = geo.shapes_of(polygons(spark, n))
    assert shapes.count() == 3 and named.count() == n and geo.places_in_shapes(points, shapes).count() == 4
    assert geo.point_in_polygon(points, polygons(spark, n)).count() == 2 * n * (n // 3) * 2
    assert geo.first_region(points, polygons(spark, n)).groupBy("region").count().first()[:] == (1, 2 * n)


def test_tiers_count_sites_of_one_shape(spark):
    """Two equal squares 0.01 wide hold the event; a crowd of equal ones is counted, not met."""
    sites = lambda n: polygons(spark, 3 * n).where("polygon_id % 3 = 0").withColumnRenamed("polygon_id", "b_id")
    e = spark.createDataFrame([(1, 27.0, 86.0), (2, 27.0, 86.02), (3, None, 86.0), (4, 27.0, 86.08), (5, 30.0, 86.0)], "a_id long, a_lat double, a_lon double")
    got = {r.a_id: r for r in resolve.match_sites(e, sites(2)).collect()}
    assert (got[1].match_method, got[1].candidate_count) == ("polygon_intersection_ambiguous", 2)
    assert (got[2].lake_uid, got[2].lake_match_confidence, got[2].candidate_count) == (0, "LOW", 2)
    assert got[3].match_method is None and got[5].match_method == "no_candidate_10km"
    assert (got[4].nearest_candidate_lake_uid, got[4].diagnostic_candidate_count) == (0, 2)
    many = {r.a_id: r.candidate_count for r in resolve.match_sites(e, sites(20_000)).collect()}
    assert many == {1: 20_000, 2: 20_000, 3: 0, 4: 0, 5: 0}
    assert {r.a_id: r.lake_match_confidence for r in resolve.match_sites(e, sites(1)).collect()}[2] == "MEDIUM"


def test_nearest_site_of_a_crowd(spark):
    s = crowd(spark, "b").selectExpr("b_id", "'c' as country", "0D as x", "b_id % 2 * 50D as y", "1D as r").selectExpr("b_id", "country", f"{SQUARE} as _flat")
    e = crowd(spark, "a").selectExpr("a_id", "'c' as country", "0D as _x", "a_id % 2 * 50D + 5D as _y")
    got = resolve.nearest_site(e, s).groupBy("b_id", "distance_m").count().collect()
    assert sorted(r[:] for r in got) == [(0, 4.0, CROWD), (1, 4.0, CROWD)]


def test_equal_polygons_dissolve_as_one(spark):
    """20,000 squares in each of two groups, three different ones: the largest."""
    t = polygons(spark, 40_000).selectExpr("polygon_id % 2 as g", "polygon")
    got = edges.dissolve(t, ["g"]).select("g", F.round(geo.area("polygon"), 9)).collect()
    assert sorted(r[:] for r in got) == [(0, 0.0036), (1, 0.0036)]


def test_pair_scores_equal_the_loop(spark):
    """Each pair once, whatever of date, name and place it shares; no join puts a date or a name into one task."""
    from datetime import date

    rnd = random.Random(4)
    pick = lambda *c: rnd.choice(c)
    rows = [
        (k, pick(None, date(2000, 1, 1), date(2000, 6, 1), date(2001, 1, 1)), pick(None, 27.0, 27.01, 27.06), 86.0 + pick(0, 0.05), pick(None, "unknown", "Lake a", "Lake b"))
        for k in range(60)
    ]
    e = spark.createDataFrame(rows, "idx long, event_date date, latitude double, longitude double, lake_name string")

    def km(a, b):
        if a[2] is None or b[2] is None:
            return math.inf
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    want = []
    for a in rows:
        for b in rows[a[0] + 1 :]:
            d, both = km(a, b), None not in (a[1], b[1])
            name = a[4] == b[4] and str(a[4]).startswith("Lake")
            score = (3 if d < 2 else 1 if d < 10 else 0) + (4 if both and a[1] == b[1] else 2 if both and a[1].year == b[1].year else 0) + 3 * name
            if score >= 3:
                want.append((a[0], b[0], score, score >= 6 or d < 2 and both and a[1] == b[1]))
    assert sorted(r[:] for r in resolve.pair_scores(e).collect()) == want
    absorbing = [(i, j) for i, j, _, x in want if x]
    assert sorted((r.i, r.j) for r in resolve.pair_scores(e, only_absorbing=True).collect()) == absorbing
    plan = resolve.pair_scores(e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_salt") > 0 and "dropDuplicates" not in plan


def test_equal_records_are_led_by_their_first(spark):
    """Leaders and reviews of copies equal the loop over all pairs; 60,000 equal records are no pairs at all."""
    from datetime import date

    rnd = random.Random(8)
    rows = [
        (k, rnd.choice([None, date(2000, 1, 1), date(2000, 1, 2)]), rnd.choice([None, -0.0, 0.0, 0.03]), rnd.choice([86.0, 86.05]), rnd.choice([None, "unknown", "Lake a", "lake A", "Lake b"]))
        for k in range(90)
    ]
    e = spark.createDataFrame(rows, "idx long, event_date date, latitude double, longitude double, lake_name string")
    scores = {(r.i, r.j): r for r in resolve.pair_scores(e).collect()}
    leader = {}
    for k in range(90):
        leader[k] = min((i for i in range(k) if leader[i] == i and (i, k) in scores and scores[i, k].absorbs), default=k)
    assigned = resolve.settled(e)
    assert {r.idx: r.leader for r in assigned.collect()} == leader and 5 < sum(k == v for k, v in leader.items()) < 60
    review = sorted(p for p, r in scores.items() if not r.absorbs and leader[p[0]] == p[0] and (leader[p[1]] > p[0] or leader[p[1]] == p[1]))
    got = resolve.reconciliation(e, assigned).collect()
    assert sorted((r.canonical, r.idx) for r in got if r.dedup_status == "CROSS_SOURCE_REVIEW") == review and len(review) > 20
    assert sorted((r.idx, r.canonical) for r in got if r.dedup_status != "CROSS_SOURCE_REVIEW") == sorted(leader.items())
    same = spark.range(60_000).selectExpr("id as idx", "date'2000-01-01' as event_date", "27D as latitude", "86D as longitude", "'Lake a' as lake_name")
    assert resolve.settled(same).groupBy("leader").count().first()[:] == (0, 60_000)


def test_equal_names_are_compared_once(spark):
    """20,000 events of one place with one name are one call of the name similarity; those without a place or country match nothing."""
    calls = spark.sparkContext.accumulator(0)

    def ratio():
        @F.pandas_udf("double")
        def counted(a, b):
            calls.add(len(a))
            return (a == b).astype("float64")

        return counted

    n = 20_000
    e = crowd(spark, "a", n // 2).selectExpr("a_id", "'c' as country", "27D as a_lat", "a_lon", "'Lake' as a_name", "'no' as a_reported")
    e = e.unionByName(spark.sql("select 20000L a_id, 'c' country, null a_lat, 86D a_lon, 'Lake' a_name, 'lake' a_reported union all select 20001L, null, 27D, 86D, null, 'x'"))
    s = polygons(spark, 30).where("polygon_id % 3 = 0").selectExpr("polygon_id as b_id", "'c' as country", "polygon", "'lAKE' as b_source_id", "2022 as b_epoch")
    before, resolve.name_ratio = resolve.name_ratio, ratio
    try:
        got = resolve.match_in_country(e, s).groupBy("lake_uid", "match_status", "lake_name_evidence").count().collect()
    finally:
        resolve.name_ratio = before
    assert sorted((r[:] for r in got), key=str) == [(0, resolve.HIGH, True, n), (None, resolve.UNMATCHED, False, 2)] and 0 < calls.value <= 10
