"""Queries: geography, entity resolution, rasters, inventories."""

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as X
from tarnwatch.operators import edges, geo, inventory, mosaic, overlay, raster, resolve, zones
from tarnwatch.plans import standins as S
from tarnwatch.plans.alignment import rounded
from tarnwatch.plans.register import registry

QUERIES, ORACLES, query = registry()

HAVERSINE = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0)))"
MX, MY = "radians({t}.lon) * 6378137.0", "ln(tan(pi() / 4 + radians({t}.lat) / 2)) * 6378137.0"
FLAT = f"sqrt(pow({MX.format(t='a')} - {MX.format(t='b')}, 2) + pow({MY.format(t='a')} - {MY.format(t='b')}, 2))"
POINTS = S.ctes("customers", "suppliers")


def side(df, p):
    return df.select(F.col("id").alias(f"{p}_id"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))


def customers(spark, d):
    return S.sites(spark, d)


def suppliers(spark, d):
    return S.sites(spark, d, "supplier", "s_suppkey")


@query(POINTS + f" select a.id as a_id, b.id as b_id, round({FLAT}, 3) as distance_m from customers a, suppliers b where {FLAT} <= 5000")
def d09_within_distance(spark, d):
    return geo.within_distance(
        side(customers(spark, d), "a"), side(suppliers(spark, d), "b"), 5000, given=lambda m: F.round(m, 3),
    ).select("a_id", "b_id", "distance_m")


@query(
    POINTS + f" select a.id as a_id, b.id as b_id, round({HAVERSINE.format(a='a', b='b')}, 6) as km from customers a, suppliers b where "
    f"{HAVERSINE.format(a='a', b='b')} <= 5"
)
def h06_haversine_join(spark, d):
    out = geo.within_distance(side(customers(spark, d), "a"), side(suppliers(spark, d), "b"), 5000, "haversine", lambda m: F.round(m / 1000, 6))
    return out.select("a_id", "b_id", F.col("distance_m").alias("km"))


@query(
    POINTS + f", m as (select a.id as a_id, b.id as b_id, {FLAT} as d, row_number() over (partition by a.id order by {FLAT}, b.id) as r from "
    f"customers a, suppliers b where {FLAT} <= 10000) select c.id as a_id, m.b_id, round(m.d, 3) as distance_m from customers c left "
    "join m on m.a_id = c.id and m.r = 1"
)
def d11_nearest_site(spark, d):
    return geo.nearest(
        side(customers(spark, d), "a"), side(suppliers(spark, d), "b"), 10000,
    ).select("a_id", "b_id", F.round("distance_m", 3).alias("distance_m"))


@query(
    POINTS + f", m as (select a.id as a_id, b.id as b_id, row_number() over (partition by a.id order by {FLAT}, b.id) as candidate_rank from "
    f"customers a, suppliers b where {FLAT} <= 5000) select a_id, b_id, cast(candidate_rank as int) as candidate_rank from m"
)
def f06_candidate_queue(spark, d):
    return resolve.candidate_queue(side(customers(spark, d), "a"), side(suppliers(spark, d), "b")).select("a_id", "b_id", "candidate_rank")


@query(
    POINTS + f" select a.id, min(b.id) as duplicate_of from customers a left join customers b on b.id < a.id and {FLAT} <= 2000 group by a.id"
)
def d15_near_duplicates(spark, d):
    return geo.near_duplicates(customers(spark, d), 2000).select("id", "duplicate_of")


@query(
    POINTS + f", m as (select a.id as a_id, 'TARN_' || lpad(b.id::varchar, 6, '0') as uid, {FLAT} as d, row_number() over (partition by a.id "
    f"order by {FLAT}, 'TARN_' || lpad(b.id::varchar, 6, '0')) as r from customers a, suppliers b where {FLAT} <= 3000), n as (select "
    "c.id, m.uid, m.d from customers c left join m on m.a_id = c.id and m.r = 1) select id, coalesce(uid, 'TARN_' || "
    "lpad((row_number() over (partition by uid is null order by id) + (select max(id) from suppliers))::varchar, 6, '0')) as uid, "
    "round(d, 3) as distance_m from n"
)
def d16_link_epochs(spark, d):
    new = suppliers(spark, d).withColumn("uid", F.concat(F.lit("TARN_"), X.zfill("id", 6)))
    return geo.link_epochs(customers(spark, d), new, 3000).select("id", "uid", F.round("distance_m", 3).alias("distance_m"))


# Site polygons: squares of 0.01 to 0.05 degrees round the suppliers, every other with a hole of a quarter of their width.
# Events stand off the grid, so that no point is on a side.
OFF = 0.00001234
SQUARES = f"""e as (select id as a_id, lat + {OFF} as lat, lon + {OFF} as lon from customers),
p as (select *, {MX.format(t="e")} as x, {MY.format(t="e")} as y from e),
q as (select id as b_id, lon, lat, 0.01 * (1 + id % 5) as r, id % 2 = 0 as holed, radians(lon - r) * 6378137.0 as x0, radians(lon + r) * 6378137.0 as x1,
  ln(tan(pi() / 4 + radians(lat - r) / 2)) * 6378137.0 as y0, ln(tan(pi() / 4 + radians(lat + r) / 2)) * 6378137.0 as y1,
  radians(lon - r / 4) * 6378137.0 as hx0, radians(lon + r / 4) * 6378137.0 as hx1, ln(tan(pi() / 4 + radians(lat - r / 4) / 2)) * 6378137.0 as hy0, ln(tan(pi() / 4 + radians(lat + r / 4) / 2)) * 6378137.0 as hy1 from suppliers),
d as (select a_id, b_id, abs(p.lon - q.lon) < r and abs(p.lat - q.lat) < r as outer_in, holed and abs(p.lon - q.lon) < r / 4 and abs(p.lat - q.lat) < r / 4 as in_hole,
  case when in_hole then least(x - hx0, hx1 - x, y - hy0, hy1 - y) when outer_in then 0 else sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)) end as e,
  outer_in and not in_hole as inside from p, q)"""
TIERS = f""", {SQUARES},
c as (select a_id, b_id, inside, e from d where e <= 10000),
r as (select *, row_number() over w as rank, lead(e) over w as nxt, count(*) filter (inside) over v as holds, count(*) filter (e <= 5000) over v as within, count(*) over v as n from c window w as (partition by a_id order by inside desc, e, b_id), v as (partition by a_id)),
m as (select k.id as a_id, k.id % 50 <> 0 as placed, r.* exclude a_id from customers k left join r on r.a_id = k.id and r.rank = 1 and k.id % 50 <> 0)
select a_id, case when holds = 1 or (holds = 0 and within > 0) then b_id end as lake_uid,
case when coalesce(holds, 0) = 1 then 'HIGH_CONFIDENCE_MATCH' when coalesce(holds, 0) > 1 or coalesce(within, 0) > 0 then 'MANUAL_REVIEW' else 'UNMATCHED' end as match_status,
case when coalesce(holds, 0) = 1 then 'polygon_intersection' when coalesce(holds, 0) > 1 then 'polygon_intersection_ambiguous' when coalesce(within, 0) > 0 then 'distance_buffer_5km' when b_id is not null then 'diagnostic_missed_match_10km' when placed then 'no_candidate_10km' end as match_method,
case when coalesce(holds, 0) = 1 then 'HIGH' when holds = 0 and within > 0 then case when nxt is null or nxt > 5000 or nxt - e > 300 then 'MEDIUM' else 'LOW' end end as lake_match_confidence,
case when holds = 1 or (holds = 0 and within > 0) then round(e, 1) end as match_distance_m, cast(coalesce(case when holds > 0 then holds when within > 0 then within end, 0) as bigint) as candidate_count,
case when holds = 0 and within = 0 then n end as diagnostic_candidate_count, case when holds = 0 and within = 0 then b_id end as nearest_candidate_lake_uid, case when holds = 0 and within = 0 then round(e, 1) end as nearest_candidate_distance_m from m"""


def square(r):
    at = lambda i, j: F.struct((F.col("lon") + i * r).alias("x"), (F.col("lat") + j * r).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def site_polygons(spark, d):
    r = 0.01 * (1 + F.col("id") % 5)
    return suppliers(spark, d).select(
        F.col("id").alias("b_id"),
        F.when(F.col("id") % 2 == 0, F.array(square(r), square(r / 4))).otherwise(F.array(square(r))).alias("polygon"),
    )


def events_off(spark, d):
    return customers(spark, d).select(F.col("id").alias("a_id"), (F.col("lat") + OFF).alias("a_lat"), (F.col("lon") + OFF).alias("a_lon"))


def tiers(spark, d):
    """Every fiftieth event has no coordinates."""
    e = events_off(spark, d)
    return resolve.match_sites(
        e.withColumns({c: F.when(F.col("a_id") % 50 != 0, F.col(c)) for c in ("a_lat", "a_lon")}), site_polygons(spark, d),
    )


@query(POINTS + TIERS)
def j04_match_tiers(spark, d):
    return tiers(spark, d)


@query(
    POINTS + f", {SQUARES}, c as (select a_id, b_id, e, row_number() over (partition by a_id order by e, b_id) as r from d where e <= 5000) "
    "select a_id, b_id, round(e, 3) as distance_m, cast(r as int) as candidate_rank from c"
)
def d09_polygon_candidates(spark, d):
    return resolve.candidate_queue(events_off(spark, d), site_polygons(spark, d), given=lambda m: F.round(m, 3))


@query(
    POINTS + " select audit_status, audit_confidence, count(*) as rows from (select case when candidate_count = 1 and match_distance_m > 1000 "
    "then 'PLAUSIBLE_MATCH' when candidate_count > 1 then 'AMBIGUOUS' else 'UNMAPPABLE' end as audit_status, case when "
    "candidate_count = 1 and match_distance_m > 1000 then 'MEDIUM' else 'LOW' end as audit_confidence from (with " + TIERS.lstrip(", ") + ") where match_status = 'MANUAL_REVIEW') group by all"
)
def j06_review_audit(spark, d):
    return resolve.review_audit(tiers(spark, d)).groupBy("audit_status", "audit_confidence").agg(F.count("*").alias("rows"))


@query(
    POINTS + ", x as (select id, case when id % 10 = 0 then null when id % 10 = 1 then round(lat) else lat end as lat, case when id % 10 = 1 "
    "then round(lon) else lon end as lon from customers), n as (select distinct a.id from x a, suppliers b where a.lat is not null "
    f"and {FLAT} <= 4000) select case when x.lat is null then 'NO_USABLE_GEOGRAPHY' when x.lat % 1 = 0 and x.lon % 1 = 0 then "
    "'COARSE_GEOGRAPHY' when n.id is not null then 'CANDIDATE_LAKES_EXIST' else 'MATCHING_PIPELINE_GAP' end as audit_class, count(*) "
    "as rows from x left join n using (id) group by 1"
)
def c20_unmatched_audit(spark, d):
    k = F.col("a_id") % 10
    a = side(customers(spark, d), "a").withColumns(
        {
            "a_lat": F.when(k == 1, F.round("a_lat")).when(k > 1, F.col("a_lat")),
            "a_lon": F.when(k == 1, F.round("a_lon")).otherwise(F.col("a_lon")),
        }
    )
    return resolve.unmatched_audit(a, side(suppliers(spark, d), "b"), 4000)


def utm_sql(lat, lon, zone):
    """(easting, northing) as SQL, by the same series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians({lat}))) - {k!r} * atanh({k!r} * sin(radians({lat}))))"
    dl = f"radians({lon} - {6 * zone - 183})"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    e = " + ".join([eta, *(f"{c!r}::double * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})" for j, c in enumerate(alpha))])
    y = " + ".join([xi, *(f"{c!r}::double * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})" for j, c in enumerate(alpha))])
    return f"(500000 + {0.9996 * radius!r} * ({e}))", f"({0.9996 * radius!r} * ({y}))"


def corners_sql(of, r, zone):
    """Corners 0 to 3 of squares of half-width r, in UTM."""
    return f"select {of}, k, {utm_sql(f'(lat + {r} * (case when k in (0, 1) then -1 else 1 end))', f'(lon + {r} * (case when k in (0, 3) then -1 else 1 end))', zone)[0]} as x, {utm_sql(f'(lat + {r} * (case when k in (0, 1) then -1 else 1 end))', f'(lon + {r} * (case when k in (0, 3) then -1 else 1 end))', zone)[1]} as y"


IN_COUNTRY = f"""c as ({corners_sql('b_id', '0.01', 45)} from (select id as b_id, lat, lon from suppliers), range(4) t(k)),
s as (select a.b_id, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from c a join c b on a.b_id = b.b_id and b.k = (a.k + 1) % 4),
e as (select id as a_id, lat + {OFF} as lat, lon + {OFF} as lon, c_nationkey % 5 as country from customers join customer on c_custkey = id),
p as (select a_id, country, {utm_sql('lat', 'lon', 45)[0]} as x, {utm_sql('lat', 'lon', 45)[1]} as y from e),
n as (select s_suppkey as b_id, s_nationkey % 5 as country from supplier),
g as (select a_id, s.b_id, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) as t, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) > 0 as l from p join n using (country) join s on s.b_id = n.b_id),
w as (select a_id, b_id, case when bool_and(l) then 0 else min(sqrt(pow(x - (x0 + t * (x1 - x0)), 2) + pow(y - (y0 + t * (y1 - y0)), 2))) end as dist from g group by all),
b as (select a_id, b_id, dist from (select *, row_number() over (partition by a_id order by dist, b_id) as r from w) where r = 1),
v as (select k.id as a_id, b.b_id, b.dist, coalesce(chr(cast(97 + k.id % 7 as int)) = chr(cast(97 + b.b_id % 7 as int)) or chr(cast(97 + k.id % 11 as int)) = chr(cast(97 + b.b_id % 7 as int)), false) or coalesce(b.dist = 0, false) as ev from customers k left join b on b.a_id = k.id)
select a_id, case when dist <= 10000 then b_id end as lake_uid, case when dist = 0 then 'HIGH_CONFIDENCE_MATCH' when dist <= 5000 and ev then 'MANUAL_REVIEW' else 'UNMATCHED' end as match_status,
case when dist <= 10000 then round(dist, 3) end as nearest_lake_distance, ev as lake_name_evidence, repeat(chr(cast(97 + a_id % 11 as int)), 6) as historical_source_lake_identifier, case when dist <= 10000 then 2022 end as inventory_epoch,
coalesce(dist > 0 and dist <= 5000, false) as spatially_plausible_no_intersection from v"""


@query(POINTS + ", " + IN_COUNTRY)
def j05_match_in_country(spark, d):
    word = lambda c, n: F.repeat(F.char(97 + F.col(c) % n), F.lit(6))
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("a_id"), (F.col("c_nationkey") % 5).alias("country"))
    a = events_off(spark, d).join(c, "a_id").withColumns({"a_name": word("a_id", 7), "a_reported": word("a_id", 11)})
    n = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("b_id"), (F.col("s_nationkey") % 5).alias("country"))
    b = suppliers(spark, d).select(
        F.col("id").alias("b_id"), F.array(square(F.lit(0.01))).alias("polygon"),
    ).join(n, "b_id").withColumns({"b_source_id": word("b_id", 7), "b_epoch": F.lit(2022)})
    return resolve.match_in_country(a, b).withColumn("nearest_lake_distance", F.round("nearest_lake_distance", 3))


@query(
    POINTS + f", c as ({corners_sql('id', '0.2', 44)} from suppliers, range(4) t(k)), a as (select a.id, abs(sum(a.x * b.y - b.x * a.y)) / 2e6 "
    "as km2 from c a join c b on a.id = b.id and b.k = (a.k + 1) % 4 group by 1) select 'ROW_' || (row_number() over (order by id) - "
    "1) as source_lake_id, null::double as elevation_m, round(km2, 3) as lake_area_km2 from a"
)
def c02_inventory_fallbacks(spark, d):
    s = suppliers(spark, d).select(F.col("id").alias("row"), F.array(square(F.lit(0.2))).alias("polygon"))
    return inventory.standardised(s, ["row"]).select("source_lake_id", "elevation_m", F.round("lake_area_km2", 3).alias("lake_area_km2"))


def boxes(spark, d):
    """Squares round the suppliers, with a square hole in every other."""
    return suppliers(spark, d).select(
        F.col("id").alias("polygon_id"), "lat", "lon",
        F.when(F.col("id") % 2 == 0, F.array(square(0.2), square(0.05))).otherwise(F.array(square(0.2))).alias("polygon"),
    )


@query(
    POINTS + " select a.id as point_id, b.id as polygon_id from customers a, suppliers b where abs(a.lon - b.lon) < 0.2 and abs(a.lat - "
    "b.lat) < 0.2 and not (b.id % 2 = 0 and abs(a.lon - b.lon) < 0.05 and abs(a.lat - b.lat) < 0.05)"
)
def d08_point_in_polygon(spark, d):
    p = customers(spark, d).select(
        (F.col("id")).alias("point_id"), (F.col("lon") + 0.00001234).alias("x"), (F.col("lat") + 0.00001234).alias("y"),
    )
    return geo.point_in_polygon(p, boxes(spark, d))


ORACLES["d08_point_in_polygon"] = ORACLES["d08_point_in_polygon"].replace(
    "a.lon - b.lon", "a.lon + 0.00001234 - b.lon",
).replace("a.lat - b.lat", "a.lat + 0.00001234 - b.lat")


@query(
    POINTS + ", h as (select a.id as point_id, min(b.id) as region from customers a, suppliers b where abs(a.lon + 0.00001234 - b.lon) < 0.2 "
    "and abs(a.lat + 0.00001234 - b.lat) < 0.2 and not (b.id % 2 = 0 and abs(a.lon + 0.00001234 - b.lon) < 0.05 and abs(a.lat + "
    "0.00001234 - b.lat) < 0.05) group by 1) select c.id as point_id, h.region from customers c left join h on h.point_id = c.id"
)
def d12_first_region(spark, d):
    p = customers(spark, d).select(
        (F.col("id")).alias("point_id"), (F.col("lon") + 0.00001234).alias("x"), (F.col("lat") + 0.00001234).alias("y"),
    )
    return geo.first_region(p, boxes(spark, d)).select("point_id", "region")


# A boundary that is not convex, and a second one that overlaps it: together three rectangles side by side.
BOUNDARY = [
    [[(86.0, 27.0), (87.4, 27.0), (87.4, 27.5), (86.8, 27.5), (86.8, 28.0), (86.0, 28.0)]],
    [[(86.5, 27.3), (87.8, 27.3), (87.8, 27.4), (86.5, 27.4)]],
]
RECTANGLES = "b as (select * from (values (86.0::double, 86.8::double, 27.0::double, 28.0::double), (86.8, 87.4, 27.0, 27.5), (87.4, 87.8, 27.3, 27.4)) v(bx0, bx1, by0, by1))"
OVERLAP = "greatest(least(lon + {r}, bx1) - greatest(lon - {r}, bx0), 0) * greatest(least(lat + {r}, by1) - greatest(lat - {r}, by0), 0)"


@query(
    POINTS + f", {RECTANGLES}, o as (select id, lat, lon, case when id % 2 = 0 then 0.15::double else 0.16::double end as area, "
    f"sum({OVERLAP.format(r=0.2)} - case when id % 2 = 0 then {OVERLAP.format(r=0.05)} else 0 end) as part from suppliers, b group by "
    "all) "
    "select id as polygon_id, area, round(lon, 5) as x, round(lat, 5) as y, round(part / area, 6) as overlap_ratio, case when "
    "round(part / area, 6) >= 0.5 then 'inside' when round(part / area, 6) > 0 then 'boundary' else 'outside' end as boundary_status "
    "from o"
)
def d13_overlap_ratio(spark, d):
    b = overlay.overlap_ratio(boxes(spark, d), BOUNDARY)
    x, y = geo.centroid("polygon")
    r = F.round("overlap_ratio", 6)
    return b.select(
        "polygon_id", F.round(geo.area("polygon"), 6).alias("area"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"),
        r.alias("overlap_ratio"), geo.boundary_status(r).alias("boundary_status"),
    )


@query(
    POINTS + f", {RECTANGLES} select distinct id as polygon_id from suppliers, b where sqrt(pow(greatest(lon - 0.05 - bx1, bx0 - lon - 0.05, "
    "0), 2) + pow(greatest(lat - 0.05 - by1, by0 - lat - 0.05, 0), 2)) <= 0.1003"
)
def d14_boundary_filter(spark, d):
    s = suppliers(spark, d).select(F.col("id").alias("polygon_id"), F.array(square(F.lit(0.05))).alias("polygon"))
    return overlay.meeting(s, BOUNDARY, 0.1003).select("polygon_id")


@query(
    POINTS + ", q as (select id % 5 as g, lon - 0.2 as x0, lon + 0.2 as x1, lat - 0.2 as y0, lat + 0.2 as y1 from suppliers), "
    "xs as (select g, x, lead(x) over (partition by g order by x) as x2 from (select g, x0 as x from q union select g, x1 from q)), "
    "ys as (select g, y, lead(y) over (partition by g order by y) as y2 from (select g, y0 as y from q union select g, y1 from q)), "
    "c as (select distinct xs.g, x, x2, y, y2 from xs join ys on xs.g = ys.g join q on q.g = xs.g and x0 <= x and x1 >= x2 and y0 <= "
    "y and y1 >= y2) select g, round(sum((x2 - x) * (y2 - y)), 6) as area from c group by 1"
)
def e28_dissolve(spark, d):
    s = suppliers(spark, d).select((F.col("id") % 5).alias("g"), F.array(square(F.lit(0.2))).alias("polygon"))
    return edges.dissolve(s, ["g"]).groupBy("g").agg(F.round(F.sum(geo.area("polygon")), 6).alias("area"))


@query(
    POINTS + ", t as (select unnest(generate_series(floor(lat - 0.2)::bigint, ceil(lat + 0.2)::bigint - 1)) as lat, lon from suppliers), u as "
    "(select lat, unnest(generate_series(floor(lon - 0.2)::bigint, ceil(lon + 0.2)::bigint - 1)) as lon from t) select distinct lat, "
    "lon, 'SRTMGL1_N' || lpad(lat::varchar, 2, '0') || 'E' || lpad(lon::varchar, 3, '0') as tile from u"
)
def a17_dem_tiles(spark, d):
    b = suppliers(spark, d).select(
        (F.col("lon") - 0.2).alias("min_x"), (F.col("lon") + 0.2).alias("max_x"), (F.col("lat") - 0.2).alias("min_y"),
        (F.col("lat") + 0.2).alias("max_y"),
    )
    return geo.dem_tiles(b)


@query(
    POINTS + ", a as (select unnest([86.0::double, 86.4::double, 87.0::double, 87.9::double]) as x), r as (select c.id, a.x, row_number() "
    "over (partition by c.id order by abs(a.x - c.lon), a.x) as r from customers c, a) select id, x as cell from r where r = 1"
)
def d25_nearest_cell(spark, d):
    return geo.nearest_cell(customers(spark, d), [86.0, 86.4, 87.0, 87.9], "lon", "cell").select("id", "cell")


@query(
    "select event_type, round(degrees(atan2(avg(sin(radians(value * 3.6))), avg(cos(radians(value * 3.6))))) + case when "
    "degrees(atan2(avg(sin(radians(value * 3.6))), avg(cos(radians(value * 3.6))))) < 0 then 360 else 0 end, 6) as direction from "
    "events group by 1"
)
def e11_circular_mean(spark, d):
    return S.table(spark, d, "events").withColumn("a", F.col("value") * 3.6).groupBy("event_type").agg(
        F.round(X.circular_mean("a"), 6).alias("direction")
    )


@query(
    POINTS + " select id, cast(32600 + floor((lon + 180) / 6) + 1 as int) as epsg, round(" + MX.format(t="c") + ", 3) as x, round(" + MY.format(t="c") + ", 3) as y from customers c"
)
def h07_projections(spark, d):
    return customers(spark, d).select(
        "id", X.utm_epsg("lat", "lon").alias("epsg"), F.round(X.mercator_x("lon"), 3).alias("x"),
        F.round(X.mercator_y("lat"), 3).alias("y"),
    )


def faulty(spark, d):
    """Six kinds of shapes of several sizes: a square, a bow-tie, a spike, a ring twice over, holes that overlap, a hole across the shell."""
    r, x = 1.0 + F.col("id") % 7, F.col("id") * 0.5
    ring = lambda *points: F.array(*[F.struct((x + a * r).alias("x"), (b * r).alias("y")) for a, b in points])
    box = lambda a, s: [(a, a), (a + s, a), (a + s, a + s), (a, a + s)]
    shapes = [
        [box(0, 4)], [[(0, 0), (4, 4), (4, 0), (0, 4)]], [[*box(0, 4)[:3], (4, 9), (4, 4), (0, 4)]], [box(0, 4) * 2], [box(0, 10), box(1, 4), box(3, 4)],
        [box(0, 10), box(8, 4)],
    ]
    which = F.lit(None)
    for k, rings in enumerate(shapes):
        which = F.when(F.col("id") % 6 == k, F.array(*[ring(*p) for p in rings])).otherwise(which)
    return customers(spark, d).select("id", which.alias("polygon"))


def balance_tiles(spark, d):
    """Customers' balances as a raster of 50 columns, in tiles of 8 x 8."""
    k = F.col("c_custkey")
    p = S.table(spark, d, "customer").select(F.floor(k / 50).alias("r"), (k % 50).alias("c"), F.col("c_acctbal").alias("v"))
    at = ((F.col("r") % 8) * 8 + F.col("c") % 8).cast("int").alias("at")
    t = p.groupBy(F.floor(F.col("r") / 8).alias("tile_row"), F.floor(F.col("c") / 8).alias("tile_col")).agg(F.map_from_entries(F.collect_list(F.struct(at, "v"))).alias("m"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.try_element_at("m", i))
    return t.select("tile_row", "tile_col", F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("value"))


# The same raster in degrees, seen on a Web Mercator grid of 700 m.
@query(
    "with p as (select c_custkey // 50 as r, c_custkey % 50 as c, c_acctbal as v from customer), "
    "g as (select cast(i as bigint) as row, cast(j as bigint) as col, (28.0 - degrees(2 * atan(exp((3249000.0 - (i + 0.5) * 700) / 6378137.0)) - pi() / 2)) / 0.01 - 0.5 as y, "
    "(degrees((9573000.0 + (j + 0.5) * 700) / 6378137.0) - 86.0) / 0.01 - 0.5 as x from range(600) a(i), range(90) b(j)), "
    "n as (select row, col, v, (case when p.r = floor(y) then 1 - (y - floor(y)) else y - floor(y) end) * (case when p.c = floor(x) then 1 - (x - floor(x)) else x - floor(x) end) as w "
    "from g join p on p.r between floor(y) and floor(y) + 1 and p.c between floor(x) and floor(x) + 1 where v is not null) "
    "select row, col, round(sum(v * w) / sum(w), 4) as value from n group by row, col having sum(w) > 0"
)
def h08_reproject(spark, d):
    out = mosaic.reproject(balance_tiles(spark, d), (86.0, 28.0, 0.01), (9573000.0, 3249000.0, 700.0), 600, 90)
    return out.withColumn("value", F.round("value", 4))


# Customers' balances as a raster of 50 columns in tiles of 8 x 8, under suppliers' holed squares.
@query(
    "with p as (select c_custkey // 50 as r, c_custkey % 50 as c, c_acctbal as v from customer), "
    "z as (select s_suppkey as id, s_suppkey * 7919 % 50 + 0.25 as x, s_suppkey * 104729 % 30 + 0.25 as y, 2 + s_suppkey % 5 as s from supplier) "
    "select id, count(v) as valid, round(avg(v), 6) as mean, min(v) as low, max(v) as high, round(median(v), 6) as median from z join p on "
    "greatest(abs(c + 0.5 - x), abs(r + 0.5 - y)) < s and greatest(abs(c + 0.5 - x), abs(r + 0.5 - y)) > s / 2.0 group by id"
)
def h08_zones(spark, d):
    t = balance_tiles(spark, d)
    n = F.col("s_suppkey")
    x, y, s = n * 7919 % 50 + 0.25, n * 104729 % 30 + 0.25, (2 + n % 5).cast("double")
    ring = lambda q: F.array(*[F.struct((x + i * q).alias("x"), (-y + j * q).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    out = zones.zone_stats(t, S.table(spark, d, "supplier").select(n.alias("id"), F.array(ring(s), ring(s / 2)).alias("polygon")), 0.0, 0.0, 1.0)
    return out.where("valid > 0").drop("pixels").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query(
    POINTS + " select id, ['valid_original', 'repaired', 'repaired', 'unrepairable', 'repaired', 'repaired'][id % 6 + 1] as status, "
    "[0.0, 0.0, 0.0, 0.0, 0.117647, 0.285714][id % 6 + 1]::double as area_change, case when id % 6 not in (0, 3) then pow(1 + id % 7, 2) * [0, 8, 16, 0, 76, 108][id % 6 + 1] end as area, "
    "case when id % 6 not in (0, 3) then [0, 2, 1, 0, 3, 2][id % 6 + 1] end as rings from customers"
)
def h07_repair(spark, d):
    r = edges.repair(faulty(spark, d))
    area = F.aggregate("repaired", F.lit(0.0), lambda s, ring: s + geo.ring_area(ring))
    return r.select("id", "status", "area_change", F.round(area, 6).alias("area"), F.size("repaired").alias("rings"))


def records(spark, d):
    """Suppliers as event records, some near copies of one another."""
    k = F.col("s_suppkey")
    base = F.floor(k / 3)
    return S.table(spark, d, "supplier").select(
        k.alias("idx"), k.cast("string").alias("source_record_id"), F.concat(F.lit("http://s/"), k.cast("string")).alias("source_url"),
        F.date_add(
            F.lit("2000-01-01").cast("date"), (base * 37 % 2000).cast("int") + F.when(k % 7 == 0, 1).otherwise(0),
        ).alias("event_date"),
        (27 + (base * 7919 % 2000) / 1000.0 + k % 3 * 0.008).alias("latitude"), (86 + (base * 104729 % 2000) / 1000.0).alias("longitude"),
        F.when(k % 5 == 0, "unknown").otherwise(F.concat(F.lit("Lake "), (base % 40).cast("string"))).alias("lake_name"),
        F.element_at(F.array(*map(F.lit, ("LOW", "HIGH", "MEDIUM", "UNVERIFIED"))), (k % 4 + 1).cast("int")).alias("event_confidence"),
    )


RECORDS = """records as (select s_suppkey as idx, date '2000-01-01' + cast(s_suppkey // 3 * 37 % 2000 + case when s_suppkey % 7 = 0 then 1 else 0 end as int) as event_date, 27 + (s_suppkey // 3 * 7919 % 2000) / 1000.0::double + s_suppkey % 3 * 0.008::double as lat, 86 + (s_suppkey // 3 * 104729 % 2000) / 1000.0::double as lon, case when s_suppkey % 5 <> 0 then 'lake ' || (s_suppkey // 3 % 40) end as name from supplier)"""


@query(
    f"with {RECORDS}, p as (select a.idx as i, b.idx as j, {HAVERSINE.format(a='a', b='b')} as km, a.event_date = b.event_date as sd, "
    "year(a.event_date) = year(b.event_date) as sy, coalesce(a.name = b.name, false) as sn from records a join records b on a.idx < "
    "b.idx), s as (select i, j, cast(case when km < 2 then 3 when km < 10 then 1 else 0 end + case when sd then 4 when sy then 2 "
    "else 0 end + case when sn then 3 else 0 end as int) as score, km, sd from p) select i, j, score, score >= 6 or (km < 2 and sd) "
    "as absorbs from s where score >= 3 or (km < 2 and sd)"
)
def d22_pair_scores(spark, d):
    return resolve.pair_scores(records(spark, d))


# Greedy leaders in order: an event is taken by the earliest leader that absorbs it, else it leads.
LEADERS = f"""{RECORDS}, p as (select a.idx as i, b.idx as j, {HAVERSINE.format(a='a', b='b')} as km, a.event_date = b.event_date as sd, year(a.event_date) = year(b.event_date) as sy, coalesce(a.name = b.name, false) as sn from records a join records b on a.idx < b.idx),
sc as (select i, j, case when km < 2 then 3 when km < 10 then 1 else 0 end + case when sd then 4 when sy then 2 else 0 end + case when sn then 3 else 0 end as score, score >= 6 or (km < 2 and sd) as absorbs from p),
ab as (select j, list(i order by i) as takers from sc where absorbs group by 1),
seq as (select idx, row_number() over (order by idx) as r, coalesce(takers, []) as takers from records left join ab on j = idx),
walk as (with recursive w(r, idx, leader, leads) as (select 0::bigint, null::bigint, null::bigint, []::bigint[] union all select seq.r, seq.idx, coalesce(list_filter(seq.takers, lambda x: list_contains(w.leads, x))[1], seq.idx), case when len(list_filter(seq.takers, lambda x: list_contains(w.leads, x))) = 0 then list_append(w.leads, seq.idx) else w.leads end from w join seq on seq.r = w.r + 1) select idx, leader from w where r > 0)"""


@query(f"with {LEADERS} select idx, leader from walk")
def j01_cross_source_dedup(spark, d):
    r = records(spark, d)
    return resolve.settled(r)


@query(
    f"with {LEADERS}, f as (select s_suppkey as idx, (['LOW', 'HIGH', 'MEDIUM', 'UNVERIFIED'])[s_suppkey % 4 + 1] as conf, case when "
    "s_suppkey % 5 = 0 then 'unknown' else 'Lake ' || (s_suppkey // 3 % 40) end as lake_name from supplier), "
    "g as (select leader, count(*) as source_count, string_agg(cast(f.idx as varchar), '|' order by f.idx) as source_ids, "
    "string_agg('http://s/' || f.idx, '|' order by f.idx) as source_urls, max_by(conf, (case conf when 'HIGH' then 3 when 'MEDIUM' "
    "then 2 when 'LOW' then 1 else 0 end, -f.idx)) as event_confidence from walk join f using (idx) group by 1) "
    "select leader, cast(leader as varchar) as source_record_id, event_date, round(lat, 6) as latitude, round(lon, 6) as longitude, "
    "f.lake_name, source_count, source_ids, source_urls, event_confidence, substr(sha256(leader || '_' || event_date), 1, 12) as "
    "event_id from g join records r on r.idx = leader join f on f.idx = leader"
)
def j02_merged_events(spark, d):
    r = records(spark, d)
    out = resolve.merge_events(r, resolve.settled(r))
    return rounded(out.drop("source_url"), "latitude", "longitude")


@query(
    f"with {LEADERS} select leader as canonical, idx, case when idx = leader then 'NEW_EVENT' else 'DUPLICATE_EXISTING_EVENT' end as "
    "dedup_status from walk union all "
    "select sc.i, sc.j, 'CROSS_SOURCE_REVIEW' from sc join walk a on a.idx = sc.i and a.leader = sc.i join walk b on b.idx = sc.j "
    "where not absorbs and score >= 3 and (b.leader > sc.i or b.leader = b.idx)"
)
def j02_reconciliation(spark, d):
    r = records(spark, d)
    return resolve.reconciliation(r, resolve.settled(r))


TILES = "tiles as (select user_id as tile, list(cast(floor(value) as int) order by event_id) as g, list(cast(event_id % 60 as int) order by event_id) as s, list(cast(event_id % 12 as int) order by event_id) as c from events group by 1)"


def tiles(spark, d):
    """An entity's values as the pixels of a tile."""
    e = S.table(spark, d, "events").groupBy(F.col("user_id").alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", F.floor("value").cast("int").alias("g")))).alias("p")
    )
    return e.select(
        "tile", F.transform("p", lambda x: x["g"]).alias("green"),
        F.transform("p", lambda x: (x["event_id"] % 60).cast("int")).alias("swir"),
        F.transform("p", lambda x: (x["event_id"] % 12).cast("int")).alias("scl"),
    )


@query(
    f"with {TILES}, p as (select tile, unnest(g) as g, unnest(s) as s, unnest(c) as c from tiles), q as (select tile, c, (g - s) / "
    "nullif(g + s, 0) as x, c not in (0, 3, 8, 9, 10) as ok from p) select tile, count(*) as pixels, count(*) filter (ok) as "
    "valid_pixels, count(*) filter (c in (8, 9, 10)) as cloud_pixels, count(*) filter (ok and x > 0) as water_pixels, round(avg(x) "
    "filter (ok), 6) as ndwi_mean, round(quantile_cont(x, 0.5) filter (ok), 6) as ndwi_median, round(stddev_pop(x) filter (ok), 6) "
    "as ndwi_std, round(count(*) filter (c in (8, 9, 10)) / count(*), 6) as cloud_fraction, round(count(*) filter (ok) / count(*), "
    "6) as valid_pixel_fraction, round(count(*) filter (ok and x > 0) / nullif(count(*) filter (ok), 0), 6) as water_pixel_fraction, "
    "round(count(*) filter (ok and x > 0) * 100.0::double / 1e6, 6) as lake_area_km2 from q group by 1"
)
def e12_masked_water_stats(spark, d):
    return rounded(
        raster.water_stats(tiles(spark, d), ["tile"]), "ndwi_mean", "ndwi_median", "ndwi_std", "cloud_fraction", "valid_pixel_fraction",
        "water_pixel_fraction", "lake_area_km2",
    )


@query(
    "select user_id as tile, round(count(*) filter (value * 1.5 > 0 and value * 1.5 <= 100) / nullif(count(*) filter (value * 1.5 >= "
    "0 and value * 1.5 <= 100), 0), 6) as snow_fraction from (select user_id, floor(value) - 5 as value from events) group by 1"
)
def e13_snow_fraction(spark, d):
    t = S.table(spark, d, "events").groupBy(F.col("user_id").alias("tile")).agg(F.collect_list((F.floor("value") - 5) * 1.5).alias("raw"))
    return t.select("tile", F.round(raster.snow_fraction(), 6).alias("snow_fraction"))


# Rows of 5 pixels; differences are one-sided at the rim, and NULL where a neighbour is.
@query(
    f"with {TILES}, px as (select tile, cast((pos - 1) // 5 as int) as r, cast((pos - 1) % 5 as int) as c, z, cast(ceil(n / 5.0) as "
    "int) as h from (select tile, unnest(range(1, cast(ceil(len(g) / 5.0) as int) * 5 + 1)) as pos, len(g) as n, g from tiles) t, "
    "lateral (select case when pos <= n then g[pos] end as z)), "
    "nb as (select *, lag(z) over w as left_z, lead(z) over w as right_z, lag(z) over v as up_z, lead(z) over v as down_z from px "
    "window w as (partition by tile, r order by c), v as (partition by tile, c order by r)), "
    "gr as (select tile, z, case when c = 0 then right_z - z when c = 4 then z - left_z else (right_z - left_z) / 2.0::double end / "
    "30.0::double as gx, case when h = 1 then null when r = 0 then down_z - z when r = h - 1 then z - up_z else (down_z - up_z) / "
    "2.0::double end / 30.0::double as gy from nb), "
    "sa as (select tile, z, degrees(atan(sqrt(gx * gx + gy * gy))) as slope, case when gx is not null and gy is not null then (90 - "
    "degrees(atan2(-gy, gx)) + 720) % 360 end as aspect from gr) "
    "select tile, round(avg(z), 5) as elevation_m, round(avg(slope), 5) as mean_slope_deg, round(max(slope), 5) as max_slope_deg, "
    "round((degrees(atan2(avg(sin(radians(aspect))), avg(cos(radians(aspect))))) + 360) % 360, 4) as mean_aspect_deg from sa group "
    "by 1"
)
def h08_terrain(spark, d):
    """Whole tiles, the last row filled up with NULL."""
    t = tiles(spark, d).withColumn("height", F.ceil(F.size("green") / 5).cast("int"))
    t = t.select(
        "tile", "height", F.lit(5).alias("width"),
        F.concat("green", F.array_repeat(F.lit(None).cast("int"), F.col("height") * 5 - F.size("green"))).alias("elevation"),
    )
    out = raster.terrain(t, ["tile"])
    return out.select(
        "tile", *[F.round(c, 5).alias(c) for c in ("elevation_m", "mean_slope_deg", "max_slope_deg")],
        F.round("mean_aspect_deg", 4).alias("mean_aspect_deg"),
    )


@query(
    "with m as (select quantile_cont(o_totalprice, 0.5) as m from orders) select o_orderkey, round(case when m > 100 then "
    "o_totalprice / 1e6 else o_totalprice end, 9) as lake_area_km2 from orders, m"
)
def c03_conditional_units(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("lake_area_km2"))
    return inventory.to_km2(o).withColumn("lake_area_km2", F.round("lake_area_km2", 9))


@query("select s_suppkey as source_lake_id, s_acctbal as elevation_m, null::int as lake_type from supplier")
def c02_resolve_columns(spark, d):
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("Lake_ID"), F.col("s_acctbal").alias("ELEV"))
    return inventory.resolve_columns(s).select("source_lake_id", "elevation_m", F.col("lake_type").cast("int").alias("lake_type"))


@query("select 'TARN_' || lpad((row_number() over (order by s_acctbal, s_suppkey))::varchar, 6, '0') as lake_uid, s_suppkey from supplier")
def f08_surrogate_ids(spark, d):
    return inventory.surrogate_ids(S.table(spark, d, "supplier"), ["s_acctbal", "s_suppkey"], "TARN_").select("lake_uid", "s_suppkey")


@query(
    "select 'C_' || lpad(c_custkey::varchar, 6, '0') as lake_uid, 'one' as country, c_custkey::varchar as source_lake_id, 'v1' as "
    "inventory_version from customer union all select 'S_' || lpad(s_suppkey::varchar, 6, '0'), 'two', s_suppkey::varchar, 'v2' from "
    "supplier"
)
def c30_registry(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("source_lake_id"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_lake_id"))
    return inventory.registry(
        {"one": (c, "C_"), "two": (s, "S_")}, {"one": {"inventory_version": "v1"}, "two": {"inventory_version": "v2"}},
    )


DUP = POINTS + f", w as (select *, 'P' || (id % 1400) as wkt from customers), e as (select *, row_number() over (partition by wkt order by id) > 1 as exact from w), n as (select a.id, min(b.id) as of from e a join e b on not a.exact and not b.exact and b.id < a.id and {FLAT} <= 500 group by 1)"


@query(
    DUP + " select e.id, n.of as duplicate_of, case when exact then 'exact_duplicate' when n.of is not null then "
    "'near_duplicate_candidate' else 'unique' end as duplicate_status from e left join n using (id)"
)
def j03_duplicate_flags(spark, d):
    c = customers(spark, d).withColumn("wkt", F.concat(F.lit("P"), (F.col("id") % 1400).cast("string")))
    return inventory.duplicate_flags(c, 500).select("id", "duplicate_of", "duplicate_status")


@query(
    "with o as (select nullif(o_custkey, 7) as id from orders) select 'ID' as id_column, cast(count(*) filter (id is null) as "
    "bigint) as null_ids, cast(count(id) - count(distinct id) as bigint) as duplicate_ids from o"
)
def e33_id_quality(spark, d):
    o = S.table(spark, d, "orders").select(F.when(F.col("o_custkey") != 7, F.col("o_custkey")).alias("ID"))
    return inventory.id_quality(o)


@query(
    "select 'o_orderstatus' as column, o_orderstatus as value, count(*) as rows from orders group by 2 union all select "
    "'o_orderpriority', o_orderpriority, count(*) from orders group by 2"
)
def e34_stage_stats(spark, d):
    return inventory.stage_stats(S.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
