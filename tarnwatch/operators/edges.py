"""Polygons as edge rows: self-crossings, repair by the even-odd rule, rings traced anew.

An edge is a row (id, ring, edge, x0, y0, x1, y1). Edges of a polygon meet through grid cells of its own bounding box, so that only
neighbours are compared and a polygon of a million edges is as many rows in as many tasks. They are cut where they meet; pieces
that lie on one another in even numbers cancel; what is left bounds the polygon's inside, each piece with the inside on its left.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import col
from tarnwatch.functions.storage import stored
from tarnwatch.operators import geo

DIGITS = 9  # decimals to which corners and crossings are rounded, so that equal points are equal numbers
SLANT = 0.01370359963  # lines y + SLANT * x = constant are those along which the inside is looked for; no edge should lie on one
GRID = 1024  # cells along each axis at most


def edge_rows(polygons: DataFrame, key: str = "id", polygon: str = "polygon", digits: int = DIGITS) -> DataFrame:
    """(id, ring, edge, x0, y0, x1, y1) of every ring's sides, without those of no length."""
    p = polygons.select(F.col(key).alias("id"), F.posexplode(col(polygon)).alias("ring", "_r")).where(F.size("_r") > 0)
    at = lambda i: F.get(F.col("_r"), i % F.size("_r"))
    sides = F.transform(F.sequence(F.lit(0), F.size("_r") - 1), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))
    r = lambda c: F.round(F.col(c), digits)
    e = p.select("id", "ring", F.posexplode(sides).alias("_k", "_s"))
    e = e.select(
        "id", "ring", (F.col("ring").cast("long") * 2**32 + F.col("_k")).alias("edge"), r("_s.a.x").alias("x0"), r("_s.a.y").alias("y0"), r("_s.b.x").alias("x1"),
        r("_s.b.y").alias("y1"),
    )
    return e.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def frames(edges: DataFrame) -> DataFrame:
    """(id, _bx, _by, _w, _h, _n): each polygon's cell grid, with about as many cells as edges."""
    x, y = (F.array("x0", "x1"), F.array("y0", "y1"))
    b = edges.groupBy("id").agg(
        F.min(F.array_min(x)).alias("_bx"), F.max(F.array_max(x)).alias("_tx"), F.min(F.array_min(y)).alias("_by"), F.max(F.array_max(y)).alias("_ty"),
        F.least(F.lit(GRID), F.ceil(F.sqrt(F.count("*")))).cast("int").alias("_n"),
    )
    wide = lambda lo, hi: F.greatest((F.col(hi) - F.col(lo)) / F.col("_n"), F.lit(1e-9))
    return b.select("id", "_bx", "_by", wide("_bx", "_tx").alias("_w"), wide("_by", "_ty").alias("_h"), "_n")


def crossings(edges: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(id, edge, t, x, y, bad): where edges are to be cut, t along the edge, and whether that cut shows an invalid polygon.

    Every pair of edges that share a cell is looked at: where they cross, where one's end lies on the other, where they overlap.
    Cells are dealt to many tasks, however few bytes the edges are.
    """
    f = edges.join(frames(edges), "id")
    cell = "cast(greatest(0, least(_n - 1, floor(({v} - {b}) / {s}))) as int)"
    x = lambda v: cell.format(v=v, b="_bx", s="_w")
    y = lambda v: cell.format(v=v, b="_by", s="_h")
    line = "(y0 + (y1 - y0) * greatest(0D, least(1D, coalesce(({at} - x0) / nullif(x1 - x0, 0), 0D))))"
    left, right = line.format(at="(_bx + c * _w)"), line.format(at="(_bx + (c + 1) * _w)")
    low, high = f"if(x0 = x1, least(y0, y1), least({left}, {right})) - 1e-9", f"if(x0 = x1, greatest(y0, y1), greatest({left}, {right})) + 1e-9"
    cells = F.expr(
        f"flatten(transform(sequence({x('least(x0, x1) - 1e-9')}, {x('greatest(x0, x1) + 1e-9')}), c -> transform(sequence({y(low)}, {y(high)}), r -> c * {GRID} + r)))"
    )
    c = f.select("id", "ring", "edge", "x0", "y0", "x1", "y1", F.explode(cells).alias("_cell"))
    b = c.select("id", "_cell", *[F.col(n).alias(f"b_{n}") for n in ("ring", "edge", "x0", "y0", "x1", "y1")])
    near = "least(x0, x1) <= greatest(b_x0, b_x1) and least(b_x0, b_x1) <= greatest(x0, x1) and least(y0, y1) <= greatest(b_y0, b_y1) and least(b_y0, b_y1) <= greatest(y0, y1)"
    m = geo.dealt(c, b, ["id", "_cell"]).where(f"edge < b_edge and {near}").drop("_cell").distinct()
    m = m.selectExpr("*", "x1 - x0 as rx", "y1 - y0 as ry", "b_x1 - b_x0 as sx", "b_y1 - b_y0 as sy", "b_x0 - x0 as dx", "b_y0 - y0 as dy")
    m = m.selectExpr(
        "*", "rx * sy - ry * sx as k", "sqrt((rx * rx + ry * ry) * (sx * sx + sy * sy)) as kk", "rx * rx + ry * ry as rr",
        "sx * sx + sy * sy as ss",
    )
    m = m.selectExpr("*", "abs(k) <= 1e-12 * kk as flat", "(dx * sy - dy * sx) / nullif(k, 0) as t", "(dx * ry - dy * rx) / nullif(k, 0) as u")
    px, py = f"round(x0 + t * rx, {digits})", f"round(y0 + t * ry, {digits})"
    meets = "not flat and t between -1e-12 and 1 + 1e-12 and u between -1e-12 and 1 + 1e-12"
    one = f"struct(edge as edge, t as t, {px} as x, {py} as y), struct(b_edge as edge, u as t, {px} as x, {py} as y)"
    on = lambda e, qx, qy, ax, ay, vx, vy, vv: f"struct({e} as edge, (({qx} - {ax}) * {vx} + ({qy} - {ay}) * {vy}) / {vv} as t, {qx} as x, {qy} as y)"
    ends = ", ".join(
        [on("edge", f"b_x{i}", f"b_y{i}", "x0", "y0", "rx", "ry", "rr") for i in (0, 1)] + [on(
            "b_edge", f"x{i}", f"y{i}", "b_x0", "b_y0", "sx", "sy", "ss",
        ) for i in (0, 1)]
    )
    line_up = "flat and abs(dx * ry - dy * rx) <= 1e-12 * greatest(sqrt(rr), 1D) * greatest(sqrt(rr), sqrt(ss), 1D)"
    m = m.selectExpr(
        "id", "ring = b_ring as same", "flat", "t", "u", "x0", "y0", "x1", "y1", "b_x0", "b_y0", "b_x1", "b_y1",
        f"case when {meets} then array({one}) when {line_up} then array({ends}) end as cuts",
    )
    # strictly inside an edge: not one of its ends after rounding
    inside = lambda c, a: F.expr(f"({c}.x <> {a}x0 or {c}.y <> {a}y0) and ({c}.x <> {a}x1 or {c}.y <> {a}y1) and {c}.t > 0 and {c}.t < 1")
    m = m.where("cuts is not null").withColumns({"i": inside("cuts[0]", ""), "j": F.expr("cuts[1]").isNotNull() & inside("cuts[1]", "b_")})
    strict = F.filter("cuts", lambda q: (q["t"] > 0) & (q["t"] < 1))
    bad = F.when(F.col("flat"), F.lit(True)).otherwise(F.col("same") | (F.col("i") & F.col("j")))
    own = lambda q: (
        ((q["x"] != F.col("x0")) | (q["y"] != F.col("y0"))) & ((q["x"] != F.col("x1")) | (q["y"] != F.col("y1")))
    ) | (((q["x"] != F.col("b_x0")) | (q["y"] != F.col("b_y0"))) & ((q["x"] != F.col("b_x1")) | (q["y"] != F.col("b_y1"))))
    m = m.withColumn("cuts", F.filter(strict, own)).where(F.size("cuts") > 0)
    return m.select("id", F.explode("cuts").alias("c"), bad.alias("bad")).select("id", "c.edge", "c.t", "c.x", "c.y", "bad")


def pieces(edges: DataFrame, cuts: DataFrame, also: tuple = ()) -> DataFrame:
    """(id, also, ax, ay, bx, by, times): edges between their cuts, the smaller end first, and how many lie there."""
    cut = cuts.groupBy("id", "edge").agg(F.array_sort(F.collect_set(F.struct("t", "x", "y"))).alias("_cuts"))
    ends = lambda t, x, y: F.array(F.struct(F.lit(t).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")))
    e = edges.join(cut, ["id", "edge"], "left")
    way = F.when(F.col("_cuts").isNull(), F.concat(ends(0.0, "x0", "y0"), ends(1.0, "x1", "y1"))).otherwise(
        F.concat(ends(0.0, "x0", "y0"), F.col("_cuts"), ends(1.0, "x1", "y1")),
    )
    e = e.select("id", *also, way.alias("_w"))
    step = F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b")))
    p = e.select("id", *also, F.explode(step).alias("s")).select("id", *also, *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    p = p.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    p = p.select("id", *also, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return p.groupBy("id", *also, "a", "b").agg(F.count("*").alias("times")).select(
        "id", *also, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "times",
    )


def beyond(middles: DataFrame, others: DataFrame) -> DataFrame:
    """Pieces (id, ax, ay, bx, by, ...) and the middle of each, with the pieces o_ of the same id that share its strip: columns of
    both, `same` (it is that piece) and `beyond` (it lies farther along the slanted line through the middle)."""
    up = lambda e: F.col(f"{e}y") + SLANT * F.col(f"{e}x")
    o = others.withColumns({"ua": up("a"), "ub": up("b")})
    span = o.groupBy("id").agg(
        F.min(F.least("ua", "ub")).alias("_lo"), (F.max(F.greatest("ua", "ub")) - F.min(F.least("ua", "ub"))).alias("_of"),
        F.least(F.lit(GRID * GRID), F.ceil(F.sqrt(F.count("*")))).cast("int").alias("_n"),
    )
    strip = lambda u: F.greatest(
        F.lit(0), F.least(F.col("_n") - 1, F.floor((u - F.col("_lo")) / F.greatest(F.col("_of"), F.lit(1e-300)) * F.col("_n")).cast("int")),
    )
    m = middles.withColumns({"ua": up("a"), "ub": up("b"), "mx": (F.col("ax") + F.col("bx")) / 2}).withColumn("mu", (F.col("ua") + F.col("ub")) / 2)
    m = m.join(span, "id").withColumn("_s", strip(F.col("mu"))).drop("_lo", "_of", "_n")
    o = o.join(span, "id").withColumn("_s", F.explode(F.sequence(strip(F.least("ua", "ub")), strip(F.greatest("ua", "ub"))))).drop("_lo", "_of", "_n")
    met = geo.dealt(m, o.withColumnsRenamed({c: f"o_{c}" for c in o.columns if c not in ("id", "_s")}), ["id", "_s"])
    same = (F.col("o_ax") == F.col("ax")) & (F.col("o_ay") == F.col("ay")) & (F.col("o_bx") == F.col("bx")) & (F.col("o_by") == F.col("by"))
    x = F.col("o_ax") + F.try_divide(F.col("mu") - F.col("o_ua"), F.col("o_ub") - F.col("o_ua")) * (F.col("o_bx") - F.col("o_ax"))
    crossed = ((F.col("o_ua") > F.col("mu")) != (F.col("o_ub") > F.col("mu"))) & (x > F.col("mx"))
    return met.withColumns({"same": same, "beyond": ~same & F.coalesce(crossed, F.lit(False))})


PIECE = ("id", "ax", "ay", "bx", "by", "ua", "ub")


def turned(sides: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by) with the inside on the left, of PIECE and `right`: whether the inside lies beyond the middle, which is
    on the left of a piece that goes down."""
    keep = F.col("right") == (F.col("ua") > F.col("ub"))
    turn = lambda c, d: F.when(keep, F.col(c)).otherwise(F.col(d))
    return sides.select("id", turn("ax", "bx").alias("ax"), turn("ay", "by").alias("ay"), turn("bx", "ax").alias("bx"), turn("by", "ay").alias("by"))


def directed(border: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by) with the inside on the left, of the pieces that bound it in any direction: beyond a piece the inside
    begins where an odd number of pieces lies farther."""
    p = border.select("id", "ax", "ay", "bx", "by")
    return turned(beyond(p, p).groupBy(*PIECE).agg((F.count_if("beyond") % 2 == 1).alias("right")))


def united(parts: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by) with the inside on the left, of the pieces that bound what any owner covers.

    parts: (id, owner, ax, ay, bx, by), each owner's own border. A piece stays if just one of its flanks is inside any owner; so a
    border that two owners share goes, and so does what lies within another.
    """
    p = parts.select("id", "ax", "ay", "bx", "by").distinct()
    own = beyond(p, parts.select("id", "owner", "ax", "ay", "bx", "by")).groupBy(*PIECE, "o_owner").agg(
        (F.count_if("beyond") % 2 == 1).alias("right"), F.max("same").alias("on"),
    )
    flanks = own.groupBy(*PIECE).agg(F.max("right").alias("right"), F.max(F.col("right") != F.col("on")).alias("left"))
    return turned(flanks.where("left <> right"))


def traced(border: DataFrame, name: str = "rings") -> DataFrame:
    """(id, ring, at, x, y, x1, y1, area): directed pieces chained to rings, by pointers that double each round.

    Where several pieces leave a point the first one clockwise from the way back is next, so that parts that touch in a
    point are rings of their own. A ring's area is positive round an inside, negative round a hole.
    """
    p = stored(border.select("id", "ax", "ay", "bx", "by", F.monotonically_increasing_id().alias("piece")), name)
    n = p.select(
        "id", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"),
        F.col("piece").alias("next"),
    )
    came, goes = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")), F.atan2(F.col("cy") - F.col("by"), F.col("cx") - F.col("bx"))
    clockwise = F.pmod(came - goes + 4 * F.pi() - 1e-12, 2 * F.pi())
    way = p.join(n, ["id", "bx", "by"]).groupBy("id", "piece").agg(F.min_by("next", F.struct(clockwise, "next")).alias("next"))
    state = stored(way.select("piece", "next", F.least("piece", "next").alias("low"), F.lit(True).alias("moved")), name)
    while True:
        ahead = state.select(F.col("piece").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        state = stored(
            state.join(ahead, "next").select(
                "piece", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved"),
            ),
            name,
        )
        if state.where("moved").isEmpty():
            break
    rings = state.select("piece", F.col("low").alias("ring"))
    # places: steps to the piece before the ring's first, by doubling again
    step = way.join(rings, "piece").select(
        "piece", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("steps"),
    )
    step = stored(step, name)
    while not step.where("next is not null").isEmpty():
        ahead = step.select(F.col("piece").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        step = stored(
            step.join(ahead, "next", "left").select(
                "piece", "ring", F.col("_next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            ),
            name,
        )
    out = p.join(step.select("piece", "ring", "steps"), "piece")
    area = out.groupBy("ring").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    return out.join(area, "ring").select(
        "id", "ring", (-F.col("steps")).alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("x1"),
        F.col("by").alias("y1"), "area",
    )


def repair(polygons: DataFrame, key: str = "id", polygon: str = "polygon", geometry: bool = True, digits: int = DIGITS) -> DataFrame:
    """(id, status, area_change, repaired): valid_original, repaired, or unrepairable where no inside is left.

    The inside is what an odd number of rings covers: a bow-tie becomes its two halves, spikes and doubled rings cancel,
    overlapping holes open where they overlap. `repaired` holds the rings of the result, the largest first, for polygons that
    were repaired. area_change is relative to the shell's area without the holes', 0 where that is 0; NULL polygons are left
    as they are (valid_original). A hole that touches its shell in a point is valid.
    """
    e = stored(edge_rows(polygons, key, polygon, digits), "edges")
    c = stored(crossings(e, digits), "cuts")
    p = stored(pieces(e, c), "pieces")
    border = stored(directed(p.where("times % 2 = 1")), "border")
    areas = border.groupBy("id").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("_area"))
    touched = e.groupBy("id", "ring", "x0", "y0").agg(F.count("*").alias("k")).where("k > 1").select("id")
    faults = c.where("bad").select("id").unionByName(p.where("times > 1").select("id")).unionByName(touched).distinct().withColumn("_bad", F.lit(True))
    shell = F.get(col(polygon), F.lit(0))
    known = polygons.select(
        F.col(key).alias("id"), col(polygon).isNotNull().alias("_there"), geo.area(polygon).alias("_old"), F.coalesce(
            F.size(F.array_distinct(shell)) >= 3, F.lit(False),
        ).alias("_points"),
    )
    r = known.join(areas, "id", "left").join(faults, "id", "left")
    new, old = F.coalesce("_area", F.lit(0.0)), F.coalesce("_old", F.lit(0.0))
    small = F.lit(1e-9) * F.greatest(F.abs(old), F.lit(1e-300))
    fine = ~F.col("_there") | (F.col("_bad").isNull() & F.col("_points") & (F.abs(new - old) <= small) & (old > 0))
    status = F.when(fine, "valid_original").when(new > 1e-12, "repaired").otherwise("unrepairable")
    change = F.when((status == "repaired") & (old > 0), F.abs(new - old) / old).otherwise(0.0)
    r = r.select("id", status.alias("status"), F.round(change, 6).alias("area_change"))
    if not geometry:
        return r
    wanted = border.join(r.where("status = 'repaired'").select("id"), "id", "left_semi")
    ring = traced(wanted).groupBy("id", "ring", "area").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")),
    ).alias("points"))
    made = ring.groupBy("id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.abs("area")).alias("a"), "ring", "points"))), lambda q: q["points"],
    ).alias("repaired"))
    return r.join(made, "id", "left").select("id", "status", "area_change", "repaired")


def outlines(rings: DataFrame) -> DataFrame:
    """traced() rings as rows (id, ring, area, points), without corners on a straight line."""
    r = rings.groupBy("id", "ring", "area").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")),
    ).alias("_p"))
    n = F.size("_p")
    at = lambda i: F.get("_p", F.pmod(i, n).cast("int"))

    def bends(p, i):
        a, c = at(i - 1), at(i + 1)
        cross = (p["x"] - a["x"]) * (c["y"] - p["y"]) - (p["y"] - a["y"]) * (c["x"] - p["x"])
        way = F.abs(p["x"] - a["x"]) + F.abs(p["y"] - a["y"]) + F.abs(c["x"] - p["x"]) + F.abs(c["y"] - p["y"])
        return F.abs(cross) > way * way * 1e-9

    return r.select("id", "ring", "area", F.filter("_p", bends).alias("points"))


def dissolve(df: DataFrame, by: list[str], polygon: str = "polygon", digits: int = DIGITS) -> DataFrame:
    """(by, part, polygon): the union of each group's polygons, a row a shell with its holes, the largest shell first.

    Edges, not polygons, meet: within cells where they cross, within strips where their flanks are looked at. One group is as many
    tasks as it has cells and strips; only the points of one outline come together in a row. A polygon's own inside is what an
    odd number of its rings covers. Corners are rounded to `digits`. NULL polygons count for nothing; groups with no area have
    no row. Equal polygons of a group count once, as their union is one of them.
    """
    df = df.select(*by, polygon).where(F.col(polygon).isNotNull()).distinct()
    p = df.select(F.struct(F.struct(*by).alias("g"), F.monotonically_increasing_id().alias("owner")).alias("id"), F.col(polygon).alias("polygon"))
    e = edge_rows(p, "id", "polygon", digits).select(F.col("id.g").alias("id"), F.col("id.owner").alias("owner"), "ring", "x0", "y0", "x1", "y1")
    e = stored(e.withColumn("edge", F.monotonically_increasing_id()), "edges")
    parts = stored(pieces(e, crossings(e, digits), ("owner",)).where("times % 2 = 1"), "pieces")
    rings = stored(traced(united(parts)), "outlines")
    outline = outlines(rings)
    shells = outline.where("area > 0").select("id", "ring", "area", "points")
    # a hole lies in the smallest shell that has an odd number of sides beyond a point of it
    sides = lambda sign: rings.where(f"area {sign} 0").select(
        "id", "ring", "at", "area", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"),
    )
    one = sides("<").groupBy("id", "ring").agg(F.min_by(F.struct("ax", "ay", "bx", "by"), "at").alias("s")).select("id", "ring", "s.*")
    held = beyond(one, sides(">").drop("at")).groupBy("id", "ring", "o_ring", "o_area").agg((F.count_if("beyond") % 2 == 1).alias("within")).where("within")
    held = held.groupBy("id", "ring").agg(F.min_by("o_ring", "o_area").alias("shell"))
    holes = outline.where("area < 0").join(held, ["id", "ring"]).groupBy("id", "shell").agg(F.sort_array(F.collect_list(F.struct("area", "ring", "points"))).alias("holes"))
    out = shells.join(holes.withColumnRenamed("shell", "ring"), ["id", "ring"], "left")
    whole = F.concat(
        F.array("points"),
        F.coalesce(F.transform("holes", lambda h: h["points"]), F.array().cast("array<array<struct<x:double,y:double>>>")),
    )
    number = F.row_number().over(W.partitionBy("id").orderBy(F.col("area").desc(), "ring")) - 1
    return out.select(*[F.col(f"id.{c}").alias(c) for c in by], number.cast("int").alias("part"), whole.alias("polygon"))
