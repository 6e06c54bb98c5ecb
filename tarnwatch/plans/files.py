"""Queries over sources and sinks: a table is written in a format and read back; adapters get a transport that answers from a
table. What comes out must equal the table."""

import csv
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from tarnwatch.functions.storage import folder
from tarnwatch.operators import geo
from tarnwatch.plans import standins as S
from tarnwatch.plans.register import registry
from tarnwatch.sources import rasterfiles, remote, shapefile, tables

QUERIES, ORACLES, query = registry()
POINTS = S.ctes("customers", "suppliers")


def place(spark, name):
    """A folder that the driver opens files in: in the shared folder, which must be a mounted one."""
    at = folder(spark, f"{name}-{uuid.uuid4().hex}")
    if not at.startswith("file:"):
        raise ValueError("these formats are read and written by the driver: spark.checkpoint.dir must be a mounted folder")
    path = Path("/" + at.removeprefix("file:").lstrip("/"))
    path.mkdir(parents=True)
    return path


def page_rows(path, system=None):
    """A Parquet file's rows, read within a task; path is a URI where no file system is given."""
    from pyarrow import fs, parquet

    if system is None:
        system, path = fs.FileSystem.from_uri(path)
    with system.open_input_file(path) as f:
        return parquet.read_table(f).to_pylist()


def squares(spark, d, r=0.2):
    """Squares round the suppliers as rings of points."""
    s = S.sites(spark, d, "supplier", "s_suppkey")
    at = lambda i, j: F.struct((F.col("lon") + i * r).alias("x"), (F.col("lat") + j * r).alias("y"))
    return s.select("id", "lat", "lon", F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))).alias("polygon"))


SQUARES = POINTS + " select id, round(0.4 * 0.4, 6)::double as area, round(lon - 0.2, 6) as min_x from suppliers"


def measured(t, key="id"):
    return t.select(
        F.col(key).cast("long").alias("id"), F.round(geo.area("polygon"), 6).alias("area"),
        F.round(geo.bounds("polygon")["min_x"], 6).alias("min_x"),
    )


@query("select s_suppkey, s_name, s_acctbal from supplier union all select null, null, null where false")
def a01_parquet(spark, d):
    """A table that is there, and the empty table of the schema where there is none."""
    s = S.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    at = folder(spark, "a01-" + uuid.uuid4().hex)
    s.write.parquet(f"{at}/there")
    return tables.parquet(spark, f"{at}/there", s.schema).unionByName(tables.parquet(spark, f"{at}/none", s.schema))


@query(SQUARES)
def a02_geoparquet(spark, d):
    at = folder(spark, "a02-" + uuid.uuid4().hex)
    tables.write_geoparquet(squares(spark, d).select("id", "polygon"), at)
    return measured(tables.geoparquet(spark, at))


@query(SQUARES)
def a03_geojson(spark, d):
    """Unrepairable rows stay out of the file."""
    s = squares(spark, d)
    ring = F.transform(F.concat(F.get("polygon", F.lit(0)), F.slice(F.get("polygon", F.lit(0)), 1, 1)), lambda p: F.array(p["x"], p["y"]))
    geometry = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}"))
    f = s.select("id", F.lit("ok").alias("repair"), geometry.alias("geometry_json")).unionByName(
        s.select("id", F.lit("unrepairable").alias("repair"), F.lit(None).cast("string").alias("geometry_json"))
    )
    at = place(spark, "a03")
    tables.write_geojson(f, f"{at}/lakes.geojson", keep=F.col("repair") != "unrepairable")
    t = tables.geojson(spark, f"file://{at}/lakes.geojson").withColumn("polygon", tables.polygon_of("coordinates"))
    # a GeoJSON ring ends where it begins
    return measured(t.withColumn("polygon", F.transform("polygon", lambda r: F.slice(r, 1, F.size(r) - 1))))


def layer(spark, d):
    at = place(spark, "layer")
    rows = squares(spark, d).orderBy("id").collect()
    shapefile.write(
        f"{at}/lakes.shp", [[[(p.x, p.y) for p in r] for r in x.polygon] for x in rows], ["GL_ID", "NAME"],
        [[str(x.id), "India" if x.id % 2 else "Nepal"] for x in rows],
    )
    with zipfile.ZipFile(f"{at}/lakes.zip", "w") as z:
        for s in ("shp", "dbf"):
            z.write(f"{at}/lakes.{s}", f"in/lakes.{s}")
    return at


@query(SQUARES)
def a04_shapefile(spark, d):
    return measured(shapefile.read(spark, f"{layer(spark, d)}/lakes.shp"), "GL_ID")


@query(
    POINTS + " select count(*) as rows, 'Polygon' as geometry_types, round(min(lon) - 0.2, 6) as min_x, round(max(lat) + 0.2, 6) as max_y "
    "from suppliers"
)
def a04_diagnostics(spark, d):
    r = shapefile.diagnostics(shapefile.read(spark, f"{layer(spark, d)}/lakes.shp"))
    return r.select(
        "rows", F.array_join("geometry_types", ",").alias("geometry_types"), F.round("min_x", 6).alias("min_x"),
        F.round("max_y", 6).alias("max_y"),
    )


@query(SQUARES + " where id % 2 = 1")
def a05_boundary_in_zip(spark, d):
    return measured(shapefile.admin_boundary(shapefile.read(spark, f"{layer(spark, d)}/lakes.zip"), "india"), "GL_ID")


@query("select s_suppkey::varchar as id, 'Caf\xe9 ' || s_name as name from supplier")
def a06_csv_latin1(spark, d):
    at = folder(spark, "a06-" + uuid.uuid4().hex)
    s = S.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("Caf\xe9 "), "s_name").alias("name"),
    )
    s.write.option("encoding", "ISO-8859-1").option("header", True).csv(at)
    return tables.csv_latin1(spark, at)


@query("select n_nationkey::varchar as lake, n_name as country from nation")
def a07_csv_discovery(spark, d):
    """Of three files the one whose header says most."""
    at = place(spark, "a07")
    rows = S.table(spark, d, "nation").orderBy("n_nationkey").collect()
    for name, head in (("a", ["key", "text"]), ("b", ["lake", "country"]), ("c", ["year", "text"])):
        with open(f"{at}/{name}.csv", "w", encoding="latin-1", newline="") as f:
            csv.writer(f).writerows([head, *([r.n_nationkey, r.n_name] for r in rows)])
    return tables.csv_latin1(spark, "file://" + tables.discover_csv([f"{at}/{n}.csv" for n in "abc"]))


def ods(path, sheets):
    from xml.sax.saxutils import escape

    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    row = lambda v: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(str(x))}</text:p></table:table-cell>" for x in v) + "</table:table-row>"
    body = "".join(f"<table:table table:name='{n}'>{''.join(map(row, rows))}</table:table>" for n, rows in sheets.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}>{body}</office:document-content>")


@query("select n_nationkey::varchar as key, n_name as name, case when n_regionkey % 2 = 0 then 'even' else 'odd' end as sheet from nation")
def a08_workbook(spark, d):
    """Two sheets; the row after the header, of units, is not data."""
    at = place(spark, "a08")
    rows = S.table(spark, d, "nation").collect()
    part = lambda k: [["key", "name"], ["unit", "text"], *([r.n_nationkey, r.n_name] for r in rows if r.n_regionkey % 2 == k)]
    ods(f"{at}/w.ods", {"even": part(0), "odd": part(1)})
    return tables.workbook(spark, f"{at}/w.ods")


@query("select r_regionkey::varchar as key, r_name as name from region")
def a09_zip(spark, d):
    """An archive's CSV files, one a region; others stay inside."""
    at = place(spark, "a09")
    with zipfile.ZipFile(f"{at}/z.zip", "w") as z:
        for r in S.table(spark, d, "region").collect():
            z.writestr(f"in/{r.r_regionkey}.csv", f"key,name\n{r.r_regionkey},{r.r_name}\n")
            z.writestr(f"in/{r.r_regionkey}.txt", "no")
    out = tables.extract_zip(f"{at}/z.zip", f"{at}/out", (".csv",))
    return spark.read.option("header", True).csv([f"file://{p}" for p in out])


@query(
    "select r_regionkey as key, case when r_regionkey % 2 = 0 then r_name else 'kept' end as content, r_regionkey % 2 = 0 as fetched "
    "from region"
)
def a10_download(spark, d):
    """What is there already is not fetched again."""
    at, rows = place(spark, "a10"), []
    for r in S.table(spark, d, "region").collect():
        path = at / str(r.r_regionkey)
        if r.r_regionkey % 2:
            path.write_text("kept")
        got = remote.download(f"http://x/{r.r_regionkey}", str(path), lambda _, name=r.r_name: (c.encode() for c in name))
        rows.append((r.r_regionkey, path.read_text(), got))
    return spark.createDataFrame(rows, "key int, content string, fetched boolean")


@query("select s_suppkey::varchar as scene_id, 'l2' as collection, s_acctbal as cloud_cover from supplier")
def a12_catalogue(spark, d):
    """All pages of searches of 30 items each, a day a search. The service's items lie in files of 100 pages, a folder a day."""
    at = folder(spark, "a12-" + uuid.uuid4().hex)
    s = S.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("cloud"), F.pmod("s_suppkey", F.lit(31)).alias("day"))
    s = s.repartition("day").sortWithinPartitions("day", "s_suppkey")
    s.write.option("maxRecordsPerFile", 3000).partitionBy("day").parquet(at)
    days = [f"2024-01-{k + 1:02d}" for k in range(31)]

    def search(body):
        from pyarrow import fs

        n, day = body.get("page", 0), body["datetime"][:10]
        system, path = fs.FileSystem.from_uri(f"{at}/day={days.index(day)}")
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
        rows = page_rows(files[n // 100], system) if files else []
        first = 30 * (n % 100)
        items = [
            {
                "id": str(r["s_suppkey"]), "collection": body["collections"][0], "bbox": [0, 0, 1, 1],
                "properties": {"datetime": f"{day}T12:00:00Z", "eo:cloud_cover": r["cloud"]},
            } for r in rows[first : first + 30]
        ]
        more = first + 30 < len(rows) or n // 100 + 1 < len(files)
        return {"features": items, "links": [{"rel": "next", "body": {"page": n + 1}}] if more else []}

    spans = list(zip(days, [*days[1:], "2024-02-01"], strict=True))
    found = remote.scenes(spark, search, (0, 0, 1, 1), "2024-01-01", "2024-02-01", "l2", 30, spans)
    return found.select("scene_id", "collection", "cloud_cover")


@query("select k as call, cast(k // 4 + 1 as varchar) as token from range(12) r(k)")
def a13_token(spark, d):
    """A token of 100 s that is asked for every 10 s, with 60 s to spare: renewed every 40 s."""
    now, asked = [0.0], []
    t = remote.Token(lambda form: asked.append(form) or {"access_token": str(len(asked)), "expires_in": 100}, "a", "b", lambda: now[0])
    rows = []
    for k in range(12):
        now[0] = 10.0 * k
        rows.append((k, t.get()))
    return spark.createDataFrame(rows, "call long, token string")


@query("select o_orderkey::varchar as granule_id, o_orderstatus as start from orders where o_orderstatus <> 'P'")
def a15_granules(spark, d):
    """Granules without a time are rejected. The service's pages of 2,000 are files, which tasks read."""
    at = folder(spark, "a15-" + uuid.uuid4().hex)
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("url"))
    time = F.when(F.col("url") != "P", "2024-01-01")
    o.withColumn("start", time).write.option("maxRecordsPerFile", 2000).parquet(at)
    pages = sorted(spark.read.parquet(at).inputFiles())
    found = remote.granules(spark, lambda q: page_rows(pages[q["page_num"] - 1]), "P", "1", (0, 0, 1, 1), "x", "y", len(pages))
    return found.select("granule_id", F.col("url").alias("start"))


@query("select c_custkey as id, c_name as name from customer")
def a19_features(spark, d):
    """A layer in chunks of 500 ids."""
    names = {r.c_custkey: r.c_name for r in S.table(spark, d, "customer").select("c_custkey", "c_name").collect()}

    def answer(q):
        if "returnIdsOnly" in q:
            return {"objectIds": list(names)}
        assert len(q["objectIds"]) <= 500
        return {"features": [{"properties": {"id": i, "name": names[i]}, "geometry": None} for i in q["objectIds"]]}

    t = remote.features_by_id(spark, answer)
    return t.select(
        F.get_json_object("properties", "$.id").cast("long").alias("id"), F.get_json_object("properties", "$.name").alias("name"),
    )


@query("select 'run' as key, 'r1' as value union all select 'rows', (select count(*) from orders)::varchar union all select 'start', null")
def a20_config(spark, d):
    """A manifest's facts as a configuration over defaults; the text None means nothing."""
    at = place(spark, "a20")
    tables.manifest(f"{at}/m.json", rows=S.table(spark, d, "orders").count(), start="None")
    c = tables.config(f"{at}/m.json", {"run": "r1", "rows": 0, "start": "x"})
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in c.items()], "key string, value string")


@query("select r_name as service, r_regionkey % 2 = 0 as there from region")
def a21_credentials(spark, d):
    rows = S.table(spark, d, "region").collect()
    env = {f"{r.r_name}_{k}": "x" if k == "ID" or r.r_regionkey % 2 == 0 else "" for r in rows for k in ("ID", "KEY")}
    got = tables.credentials({r.r_name: [f"{r.r_name}_ID", f"{r.r_name}_KEY"] for r in rows}, env)
    return spark.createDataFrame(list(got.items()), "service string, there boolean")


@query(POINTS + " select id::varchar as id, round(lon - 0.2, 6) as x from suppliers")
def b05_csv_with_wkt(spark, d):
    at = folder(spark, "b05-" + uuid.uuid4().hex)
    tables.write_csv(squares(spark, d).select("id", "polygon"), at)
    t = spark.read.option("header", True).csv(at)
    return t.select("id", F.round(F.regexp_extract("polygon", r"POLYGON \(\((\S+) ", 1).cast("double"), 6).alias("x"))


@query("select o_orderstatus as status, count(*)::varchar as rows from orders group by 1")
def b07_markdown(spark, d):
    """A report's table, every row of it, read back by its bars."""
    o = S.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows"))
    text = tables.markdown(o, "Orders")
    cells = [line.strip("|").split("|") for line in io.StringIO(text).read().splitlines() if line.startswith("|")]
    return spark.createDataFrame([tuple(c) for c in cells[2:]], ", ".join(f"{c} string" for c in cells[0]))


@query("select 'n_nationkey' as name, 'int' as type union all select 'n_regionkey', 'int'")
def b09_predictor_schema(spark, d):
    at = place(spark, "b09")
    n = S.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey"), "n_name").withColumns(
        {c: F.col(c).cast("int") for c in ("n_nationkey", "n_regionkey")}
    )
    tables.predictor_schema(n, f"{at}/s.yaml", ("n_name",))
    lines = Path(f"{at}/s.yaml").read_text().splitlines()[1:]
    pairs = [(a.removeprefix("  - name: "), b.removeprefix("    type: ")) for a, b in zip(lines[::2], lines[1::2], strict=True)]
    return spark.createDataFrame(pairs, "name string, type string")


@query("select r_name as file, sha256(r_name) as digest, r_regionkey % 2 = 0 as verified from region")
def k18_frozen_files(spark, d):
    """Files' SHA-256 in a manifest; those that changed since are found out."""
    import json

    at, rows = place(spark, "k18"), S.table(spark, d, "region").collect()
    paths = {r.r_name: f"{at}/{r.r_regionkey}" for r in rows}
    for n, p in paths.items():
        Path(p).write_text(n)
    tables.freeze(paths, f"{at}/manifest.json")
    digests = json.loads(Path(f"{at}/manifest.json").read_text())
    out = []
    for r in rows:
        if r.r_regionkey % 2:
            Path(paths[r.r_name]).write_text("changed")
        single = f"{at}/{r.r_regionkey}.json"
        Path(single).write_text(json.dumps({r.r_name: digests[r.r_name]}))
        try:
            tables.verify(paths, single)
            ok = True
        except ValueError:
            ok = False
        out.append((r.r_name, digests[r.r_name], ok))
    return spark.createDataFrame(out, "file string, digest string, verified boolean")


BANDS = "select user_id as tile, unnest(['band1', 'band2']) as variable, unnest([count(*), count(*)]) as pixels, unnest([round(sum(floor(value)), 3), round(sum(event_id % 60), 3)])::double as total from events group by 1"


def rasters(spark, d, suffix, encode):
    """An entity's events as a raster of one row in two bands, a file each, written by tasks."""
    import numpy as np

    e = S.table(spark, d, "events").groupBy(F.col("user_id").alias("tile")).agg(
        F.sort_array(
            F.collect_list(
                F.struct("event_id", F.floor("value").cast("double").alias("a"), (F.col("event_id") % 60).cast("double").alias("b"))
            )
        ).alias("p")
    )
    at = folder(spark, "raster-" + uuid.uuid4().hex)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(at)
        system.create_dir(path)
        for t in batches:
            pixels = t.column("p")
            ends = np.cumsum([0, *(n or 0 for n in pixels.value_lengths().to_pylist())])
            _, one, two = (c.to_numpy(zero_copy_only=False) for c in pixels.flatten().flatten())
            for tile, lo, hi in zip(t.column("tile").to_pylist(), ends, ends[1:]):
                bands = np.array([[one[lo:hi]], [two[lo:hi]]], np.float32)
                with system.open_output_stream(f"{path}/{tile}.{suffix}", compression=None) as f:
                    f.write(encode(bands))
            yield pa.RecordBatch.from_arrays([t.column("tile")], ["tile"])

    e.mapInArrow(write, "tile long").count()
    return at


def sums(t):
    return t.select(
        F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("long").alias("tile"), "variable",
        F.size("values").cast("long").alias("pixels"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 3).alias("total"),
    )


@query(BANDS)
def a14_geotiff(spark, d):
    """Two-band GeoTIFFs, decoded by tasks."""
    return sums(rasterfiles.grids(spark, rasters(spark, d, "tif", rasterfiles.write_tiff)))


@query(BANDS)
def a16_netcdf(spark, d):
    """Packed classic NetCDF variables, found by lists of candidate names."""
    t = rasterfiles.grids(spark, rasters(spark, d, "nc", packed_netcdf), {"band1": ["temperature", "t2m"], "band2": ["tp"]})
    return sums(t)


def packed_netcdf(bands) -> bytes:
    """Two variables in halves, with an offset of 10."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    attribute = lambda key, v: name(key) + struct.pack(">iid", 6, 1, v)
    attributes = struct.pack(">ii", 12, 2) + attribute("scale_factor", 0.5) + attribute("add_offset", 10.0)
    raw = [((b - 10) * 2).astype(">i4").tobytes() for b in bands]

    def head(at):
        out = b"CDF\1" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("y") + struct.pack(">i", 1) + name("x") + struct.pack(">i", bands.shape[2]) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
        for k, n in enumerate(("t2m", "tp")):
            out += name(n) + struct.pack(">iii", 2, 0, 1) + attributes + struct.pack(">iii", 4, len(raw[0]), at + k * len(raw[0]))
        return out

    return head(len(head(0))) + b"".join(raw)
