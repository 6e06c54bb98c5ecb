"""Adapters: what a service answers becomes a table; nothing here needs a network."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import geo
from tarnwatch.sources import remote, shapefile, tables


def test_shapefile_round_trip(spark, tmp_path):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    at = str(tmp_path / "lakes.shp")
    shapefile.write(at, [[square, hole], [hole]], ["GL_ID", "NAME"], [["1", "\xe9t\xe9"], ["2", None]])
    with zipfile.ZipFile(tmp_path / "lakes.zip", "w") as z:
        for s in ("shp", "dbf"):
            z.write(tmp_path / f"lakes.{s}", f"in/lakes.{s}")
    for path in (at, str(tmp_path / "lakes.zip")):
        t = shapefile.read(spark, path)
        assert [
            (r.GL_ID, r.NAME, r.geometry_type) for r in t.orderBy("GL_ID").collect()
        ] == [("1", "\xe9t\xe9", "Polygon"), ("2", None, "Polygon")]
        assert [r[0] for r in t.orderBy("GL_ID").select(geo.area("polygon")).collect()] == [15.0, 1.0]
        d = shapefile.diagnostics(t).first()
        assert (d.rows, d.max_x, d.has_NAME, d.geometry_types) == (2, 4.0, 1, ["Polygon"])
    assert shapefile.admin_boundary(t, "\xc9T\xc9", ("ADMIN", "NAME")).count() == 1 and shapefile.admin_boundary(t, "x").count() == 0


def test_token_is_kept_until_it_ends():
    now, asked = [0.0], []
    t = remote.Token(lambda form: asked.append(form) or {"access_token": str(len(asked)), "expires_in": 100}, "a", "b", lambda: now[0])
    assert t.get() == t.get() == "1"
    now[0] = 50.0
    assert t.get() == "2" and asked[0]["grant_type"] == "client_credentials"


def test_scene_search_reads_all_pages(spark):
    def search(body):
        n = body.get("page", 0)
        link = [{"rel": "next", "body": {"page": n + 1}}] if n < 2 else []
        return {
            "features": [
                {"id": f"s{n}", "collection": "c", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-01-01", "eo:cloud_cover": 10}}
            ],
            "links": link,
        }

    got = remote.scenes(spark, search, (0, 0, 1, 1), "2024-01-01", "2024-02-01", "c").orderBy("scene_id").collect()
    assert [r.scene_id for r in got] == ["s0", "s1", "s2"] and (got[0].west, got[0].north) == (1.0, 4.0)
    request = remote.process_request((0, 0, 1, 1), "a", "b", 5, 6)
    assert request["output"]["width"] == 5 and "s.B11" in request["evalscript"]


def test_granules_and_features(spark):
    got = remote.granules(spark, lambda q: [{"id": "a", "start": "2024-01-01"}, {"id": "b"}], "P", "1", (0, 0, 1, 1), "x", "y")
    assert [r.granule_id for r in got.collect()] == ["a"]
    asked = []

    def query(q):
        asked.append(q)
        return {"objectIds": [3, 1, 2]} if "returnIdsOnly" in q else {
            "features": [{"properties": {"i": i}, "geometry": None} for i in q["objectIds"]]
        }

    assert remote.features_by_id(spark, query, 2).count() == 3 and len(asked) == 3
    row = remote.tile_rows("l", "s", "t", [[[1, 2], [3, 4]]] * 3)
    assert spark.createDataFrame([row], remote.TILE).first().green == [1.0, 2.0, 3.0, 4.0]


def test_scene_search_has_no_last_page_but_the_services(spark):
    """More than 1,000 pages, spans that share an item on their border, and pages that go round."""
    item = lambda i, day: {"id": i, "collection": "c", "bbox": [1, 2, 3, 4], "properties": {"datetime": day}}

    def search(body):
        n, (lo, hi) = body.get("page", 0), body["datetime"].split("/")
        own = [item(f"{lo}-{n}", lo), *([item("border", "2024-01-02")] if n == 0 else [])]
        return {"features": own, "links": [{"rel": "next", "body": {"page": n + 1}}] if n < 1100 else []}

    spans = [("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-03")]
    got = remote.scenes(spark, search, (0, 0, 1, 1), "2024-01-01", "2024-01-03", "c", 1, spans)
    assert got.count() == 2 * 1101 + 1 and got.where("scene_id = 'border'").count() == 1
    assert remote.scenes(spark, search, (0, 0, 1, 1), "2024-01-01", "2024-01-02", "c").count() == 1102

    def turning(body):
        return {"features": [], "links": [{"rel": "next", "body": {"page": (body.get("page", 0) + 1) % 3}}]}

    with pytest.raises(Exception, match="names a page again"):
        remote.scenes(spark, turning, (0, 0, 1, 1), "2024-01-01", "2024-01-02", "c").count()


def test_granule_pages_are_asked_for_by_tasks(spark):
    import os

    driver = os.getpid()

    def search(q):
        n = q["page_num"]
        return [{"id": f"g{n}-{k}", "start": None if k == 1 else "2024-01-01", "url": str(os.getpid())} for k in range(n)]

    got = remote.granules(spark, search, "P", "1", (0, 0, 1, 1), "x", "y", 5).collect()
    assert sorted(r.granule_id for r in got) == sorted(f"g{n}-{k}" for n in range(1, 6) for k in range(n) if k != 1)
    assert str(driver) not in {r.url for r in got}
    assert remote.granules(spark, search, "P", "1", (0, 0, 1, 1), "x", "y", 0).count() == 0


def test_sinks(spark, tmp_path):
    p = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]]
    t = spark.createDataFrame([(1, p)], f"id long, polygon {tables.RINGS}")
    tables.write_csv(t, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().polygon == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 2.0, 0.0 0.0))"
    tables.predictor_schema(t, str(tmp_path / "s.yaml"), ("polygon",))
    assert (tmp_path / "s.yaml").read_text() == "predictors:\n  - name: id\n    type: bigint\n"
    tables.manifest(str(tmp_path / "m.json"), run="r", rows=1)
    assert tables.config(str(tmp_path / "m.json"), {"rows": 0, "x": 2}) == {"run": "r", "rows": 1, "x": 2}
    assert tables.credentials({"a": ["X"], "b": ["Y"]}, {"X": "1"}) == {"a": True, "b": False}
    sites = spark.range(5).select(F.concat(F.lit("L"), "id").alias("lake_uid"))
    assert [remote.run_scope(a, sites, ["L1", "L2"]).count() for a in ({"lake_id": "L3"}, {"test": True}, {})] == [1, 2, 5]


def test_python_data_source(spark):
    remote.register(spark)
    t = spark.read.format("granules").option("pages", "2").option("search", "tests.granule_pages:page").load()
    assert t.count() == 4


def test_ods_and_zip(tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    row = lambda *v: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{x}</text:p></table:table-cell>" for x in v) + "</table:table-row>"
    with zipfile.ZipFile(tmp_path / "w.ods", "w") as z:
        z.writestr(
            "content.xml",
            f"<office:document-content {ns}><table:table "
            f"table:name='S'>{row('a', 'b')}{row('unit', '')}{row('1', '2')}</table:table></office:document-content>",
        )
    assert tables.ods_sheets(str(tmp_path / "w.ods")) == {"S": [["a", "b"], ["unit"], ["1", "2"]]}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/a.nc", "1")
        z.writestr("b.txt", "2")
    assert [p.rpartition("/")[2] for p in tables.extract_zip(str(tmp_path / "z.zip"), str(tmp_path / "out"), (".nc",))] == ["a.nc"]


def test_workbook(spark, tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    row = lambda *v: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{x}</text:p></table:table-cell>" for x in v) + "</table:table-row>"
    with zipfile.ZipFile(tmp_path / "w.ods", "w") as z:
        z.writestr(
            "content.xml",
            f"<office:document-content {ns}><table:table "
            f"table:name='S'>{row('a', 'b')}{row('unit', 'u')}{row('1', '2')}</table:table><table:table "
            f"table:name='T'>{row('a')}{row('u')}{row('3')}</table:table></office:document-content>",
        )
    got = tables.workbook(spark, str(tmp_path / "w.ods")).orderBy("a").collect()
    assert [(r.a, r.b, r.sheet) for r in got] == [("1", "2", "S"), ("3", None, "T")]
