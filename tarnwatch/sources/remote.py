"""Network adapters. Each one's tested boundary is the table it returns; the transport is a function that is passed in."""

import math
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwatch.functions.ranges import numbered
from tarnwatch.functions.storage import stored

GRANULE = "granule_id string, product string, start string, stop string, url string"


def outward(n: float, w: float, s: float, e: float, step: float = 0.1) -> tuple:
    """A box rounded outwards, so that near requests share a cache entry."""
    k = round(1 / step)
    up, down = lambda v: math.ceil(round(v * k, 9)) / k, lambda v: math.floor(round(v * k, 9)) / k
    return up(n), down(w), down(s), up(e)


def month_requests(boxes: DataFrame) -> DataFrame:
    """boxes (north, west, south, east, start, stop) -> a row a month and outward box; a window's first month counts
    from its first day on."""
    months = F.explode(
        F.sequence(F.date_trunc("month", F.col("start")).cast("date"), F.col("stop").cast("date"), F.expr("interval 1 month"))
    )
    b = boxes.withColumn("month", months)
    up, down = (lambda c: F.ceil(F.round(F.col(c) * 10, 9)) / 10), (lambda c: F.floor(F.round(F.col(c) * 10, 9)) / 10)
    return b.select(
        F.year("month").alias("year"), F.month("month").alias("month"), up("north").alias("north"), down("west").alias("west"),
        down("south").alias("south"), up("east").alias("east"),
    ).distinct()


def download(url: str, path: str, fetch: Callable[[str], Iterable[bytes]], force: bool = False) -> bool:
    """Whether anything was fetched; a part file never takes the final name."""
    if Path(path).exists() and not force:
        return False
    tmp = Path(f"{path}.part")
    with tmp.open("wb") as f:
        for chunk in fetch(url):
            f.write(chunk)
    tmp.rename(path)
    return True


def retried(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable = time.sleep):
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)


def in_chunks(ids: DataFrame, column: str, size: int = 500) -> DataFrame:
    """(chunk, ids) in order of id, for services that take so many at once."""
    n = F.floor((F.col("_n") - 1) / size)
    return numbered(ids, [column], "_n").withColumn("chunk", n).groupBy("chunk").agg(F.sort_array(F.collect_list(column)).alias("ids"))


def first_existing(names: Iterable[str], candidates: list[str]) -> str | None:
    """The first candidate among a dataset's variable or dimension names."""
    have = set(names)
    return next((c for c in candidates if c in have), None)


class GranuleSource(DataSource):
    """spark.read.format("granules"): a search service's answers as a table, a partition a page.

    options: pages (how many), search (module:function of (page) -> rows of GRANULE).
    """

    @classmethod
    def name(cls) -> str:
        return "granules"

    def schema(self) -> str:
        return GRANULE

    def reader(self, schema) -> "GranuleReader":
        return GranuleReader(self.options)


class GranuleReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition):
        import importlib

        module, _, function = self.options["search"].partition(":")
        yield from retried(lambda: list(getattr(importlib.import_module(module), function)(partition.value)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GranuleSource)


def with_time(granules: DataFrame) -> DataFrame:
    """Granules without a time are rejected, never dated now."""
    return granules.where(F.try_to_timestamp("start").isNotNull())


class Token:
    """OAuth client credentials: a token that is asked for once and again before it ends."""

    def __init__(
        self, ask: Callable[[dict], dict], client_id: str, client_secret: str, clock: Callable[[], float] = time.time, early: float = 60,
    ):
        self.ask, self.form, self.clock, self.early = ask, {
            "grant_type": "client_credentials", "client_id": client_id, "client_secret": client_secret,
        }, clock, early
        self.value, self.until = None, 0.0

    def get(self) -> str:
        if self.value is None or self.clock() >= self.until - self.early:
            got = retried(lambda: self.ask(self.form))
            self.value, self.until = got["access_token"], self.clock() + float(got.get("expires_in", 300))
        return self.value


def asked(spark: SparkSession, ask: Callable[[int], Iterable[list[tuple]]], n: int, schema: str, name: str) -> DataFrame:
    """The rows that ask(k) gives page by page for k from 0 to n - 1, asked once by tasks and written: only numbers leave the driver."""
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        import pandas as pd

        for t in batches:
            for k in t.id:
                for page in ask(int(k)):
                    yield pd.DataFrame(page, columns=names)

    tasks = min(n, max(spark.sparkContext.defaultParallelism * 4, -(-n // 64)))
    return stored(spark.range(0, n, 1, max(tasks, 1)).mapInPandas(read, schema), name)


SCENE = "scene_id string, collection string, datetime string, cloud_cover double, west double, south double, east double, north double"


def found_pages(search: Callable[[dict], dict], body: dict) -> Iterable[list[tuple]]:
    """A search's pages of SCENE rows, each named by the one before, to the last; one that is named twice would never end."""
    seen = set()
    while body is not None:
        seen.add(hash(repr(body)))
        page, rows = retried(lambda body=body: search(body)), []
        for f in page.get("features", []):
            p, b = f.get("properties", {}), f.get("bbox") or [None] * 4
            rows.append(
                (
                    f.get("id"), f.get("collection"), p.get("datetime"),
                    None if p.get("eo:cloud_cover") is None else float(p["eo:cloud_cover"]),
                    *[None if v is None else float(v) for v in (b[:2] + b[-2:])[:4]],
                )
            )
        yield rows
        after = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
        body = None if after is None else body | after.get("body", {"next": after.get("href")})
        if body is not None and hash(repr(body)) in seen:
            raise RuntimeError("the catalogue names a page again that was read already")


def scenes(
    spark: SparkSession, search: Callable[[dict], dict], box: tuple, start: str, stop: str, collection: str, limit: int = 100,
    spans: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """A STAC catalogue's items in a box and time span, all pages (search: a request's body -> a FeatureCollection).

    A page is named by the one before, so a span is one task, which writes page by page; `spans` cut the time into several, each
    with pages of its own. An item on the border of two spans is a row once.
    """
    # Fixed values of the service: the fields of a search.
    cut = spans or [(start, stop)]
    body = {"collections": [collection], "bbox": list(box), "limit": limit}
    rows = asked(spark, lambda k: found_pages(search, body | {"datetime": "/".join(cut[k])}), len(cut), SCENE, "scenes")
    return rows.dropDuplicates() if len(cut) > 1 else rows


def process_request(
    box: tuple, start: str, stop: str, width: int, height: int, bands: tuple = ("B03", "B11", "SCL"), collection: str = "sentinel-2-l2a",
) -> dict:
    """A raster service's request for bands of a box as one GeoTIFF of floats."""
    # Fixed values of the service: the script's functions and the request's fields.
    script = f"//VERSION=3\nfunction setup() {{ return {{ input: {list(bands)!r}, output: {{ bands: {len(bands)}, sampleType: 'FLOAT32' }} }}; }}\nfunction evaluatePixel(s) {{ return [{', '.join('s.' + b for b in bands)}]; }}"
    return {
        "input": {
            "bounds": {"bbox": list(box), "properties": {"crs": "http://www.opengis.net/def/crs/EPSG/0/4326"}},
            "data": [{"type": collection, "dataFilter": {"timeRange": {"from": start, "to": stop}}}],
        },
        "output": {"width": width, "height": height, "responses": [{"identifier": "default", "format": {"type": "image/tiff"}}]},
        "evalscript": script,
    }


TILE = "lake_uid string, scene_id string, ts string, height int, width int, green array<float>, swir array<float>, scl array<float>"


def tile_rows(lake_uid: str, scene_id: str, ts: str, bands: list) -> tuple:
    """A decoded raster's bands (2-D arrays) as a row of TILE; the decoder is the caller's."""
    height, width = len(bands[0]), len(bands[0][0])
    return (lake_uid, scene_id, ts, height, width, *([float(v) for row in b for v in row] for b in bands))


def granules(
    spark: SparkSession, search: Callable[[dict], list], product: str, version: str, box: tuple, start: str, stop: str,
    pages: int | None = None,
) -> DataFrame:
    """A granule search's answers as GRANULE rows; those without a time are rejected.

    With `pages` (as many as the service's hits make), each is asked for by a task, as page_num from 1 on, so search must be a
    function that can be sent there; without, the one answer comes to the driver.
    """
    query = {"short_name": product, "version": version, "bounding_box": box, "temporal": (start, stop)}
    rows = lambda found: [(g.get("id"), product, g.get("start"), g.get("stop"), g.get("url")) for g in found]
    if pages is None:
        return with_time(spark.createDataFrame(rows(retried(lambda: search(query))), GRANULE))
    return with_time(asked(spark, lambda k: [rows(retried(lambda: search(query | {"page_num": k + 1})))], pages, GRANULE, "granules"))


def features_by_id(spark: SparkSession, query: Callable[[dict], dict], size: int = 500) -> DataFrame:
    """A map server's layer: its object ids, then the features of so many at once (attributes and geometry as JSON)."""
    import json

    ids = sorted(retried(lambda: query({"where": "1=1", "returnIdsOnly": "true"}))["objectIds"] or [])
    rows = []
    for at in range(0, len(ids), size):
        page = retried(lambda at=at: query({"objectIds": ids[at : at + size], "outFields": "*", "f": "geojson"}))
        rows += [(json.dumps(f.get("properties"), sort_keys=True), json.dumps(f.get("geometry"))) for f in page["features"]]
    return spark.createDataFrame(rows, "properties string, geometry_json string")


def run_scope(arguments: dict, sites: DataFrame, test_ids: list, key: str = "lake_uid") -> DataFrame:
    """The sites of a run: one id, the test list, or all."""
    if arguments.get("lake_id"):
        return sites.where(F.col(key) == arguments["lake_id"])
    return sites.where(F.col(key).isin(test_ids)) if arguments.get("test") else sites
