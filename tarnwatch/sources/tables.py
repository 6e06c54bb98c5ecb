"""Readers and writers: Parquet with a declared schema, GeoJSON, CSV and its discovery, WKB, archives, downloads."""

import csv
import io
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS = "array<array<struct<x:double,y:double>>>"
KEYWORDS = ("lat", "lon", "lake", "year", "date", "country")


def parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or no rows of its schema where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection -> the properties, geometry_type and coordinates (JSON text)."""
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.explode(F.from_json("value", "struct<features:array<string>>")["features"]).alias("f"))
    keys = [
        r[0] for r in features.select(
            F.explode(F.json_object_keys(F.get_json_object("f", "$.properties")))
        ).distinct().orderBy("col").collect()
    ]
    return features.select(
        *[F.get_json_object("f", f"$.properties['{k}']").alias(k) for k in keys],
        F.get_json_object("f", "$.geometry.type").alias("geometry_type"),
        F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"),
    )


def polygon_of(coordinates) -> F:
    """GeoJSON Polygon coordinates -> rings of points."""
    c = F.col(coordinates) if isinstance(coordinates, str) else coordinates
    return F.transform(
        F.from_json(c, "array<array<array<double>>>"), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )


def csv_latin1(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("encoding", "ISO-8859-1").option("header", True).csv(path)


def score_header(columns) -> int:
    """How many of the keywords the names hold."""
    text = " ".join(columns).lower()
    return sum(k in text for k in KEYWORDS)


def discover_csv(paths: list[str]) -> str | None:
    """The file whose header says most; the first of equals."""
    best, most = None, -1
    for p in paths:
        with open(p, encoding="latin-1", newline="") as f:
            n = score_header(next(csv.reader(f), []))
        if n > most:
            best, most = p, n
    return best


def extract_zip(path: str, to: str, suffixes: tuple = ("",)) -> list[str]:
    """The archive's files, none written outside the folder."""
    out, top = [], Path(to).resolve()
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            at = (top / name).resolve()
            if name.endswith("/") or not name.endswith(suffixes):
                continue
            if top not in at.parents:
                raise ValueError(f"{name} leaves the folder")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(z.read(name))
            out.append(str(at))
    return out


def ods_sheets(path: str) -> dict[str, list[list]]:
    """Sheets of an ODS workbook as rows of text, by the standard library."""
    from xml.etree import ElementTree as E

    ns = {"t": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "x": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}
    repeat = "{%s}number-columns-repeated" % ns["t"]
    with zipfile.ZipFile(path) as z:
        root = E.fromstring(z.read("content.xml"))
    out = {}
    for sheet in root.iter("{%s}table" % ns["t"]):
        rows = []
        for row in sheet.iter("{%s}table-row" % ns["t"]):
            cells = []
            for c in row.findall("t:table-cell", ns):
                text = "\n".join("".join(p.itertext()) for p in c.findall("x:p", ns))
                cells += [text or None] * min(int(c.get(repeat, 1)), 1024 if text else 64)
            while cells and cells[-1] is None:
                cells.pop()
            rows.append(cells)
        out[sheet.get("{%s}name" % ns["t"])] = [r for r in rows if r]
    return out


def workbook(spark: SparkSession, path: str, skip: int = 1) -> DataFrame | None:
    """All sheets in one table: the header, then all rows but the first `skip`; columns that a sheet lacks are NULL."""
    out = None
    for name, rows in ods_sheets(path).items():
        if not rows:
            continue
        head = [str(h) for h in rows[0]]
        body = [tuple((r + [None] * len(head))[: len(head)]) + (name,) for r in rows[1 + skip :]]
        t = spark.createDataFrame(body, T.StructType([T.StructField(h, T.StringType()) for h in [*head, "sheet"]]))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def wkb_rings():
    """WKB polygon (or the parts of a multipolygon, as rings in a row) -> rings, as an Arrow UDF."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(RINGS)
    def rings(values):
        import struct

        import pandas as pd

        def read(b, at):
            order = "<" if b[at] else ">"
            (kind,) = struct.unpack_from(order + "I", b, at + 1)
            at += 5
            if kind & 0x20000000:
                at += 4
            kind = kind & 0xFF
            (n,) = struct.unpack_from(order + "I", b, at)
            at += 4
            out = []
            if kind == 6:
                for _ in range(n):
                    more, at = read(b, at)
                    out += more
                return out, at
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", b, at)
                v = struct.unpack_from(f"{order}{2 * m}d", b, at + 4)
                out.append([{"x": x, "y": y} for x, y in zip(v[::2], v[1::2], strict=True)])
                at += 4 + 16 * m
            return out, at

        return pd.Series([None if v is None else read(bytes(v), 0)[0] for v in values])

    return rings


def to_wkb():
    """Rings -> little-endian WKB polygon."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def wkb(values):
        import struct

        import pandas as pd

        def pack(rings):
            out = struct.pack("<BII", 1, 3, len(rings))
            for r in rings:
                out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in r)
            return out

        return pd.Series([None if v is None else pack(v) for v in values])

    return wkb


def write_geoparquet(df: DataFrame, path: str, polygon: str = "polygon") -> None:
    """Parquet with the polygon as WKB in a `geometry` column."""
    df.withColumn("geometry", to_wkb()(polygon)).drop(polygon).write.mode("overwrite").parquet(path)


def geoparquet(spark: SparkSession, path: str, geometry: str = "geometry", polygon: str = "polygon") -> DataFrame:
    """A GeoParquet table with its WKB column as rings; other columns pass as they are."""
    return spark.read.parquet(path).withColumn(polygon, wkb_rings()(geometry)).drop(geometry)


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry_json", keep=None) -> None:
    """A FeatureCollection in one file; keep: the rows to write (unrepairable ones stay out)."""
    rows = df if keep is None else df.where(keep)
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*[c for c in df.columns if c != geometry])), F.lit(',"geometry":'),
        F.coalesce(geometry, F.lit("null")), F.lit("}"),
    )
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, r in enumerate(rows.select(feature.alias("f")).toLocalIterator()):
            f.write("," * (i > 0) + r.f)
        f.write("]}")


def markdown(df: DataFrame, title: str) -> str:
    """A metrics table as Markdown, all of its rows, fetched a partition at a time."""
    out = io.StringIO()
    out.write(f"# {title}\n\n|{'|'.join(df.columns)}|\n|{'|'.join('-' for _ in df.columns)}|\n")
    for r in df.toLocalIterator():
        out.write(f"|{'|'.join('' if v is None else str(v) for v in r)}|\n")
    return out.getvalue()


def manifest(path: str, **fields) -> None:
    """A run's facts as JSON, written whole."""
    tmp = Path(f"{path}.tmp")
    tmp.write_text(json.dumps(fields, indent=1, default=str, sort_keys=True))
    tmp.rename(path)


def sha256_file(path: str) -> str:
    import hashlib

    h = hashlib.sha256()
    with open(path, "rb") as f:
        while b := f.read(1 << 20):
            h.update(b)
    return h.hexdigest()


def freeze(paths: dict[str, str], at: str) -> None:
    Path(at).write_text(json.dumps({n: sha256_file(p) for n, p in sorted(paths.items())}, indent=1))


def verify(paths: dict[str, str], at: str) -> None:
    """Every frozen file must be there with its hash."""
    want = json.loads(Path(at).read_text())
    bad = [n for n, h in want.items() if n not in paths or not Path(paths[n]).exists() or sha256_file(paths[n]) != h]
    if bad:
        raise ValueError(f"changed or missing: {', '.join(sorted(bad))}")


def config(path: str, defaults: dict) -> dict:
    """A JSON configuration over defaults; the text 'None' means nothing."""
    given = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    none = lambda v: None if v in ("None", "none", "") else v
    return defaults | {k: none(v) for k, v in given.items()}


def credentials(names: dict[str, list[str]], env: dict) -> dict[str, bool]:
    """service -> whether all its variables are set."""
    return {s: all(bool(env.get(v)) for v in vs) for s, vs in names.items()}


def wkt(polygon):
    """Rings -> WKT text, each ring closed."""
    ring = "concat('(', array_join(transform(concat(r, slice(r, 1, 1)), p -> concat(cast(p.x as string), ' ', cast(p.y as string))), ', '), ')')"
    return F.expr(f"concat('POLYGON (', array_join(transform({polygon}, r -> {ring}), ', '), ')')")


def write_csv(df: DataFrame, path: str, polygon: str = "polygon") -> None:
    """All rows as CSV, the polygon as WKT."""
    out = df.withColumn(polygon, wkt(polygon)) if polygon in df.columns else df
    out.write.mode("overwrite").option("header", True).csv(path)


def predictor_schema(df: DataFrame, path: str, leave_out: tuple = ()) -> None:
    """A feature table's predictors and types as YAML text."""
    Path(path).write_text("predictors:\n" + "".join(f"  - name: {n}\n    type: {t}\n" for n, t in df.dtypes if n not in leave_out))
