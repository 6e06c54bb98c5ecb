"""WARC archives with an index first.

Tasks write archives (a gzip member a record) and return an index row a record: file, offset, length, URL, digest.
Reading goes by the index alone: the selected records' byte ranges are sorted and coalesced, and each range is one
read. Of records with equal payloads one is a response, the others revisits that name it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm.common import fresh, small, stored, tasks_for
from tarnwatch.llm.files import Ranges, Roller

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
MASK = (1 << 64) - 1


def name_of(page_id, copy: int = 0) -> str:
    """The record's URN: a page_id in its low 64 bits, a null as the next bit, and above it the copy's number, 0 for the row
    that revisits refer to; so that rows which repeat a page_id have names of their own."""
    import uuid

    return f"urn:uuid:{uuid.UUID(int=copy << 65 | (1 << 64 if page_id is None else int(page_id) & MASK))}"


def id_of(name: str):
    import uuid

    n = uuid.UUID(name).int
    low = n & MASK
    return None if n >> 64 & 1 else low - (1 << 64 if low >> 63 else 0)


def sha1_base32(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, revisit: bool, copy: int = 0) -> tuple[bytes, str]:
    """-> (the record as a gzip member, payload digest)"""
    import zlib
    from urllib.parse import quote

    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name_of(page_id, copy)}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name_of(*refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush(), digest


def parsed(member: bytes) -> dict:
    """A record's fields and payload (None for a revisit); digests are checked."""
    import zlib

    head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and (
        len(payload) != size or sha1_base32(payload) != digest
    ):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = id_of(fields["WARC-Refers-To"].strip("<>")) if revisit else None
    return {
        "page_id": id_of(fields["WARC-Record-ID"].strip("<>")), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers, "payload": None if revisit else payload,
    }


def named(pages: DataFrame) -> DataFrame:
    """pages plus copy: 0 for one row of each page_id, another number for each further row of it.

    Rows of repeated page_ids are written with their numbers before these are used: numbers made anew in each pass over the
    input would differ where rows arrive in another order.
    """
    many = pages.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("of"), F.lit(True).alias("repeated"))
    many = small(stored(many, "warc-repeated"))
    p = pages.join(many, F.col("page_id").eqNullSafe(F.col("of")), "left")
    again = stored(p.where("repeated").select(*pages.columns, F.monotonically_increasing_id().alias("row")), "warc-rows")
    lead = small(stored(again.groupBy(F.col("page_id").alias("of")).agg(F.min("row").alias("lead")), "warc-leads"))
    again = again.join(lead, F.col("page_id").eqNullSafe(F.col("of")))
    copy = F.when(F.col("row") != F.col("lead"), F.col("row") + 1).otherwise(F.lit(0)).cast("long")
    once = p.where("repeated is null").select(*pages.columns, F.lit(0).cast("long").alias("copy"))
    return once.unionByName(again.select(*pages.columns, copy.alias("copy")))


def write(pages: DataFrame, folder: str | None = None, least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """pages (page_id, url, html, ...) -> the stored index, a row a record.

    Of pages with equal payloads of at least `least` bytes those with the largest page_id are responses (repeated
    rows of it all are), the others revisit it; a null page_id counts as the smallest, and if all are null all are
    responses. Rows that repeat a page_id have record names of their own, and a revisit names the row that has its payload. Only digests and ids are shuffled to find that
    out, never pages, unless those that repeat are more than small() takes. A retried task leaves a file that no index row
    names.
    """
    folder = folder or fresh(pages.sparkSession, "warc")
    p = named(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")))
    key = F.sha1(F.col("html").cast("binary"))
    row = F.struct("page_id", (-F.col("copy")).alias("less"))
    again = p.where(F.octet_length("html") >= least).select(row.alias("row"), key.alias("k")).groupBy("k").agg(
        F.max("row").alias("top"), F.count("*").alias("many"),
    )
    again = again.where("many > 1").select("k", F.col("top.page_id").alias("first"), (-F.col("top.less")).alias("first_copy"))
    again = small(stored(again, "warc-again"))
    p = p.withColumn("k", key).join(again, "k", "left").withColumn(
        "revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)),
    )

    def run(batches):
        import pyarrow as pa

        out = Roller(folder, ".warc.gz", file_bytes)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                data, digest = record(
                    r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), (r["first"], r["first_copy"]), r["revisit"], r["copy"],
                )
                file, offset = out.write(data)
                rows.append((file, offset, len(data), r["url"], digest, r["page_id"], "revisit" if r["revisit"] else "response"))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds],
                names=[x.split()[0] for x in INDEX.split(", ")],
            )
        out.close()

    return stored(p.select("page_id", "url", "html", "first", "first_copy", "revisit", "copy").mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = 64 << 10, most: int = 1 << 20) -> DataFrame:
    """The selected records -> (file, start, stop, parts): neighbours at most `gap` bytes apart share a read of about `most`.

    Windows are by file, whose size write() bounds.
    """
    by = W.partitionBy("file").orderBy("offset")
    prior = F.lag(F.col("offset") + F.col("length")).over(by)
    i = index.select("file", "offset", "length", F.coalesce((F.col("offset") - prior > gap).cast("int"), F.lit(1)).alias("new"))
    i = i.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("piece", F.floor(F.col("offset") / most))
    part = F.struct("offset", "length")
    return i.groupBy("file", "run", "piece").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(part)).alias("parts"),
    )


def read(index: DataFrame, where: Column | None = None, payloads: bool = True) -> DataFrame:
    """The records that the index rows (those that `where` selects) name, fetched by coalesced ranges, in as many tasks as
    their bytes ask for."""
    chosen = index if where is None else index.where(where)
    size = chosen.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    wanted = stored(ranges(chosen), "warc-ranges").repartitionByRange(
        tasks_for(index.sparkSession, size, 1 << 20), "file", "start",
    ).sortWithinPartitions("file", "start")

    def run(batches):
        import pyarrow as pa

        from_file = Ranges()
        for b in batches:
            for r in b.to_pylist():
                data = from_file.read(r["file"], r["start"], r["stop"] - r["start"])
                got = [parsed(data[x["offset"] - r["start"] :][: x["length"]]) for x in r["parts"]]
                fields = [
                    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if n == "payload" and not payloads else x[n] for x in got], t) for n, t in fields],
                    names=[n for n, _ in fields],
                )
        from_file.close()

    return wanted.mapInArrow(run, RECORD)
