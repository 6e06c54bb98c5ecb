"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG named by the payload's SHA-256 in a tar shard; rows carry digest, file,
offset and length. A range read of a PNG's header fills the metadata columns; a full read gives features.
"""

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import drop, fresh, stored, tasks_for
from tarnwatch.llm.files import Ranges, Roller

WIDTH = 576
#: Payloads whose places a task remembers, about 20 MB.
SEEN = 100_000
HEADER = 33
ENTRY = "doc_id long, digest string, file string, offset long, length long"


def payload_of(text) -> bytes:
    """UTF-8, then bytes 255 (which UTF-8 never has) up to a positive multiple of WIDTH."""
    b = text.encode("utf-8", "surrogatepass") if text is not None else b""
    return b + b"\xff" * (max(-(-len(b) // WIDTH), 1) * WIDTH - len(b))


def chunk(kind: bytes, data: bytes) -> bytes:
    import zlib

    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """WIDTH samples a row, no filter."""
    import zlib

    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + chunk(b"IEND", b"")


def header_of(data: bytes) -> tuple[int, int]:
    """(width, height) from a PNG's first HEADER bytes."""
    if data[:16] != b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">II", data[16:24])


def from_png(data: bytes) -> bytes:
    import zlib

    import numpy as np

    width, height = header_of(data)
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and a 64-bit difference hash of the samples in 65 equal runs."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    edges = np.arange(66) * len(x) // 65
    total = np.concatenate(([0], np.cumsum(x)))
    means = (total[edges[1:]] - total[edges[:-1]]) / (edges[1:] - edges[:-1])
    bits = int("".join("1" if b > a else "0" for a, b in zip(means[:-1], means[1:], strict=True)), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};dhash={bits:016x}"


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text, ...) -> stored rows of ENTRY.

    One pass without a shuffle of texts: a task remembers its last SEEN payloads and stores none of them again. Where a
    payload is stored more than once, by several tasks or beyond that memory, catalogue() keeps one of the copies and no
    row refers to the others.
    """
    import tarfile

    folder = folder or fresh(docs.sparkSession, "media")
    block = tarfile.BLOCKSIZE

    def run(batches):
        import hashlib
        from collections import OrderedDict

        import pyarrow as pa

        out, seen = Roller(folder, ".tar", shard_bytes, b"\0" * 2 * block), OrderedDict()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    png = to_png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    file, at = out.write(info.tobuf(tarfile.USTAR_FORMAT) + png + b"\0" * (-len(png) % block))
                    seen[digest] = (file, at + block, len(png))
                    if len(seen) > SEEN:
                        seen.popitem(last=False)
                rows.append((doc_id, digest, *seen[digest]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds],
                names=[x.split()[0] for x in ENTRY.split(", ")],
            )
        out.close()

    return stored(docs.select("doc_id", "text").mapInArrow(run, ENTRY), "media-rows")


def catalogue(rows: DataFrame) -> DataFrame:
    """digest -> the one place that counts: the least of its copies'."""
    at = F.min(F.struct("file", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(at).select("digest", "at.*")


def placed(places: DataFrame, cost) -> DataFrame:
    """In order of file and offset, so that a task reads few files, forwards; as many tasks as the bytes to read ask for."""
    size = places.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long")).first()[0]
    return places.repartitionByRange(tasks_for(places.sparkSession, size), "file", "offset").sortWithinPartitions("file", "offset")


def metadata(places: DataFrame) -> DataFrame:
    """places with width and height: a read of HEADER bytes a payload, and of nothing else."""
    own = places.schema.fields

    def run(batches):
        import pyarrow as pa

        source = Ranges()
        for b in batches:
            rows = b.to_pylist()
            heads = [header_of(source.read(r["file"], r["offset"], HEADER)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array([h[k] for h in heads], pa.int64()) for k in (0, 1))],
                names=[f.name for f in own] + ["width", "height"],
            )
        source.close()

    # a read of a header costs about what 4 KiB of payload do
    return placed(places, F.lit(4096)).mapInArrow(run, T.StructType([*own, *T.StructType.fromDDL("width long, height long").fields]))


FEATURES = "n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(places: DataFrame) -> DataFrame:
    """places with metadata() and with what their payloads, read back whole, give.

    The payload's SHA-256 is checked against the digest, so that is the digest read back, too; its size against width and
    height.
    """
    own, made = places.schema.fields, [x.split() for x in FEATURES.split(", ")]

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        source = Ranges()
        for b in batches:
            out = []
            for r in b.to_pylist():
                media = source.read(r["file"], r["offset"], r["length"])
                payload = from_png(media)
                if len(payload) != r["width"] * r["height"] or hashlib.sha256(payload).hexdigest() != r["digest"]:
                    raise ValueError(f"damaged payload {r['digest']}")
                out.append(
                    (
                        len(payload.rstrip(b"\xff")), len(payload), zlib.crc32(payload[-32:]), len(media),
                        hashlib.sha256(media).hexdigest(), feature_of(payload),
                    )
                )
            columns = list(zip(*out, strict=True)) if out else [[]] * len(made)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, made, strict=True))],
                names=[f.name for f in own] + [n for n, _ in made],
            )
        source.close()

    return placed(places, F.col("length")).mapInArrow(run, T.StructType([*own, *T.StructType.fromDDL(FEATURES).fields]))


def media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, digest (of the payload), file, offset, length, metadata() and features().

    Two passes over the stored bytes: headers fill width and height, then whole reads give features. Each input row gives one row; rows of equal texts have equal values. A null text is an empty one, whose payload
    is WIDTH bytes 255.
    """
    rows = store(docs, folder)
    places = stored(catalogue(rows), "media-places")
    headed = stored(metadata(places), "media-headers")
    known = stored(features(headed), "media-known")
    drop(places)
    drop(headed)
    return rows.select("doc_id", "digest").join(known, "digest")
