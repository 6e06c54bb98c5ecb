"""Raster files as tables: GeoTIFF, classic NetCDF and HDF5 (so NetCDF-4), decoded by tasks from their published layouts.

Files come through Spark's binary source, so they may lie wherever Spark reads; a file is decoded in one task.
"""

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

GRID = "path string, variable string, dims array<int>, values array<double>"

# Fixed values of the formats.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_PACKED, TIFF_OFFSETS, TIFF_BANDS, TIFF_ROWS, TIFF_COUNTS, TIFF_PLANES, TIFF_PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, TIFF_KIND, PIXEL_SCALE, TIE_POINT = 322, 323, 324, 325, 339, 33550, 33922
CDF_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, 9 to 12 bits, 256 clears and 257 ends."""
    out, table, bits, size, at, last = [], [], 0, 9, 0, None
    value = int.from_bytes(data, "big")
    total = 8 * len(data)
    while at + size <= total:
        code = value >> (total - at - size) & ((1 << size) - 1)
        at += size
        if code == 257:
            break
        if code == 256:
            table, size, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            # the width grows one code early
            size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(word)
        last = word
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32773: packbits, 32946: zlib.decompress}


def tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """(bands, rows, columns) and, where the file says them, origin and pixel size in x and y."""
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at += 8 if big else 2
    tags, entry, inline = {}, 20 if big else 12, 8 if big else 4
    for _ in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at)
        code = TIFF_TYPES.get(kind, "B")
        size = struct.calcsize("=" + code) * count
        spot = at + entry - inline
        if size > inline:
            (spot,) = struct.unpack_from(order + ("Q" if big else "I"), data, spot)
        tags[tag] = data[spot : spot + size] if code == "s" else struct.unpack_from(f"{order}{len(code) * count}{code[0]}", data, spot)
        at += entry
    one = lambda t, default=None: tags[t][0] if t in tags else default
    width, height, bands = one(TIFF_WIDTH), one(TIFF_HEIGHT), one(TIFF_BANDS, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(TIFF_KIND, 1)]
    dtype = np.dtype(f"{order}{kind}{one(TIFF_BITS, 8) // 8}")
    separate, predictor, unpack = one(TIFF_PLANES, 1) == 2, one(TIFF_PREDICTOR, 1), UNPACK[one(TIFF_PACKED, 1)]
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(TIFF_ROWS, height), height))
    starts, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[TIFF_OFFSETS], tags[TIFF_COUNTS])
    out = np.zeros((bands, height, width), dtype.newbyteorder("="))
    per = -(-width // across) * -(-height // down)
    depth = 1 if separate else bands
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, k = (k // per, k % per) if separate else (0, k)
        y, x = k // -(-width // across) * down, k % -(-width // across) * across
        rows = down if tiled else min(down, height - y)
        raw = unpack(data[start : start + size])
        if predictor == 3:
            # bytes of a row lie by significance, each the difference to the one before
            b = np.frombuffer(raw, np.uint8)[: rows * across * depth * dtype.itemsize].reshape(rows, -1, depth)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, across * depth)
            block = np.ascontiguousarray(b.transpose(0, 2, 1)).view(f">{kind}{dtype.itemsize}").reshape(rows, across, depth)
        else:
            block = np.frombuffer(raw, dtype)[: rows * across * depth].reshape(rows, across, depth)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        h, w = min(rows, height - y), min(across, width - x)
        out[plane : plane + depth, y : y + h, x : x + w] = block[:h, :w].transpose(2, 0, 1)
    place = {}
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        place = {"x": tags[TIE_POINT][3], "y": tags[TIE_POINT][4], "dx": tags[PIXEL_SCALE][0], "dy": tags[PIXEL_SCALE][1]}
    return out, place


def write_tiff(bands: np.ndarray, x: float = 0.0, y: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> bytes:
    """A deflated TIFF of floats in one strip, pixels of all bands side by side."""
    depth, height, width = bands.shape
    body = zlib.compress(np.ascontiguousarray(bands.transpose(1, 2, 0), "<f4").tobytes())
    extra, at, entries = b"", 8 + len(body), []
    for tag, kind, values in sorted([
        (TIFF_WIDTH, 4, [width]), (TIFF_HEIGHT, 4, [height]), (TIFF_BITS, 3, [32] * depth), (TIFF_PACKED, 3, [8]), (262, 3, [1]),
        (TIFF_OFFSETS, 4, [8]), (TIFF_BANDS, 3, [depth]), (TIFF_ROWS, 4, [height]),
        (TIFF_COUNTS, 4, [len(body)]), (TIFF_PLANES, 3, [1]), (TIFF_KIND, 3, [3] * depth), (PIXEL_SCALE, 12, [dx, dy, 0.0]),
        (TIE_POINT, 12, [0.0, 0.0, 0.0, x, y, 0.0]),
    ]):
        raw = struct.pack(f"<{len(values)}{TIFF_TYPES[kind]}", *values)
        if len(raw) > 4:
            spot, extra = struct.pack("<I", at + len(extra)), extra + raw
        else:
            spot = raw.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + spot)
    return b"II*\0" + struct.pack("<I", at + len(extra)) + body + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4


def scaled(values: np.ndarray, attributes: dict) -> np.ndarray:
    """Packed values as numbers: fill values become NaN, then scale and offset."""
    out = values.astype(float)
    for name in ("_FillValue", "missing_value"):
        if name in attributes:
            out[values == np.ravel(attributes[name])[0]] = np.nan
    scale, offset = (float(np.ravel(attributes.get(n, d))[0]) for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return out * scale + offset


def netcdf(data: bytes) -> dict:
    """Classic NetCDF (also with 64-bit offsets): variable -> (array, attributes)."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    version, at = data[3], 4
    wide = version == 5

    def number(long=wide):
        nonlocal at
        (v,) = struct.unpack_from(">q" if long else ">i", data, at)
        at += 8 if long else 4
        return v

    def name():
        nonlocal at
        n = number()
        text = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return text

    def listed(read):
        number(False)
        return [read() for _ in range(number())]

    def attribute():
        nonlocal at
        key, kind, n = name(), number(False), number()
        dtype = np.dtype(CDF_TYPES[kind])
        raw = data[at : at + n * dtype.itemsize]
        at += -(-n * dtype.itemsize // 4) * 4
        return key, raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype)

    records = number()
    dims = listed(lambda: (name(), number()))
    listed(attribute)

    def variable():
        key = name()
        axes = [number() for _ in range(number())]
        own = dict(listed(attribute))
        return key, axes, own, number(False), number(), number(version > 1)

    found = listed(variable)
    recorded = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    step, out = sum(v[4] for v in recorded), {}
    if len(recorded) == 1:  # a lone record variable is not padded
        _, axes, _, kind, _, _ = recorded[0]
        step = int(np.prod([dims[a][1] for a in axes[1:]], dtype=int)) * np.dtype(CDF_TYPES[kind]).itemsize
    for key, axes, own, kind, _, begin in found:
        dtype, shape = np.dtype(CDF_TYPES[kind]), [dims[a][1] for a in axes]
        if axes and shape[0] == 0:
            n = int(np.prod(shape[1:], dtype=int))
            rows = [np.frombuffer(data, dtype, n, begin + k * step) for k in range(records)]
            value = np.array(rows).reshape([records, *shape[1:]]) if rows else np.zeros([0, *shape[1:]], dtype)
        else:
            value = np.frombuffer(data, dtype, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        out[key] = (value, own)
    return out


class Hdf5:
    """Datasets of an HDF5 file: old and new object headers, compact, contiguous and chunked storage, deflate and shuffle."""

    def __init__(self, data: bytes):
        at = next((k for k in (0, 512, 1024, 2048) if data[k : k + 8] == b"\x89HDF\r\n\x1a\n"), None)
        if at is None:
            raise ValueError("not an HDF5 file")
        self.data, version = data, data[at + 8]
        if version < 2:
            self.base, root = struct.unpack_from(
                "<Q", data, at + 24 + 4 * (version == 1),
            )[0], struct.unpack_from("<Q", data, at + 64 + 4 * (version == 1))[0]
        else:
            self.base, root = struct.unpack_from("<Q", data, at + 12)[0], struct.unpack_from("<Q", data, at + 36)[0]
        self.datasets = {}
        self.walk(root, "")

    def unpack(self, form, at):
        return struct.unpack_from("<" + form, self.data, at)

    def messages(self, at):
        """(type, bytes) of an object's header and its continuations."""
        d, at = self.data, at + self.base
        if d[at : at + 4] == b"OHDR":
            flags = d[at + 5]
            spot = at + 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            size = int.from_bytes(d[spot : spot + width], "little")
            blocks, head, more = [(spot + width, size)], 4 + 2 * bool(flags & 4), True
        else:
            (size,) = self.unpack("I", at + 8)
            blocks, head, more = [(at + 16, size)], 8, False
        while blocks:
            start, size = blocks.pop(0)
            end = start + size
            while start + head <= end:
                kind, length = (d[start], self.unpack("H", start + 1)[0]) if more else self.unpack("HH", start)
                body = d[start + head : start + head + length]
                start += head + length
                if kind == 0x10:
                    offset, length = struct.unpack_from("<QQ", body)
                    offset += self.base
                    blocks.append((offset + 4, length - 8) if more else (offset, length))
                else:
                    yield kind, body

    def walk(self, at, path):
        found = list(self.messages(at))
        kinds = {k for k, _ in found}
        if 0x08 in kinds:
            self.datasets[path] = found
        for kind, body in found:
            if kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", body)
                (names,) = self.unpack("Q", heap + self.base + 24)
                for name, header in self.symbols(tree, names + self.base):
                    self.walk(header, f"{path}/{name}".lstrip("/"))
            elif kind == 0x06:
                flags, spot = body[1], 2
                if flags & 8 and body[spot]:
                    continue  # a soft or external link
                spot += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 0x10)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[spot : spot + width], "little")
                spot += width
                self.walk(struct.unpack_from("<Q", body, spot + n)[0], f"{path}/{body[spot : spot + n].decode()}".lstrip("/"))
            elif kind == 0x02 and struct.unpack_from("<Q", body, 2 + 8 * bool(body[1] & 1))[0] != 2**64 - 1:
                raise ValueError("groups with dense links are not read")

    def symbols(self, at, names):
        at += self.base
        if self.data[at : at + 4] == b"TREE":
            (used,) = self.unpack("H", at + 6)
            for k in range(used):
                yield from self.symbols(self.unpack("Q", at + 32 + 16 * k)[0], names)
        else:
            for k in range(self.unpack("H", at + 6)[0]):
                offset, header = self.unpack("QQ", at + 8 + 40 * k)
                end = self.data.index(b"\0", names + offset)
                yield self.data[names + offset : end].decode(), header

    @staticmethod
    def dtype(body) -> np.dtype:
        kind, size = body[0] & 15, struct.unpack_from("<I", body, 4)[0]
        order = ">" if body[1] & 1 else "<"
        if kind == 0:
            return np.dtype(f"{order}{'i' if body[1] & 8 else 'u'}{size}")
        if kind == 1:
            return np.dtype(f"{order}f{size}")
        return np.dtype(f"S{size}" if kind == 3 else f"V{size}")

    @staticmethod
    def shape(body) -> list:
        return list(struct.unpack_from(f"<{body[1]}Q", body, 8 if body[0] == 1 else 4))

    @staticmethod
    def filters(body) -> list:
        out, at, old = [], 8 if body[0] == 1 else 2, body[0] == 1
        for _ in range(body[1]):
            (ident,) = struct.unpack_from("<H", body, at)
            named = old or ident >= 256
            n = struct.unpack_from("<H", body, at + 2)[0] if named else 0
            at += 4 if named else 2
            values = struct.unpack_from("<H", body, at + 2)[0]
            at += 4 + (-(-n // 8) * 8 if old else n)
            out.append(ident)
            at += 4 * values + 4 * (old and values % 2)
        return out

    def chunks(self, at, rank):
        """(bytes, offsets, filter mask) of all chunks below a tree's node."""
        at += self.base
        level, (used,) = self.data[at + 5], self.unpack("H", at + 6)
        key = 8 + 8 * (rank + 1)
        for k in range(used):
            spot = at + 24 + k * (key + 8)
            size, mask = self.unpack("II", spot)
            (child,) = self.unpack("Q", spot + key)
            if level:
                yield from self.chunks(child, rank)
            else:
                yield self.data[child + self.base : child + self.base + size], self.unpack(f"{rank}Q", spot + 8), mask

    def attributes(self, name) -> dict:
        """Numbers that a dataset's attributes hold."""
        out = {}
        for kind, b in self.datasets[name]:
            if kind != 0x0C:
                continue
            n, t, s = struct.unpack_from("<HHH", b, 2)
            pad = (lambda v: -(-v // 8) * 8) if b[0] == 1 else (lambda v: v)
            at = 8 + (b[0] == 3)
            key, body = b[at : at + n].split(b"\0")[0].decode(), b[at + pad(n) :]
            dtype, shape = self.dtype(body[:t]), self.shape(body[pad(t) : pad(t) + s])
            if dtype.kind in "iuf":
                out[key] = np.frombuffer(body, dtype, int(np.prod(shape, dtype=int)), pad(t) + pad(s))
        return out

    def read(self, name) -> np.ndarray:
        found = dict(self.datasets[name][::-1])
        dtype, shape, layout = self.dtype(found[0x03]), self.shape(found[0x01]), found[0x08]
        if layout[0] != 3:
            raise ValueError(f"storage layout {layout[0]} is not read")
        n = int(np.prod(shape, dtype=int))
        if layout[1] == 0:
            return np.frombuffer(layout, dtype, n, 4).reshape(shape)
        if layout[1] == 1:
            (at,) = struct.unpack_from("<Q", layout, 2)
            return np.zeros(shape, dtype) if at == 2**64 - 1 else np.frombuffer(self.data, dtype, n, at + self.base).reshape(shape)
        rank, (tree,) = layout[2] - 1, struct.unpack_from("<Q", layout, 3)
        block = struct.unpack_from(f"<{rank}I", layout, 11)
        steps, out = self.filters(found[0x0B]) if 0x0B in found else [], np.zeros(shape, dtype)
        for raw, offsets, mask in self.chunks(tree, rank) if tree != 2**64 - 1 else ():
            for i in range(len(steps) - 1, -1, -1):
                if mask >> i & 1:
                    continue
                if steps[i] == 1:
                    raw = zlib.decompress(raw)
                elif steps[i] == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T.tobytes()
                elif steps[i] == 3:
                    raw = raw[:-4]  # a checksum
                else:
                    raise ValueError(f"filter {steps[i]} is not read")
            part = np.frombuffer(raw, dtype).reshape(block)
            inside = tuple(slice(0, min(b, s - o)) for b, s, o in zip(block, shape, offsets, strict=True))
            out[tuple(slice(o, o + w.stop) for o, w in zip(offsets, inside, strict=True))] = part[inside]
        return out


def variables(data: bytes) -> dict:
    """variable -> numbers (scaled, fill values NaN) of a file of any of the formats; a TIFF's bands are band1, band2, ..."""
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return {f"band{k + 1}": b.astype(float) for k, b in enumerate(tiff(data)[0])}
    if data[:3] == b"CDF":
        return {n: scaled(v, a) for n, (v, a) in netcdf(data).items() if v.dtype.kind in "iuf"}
    h = Hdf5(data)
    return {n: scaled(v, h.attributes(n)) for n in h.datasets if (v := h.read(n)).dtype.kind in "iuf"}


VALUES = 2**18  # values that a task holds as Python numbers before it passes them on


def grids(spark: SparkSession, path: str, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of GRID, one a file and variable; wanted: a name and the candidates of which the first that a file has is read
    (a path's last part counts, too). NaN comes as NULL. A file without a wanted variable gives no row for it. Rows leave the task
    after VALUES values, whatever the number of files in a batch."""
    from tarnwatch.sources.remote import first_existing

    names = ["path", "variable", "dims", "values"]

    def run(batches):
        import pandas as pd

        for t in batches:
            rows, held = [], 0
            for at, data in zip(t["path"], t["content"], strict=True):
                have = variables(bytes(data))
                short = {n.rpartition("/")[2]: n for n in have} | {n: n for n in have}
                picked = {n: n for n in have} if wanted is None else {
                    n: short[c] for n, cs in wanted.items() if (c := first_existing(short, cs))
                }
                for name, of in picked.items():
                    v = have[of]
                    rows.append((at, name, list(v.shape), [None if x != x else x for x in v.ravel().tolist()]))
                    held += v.size
                    if held >= VALUES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, GRID)
