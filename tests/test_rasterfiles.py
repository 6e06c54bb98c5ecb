"""Raster formats against writers that follow the same published layouts."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.sources import rasterfiles as R


def tiff_of(a, order="<", packed=1, predictor=1, tile=None, separate=False):
    """Bands, rows, columns as a TIFF with the given storage."""
    depth, height, width = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    th, tw = tile or (3, width)
    blocks = []
    for plane in range(depth) if separate else [slice(None)]:
        part = a[plane][None] if separate else a
        for y in range(0, height, th):
            for x in range(0, width, tw):
                b = part[:, y : y + th, x : x + tw]
                if tile:
                    b = np.pad(b, ((0, 0), (0, th - b.shape[1]), (0, tw - b.shape[2])))
                b = b.transpose(1, 2, 0)
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=b[:, :1] * 0)
                raw = np.ascontiguousarray(b).astype(a.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    rows = np.ascontiguousarray(b).astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(b.shape[0], -1, a.dtype.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    raw = np.diff(rows, axis=1, prepend=rows[:, :1] * 0).astype(np.uint8).tobytes()
                blocks.append(zlib.compress(raw) if packed == 8 else raw)
    starts = np.cumsum([8] + [len(b) for b in blocks]).tolist()
    body = b"".join(blocks)
    tags = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [a.dtype.itemsize * 8] * depth), (259, 3, [packed]), (277, 3, [depth]),
        (284, 3, [2 if separate else 1]), (317, 3, [predictor]), (339, 3, [kind] * depth),
    ]
    tags += [
        (322, 4, [tw]), (323, 4, [th]), (324, 4, starts[:-1]), (325, 4, [len(b) for b in blocks]),
    ] if tile else [(273, 4, starts[:-1]), (278, 4, [th]), (279, 4, [len(b) for b in blocks])]
    extra, entries, at = b"", [], 8 + len(body)
    for tag, code, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{'H' if code == 3 else 'I'}", *values)
        if len(raw) > 4:
            spot, extra = struct.pack(order + "I", at + len(extra)), extra + raw
        else:
            spot = raw.ljust(4, b"\0")
        entries.append(struct.pack(order + "HHI", tag, code, len(values)) + spot)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at + len(extra)) + body + extra + struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0" * 4


@pytest.mark.parametrize(
    "storage",
    [
        {}, {"order": ">"}, {"packed": 8}, {"packed": 8, "predictor": 2}, {"tile": (16, 16)},
        {"separate": True, "tile": (16, 16), "packed": 8},
    ],
)
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_tiff(storage, dtype):
    if dtype == "f4" and storage.get("predictor") == 2:
        storage = storage | {"predictor": 3}
    a = (np.random.default_rng(1).random((3, 10, 21)) * 100).astype(dtype)
    assert (R.tiff(tiff_of(a, **storage))[0] == a).all()


def test_tiff_with_its_place():
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    got, place = R.tiff(R.write_tiff(a, 86.0, 28.0, 0.5, 0.25))
    assert (got == a).all() and place == {"x": 86.0, "y": 28.0, "dx": 0.5, "dy": 0.25}


def codes_of(data):
    """LZW codes of bytes, as a plain encoder makes them."""
    table, word, out, size = {bytes([i]): i for i in range(256)}, b"", [(256, 9)], 9
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        out.append((table[word], size))
        table[word + c] = len(table) + 2
        size = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        word = c
        if len(table) + 2 >= 4094:
            out += [(table[word], size), (256, size)]
            table, word, size = {bytes([i]): i for i in range(256)}, b"", 9
    if word:
        out.append((table[word], size))
    return [*out, (257, size)]


def test_lzw_and_packbits():
    rng = np.random.default_rng(2)
    for n in (1, 300, 3000, 20_000):
        data = rng.integers(0, 7, n).astype(np.uint8).tobytes()
        bits = "".join(f"{c:0{w}b}" for c, w in codes_of(data))
        bits += "0" * (-len(bits) % 8)
        assert R.lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == data
    assert R.packbits(b"\xfe\xaa\x02\x80\x00\x2a\x80\xfd\xaa") == b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa"


def netcdf_of(records=2):
    """A file with a packed fixed variable and a record variable."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    att = lambda key, code, raw, n: name(key) + struct.pack(">ii", code, n) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    fixed = np.arange(6, dtype=">i2").reshape(2, 3)
    fixed[0, 0] = -9999
    moving = (np.arange(records * 3).reshape(records, 3) + 0.5).astype(">f4")
    attrs = struct.pack(">ii", 12, 3) + att(
        "scale_factor", 6, struct.pack(">d", 0.5), 1,
    ) + att("add_offset", 6, struct.pack(">d", 10.0), 1) + att("_FillValue", 3, struct.pack(">h", -9999), 1)
    def build(a, b):
        head = b"CDF\1" + struct.pack(">i", records) + struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("y") + struct.pack(">i", 2) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
        head += name("t2m") + struct.pack(">iii", 2, 1, 2) + attrs + struct.pack(">iii", 3, 12, a)
        return head + name("tp") + struct.pack(">iii", 2, 0, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 12, b)
    size = len(build(0, 0))
    return build(size, size + 12) + fixed.tobytes() + moving.tobytes(), fixed, moving


def test_netcdf():
    data, fixed, moving = netcdf_of()
    got = R.variables(data)
    assert np.isnan(got["t2m"][0, 0]) and got["t2m"][1, 2] == fixed[1, 2] * 0.5 + 10 and (got["tp"] == moving).all()
    assert R.netcdf(netcdf_of(0)[0])["tp"][0].shape == (0, 3)


def hdf5_of(tables, chunk=None):
    """name -> array as an HDF5 file with one old-style group; chunked ones are shuffled and deflated."""
    out = bytearray(b"\0" * 2048)

    def put(data):
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(found):
        body = b"".join(struct.pack("<HHB3x", k, -(-len(m) // 8) * 8, 0) + m.ljust(-(-len(m) // 8) * 8, b"\0") for k, m in found)
        return put(struct.pack("<BxHII4x", 1, len(found), 1, len(body)) + body)

    headers = {}
    for name, a in tables.items():
        space = struct.pack("<BBB5x", 1, a.ndim, 0) + struct.pack(f"<{a.ndim}Q", *a.shape)
        kind = struct.pack(
            "<B3BI", 0x10 | (a.dtype.kind == "f"), 0x20 if a.dtype.kind == "f" else 8 * (a.dtype.kind == "i"), 0, 0, a.dtype.itemsize,
        ) + struct.pack("<HH8x", 0, a.dtype.itemsize * 8)
        fill = struct.pack("<BxHHH", 1, 11, len(kind), 8) + b"_FillValue\0".ljust(16, b"\0") + kind.ljust(-(-len(kind) // 8) * 8, b"\0") + struct.pack("<BBB5x", 1, 0, 0) + np.array(-1, a.dtype).tobytes()
        found = [(0x01, space), (0x03, kind), (0x0C, fill)]
        if chunk:
            keys = []
            for at in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunk, strict=True)]):
                corner = [i * c for i, c in zip(at, chunk, strict=True)]
                part = a[tuple(slice(o, o + c) for o, c in zip(corner, chunk, strict=True))]
                part = np.pad(part, [(0, c - s) for c, s in zip(chunk, part.shape, strict=True)])
                raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
                keys.append((len(raw), corner, put(raw)))
            node = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(keys), 2**64 - 1, 2**64 - 1)
            node += b"".join(
                struct.pack("<II", n, 0) + struct.pack(f"<{a.ndim + 1}Q", *corner, 0) + struct.pack("<Q", at) for n, corner, at in keys
            ) + b"\0" * (8 + 8 * (a.ndim + 1))
            filters = struct.pack("<BB6x", 1, 2) + struct.pack(
                "<HHHHI4x", 2, 0, 1, 1, a.dtype.itemsize,
            ) + struct.pack("<HHHHI4x", 1, 0, 1, 1, 6)
            found += [
                (0x0B, filters),
                (
                    0x08,
                    struct.pack("<BBB", 3, 2, a.ndim + 1) + struct.pack("<Q", put(node)) + struct.pack(
                        f"<{a.ndim + 1}I", *chunk, a.dtype.itemsize,
                    ),
                ),
            ]
        else:
            found.append((0x08, struct.pack("<BBQQ", 3, 1, put(a.tobytes()), a.nbytes)))
        headers[name] = header(found)
    names, spots = b"\0" * 8, {}
    for n in sorted(headers):
        spots[n], names = len(names), names + n.encode().ljust(-(-(len(n) + 1) // 8) * 8, b"\0")
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 0, put(names)))
    nodes = put(
        b"SNOD" + struct.pack("<BxH", 1, len(headers)) + b"".join(
            struct.pack("<QQII16x", spots[n], headers[n], 0, 0) for n in sorted(headers)
        )
    )
    tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, nodes, 0))
    root = header([(0x11, struct.pack("<QQ", tree, heap))])
    top = b"\x89HDF\r\n\x1a\n" + struct.pack(
        "<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0,
    ) + struct.pack("<QQQQ", 0, 2**64 - 1, len(out), 2**64 - 1) + struct.pack("<QQII16x", 0, root, 1, 0)
    out[: len(top)] = top
    return bytes(out)


@pytest.mark.parametrize("chunk", [None, (4, 8)])
def test_hdf5(chunk):
    rng = np.random.default_rng(3)
    tables = {"precipitation": rng.random((10, 21)).astype("<f4"), "NDSI_Snow_Cover": rng.integers(0, 100, (10, 21)).astype("<i2")}
    tables["NDSI_Snow_Cover"][0, 0] = -1
    got = R.variables(hdf5_of(tables, chunk))
    assert (got["precipitation"] == tables["precipitation"]).all()
    assert np.isnan(got["NDSI_Snow_Cover"][0, 0]) and (got["NDSI_Snow_Cover"].ravel()[1:] == tables["NDSI_Snow_Cover"].ravel()[1:]).all()


def test_grids_of_all_formats(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(1, 3, 4)
    (tmp_path / "a.tif").write_bytes(R.write_tiff(a))
    (tmp_path / "b.nc").write_bytes(netcdf_of()[0])
    (tmp_path / "c.h5").write_bytes(hdf5_of({"snow": a[0]}, (2, 2)))
    t = R.grids(spark, f"file://{tmp_path}", {"value": ["none", "band1", "snow"], "t2m": ["t2m", "t"]})
    got = {(r.path.rpartition("/")[2], r.variable): r for r in t.collect()}
    assert set(got) == {("a.tif", "value"), ("b.nc", "t2m"), ("c.h5", "value")}
    assert got["a.tif", "value"]["values"] == got["c.h5", "value"]["values"] == a.ravel().tolist() and got["a.tif", "value"].dims == [3, 4]
    assert got["b.nc", "t2m"]["values"][0] is None and t.where(F.col("variable") == "t2m").count() == 1
    with pytest.raises(ValueError):
        R.variables(b"plain text")


def test_rows_leave_before_all_files_are_read(spark, tmp_path, monkeypatch):
    """A batch of files is not held whole as Python numbers."""
    for k in range(6):
        (tmp_path / f"{k}.tif").write_bytes(R.write_tiff(np.full((2, 1, 50), float(k), np.float32)))
    monkeypatch.setattr(R, "VALUES", 120)
    t = R.grids(spark, f"file://{tmp_path}")
    assert sorted((r.path[-5], r.variable, sum(r["values"])) for r in t.collect()) == [(str(k), f"band{b}", 50.0 * k) for k in range(6) for b in (1, 2)]
