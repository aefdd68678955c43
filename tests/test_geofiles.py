import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from tidelog.sources.daily import area_features, find_area_source
from tidelog.sources.geojson import polygon_pieces
from tidelog.sources.geopackage import shape
from tidelog.sources.raster import geotiff_pixels


def tiff(z, order="<", compression=1, predictor=1, rows=3, tile=None, nodata=None):
    """A small raster file, written tag by tag."""
    kind = z.dtype.newbyteorder(order)
    height, width = z.shape
    if tile:
        blocks = [np.pad(z[r : r + tile, c : c + tile], ((0, max(0, r + tile - height)), (0, max(0, c + tile - width)))) for r in range(0, height, tile) for c in range(0, width, tile)]
    else:
        blocks = [z[r : r + rows] for r in range(0, height, rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), b.dtype)) for b in blocks]
    data = [b.astype(kind).tobytes() for b in blocks]
    data = [zlib.compress(b) if compression == 8 else b for b in data]
    at = [8 + sum(map(len, data[:k])) for k in range(len(data))]
    n = [len(b) for b in data]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [z.dtype.itemsize * 8]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[z.dtype.kind]]), (33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", at), (325, "I", n)] if tile else [(273, "I", at), (278, "I", [rows]), (279, "I", n)]
    tags += [(42113, "s", str(nodata).encode() + b"\0")] if nodata is not None else []
    tags.sort()
    body, entries, more = b"".join(data), b"", b""
    where = 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, letter, values in tags:
        raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        code = {"s": 2, "H": 3, "I": 4, "d": 12}[letter]
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", where + len(more))
        more += b"" if len(raw) <= 4 else raw
        entries += struct.pack(f"{order}HHI", tag, code, len(values)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8 + len(body)) + body + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4 + more


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"compression": 8, "predictor": 2}, {"tile": 4, "compression": 8}])
def test_pixels(spark, tmp_path, how):
    z = np.arange(-30, 40, dtype=np.int16).reshape(10, 7) * 3
    path = tmp_path / "z.tif"
    path.write_bytes(tiff(z, nodata=-90, **how))
    got = {(r["lat"], r["lon"]): r["elevation"] for r in geotiff_pixels(spark, str(path)).collect()}
    want = {(50.0 - (i + 0.5) * 0.25, 10.0 + (j + 0.5) * 0.5): float(z[i, j]) for i in range(10) for j in range(7)}
    assert got.keys() == want.keys() and np.isnan(got[49.875, 10.25])
    assert all(got[k] == v for k, v in want.items() if v != -90)


def test_pixels_of_real_numbers(spark, tmp_path):
    z = np.linspace(-1, 1, 12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "z.tif").write_bytes(tiff(z, rows=1))
    pixels = geotiff_pixels(spark, f"file://{tmp_path}/z.tif")
    assert pixels.rdd.getNumPartitions() == 3 and abs(pixels.agg({"elevation": "max"}).first()[0] - 1.0) < 1e-6
    (tmp_path / "bad.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff_pixels(spark, str(tmp_path / "bad.tif")).collect()


def binary(rings, order="<", flag=1, z=False):
    out = bytes([order == "<"]) + struct.pack(f"{order}II", 3 + 1000 * z, len(rings))
    for r in rings:
        out += struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + z}d", *p, *([7.0] if z else [])) for p in r)
    return out


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]


def test_shapes():
    head = b"GP" + bytes([0, 1]) + struct.pack("<i", 4326)
    assert shape(head + binary([SQUARE])) == {"type": "Polygon", "coordinates": [SQUARE]} == shape(head + binary([SQUARE], ">", z=True))
    with_box = b"GP" + bytes([0, 3]) + struct.pack("<i4d", 4326, 0, 4, 0, 4)
    two = bytes([1]) + struct.pack("<II", 6, 2) + binary([SQUARE]) + binary([SQUARE, SQUARE])
    assert shape(with_box + two) == {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE, SQUARE]]}
    assert shape(None) is None and shape(head + bytes([1]) + struct.pack("<I2d", 1, 0, 0)) is None


def test_layers(spark, tmp_path):
    path = tmp_path / "areas.gpkg"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    c.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, geom BLOB, NAME TEXT, n INTEGER)")
    c.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom')")
    head = b"GP" + bytes([0, 1]) + struct.pack("<i", 4326)
    c.executemany("INSERT INTO zones VALUES (?, ?, ?, ?)", [(k, head + binary([SQUARE]) if k % 2 else None, f"zone {k}", None) for k in range(1, 1_202)])
    c.commit()
    c.close()
    (tmp_path / "other.geojson").write_text(json.dumps({"features": []}))
    assert find_area_source(str(tmp_path)) == path
    for where in (str(path), f"file://{path}"):
        f = area_features(spark, where)
        assert f.rdd.getNumPartitions() == 3 and f.count() == 1_201 and f.where("area_id = '7'").first()["properties"] == {"fid": "7", "NAME": "zone 7"}
        assert polygon_pieces(f).count() == 601 and polygon_pieces(f).first()["max_lat"] == 4.0
    with pytest.raises(Exception, match="no layer"):
        area_features(spark, str(path), "none").collect()
