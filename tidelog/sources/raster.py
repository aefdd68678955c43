"""Pixels of one-band GeoTIFF rasters as rows, read in parallel without a library: a partition per block of the file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from tidelog.sources.daily import opened

PIXELS = "lat double, lon double, elevation double"
# Tags, types (code: size and letter), sample kinds and compressions of the format.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 278: "rows", 277: "samples", 279: "strip_bytes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_bytes", 339: "kind", 33550: "scale", 33922: "tie", 42113: "nodata"}
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATE = 1, (8, 32946)


def header(f) -> dict:
    """The tags of the first image, and the byte order; small TIFF and BigTIFF."""
    f.seek(0)
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    f.seek(at)
    n = struct.unpack(f"{order}Q", f.read(8))[0] if big else struct.unpack(f"{order}H", f.read(2))[0]
    size, room = (20, 8) if big else (12, 4)
    entries, out = f.read(n * size), {"order": order}
    for k in range(n):
        e = entries[k * size : (k + 1) * size]
        tag, kind = struct.unpack(f"{order}HH", e[:4])
        count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : 4 + room])[0]
        if tag not in TAGS or kind not in TYPES:
            continue
        width, letter = TYPES[kind]
        data = e[4 + room :][: width * count]
        if width * count > room:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 + room :])[0])
            data = f.read(width * count)
        out[TAGS[tag]] = data.split(b"\0")[0].decode() if letter == "s" else struct.unpack(f"{order}{count}{letter}", data)
    if out.get("samples", (1,))[0] != 1:
        raise ValueError("only rasters of one band can be read")
    if out.get("compression", (PLAIN,))[0] not in (PLAIN, *DEFLATE) or out.get("predictor", (1,))[0] not in (1, 2):
        raise ValueError("only plain and deflated rasters, with or without differences along rows, can be read")
    if "scale" not in out or "tie" not in out:
        raise ValueError("the raster has no scale and tie point")
    return out


class Block(InputPartition):
    def __init__(self, offset: int, size: int, row: int, column: int, width: int, height: int) -> None:
        self.offset, self.size, self.row, self.column, self.width, self.height = offset, size, row, column, width, height


class RasterReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Block]:
        with opened(self.path) as f:
            h = header(f)
        width, height = h["width"][0], h["height"][0]
        if "tiles" in h:
            w, r = h["tile_width"][0], h["tile_height"][0]
            across = -(-width // w)
            return [Block(o, n, k // across * r, k % across * w, w, r) for k, (o, n) in enumerate(zip(h["tiles"], h["tile_bytes"], strict=True))]
        r = min(h.get("rows", (height,))[0], height)
        return [Block(o, n, k * r, 0, width, min(r, height - k * r)) for k, (o, n) in enumerate(zip(h["strips"], h["strip_bytes"], strict=True))]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            h = header(f)
            f.seek(block.offset)
            data = f.read(block.size)
        if h.get("compression", (PLAIN,))[0] in DEFLATE:
            data = zlib.decompress(data)
        kind = np.dtype(f"{h['order']}{KINDS[h.get('kind', (1,))[0]]}{h['bits'][0] // 8}")
        z = np.frombuffer(data, kind, block.width * block.height).reshape(block.height, block.width)
        if h.get("predictor", (1,))[0] == 2:
            z = np.cumsum(z, axis=1, dtype=kind.newbyteorder("="))
        value = z.astype(np.float64)
        if "nodata" in h:
            value = np.where(value == float(h["nodata"]), np.nan, value)
        rows, columns = min(block.height, h["height"][0] - block.row), min(block.width, h["width"][0] - block.column)
        i, j, _, x, y, _ = h["tie"][:6]
        lon = x + (block.column + np.arange(columns) - i + 0.5) * h["scale"][0]
        lat = y - (block.row + np.arange(rows) - j + 0.5) * h["scale"][1]
        for k in range(0, rows, step := max(1, 1_000_000 // max(columns, 1))):
            part = value[k : min(k + step, rows), :columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lat[k : k + step], columns)), pa.array(np.tile(lon, len(part))), pa.array(np.ascontiguousarray(part).ravel())], names=["lat", "lon", "elevation"])


class RasterSource(DataSource):
    """spark.read.format("geotiff").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"])


def geotiff_pixels(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon (of the centre, in the units of the raster) and elevation (NaN: no data) of every pixel."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("geotiff").load(path)
