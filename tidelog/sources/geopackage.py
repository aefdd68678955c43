"""Polygon layers of GeoPackage files as rows: SQLite tables whose shapes are well-known binary."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from tidelog.sources.daily import opened

FEATURES = "area_id string, properties map<string, string>, geometry string"
ROWS = 500
# Bytes of the envelope by its kind; kinds of shapes.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POLYGON, MULTIPOLYGON = 3, 6


def connected(path: str) -> sqlite3.Connection:
    """The file, read-only: in place if it is local, else from memory."""
    if "://" not in path and not path.startswith("file:"):
        return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    c = sqlite3.connect(":memory:")
    with opened(path) as f:
        c.deserialize(f.read())
    return c


def shape(blob: bytes | None) -> dict | None:
    """The GeoJSON geometry of a GeoPackage blob; None for other shapes than polygons, and for none."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + ENVELOPES.get(blob[3] >> 1 & 7, 0)

    def unsigned(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", blob, at - 4)[0]

    def polygon() -> list | None:
        nonlocal at
        order, at = "<" if blob[at] else ">", at + 1
        code = unsigned(order)
        dimensions = 2 + bool(code & 0x80000000 or code // 1000 in (1, 3)) + bool(code & 0x40000000 or code // 1000 in (2, 3))
        kind = (code & 0xFFFF) % 1000
        if kind == MULTIPOLYGON:
            return [polygon() for _ in range(unsigned(order))]
        if kind != POLYGON:
            return None
        rings = []
        for _ in range(unsigned(order)):
            n = unsigned(order)
            flat = struct.unpack_from(f"{order}{n * dimensions}d", blob, at)
            at += 8 * n * dimensions
            rings.append([list(flat[k : k + 2]) for k in range(0, len(flat), dimensions)])
        return rings

    first = struct.unpack_from(f"{'<' if blob[at] else '>'}I", blob, at + 1)[0]
    parts = polygon()
    if parts is None:
        return None
    return {"type": "MultiPolygon" if (first & 0xFFFF) % 1000 == MULTIPOLYGON else "Polygon", "coordinates": parts}


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class LayerReader(DataSourceReader):
    def __init__(self, path: str, layer: str | None) -> None:
        self.path, self.layer = path, layer

    def table(self, c: sqlite3.Connection) -> tuple[str, str]:
        """The layer (the first one if none is named) and its column of shapes."""
        found = c.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        for name, column in found:
            if self.layer in (None, name):
                return name.replace('"', '""'), column
        raise ValueError(f"{self.path} has no layer {self.layer or 'of shapes'}; there are {[n for n, _ in found]}")

    def partitions(self) -> list[Rows]:
        c = connected(self.path)
        name, _ = self.table(c)
        low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
        c.close()
        if low is None:
            raise ValueError(f"{self.path} has no features")
        return [Rows(k, min(k + ROWS, high + 1)) for k in range(low, high + 1, ROWS)]

    def read(self, rows: Rows) -> Iterator[tuple]:
        c = connected(self.path)
        name, column = self.table(c)
        found = c.execute(f'SELECT rowid, * FROM "{name}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (rows.first, rows.last))
        names = [d[0] for d in found.description][1:]
        for number, *values in found:
            v = dict(zip(names, values, strict=True))
            geometry = shape(v.pop(column))
            yield str(number), {k: str(x) for k, x in v.items() if x is not None}, None if geometry is None else json.dumps(geometry)
        c.close()


class LayerSource(DataSource):
    """spark.read.format("geopackage").option("layer", name).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options["path"], self.options.get("layer"))


def geopackage_features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """area_id (the number of the row), properties (a map) and geometry (GeoJSON text, null for shapes other than polygons) of a layer; an error if it has no feature."""
    spark.dataSource.register(LayerSource)
    reader = spark.read.format("geopackage")
    return (reader.option("layer", layer) if layer else reader).load(path)
