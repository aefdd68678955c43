"""GeoJSON polygons as rows, parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygon_pieces(df: DataFrame, area_id: str = "area_id", geometry: str = "geometry") -> DataFrame:
    """area_id, rings (array of rings of [lon, lat]) and the bounding box of each piece of a Polygon, MultiPolygon or Feature with one.

    Geometries that cannot be read, of another type, or without rings give no rows."""
    g = F.coalesce(F.get_json_object(F.col(geometry), "$.geometry"), F.col(geometry))
    coordinates = F.get_json_object(g, "$.coordinates")
    kind = F.get_json_object(g, "$.type")
    ring = "array<array<double>>"
    pieces = F.when(kind == "Polygon", F.array(F.from_json(coordinates, f"array<{ring}>"))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<array<{ring}>>"))
    out = df.select(F.col(area_id).alias("area_id"), F.explode(pieces).alias("rings")).where(F.size(F.flatten("rings")) > 2)
    for axis, name in ((0, "lon"), (1, "lat")):
        points = F.expr(f"transform(flatten(rings), p -> get(p, {axis}))")
        out = out.withColumns({f"min_{name}": F.array_min(points), f"max_{name}": F.array_max(points)})
    return out


def areas(pieces: DataFrame) -> DataFrame:
    """area_id and area (square degrees, to six places) of polygon_pieces: outlines without their holes."""
    at = lambda r, k, axis: F.get(F.get(r, k), F.lit(axis))
    cross = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, k: s + at(r, k - 1, 0) * at(r, k, 1) - at(r, k, 0) * at(r, k - 1, 1))
    each = F.transform("rings", lambda r: F.abs(cross(r)) / 2.0)
    area = F.get(each, F.lit(0)) * 2.0 - F.aggregate(each, F.lit(0.0), lambda s, a: s + a)
    return pieces.groupBy("area_id").agg(F.round(F.sum(area), 6).alias("area"))
