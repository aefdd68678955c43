"""Points near other points, and regions that contain points.

Latitude is cut into strips, and strips with more than `most` rows into ranges of longitude, at least twice as wide as the
reach: a point belongs to one range, a site to those that its reach overlaps, at most two by two of them. Copies of sites
thus do not grow with the data. A range that still has more than `most` rows on a side is dealt out: points and sites each into so many parts that no part is
larger, and every part of the points meets every part of the sites. As a range is hardly larger than the reach, such parts
hold many true pairs, so the copies stay far below the result. A pair has one owner: the range of the point and its two
parts. Within a task both sides are sorted by longitude and swept: the active sites of a point are those whose longitude
lies within reach, and only for these is the distance, or the polygon, looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
BLOCK = 1_000_000
#: Ranges of longitude per strip at most, and the width of those of polygons.
MOST_RANGES, POLYGON_RANGES = 1_440, 36
KEYS = ["strip", "range", "a", "b"]


def wrapped(lon: Column) -> Column:
    """The longitude in -180 (inclusive) to 180 (exclusive)."""
    return lon - F.floor((lon + 180.0) / 360.0) * 360.0


def haversine(lat1, lon1, lat2, lon2, m=F):
    """Great-circle metres; m: the module with the functions (pyspark's or numpy)."""
    rad = m.radians
    h = m.sin((rad(lat2) - rad(lat1)) / 2.0) ** 2 + m.cos(rad(lat1)) * m.cos(rad(lat2)) * m.sin((rad(lon2) - rad(lon1)) / 2.0) ** 2
    if m is np:
        return 2.0 * RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
    return F.lit(2.0 * RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _reach_across(strip: int, height: float, radius_m: float) -> float:
    """The greatest difference of longitude between points of a strip and sites within radius_m; 360 if it has no bound below half a turn."""
    reach = math.degrees(radius_m / RADIUS_M)
    top = min(90.0, max(abs(strip * height - 90.0), abs((strip + 1) * height - 90.0)) + 1e-9)
    ratio = math.sin(min(math.pi / 2, radius_m / RADIUS_M)) / max(math.cos(math.radians(top)), 1e-12)
    across = 360.0 if top + reach >= 90.0 or ratio >= 1.0 else math.degrees(math.asin(ratio)) + 1e-9
    return 360.0 if across >= 180.0 else across


def _ranges(points: DataFrame, sites: DataFrame, most: int, at_most: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with ranges, into how many ranges of longitude their strip is cut: as many as it has `most` rows. The table of strips has one row per strip, which their height bounds."""
    n = points.groupBy("strip").agg(F.count(F.lit(1)).alias("n")).unionByName(sites.groupBy("strip").agg(F.count(F.lit(1)).alias("n")))
    hot = F.broadcast(n.groupBy("strip").agg(F.max("n").alias("n")).where(F.col("n") > most))
    ranges = F.least(at_most, F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int"))
    return tuple(df.join(hot, "strip", "left").withColumn("ranges", ranges).drop("n") for df in (points, sites))


def _dealt(points: DataFrame, sites: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns a and b: with strip and range, the owner of their pairs. Only ranges with more than `most` rows on a side are in the table of parts, which the number of ranges bounds."""
    keys = ["strip", "range"]
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(0).cast("long"))
    m = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.lit(0).cast("long"))
    counts = n.unionByName(m).groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m")).where((F.col("n") > most) | (F.col("m") > most))
    parts = F.broadcast(counts.select(*keys, F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int").alias("na"), F.greatest(F.ceil(F.col("m") / most), F.lit(1)).cast("int").alias("nb")))
    hashed = lambda c, n: F.coalesce(F.pmod(F.xxhash64(c), F.col(n)).cast("int"), F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    p = points.join(parts, keys, "left").withColumn("a", hashed("point_id", "na")).withColumn("b", every("nb"))
    s = sites.join(parts, keys, "left").withColumn("b", hashed("site_id", "nb")).withColumn("a", every("na"))
    return p.drop("na", "nb"), s.drop("na", "nb")


def _points(df: DataFrame, point_id: str, lat: Column, lon: Column, height: float) -> DataFrame:
    good = lambda c: F.when(~F.isnan(c), c)
    p = df.select(F.col(point_id).alias("point_id"), good(lat.cast("double")).alias("lat"), wrapped(good(lon.cast("double"))).alias("lon"))
    return p.where(F.col("point_id").isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").isNotNull()).withColumn("strip", F.floor((F.col("lat") + 90.0) / height).cast("int"))


def _range(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * n).cast("int")


def _sweep_near(radius_m: float, height: float):
    reach = math.degrees(radius_m / RADIUS_M)

    def sweep(points: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(sites):
            across = _reach_across(int(points["strip"].iat[0]), height, radius_m)
            if across < 180.0:  # sites near the date line are also seen from the other side
                low, high = sites[sites["lon"] < -180.0 + across], sites[sites["lon"] >= 180.0 - across]
                sites = pd.concat([sites, low.assign(lon=low["lon"] + 360.0), high.assign(lon=high["lon"] - 360.0)])
            points, sites = points.sort_values("lon"), sites.sort_values("lon")
            plat, plon, slat, slon = (f[c].to_numpy() for f in (points, sites) for c in ("lat", "lon"))
            pid, sid = points["point_id"].to_numpy(), sites["site_id"].to_numpy()
            first, end = np.searchsorted(slon, plon - across), np.searchsorted(slon, plon + across, "right")
            width = end - first
            total = np.cumsum(width)
            start = 0
            while start < len(plon):  # a block of points with about BLOCK active sites
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK)))
                for at in range(0, int(width[start:stop].max()), BLOCK):  # a single point may have more
                    w = np.clip(width[start:stop] - at, 0, BLOCK)
                    i = np.repeat(np.arange(start, stop), w)
                    j = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[start:stop] + at, w)
                    close = np.abs(plat[i] - slat[j]) <= reach + 1e-9
                    i, j = i[close], j[close]
                    d = haversine(plat[i], plon[i], slat[j], slon[j], np)
                    hit = d <= radius_m
                    if hit.any():
                        out.append(pd.DataFrame({"point_id": pid[i[hit]], "site_id": sid[j[hit]], "distance_m": d[hit]}))
                start = stop
        return pd.concat(out) if out else pd.DataFrame({"point_id": pd.Series(dtype=object), "site_id": pd.Series(dtype=object), "distance_m": pd.Series(dtype=float)})

    return sweep


def near(points: DataFrame, sites: DataFrame, radius_m: float, point: tuple[str, Column, Column], site: tuple[str, Column, Column], most: int = 50_000) -> DataFrame:
    """point_id, site_id, distance_m of every pair within radius_m (inclusive, great circle).

    point and site: id column, latitude, longitude in degrees; longitudes may run beyond 180. Rows without an id or a place
    (null, NaN, latitude beyond 90) pair with nothing; rows of equal ids are told apart only by their ids, so an id that
    occurs twice gives its pairs twice. Other columns are not read. Either side may be empty."""
    reach = math.degrees(radius_m / RADIUS_M)
    height = max(2.0 * reach, 0.25)
    strips = int(180.0 / height) + 1
    across = [_reach_across(k, height, radius_m) for k in range(strips + 1)]
    ranges = [max(1, min(MOST_RANGES, int(360.0 / max(2.0 * w, 0.25)))) if w < 180.0 else 1 for w in across]
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("strip"))
    p = _points(points, *point, height)
    s = _points(sites, *site, height).withColumnRenamed("point_id", "site_id")
    strip = lambda x: F.floor((F.greatest(F.least(x, F.lit(90.0)), F.lit(-90.0)) + 90.0) / height).cast("int")
    s = s.withColumn("strip", F.explode(F.sequence(strip(F.col("lat") - reach - 1e-9), strip(F.col("lat") + reach + 1e-9))))
    p, s = _ranges(p, s, most, pick(ranges))
    n, w = F.col("ranges"), pick(across)
    p = p.withColumn("range", F.least(_range(F.col("lon"), n), n - 1)).drop("ranges")
    spanned = F.sequence(_range(F.col("lon") - w, n), _range(F.col("lon") + w, n))
    turned = F.when(n > 1, F.array_distinct(F.transform(spanned, lambda r: F.pmod(r, n)))).otherwise(F.array(F.lit(0)))
    s = s.withColumn("range", F.explode(turned)).drop("ranges")
    p, s = _dealt(p, s, most)
    kinds = {f.name: f.dataType.simpleString() for f in (*p.schema, *s.schema)}
    schema = f"point_id {kinds['point_id']}, site_id {kinds['site_id']}, distance_m double"
    return p.groupBy(*KEYS).cogroup(s.groupBy(*KEYS)).applyInPandas(_sweep_near(radius_m, height), schema)


def inside(lon: np.ndarray, lat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which points an odd number of edges (rows x1, y1, x2, y2) lies east of: inside the outline and outside its holes. A point on an edge counts as inside.

    Only edges whose latitudes reach a point's matter for it."""
    odd, on = np.zeros(len(lon), bool), np.zeros(len(lon), bool)
    for at in range(0, len(lon), max(1, BLOCK // max(len(edges), 1))):
        part = slice(at, at + max(1, BLOCK // max(len(edges), 1)))
        x, y = lon[part, None], lat[part, None]
        x1, y1, x2, y2 = (edges[None, :, k] for k in range(4))
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on[part] = ((cross == 0.0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))).any(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        odd[part] = (((y1 > y) != (y2 > y)) & left).sum(axis=1) % 2 == 1
    return odd | on


def _sweep_inside(points: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(points) and len(pieces):
        points = points.sort_values("lon")
        lat, lon, pid = points["lat"].to_numpy(), points["lon"].to_numpy(), points["point_id"].to_numpy()
        for site, edges, west, east, south, north in pieces[["site_id", "edges", "min_lon", "max_lon", "min_lat", "max_lat"]].itertuples(index=False):
            outline = np.stack([np.asarray(e, float) for e in edges])
            for turn in (-360.0, 0.0, 360.0):
                a, b = np.searchsorted(lon, west + turn), np.searchsorted(lon, east + turn, "right")
                at = np.arange(a, b)
                at = at[(lat[a:b] >= south) & (lat[a:b] <= north)]
                if len(at) and (hit := inside(lon[at] - turn, lat[at], outline)).any():
                    out.append(pd.DataFrame({"point_id": pid[at[hit]], "site_id": site}))
    return pd.concat(out) if out else pd.DataFrame({"point_id": pd.Series(dtype=object), "site_id": pd.Series(dtype=object)})


def containing(points: DataFrame, pieces: DataFrame, point: tuple[str, Column, Column], most: int = 50_000, height: float = 1.0) -> DataFrame:
    """point_id, site_id of every region (see geojson.polygon_pieces) that contains a point; holes excluded, edges straight in degrees.

    A piece goes to the strips, and ranges of longitude of hot strips, that its box overlaps, with those of its edges only that reach the
    strip. A region of several pieces that overlap at a point gives the pair once. Rows without an id or a place are in no
    region."""
    p = _points(points, *point, height)
    strip = lambda x: F.floor((x + 90.0) / height).cast("int")
    s = pieces.withColumnRenamed("area_id", "site_id").where(F.col("site_id").isNotNull() & F.col("min_lat").isNotNull() & F.col("min_lon").isNotNull())
    s = s.select("site_id", "rings", "min_lon", "max_lon", "min_lat", "max_lat").withColumn("strip", F.explode(F.sequence(strip(F.greatest(F.col("min_lat"), F.lit(-90.0))), strip(F.least(F.col("max_lat"), F.lit(90.0))))))
    p, s = _ranges(p, s, most, F.lit(POLYGON_RANGES))
    n = F.col("ranges")
    p = p.withColumn("range", F.least(_range(F.col("lon"), n), n - 1)).drop("ranges")
    wide = F.col("max_lon") - F.col("min_lon") >= 360.0
    spanned = F.sequence(_range(F.col("min_lon"), n), _range(F.least(F.col("max_lon"), F.col("min_lon") + 360.0), n))
    s = s.withColumn("range", F.explode(F.when(wide, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(F.transform(spanned, lambda r: F.pmod(r, n)))))).drop("ranges")
    p, s = _dealt(p, s, most)
    edge = lambda r, k: F.array(*(F.get(F.get(r, x), F.lit(c)) for x in (k, (k + 1) % F.size(r)) for c in (0, 1)))
    edges = F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda k: edge(r, k))))
    south, north = F.col("strip") * height - 90.0, (F.col("strip") + 1) * height - 90.0
    reaching = F.filter(edges, lambda e: (F.least(e[1], e[3]) <= north) & (F.greatest(e[1], e[3]) >= south))
    s = s.withColumn("edges", reaching).drop("rings").where(F.size("edges") > 0)  # only now, so that counting does not make them
    kinds = {f.name: f.dataType.simpleString() for f in (*p.schema, *s.schema)}
    return p.groupBy(*KEYS).cogroup(s.groupBy(*KEYS)).applyInPandas(_sweep_inside, f"point_id {kinds['point_id']}, site_id {kinds['site_id']}").distinct()
