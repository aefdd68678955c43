"""The table of cells: where they are, how deep, whose waters, how far from port, whether protected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidelog.functions import exprs as X
from tidelog.operators.near import containing, haversine
from tidelog.session import numbered

COLUMNS = ["cell_id", "cell_ll_lat", "cell_ll_lon", "centroid_lat", "centroid_lon", "depth_mean_m", "depth_min_m", "eez_sovereign", "eez_territory", "eez_iso", "distance_to_port_m", "in_mpa"]
#: Places in a leaf of a tree, and sites that are sent to every task at once.
LEAF, BLOCK_SITES = 32, 1_000_000


def distinct_cells(silver: DataFrame) -> DataFrame:
    half = X.CELL_STEP / 2
    c = silver.groupBy("cell_id").agg(F.min("cell_ll_lat").alias("cell_ll_lat"), F.min("cell_ll_lon").alias("cell_ll_lon"))
    return c.withColumns({"centroid_lat": F.col("cell_ll_lat") + half, "centroid_lon": F.col("cell_ll_lon") + half})


def attach_depth(cells: DataFrame, pixels: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """depth_mean_m and depth_min_m over the pixels (centre lat, lon, elevation) of each cell; null where there is none.

    box (south, west, north, east): cells that do not lie in it whole get no depth."""
    key = lambda c: F.floor(F.col(c) * 10.0 + 1e-9).cast("long")
    value = X.finite(F.col("elevation"))
    zones = pixels.where(value.isNotNull()).groupBy(key("lat").alias("_a"), key("lon").alias("_b")).agg(F.avg(value).alias("depth_mean_m"), F.min(value).alias("depth_min_m"))
    own = lambda c: F.round(F.col(c) * 10.0).cast("long")
    out = cells.drop("depth_mean_m", "depth_min_m").withColumns({"_a": own("cell_ll_lat"), "_b": own("cell_ll_lon")}).join(zones, ["_a", "_b"], "left").drop("_a", "_b")
    if box:
        south, west, north, east = box
        whole = (F.col("cell_ll_lat") >= south) & (F.col("cell_ll_lon") >= west) & (F.col("cell_ll_lat") + X.CELL_STEP <= north) & (F.col("cell_ll_lon") + X.CELL_STEP <= east)
        out = out.withColumns({c: F.when(whole, F.col(c)) for c in ("depth_mean_m", "depth_min_m")})
    return out


def smallest_area(cells: DataFrame, pieces: DataFrame, areas: DataFrame, point: tuple[str, Column, Column]) -> DataFrame:
    """cell_id and the columns of the smallest area that contains it. areas: area_id, area_km2 and more; ties to the smaller id."""
    hits = containing(cells, pieces, point).withColumnsRenamed({"point_id": "cell_id", "site_id": "area_id"}).join(areas, "area_id")
    rest = [c for c in areas.columns if c not in ("area_id", "area_km2")]
    return hits.groupBy("cell_id").agg(F.min(F.struct("area_km2", "area_id", *rest)).alias("a")).select("cell_id", "a.area_id", *(f"a.{c}" for c in rest))


def attach_mpa(cells: DataFrame, pieces: DataFrame | None, point: tuple[str, Column, Column]) -> DataFrame:
    """in_mpa: true or false by the areas, null for all cells if there is no source of areas."""
    plain = cells.drop("in_mpa")
    if pieces is None:
        return plain.withColumn("in_mpa", F.lit(None).cast("boolean"))
    hit = containing(cells, pieces, point).select(F.col("point_id").alias("cell_id")).distinct().withColumn("_in", F.lit(True))
    return plain.join(hit, "cell_id", "left").withColumn("in_mpa", F.coalesce("_in", F.lit(False))).drop("_in")


# Which protected areas count.
KEPT_MARINE, KEPT_REALM = [1.0, 2.0], ["MARINE", "COASTAL"]
KEPT_STATUS = ["designated", "inscribed", "adopted", "established", "", "nan", "none"]
KEPT_ENVIRON = ["M", "MARINE", "B", "BOTH"]


def marine_areas(areas: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The areas that count, by those of the columns marine, realm, status and environ that are there (any letter case).

    environ is looked at only without marine and realm, and only if it would keep any area at all."""
    names = {c.upper(): c for c in areas.columns}
    out = areas.where(F.col(geometry).isNotNull() & (F.trim(geometry) != ""))
    text = lambda n: F.trim(F.coalesce(F.col(names[n]).cast("string"), F.lit("")))
    if "MARINE" in names:
        out = out.where(F.col(names["MARINE"]).cast("string").try_cast("double").isin(KEPT_MARINE))
    elif "REALM" in names:
        out = out.where(F.upper(text("REALM")).isin(KEPT_REALM))
    if "STATUS" in names:
        out = out.where(F.lower(text("STATUS")).isin(KEPT_STATUS))
    if "ENVIRON" in names and not {"MARINE", "REALM"} & set(names):
        test = F.upper(text("ENVIRON")).isin(KEPT_ENVIRON)
        if out.where(test).limit(1).count():
            out = out.where(test)
    return out


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


class Tree:
    """Places on the sphere, halved along their widest axis until LEAF of them are left in a box."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        v = _unit(lat, lon)
        order, whole = np.arange(len(v)), [(0, len(v))]
        leaves = []
        while whole:
            a, b = whole.pop()
            part = order[a:b]
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            x = v[part]
            half = (b - a) // 2
            order[a:b] = part[np.argpartition(x[:, np.ptp(x, axis=0).argmax()], half)]
            whole += [(a, a + half), (a + half, b)]
        self.vectors, self.lat, self.lon = v[order], lat[order], lon[order]
        self.starts, self.ends = (np.array([x[k] for x in leaves], np.int64) for k in (0, 1))
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in leaves]).reshape(-1, 3)
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in leaves]).reshape(-1, 3)

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Great-circle metres from each point to the nearest place: the closest box is searched, then those that may hold anything closer."""
        out = np.full(len(lat), np.inf)
        step = max(1, 1_000_000 // max(len(self.starts), 1))
        for at in range(0, len(lat) if len(self.vectors) else 0, step):
            part = slice(at, at + step)
            v = _unit(lat[part], lon[part])
            gap = np.zeros((len(v), len(self.starts)))
            for k in range(3):
                x = v[:, k : k + 1]
                gap += np.maximum(np.maximum(self.low[:, k] - x, x - self.high[:, k]), 0.0) ** 2
            rows = np.arange(len(v))
            best, where = self._within(v, rows, gap.argmin(axis=1))
            i, leaf = np.nonzero(gap <= best[:, None] + 1e-15)
            more, spot = self._within(v, i, leaf)
            order = np.lexsort((more, i))
            first = order[np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))] if len(i) else order
            closer = more[first] < best[i[first]]
            where[i[first][closer]] = spot[first][closer]
            out[part] = haversine(lat[part], lon[part], self.lat[where], self.lon[where], np)
        return out

    def _within(self, v: np.ndarray, i: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a point and a box: the least squared chord to a place in the box, and that place."""
        n = self.ends[leaf] - self.starts[leaf]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(self.starts[leaf], n)
        d = ((v[np.repeat(i, n)] - self.vectors[place]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(d, begin) if len(begin) else d
        hit = np.flatnonzero(d == np.repeat(least, n))
        return least, place[hit[np.searchsorted(hit, begin)]] if len(begin) else place


def nearest(points: DataFrame, sites: DataFrame, point: tuple[str, Column, Column], site: tuple[str, Column, Column], block: int = BLOCK_SITES) -> DataFrame:
    """point_id, distance_m to the nearest site on the sphere. Points and sites without an id or a place are left out; without sites there are no rows. A point id that occurs twice gives one row.

    Sites travel in blocks of at most `block` (24 bytes each), those of a block close together, and each task searches a
    tree of them; the least distance of all blocks is taken."""
    good = lambda c: F.when(~F.isnan(c), c).cast("double")
    place = lambda df, x, name: df.select(F.col(x[0]).alias(name), good(x[1]).alias("lat"), good(x[2]).alias("lon")).where(F.col(name).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    p, s = place(points, point, "point_id"), numbered(place(sites, site, "id").select("lat", "lon").distinct(), F.floor(F.col("lat") / 10.0), F.col("lon"), F.col("lat"))
    n = s.count()
    out = p.select("point_id", F.lit(0.0).alias("distance_m")).limit(0)
    for at in range(0, n, block):
        rows = s.where((F.col("ix") >= at) & (F.col("ix") < at + block)).select("lat", "lon").toArrow()  # at most `block` rows
        shipped = points.sparkSession.sparkContext.broadcast(Tree(rows.column("lat").to_numpy(), rows.column("lon").to_numpy()))

        def run(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"point_id": f["point_id"], "distance_m": shipped.value.nearest(f["lat"].to_numpy(), f["lon"].to_numpy())})

        one = p.mapInPandas(run, f"point_id {p.schema['point_id'].dataType.simpleString()}, distance_m double")
        out = one if not at else out.unionByName(one)
    return out.groupBy("point_id").agg(F.min("distance_m").alias("distance_m"))


def checked(cells: DataFrame) -> DataFrame:
    """cells with the columns of the table in their order; an error if any is missing."""
    if missing := [c for c in COLUMNS if c not in cells.columns]:
        raise ValueError(f"cells lack {missing}")
    return cells.select(*COLUMNS)


def summary(cells: DataFrame) -> DataFrame:
    gap = lambda c: F.count_if(F.col(c).isNull()).alias(f"null_{c}")
    return cells.agg(F.count(F.lit(1)).alias("cells"), gap("depth_mean_m"), gap("eez_sovereign"), gap("in_mpa"), F.count_if("in_mpa").alias("in_mpa"))


def territories(cells: DataFrame, sovereign: str) -> DataFrame:
    """eez_territory (null: none) and cells: how many cells of a sovereign lie in each territory."""
    return cells.where(F.col("eez_sovereign") == sovereign).groupBy("eez_territory").agg(F.count(F.lit(1)).alias("cells"))


def serving_cells(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cells of the catalogue and those in protected areas."""
    mark = catalog.select("cell_id").distinct().withColumn("_c", F.lit(True))
    return cells.join(mark, "cell_id", "left").where(F.col("_c").isNotNull() | F.coalesce("in_mpa", F.lit(False))).drop("_c")
