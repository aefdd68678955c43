import json

import numpy as np
from pyspark.sql import functions as F
from tidelog.operators.cells import Tree, nearest
from tidelog.operators.near import _dealt, _ranges, containing, haversine, near
from tidelog.sources.geojson import polygon_pieces

C = F.col


def points(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    lat = np.concatenate([rng.uniform(-90, 90, n), np.full(n, 12.3) + rng.normal(0, 0.2, n), rng.uniform(88, 90, 20)])
    lon = np.concatenate([rng.uniform(-180, 180, n), np.full(n, 179.9) + rng.normal(0, 0.3, n), rng.uniform(-180, 360, 20)])
    rows = [(f"{name}{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    return rows, spark.createDataFrame([*rows, (f"{name}n", None, 1.0), (f"{name}x", float("nan"), 1.0), (None, 1.0, 1.0)], "id string, lat double, lon double")


def test_near_is_brute_force(spark):
    a, da = points(spark, 150, 1, "a")
    b, db = points(spark, 150, 2, "b")
    for radius, most in ((60_000.0, 40), (400_000.0, 1000)):
        got = sorted((r["point_id"], r["site_id"]) for r in near(da, db, radius, ("id", C("lat"), C("lon")), ("id", C("lat"), C("lon")), most).collect())
        want = sorted((i, j) for i, p, q in a for j, r, s in b if haversine(p, q, r, s, np) <= radius)
        assert got == want and len(want) > 100


def test_nearest_is_brute_force(spark):
    a, da = points(spark, 40, 3, "a")
    b, db = points(spark, 60, 4, "b")
    want = {i: min(haversine(p, q, r, s, np) for _, r, s in b) for i, p, q in a}
    for block in (1_000, 25):
        got = {r["point_id"]: r["distance_m"] for r in nearest(da, db, ("id", C("lat"), C("lon")), ("id", C("lat"), C("lon")), block).collect()}
        got = {k: v for k, v in got.items() if k in want}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_containing(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = {
        "hole": {"type": "Polygon", "coordinates": [square(0, 0, 10), square(4, 4, 2)]},
        "two": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 3)], [square(1, 1, 3)], [square(170, -5, 20)]]},
        "bad": {"type": "Point", "coordinates": [1, 2]},
    }
    areas = spark.createDataFrame([*((k, json.dumps(v)) for k, v in shapes.items()), ("null", None), ("text", "no json")], "area_id string, geometry string")
    p = spark.createDataFrame([("in", 2.0, 2.0), ("hole", 5.0, 5.0), ("out", 20.0, 20.0), ("line", 0.0, -175.0), ("edge", 0.0, 5.0), ("none", None, 5.0)], "id string, lat double, lon double")
    got = sorted(tuple(r) for r in containing(p, polygon_pieces(areas), ("id", C("lat"), C("lon"))).collect())
    assert got == [("edge", "hole"), ("in", "hole"), ("in", "two"), ("line", "two")]
    assert containing(p.limit(0), polygon_pieces(areas), ("id", C("lat"), C("lon"))).count() == 0
    assert containing(p, polygon_pieces(areas.limit(0)), ("id", C("lat"), C("lon"))).count() == 0


def test_copies_do_not_grow_with_the_data(spark):
    """A hot strip of points all along a parallel is cut into ranges, so no row of them is dealt out, however many rows there are."""
    for n in (2_000, 8_000):
        p = spark.range(n).select(F.col("id").alias("point_id"), F.lit(0).alias("strip"), (F.col("id") * 360.0 / n - 180.0).alias("lon"))
        a, b = _ranges(p, p.withColumnRenamed("point_id", "site_id"), 50, F.lit(300))
        assert a.first()["ranges"] == b.first()["ranges"] == min(300, n // 50)
        a, b = (x.withColumn("range", F.floor((F.col("lon") + 180.0) / 360.0 * F.col("ranges")).cast("int")) for x in (a, b))
        a, b = _dealt(a, b, 60)
        assert a.count() == b.count() == n


def test_a_place_with_more_rows_than_a_part(spark):
    rng = np.random.default_rng(9)
    a = [(f"a{i}", 10.0 + float(x), 20.0 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.01, (300, 2)))]
    b = [(f"b{i}", 10.0 + float(x), 20.0 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.01, (200, 2)))]
    da, db = (spark.createDataFrame(x, "id string, lat double, lon double") for x in (a, b))
    got = sorted((r["point_id"], r["site_id"]) for r in near(da, db, 1_000.0, ("id", C("lat"), C("lon")), ("id", C("lat"), C("lon")), 30).collect())
    want = sorted((i, j) for i, p, q in a for j, r, s in b if haversine(p, q, r, s, np) <= 1_000.0)
    assert got == want and len(want) > 1_000


def test_the_tree_is_brute_force():
    rng = np.random.default_rng(11)
    for n in (1, 2, 33, 3_000):
        lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
        lat[: n // 3], lon[: n // 3] = 10.0, 20.0  # a third at one place
        p, q = np.degrees(np.arcsin(rng.uniform(-1, 1, 400))), rng.uniform(-180, 540, 400)
        want = haversine(p[:, None], q[:, None], lat[None, :], lon[None, :], np).min(axis=1)
        assert np.allclose(Tree(lat, lon).nearest(p, q), want, atol=1e-3)
