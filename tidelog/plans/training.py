"""Queries of the training-data operators in the core, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidelog.functions.values import VALUE_RULES, plain_text, vessel_of
from tidelog.operators import asof, error_parse, history, near, pmm
from tidelog.operators.cells import nearest
from tidelog.session import cut, table
from tidelog.sources.geojson import polygon_pieces

NEAR_M = 60_000.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cannot be loaded."""
    rows = error_parse.parse_effort_lines(table(spark, d, "raw_effort_lines").select("raw_id", "line"))
    return rows.where(F.col("effort.reject_reason").isNotNull()).select("raw_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.split_effort_lines(table(spark, d, "raw_effort_lines"))[1]


def p1_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Lines that parse at no cost but hold an invalid value, with the first one as the reason."""
    return p1_rejects(spark, d).where(F.col("edit_cost") == 0).select("raw_id", "reject_reason")


def p1_bronze(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.split_effort_lines(table(spark, d, "raw_effort_lines"))[0].select("raw_id", *(c[0] for c in error_parse.EFFORT_COLUMNS))


def p2_fills(spark: SparkSession, d: str) -> DataFrame:
    return pmm.fill_missing(table(spark, d, "vessels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every gap, as the fills list it."""
    return p2_fills(spark, d).select("vessel_row_id", "field")


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every fill with whether its donor is observed, belongs to the stated group, and has the value that was copied."""
    v = table(spark, d, "vessels")
    return pmm.checked_fills(v, cut(pmm.fill_missing(v)))


def p2_vessels(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vessels")
    return pmm.with_fills(v, cut(pmm.fill_missing(v)))


def _place(axis: str) -> F.Column:
    gap = F.col("centroid_lat").isNull() | F.col("centroid_lon").isNull() | F.isnan("centroid_lat") | F.isnan("centroid_lon")
    return F.when(gap, F.col(f"cell_ll_{axis}") + F.lit(0.05)).otherwise(F.col(f"centroid_{axis}"))


def _cell_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = table(spark, d, "cells").select("cell_id", "cell_ll_lat", "cell_ll_lon", "centroid_lat", "centroid_lon")
    point = ("cell_id", _place("lat"), _place("lon"))
    ports = near.near(cells, table(spark, d, "anchorages").select("s2id", "lat", "lon"), NEAR_M, point, ("s2id", F.col("lat"), F.col("lon")))
    areas = near.containing(cells, polygon_pieces(table(spark, d, "protected_areas").select("area_id", "geometry")), point)
    return ports, areas


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the areas that contain them and the anchorages within 60 km."""
    ports, areas = _cell_sites(spark, d)
    return ports.select("point_id", "site_id").unionByName(areas).withColumnRenamed("point_id", "cell_id")


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per cell in_mpa and the distance to the nearest anchorage, however far."""
    cells = table(spark, d, "cells").select("cell_id", "cell_ll_lat", "cell_ll_lon", "centroid_lat", "centroid_lon")
    point = ("cell_id", _place("lat"), _place("lon"))
    areas = near.containing(cells, polygon_pieces(table(spark, d, "protected_areas").select("area_id", "geometry")), point)
    inside = areas.select(F.col("point_id").alias("cell_id"), F.lit(True).alias("in_mpa")).distinct()
    port = nearest(cells, table(spark, d, "anchorages"), point, ("s2id", F.col("lat"), F.col("lon"))).withColumnRenamed("point_id", "cell_id")
    out = cells.select("cell_id").join(port, "cell_id", "left").join(inside, "cell_id", "left")
    return out.select("cell_id", F.coalesce("in_mpa", F.lit(False)).alias("in_mpa"), F.round("distance_m", 3).alias("distance_to_port_m"))


def _events_with_records(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vessels").select("vessel_row_id", "mmsi", "year", "known_on").withColumn("vessel", vessel_of(F.col("mmsi")))
    events = table(spark, d, "interactions").select("interaction_id", "mmsi", "date")
    low, high = events.agg(F.min("date"), F.max("date")).select(*(asof.month_of(F.col(c)) for c in ("min(date)", "max(date)"))).first()
    rank = F.struct(F.col("year"), F.coalesce("known_on", F.lit("0001-01-01").cast("date")), -F.col("vessel_row_id"))
    begins = F.when(F.col("year").between(1, 9999), F.make_date("year", F.lit(1), F.lit(1)))
    known = asof.validity(v, F.col("vessel"), F.when(F.col("known_on").isNotNull(), F.greatest("known_on", begins)), rank, F.col("vessel_row_id"))
    hindsight = asof.validity(v, F.col("vessel"), begins, rank, F.col("vessel_row_id"))
    return asof.as_known(events, vessel_of(F.col("mmsi")), F.col("date"), {"known_row": known, "hindsight_row": hindsight}, (low or 0, -1 if high is None else high))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Interactions whose record as known is not the one in hindsight."""
    e = _events_with_records(spark, d).where(F.col("hindsight_row").isNotNull() & ~F.col("hindsight_row").eqNullSafe(F.col("known_row")))
    return e.select("interaction_id", F.coalesce("known_row", F.lit(0)).cast("long").alias("vessel_row_id"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every interaction with the class known on its day (null: none was).

    The class travels with the validity interval, so no second join by row id is needed."""
    v = table(spark, d, "vessels").select("vessel_row_id", "mmsi", "year", "known_on", "vessel_class_gfw").withColumn("vessel", vessel_of(F.col("mmsi")))
    events = table(spark, d, "interactions").select("interaction_id", "mmsi", "date")
    low, high = events.agg(F.min("date"), F.max("date")).select(*(asof.month_of(F.col(c)) for c in ("min(date)", "max(date)"))).first()
    begins = F.when(F.col("year").between(1, 9999), F.make_date("year", F.lit(1), F.lit(1)))
    rank = F.struct(F.col("year"), F.col("known_on"), -F.col("vessel_row_id"))
    payload = F.struct(F.col("vessel_row_id").alias("id"), plain_text(F.col("vessel_class_gfw")).alias("vessel_class"))
    known = asof.validity(v, F.col("vessel"), F.when(F.col("known_on").isNotNull(), F.greatest("known_on", begins)), rank, payload)
    e = asof.as_known(events, vessel_of(F.col("mmsi")), F.col("date"), {"known": known}, (low or 0, -1 if high is None else high))
    return e.select("interaction_id", F.col("known.id").alias("vessel_row_id"), F.col("known.vessel_class").alias("vessel_class_known"))


def _vessel_states(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vessels").select("vessel_row_id", "mmsi", "year", "known_on", "vessel_class_gfw", "flag_gfw")
    values = {n: VALUE_RULES[n](F.col(n)) for n in ("vessel_class_gfw", "flag_gfw")}
    return cut(history.recorded_states(v, vessel_of(F.col("mmsi")), F.col("year"), values, F.col("known_on"), F.col("vessel_row_id")))


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history(_vessel_states(spark, d), ["vessel_class_gfw", "flag_gfw"]).withColumnRenamed("entity", "mmsi")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every vessel."""
    return p7_history(spark, d).select("mmsi", "valid_from", "valid_to")


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_invalid, p1_bronze, p2_found, p2_fills, p2_checked, p2_vessels, p4_found, p4_cells, p6_found, p6_classes, p7_found, p7_history)}

_NO = "('', '-', '--', '?', '.', 'na', 'n/a', 'n.a.', 'nan', 'nil', 'none', 'null', 'unk', 'unknown', 'undefined', 'missing', 'not available', 'no data')"


def _plain(c: str) -> str:
    t = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    return f"CASE WHEN {t} NOT IN {_NO} THEN {t} END"


def _number(c: str, low: float, high: float) -> str:
    return f"CASE WHEN {c} > {low} AND {c} < {high} THEN {c} END"


_VESSEL = r"nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(upper(mmsi), '^[\s\x{00A0}]*(MMSI)?[:#=]?|[\s\x{00A0}]+$', '', 'g'), '\.0*$', ''), '[-_\s\x{00A0}]', '', 'g'), '^[0-9]{9}$'), '')"

_RULES = {
    "length_m_gfw": _number("length_m_gfw", 0, 130),
    "engine_power_kw_gfw": _number("engine_power_kw_gfw", 0, 8500),
    "tonnage_gt_gfw": _number("tonnage_gt_gfw", 0, 7500),
    "vessel_class_gfw": _plain("vessel_class_gfw"),
}

_NUM = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"
_COL = r'("(?:[^"]|"")*"|[^",]*)'
_LINE = ",".join([_COL] * 8)


def _parsed_sql() -> str:
    """A second way to the same columns: one regular expression for a sound line, then tests of each value."""
    value = lambda i: f"""CASE WHEN c[{i}] LIKE '"%' THEN trim(replace(substr(c[{i}], 2, length(c[{i}]) - 2), '""', '"'), ' ' || chr(9)) ELSE trim(c[{i}], ' ' || chr(9)) END AS v{i}"""
    take = ", ".join(f"regexp_extract(l, '^{_LINE}$', {i})" for i in range(1, 9))
    whole = lambda v: f"regexp_full_match({v}, {_NUM}) AND isfinite(try_cast({v} AS DOUBLE))"
    empty = "('', 'NA', 'NaN', 'null', 'NULL')"
    tests = [
        "regexp_full_match(v1, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v1 AS DATE) IS NOT NULL",
        f"{whole('v2')} AND try_cast(v2 AS DOUBLE) BETWEEN -90 AND 90",
        f"{whole('v3')} AND try_cast(v3 AS DOUBLE) BETWEEN -180 AND 180",
        "regexp_full_match(v4, '[0-9]+')",
        f"{whole('v5')} AND try_cast(v5 AS DOUBLE) >= 0",
        f"(v6 IN {empty} OR ({whole('v6')} AND try_cast(v6 AS DOUBLE) >= 0))",
        f"v7 NOT IN {empty}",
        "v8 IN ('zip', 'csv_dir')",
    ]
    return f"""WITH s AS (SELECT raw_id, regexp_replace(line, '\\r$', '') AS l FROM raw_effort_lines),
t AS (SELECT raw_id, coalesce(regexp_full_match(l, '{_LINE}'), false) AS shape, [{take}] AS c FROM s),
p AS (SELECT raw_id, shape, {', '.join(value(i) for i in range(1, 9))} FROM t),
q AS (SELECT *, shape AND coalesce({' AND '.join(f'({x})' for x in tests)}, false) AS sound, coalesce({', '.join(f"CASE WHEN ({x}) IS NOT TRUE THEN 'invalid_value: {name}' END" for x, (name, *_) in zip(tests, error_parse.EFFORT_COLUMNS, strict=True))}) AS reason FROM p)"""


_REACH = "a.lat BETWEEN c.lat - 0.55 AND c.lat + 0.55 AND "


def _places_sql() -> str:
    return """WITH p AS (SELECT cell_id, CASE WHEN gap THEN cell_ll_lat + 0.05 ELSE centroid_lat END AS lat, CASE WHEN gap THEN cell_ll_lon + 0.05 ELSE centroid_lon END AS raw
  FROM (SELECT *, coalesce(isnan(centroid_lat) OR isnan(centroid_lon), true) AS gap FROM cells)),
c AS (SELECT cell_id, lat, raw - floor((raw + 180.0) / 360.0) * 360.0 AS lon FROM p),
n AS (SELECT cell_id, s2id AS site_id, 2.0 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(a.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(a.lat)) * pow(sin((radians(a.lon) - radians(c.lon)) / 2), 2)))) AS distance_m
  FROM c JOIN anchorages a ON a.lat BETWEEN c.lat - 0.55 AND c.lat + 0.55 AND a.lat IS NOT NULL AND a.lon IS NOT NULL AND NOT isnan(a.lat) AND NOT isnan(a.lon)),
g AS (SELECT area_id, unnest(CASE WHEN geometry->>'$.type' = 'Polygon' THEN [CAST(geometry->'$.coordinates' AS DOUBLE[][][])] ELSE CAST(geometry->'$.coordinates' AS DOUBLE[][][][]) END) AS piece FROM protected_areas),
r AS (SELECT area_id, piece_no, unnest(piece) AS ring FROM (SELECT *, row_number() OVER () AS piece_no FROM g)),
e AS (SELECT area_id, piece_no, unnest(range(1, len(ring))) AS k, ring FROM r),
f AS (SELECT area_id, piece_no, ring[k][1] AS x1, ring[k][2] AS y1, ring[k + 1][1] AS x2, ring[k + 1][2] AS y2 FROM e),
i AS (SELECT DISTINCT cell_id, area_id AS site_id FROM (SELECT cell_id, area_id, piece_no FROM c JOIN f ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1))"""


_CHOSEN = f"""WITH v AS (SELECT {_VESSEL} AS vessel, year, known_on, vessel_row_id AS id, {_plain('vessel_class_gfw')} AS cls, {_plain('flag_gfw')} AS flag FROM vessels),
y AS (SELECT vessel, year, arg_max(cls, (known_on, -id)) FILTER (cls IS NOT NULL) AS cls, arg_max(flag, (known_on, -id)) FILTER (flag IS NOT NULL) AS flag FROM v WHERE vessel IS NOT NULL AND year IS NOT NULL GROUP BY ALL),
s AS (SELECT vessel, year, {', '.join(f'coalesce(last_value({a} IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value({a} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {a}' for a in ('cls', 'flag'))} FROM y WINDOW w AS (PARTITION BY vessel ORDER BY year)),
m AS (SELECT *, CASE WHEN cls IS NOT DISTINCT FROM lag(cls) OVER w AND flag IS NOT DISTINCT FROM lag(flag) OVER w AND lag(year) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY vessel ORDER BY year)),
z AS (SELECT *, sum(new) OVER (PARTITION BY vessel ORDER BY year) AS run FROM m)
SELECT vessel AS mmsi, CAST(min(year) AS INTEGER) AS valid_from, CAST(max(year) AS INTEGER) AS valid_to"""

_RECORDS = f"""WITH v AS (SELECT {_VESSEL} AS vessel, year, known_on, vessel_row_id AS id, {_plain('vessel_class_gfw')} AS cls FROM vessels WHERE year IS NOT NULL),
i AS (SELECT {_VESSEL} AS vessel, interaction_id, date FROM interactions),
k AS (SELECT interaction_id, arg_max(id, (year, known_on, -id)) AS known, arg_max(struct_pack(c := cls), (year, known_on, -id)).c AS cls FROM i JOIN v USING (vessel) WHERE v.year <= year(date) AND known_on <= date GROUP BY 1),
h AS (SELECT interaction_id, arg_max(id, (year, known_on, -id)) AS hind FROM i JOIN v USING (vessel) WHERE v.year <= year(date) GROUP BY 1)"""

SQL = {
    "p1_found": f"{_parsed_sql()} SELECT raw_id FROM q WHERE NOT sound",
    "p1_invalid": f"{_parsed_sql()} SELECT raw_id, reason AS reject_reason FROM q WHERE shape AND NOT sound",
    "p1_bronze": f"{_parsed_sql()} SELECT raw_id, v1 AS date, CAST(v2 AS DOUBLE) AS cell_ll_lat, CAST(v3 AS DOUBLE) AS cell_ll_lon, v4 AS mmsi, CAST(v5 AS DOUBLE) AS hours, try_cast(nullif(v6, 'NaN') AS DOUBLE) AS fishing_hours, v7 AS source_file, v8 AS source_format FROM q WHERE sound",
    "p2_found": " UNION ALL ".join(f"SELECT vessel_row_id, '{f}' AS field FROM vessels WHERE ({rule}) IS NULL" for f, rule in _RULES.items()),
    "p2_checked": " UNION ALL ".join(f"SELECT vessel_row_id, '{f}' AS field, true AS observed, true AS copied, true AS in_group FROM vessels WHERE ({rule}) IS NULL" for f, rule in _RULES.items()),
    "p4_found": f"{_places_sql()} SELECT cell_id, site_id FROM n WHERE distance_m <= 60000 UNION ALL SELECT cell_id, site_id FROM i",
    "p4_cells": f"{_places_sql().replace(_REACH, '')} SELECT cell_id, cell_id IN (SELECT cell_id FROM i) AS in_mpa, d AS distance_to_port_m FROM c LEFT JOIN (SELECT cell_id, round(min(distance_m), 3) AS d FROM n GROUP BY 1) USING (cell_id)",
    "p6_found": f"{_RECORDS} SELECT interaction_id, coalesce(known, 0) AS vessel_row_id FROM h LEFT JOIN k USING (interaction_id) WHERE hind IS DISTINCT FROM known",
    "p6_classes": f"{_RECORDS} SELECT interaction_id, known AS vessel_row_id, cls AS vessel_class_known FROM i LEFT JOIN k USING (interaction_id)",
    "p7_found": f"{_CHOSEN} FROM z GROUP BY vessel, run",
    "p7_history": f"{_CHOSEN}, any_value(cls) AS vessel_class_gfw, any_value(flag) AS flag_gfw FROM z GROUP BY vessel, run",
}
