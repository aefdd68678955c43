"""The questions of the query service as functions that return DataFrames; an unknown vessel or cell gives no rows.

A Store holds what they read: fishing events (mmsi, cell_id, date, fishing_hours), hours per pair of the training window,
cells, the latest record of each vessel, cleaned vessel years, and, for recommendations and anomalies, factors. A part may
be given as a function, which is called when the part is first asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidelog.functions import exprs as X
from tidelog.operators import als
from tidelog.operators.effort import climatology

# The bounds of what may be asked for at once.
HISTORY = 400
MOST = {"vessels": 200, "recommendations": 200, "mpa_cells": 20_000, "anomalies": 200, "forecast": 200}


class Store:
    PARTS = ("events", "train", "cells", "latest", "vessels", "users", "items")

    def __init__(self, **parts: DataFrame | Callable[[], DataFrame] | None) -> None:
        if unknown := set(parts) - set(self.PARTS):
            raise TypeError(f"no parts of a store: {sorted(unknown)}")
        self.parts = dict.fromkeys(self.PARTS) | parts

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in self.PARTS:
            raise AttributeError(name)
        if callable(part := self.parts[name]):
            self.parts[name] = part = part()
        return part

    @property
    def live(self) -> bool:
        """Whether there are factors, or a way to them."""
        return self.parts["users"] is not None and self.parts["items"] is not None

    def places(self, rows: DataFrame) -> DataFrame:
        """rows with lat and lon of their cell_id: from the cells or, failing that, as the id spells them. Rows without are dropped."""
        c = self.cells.select("cell_id", F.col("cell_ll_lat").alias("_lat"), F.col("cell_ll_lon").alias("_lon"))
        out = rows.join(c, "cell_id", "left").withColumns({"lat": F.coalesce("_lat", X.id_coordinate(F.col("cell_id"), 0)), "lon": F.coalesce("_lon", X.id_coordinate(F.col("cell_id"), 1))})
        return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).drop("_lat", "_lon")


def _bounded(n: int, what: str) -> int:
    """n, if so many rows may be asked for."""
    if not 1 <= n <= MOST[what]:
        raise ValueError(f"between 1 and {MOST[what]} {what} can be asked for, not {n}")
    return n


def _protected(s: Store) -> DataFrame:
    """cell_id and in_mpa of the cells; null for all if the table has no such column."""
    return s.cells.select("cell_id", F.col("in_mpa") if "in_mpa" in s.cells.columns else F.lit(None).cast("boolean").alias("in_mpa"))


def _summaries(s: Store) -> DataFrame:
    keys = s.events.select("mmsi").distinct()
    filled = lambda c, word: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(word))
    return keys.join(s.latest, "mmsi", "left").select("mmsi", F.lit(None).cast("string").alias("name"), filled("vessel_class_gfw", "unknown").alias("gear"), filled("flag_gfw", "UNK").alias("flag"), X.finite(F.col("length_m_gfw")).alias("length"))


def vessels(s: Store, q: str | None = None, gear: str | None = None, limit: int = 20) -> DataFrame:
    _bounded(limit, "vessels")
    v = _summaries(s)
    if q:
        v = v.where(F.lower("mmsi").contains(q.lower()))
    if gear:
        v = v.where(F.col("gear") == gear)
    n = s.train.groupBy("mmsi").agg(F.count(F.lit(1)).alias("_n"))
    return v.join(n, "mmsi", "left").orderBy(F.coalesce("_n", F.lit(0)).desc(), "mmsi").limit(limit).drop("_n")


def history(s: Store, mmsi: str, limit: int = HISTORY) -> DataFrame:
    h = s.events.where(F.col("mmsi") == mmsi).groupBy("cell_id").agg(F.round(F.sum("fishing_hours"), 6).alias("fishing_hours"))
    return s.places(h.orderBy(F.col("fishing_hours").desc(), "cell_id").limit(limit)).select("cell_id", "lat", "lon", "fishing_hours")


def vessel(s: Store, mmsi: str) -> DataFrame:
    """The summary with active_days and top_cells, an array of at most five."""
    days = s.events.where(F.col("mmsi") == mmsi).groupBy("mmsi").agg(F.countDistinct("date").alias("active_days"))
    top = history(s, mmsi).orderBy(F.col("fishing_hours").desc(), "cell_id").limit(5).agg(F.sort_array(F.collect_list(F.struct((-F.col("fishing_hours")).alias("neg"), "cell_id", "lat", "lon", "fishing_hours"))).alias("t"))
    cells = top.select(F.lit(mmsi).alias("mmsi"), F.transform("t", lambda x: F.struct(x["cell_id"].alias("cell_id"), x["lat"].alias("lat"), x["lon"].alias("lon"), x["fishing_hours"].alias("fishing_hours"))).alias("top_cells"))
    return _summaries(s).where(F.col("mmsi") == mmsi).join(days, "mmsi").join(cells, "mmsi")


def top_gear(s: Store, n: int = 3, cell_id: str | None = None) -> DataFrame:
    """The n gears of most hours of each cell, or of one."""
    e = s.events if cell_id is None else s.events.where(F.col("cell_id") == cell_id)
    v = s.vessels.select("mmsi", "year", F.col("vessel_class_gfw").alias("gear"))
    hours = e.withColumn("year", F.year("date")).join(v, ["mmsi", "year"], "left").groupBy("cell_id", F.coalesce("gear", F.lit("unknown")).alias("gear")).agg(F.round(F.sum("fishing_hours"), 6).alias("hours"))
    return hours.withColumn("rank", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("hours").desc(), "gear"))).where(F.col("rank") <= n)


def cell(s: Store, cell_id: str) -> DataFrame:
    gears = top_gear(s, 3, cell_id).where(F.col("gear") != "").groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gear"))), lambda x: x["gear"]).alias("top_gear_types"))
    c = s.cells.drop("in_mpa").join(_protected(s), "cell_id").where(F.col("cell_id") == cell_id)
    return c.join(gears, "cell_id", "left").select("cell_id", X.finite(F.col("depth_mean_m")).alias("depth"), F.col("eez_sovereign").alias("eez"), "in_mpa", F.coalesce("top_gear_types", F.array().cast("array<string>")).alias("top_gear_types"))


def mpa_cells(s: Store, west=None, south=None, east=None, north=None, limit: int = 4000) -> DataFrame:
    """Cells in protected areas, within the box if all four sides are given."""
    _bounded(limit, "mpa_cells")
    c = s.cells.join(_protected(s).where("in_mpa").select("cell_id").distinct(), "cell_id", "left_semi")
    if None not in (west, south, east, north):
        c = c.where(F.col("cell_ll_lon").between(west, east) & F.col("cell_ll_lat").between(south, north))
    return c.orderBy("cell_id").limit(limit).select("cell_id", F.col("cell_ll_lat").alias("lat"), F.col("cell_ll_lon").alias("lon"))


def forecast(s: Store, season: str | None = None, exclude_mpa: bool = True, k: int = 80) -> DataFrame:
    """The cells of most expected hours in a season (winter if it is unknown)."""
    _bounded(k, "forecast")
    key = X.season_name(season) or "winter"
    c = climatology(s.events).where(F.col("season") == key).withColumn("predicted_hours", F.round("predicted_hours", 6))
    rows = s.places(c.join(_protected(s), "cell_id", "left"))
    if exclude_mpa:
        rows = rows.where(~F.coalesce("in_mpa", F.lit(False)))
    return rows.orderBy(F.col("predicted_hours").desc(), "cell_id").limit(k).select("cell_id", "lat", "lon", "predicted_hours", "season", F.lit(f"mean {key} fishing hours per year (climatology, not a dynamical forecast)").alias("reason"))


def recommendations(s: Store, mmsi: str, k: int = 50, exclude_mpa: bool = True, season: str | None = None) -> DataFrame:
    """Unseen cells by score, weighted by season if one is named; more are fetched than asked for, then those in protected areas are left out, so fewer than k may come."""
    _bounded(k, "recommendations")
    key = X.season_name(season)
    user = s.users.where(F.col("mmsi") == mmsi)
    ranked = als.recommend(user, s.items, s.train.where(F.col("mmsi") == mmsi), max(k * 8 if key else k * 3, k))
    hours = F.lit(None).cast("double")
    if key:
        c = climatology(s.events).where(F.col("season") == key)
        peak = c.agg(F.max("predicted_hours")).first()[0] or 0.0
        ranked = ranked.join(c.select("cell_id", "predicted_hours"), "cell_id", "left").withColumn("predicted_hours", F.coalesce("predicted_hours", F.lit(0.0)))
        ranked = ranked.withColumn("score", F.col("score") * X.season_weight(F.col("predicted_hours"), F.lit(peak)))
        hours = F.col("predicted_hours")
    gear = s.latest.where(F.col("mmsi") == mmsi).select("mmsi", F.col("vessel_class_gfw").alias("_gear"))
    rows = s.places(ranked).join(s.cells.select("cell_id", "depth_mean_m", "distance_to_port_m"), "cell_id", "left").join(_protected(s), "cell_id", "left").join(gear, "mmsi", "left")
    if exclude_mpa:
        rows = rows.where(~F.coalesce("in_mpa", F.lit(False)))
    reason = X.reason_text(F.col("depth_mean_m"), F.col("distance_to_port_m"), F.col("in_mpa"), F.coalesce("_gear", F.lit("unknown")))
    if key:
        reason = F.concat(F.lit(f"{key} climatology "), F.format_string("%.1fh/yr, ", hours), reason)
    rows = rows.withColumn("reason", reason).orderBy(F.col("score").desc(), "cell_id").limit(k)
    return rows.select("cell_id", "lat", "lon", "score", X.finite(F.col("depth_mean_m")).alias("depth"), "in_mpa", X.nautical_miles(F.col("distance_to_port_m")).alias("distance_to_port"), "reason")


def lowest_scores(scored: DataFrame, events: DataFrame, start: str | None = None, end: str | None = None, limit: int = 20) -> DataFrame:
    """Of the limit * 8 observed pairs of lowest score those fished between the days (both included), with the first day; at most limit."""
    few = scored.orderBy("score", "mmsi", "cell_id").limit(limit * 8).select("mmsi", "cell_id", "score", F.col("hours").alias("observed_hours"))
    e = events
    if start:
        e = e.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        e = e.where(F.col("date") <= F.lit(end).cast("date"))
    first = e.join(F.broadcast(few), ["mmsi", "cell_id"]).groupBy("mmsi", "cell_id", "score", "observed_hours").agg(F.min("date").alias("date"))
    return first.orderBy("score", "mmsi", "cell_id").limit(limit).select("mmsi", "cell_id", "date", "score", "observed_hours")


def anomalies(s: Store, start: str | None = None, end: str | None = None, limit: int = 20) -> DataFrame:
    _bounded(limit, "anomalies")
    pairs = s.events.groupBy("mmsi", "cell_id").agg(F.sum("fishing_hours").alias("hours"))
    return lowest_scores(als.pair_scores(pairs, s.users, s.items), s.events, start, end, limit)


def stats(s: Store) -> DataFrame:
    e = s.events.agg(F.countDistinct("mmsi").alias("n_vessels"), F.countDistinct("cell_id").alias("n_cells"), F.count(F.lit(1)).alias("n_interaction_rows"), F.round(F.coalesce(F.sum("fishing_hours"), F.lit(0.0)), 4).alias("fishing_hours"), F.lit(1).alias("_one"))
    m = _protected(s).agg(F.count_if("in_mpa").alias("n_mpa_cells"), F.lit(1).alias("_one"))
    return e.join(m, "_one").drop("_one").withColumn("mpa_ready", F.col("n_mpa_cells") > 0)


def health(s: Store) -> DataFrame:
    """ok, live: whether factors are there."""
    return s.cells.sparkSession.range(1).select(F.lit(True).alias("ok"), F.lit(s.live).alias("live"))
