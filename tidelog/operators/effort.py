"""Fishing events, the vessel-by-cell matrix, and its split in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidelog.functions import exprs as X

TEST_START, VAL_START = "2024-10-01", "2024-07-01"


def is_event() -> F.Column:
    return (F.col("fishing_hours") > 0.0) & (F.col("fishing_ratio") >= X.LEAST_RATIO)


def in_scope(silver: DataFrame, cells: DataFrame | None, sovereign: str | None) -> DataFrame:
    """Rows in cells of one sovereign; all rows if sovereign is None. The planner broadcasts the cells if they are few."""
    if sovereign is None:
        return silver
    return silver.join(cells.where(F.col("eez_sovereign") == sovereign).select("cell_id"), "cell_id", "left_semi")


def events(scoped: DataFrame) -> DataFrame:
    return scoped.where(is_event()).select("mmsi", "cell_id", "date", "fishing_hours")


def scope_counts(scoped: DataFrame) -> DataFrame:
    e = is_event()
    return scoped.agg(F.count(F.lit(1)).alias("in_scope_rows"), F.count_if(e).alias("event_rows"), F.round(F.coalesce(F.sum(F.when(e, F.col("fishing_hours"))), F.lit(0.0)), 4).alias("fishing_hours"), F.count_if(~e).alias("transit_or_zero_rows"))


def window(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= date < end; where events are partitioned by year, only the years of the window are read."""
    return events.where(X.between_days(F.col("date"), start, end, F.col("year") if "year" in events.columns else None))


def pair_hours(events: DataFrame, before: str | None = None) -> DataFrame:
    return window(events, None, before).groupBy("mmsi", "cell_id").agg(F.sum("fishing_hours").alias("hours"))


def matrix_shape(pairs: DataFrame) -> DataFrame:
    s = pairs.agg(F.countDistinct("mmsi").alias("n_users"), F.countDistinct("cell_id").alias("n_items"), F.count(F.lit(1)).alias("nnz"))
    size = F.col("n_users").cast("double") * F.col("n_items")
    return s.withColumn("sparsity", F.round(F.when(size > 0, 1.0 - F.col("nnz") / size).otherwise(1.0), 9))


def test_relevant(events: DataFrame, start: str = TEST_START) -> DataFrame:
    """Pairs of the test window: new grounds are those never fished before, cold vessels those never seen before."""
    test = pair_hours(window(events, start)).withColumnRenamed("hours", "fishing_hours")
    before = window(events, None, start).select("mmsi", "cell_id").distinct()
    pairs = before.withColumn("_p", F.lit(True))
    users = before.select("mmsi").distinct().withColumn("_u", F.lit(True))
    out = test.join(pairs, ["mmsi", "cell_id"], "left").join(users, "mmsi", "left")
    return out.select("mmsi", "cell_id", "fishing_hours", F.col("_p").isNull().alias("is_new_ground"), F.col("_u").isNull().alias("is_cold_start"))


def protocol_stats(relevant: DataFrame) -> DataFrame:
    new, cold = F.col("is_new_ground"), F.col("is_cold_start")
    users = lambda test: F.countDistinct(F.when(test, F.col("mmsi")))
    return relevant.agg(
        F.count(F.lit(1)).alias("test_pairs"), F.count_if(new).alias("new_ground_pairs"), F.count_if(~new).alias("revisit_pairs"), F.countDistinct("mmsi").alias("test_vessels"),
        users(cold).alias("cold_start_vessels"), users(~cold).alias("warm_test_vessels"), users(new & ~cold).alias("warm_with_new_grounds"), F.countDistinct("cell_id").alias("test_cells"),
    )


def new_grounds(events: DataFrame, history_end: str, window_end: str) -> DataFrame:
    """Pairs of a window that are new to vessels with a history."""
    history = window(events, None, history_end).select("mmsi", "cell_id").distinct()
    new = window(events, history_end, window_end).select("mmsi", "cell_id").distinct()
    return new.join(history, ["mmsi", "cell_id"], "left_anti").join(history.select("mmsi").distinct(), "mmsi", "left_semi")


def climatology(events: DataFrame) -> DataFrame:
    """season, cell_id, predicted_hours: the mean over the years in which the cell was fished in that season."""
    yearly = events.groupBy("cell_id", F.year("date").alias("year"), X.season_of(F.col("date")).alias("season")).agg(F.sum("fishing_hours").alias("hours"))
    return yearly.groupBy("cell_id", "season").agg(F.avg("hours").alias("predicted_hours"))


def season_weights(climate: DataFrame) -> DataFrame:
    """climatology with the season's peak and the weight of each cell. The peaks are four rows."""
    peak = climate.groupBy("season").agg(F.max("predicted_hours").alias("peak"))
    return climate.join(F.broadcast(peak), "season").withColumn("weight", X.season_weight(F.col("predicted_hours"), F.col("peak")))
