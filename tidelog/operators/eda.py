"""Descriptive statistics of the quality-controlled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "(unmatched)"


def r(c):
    return F.round(c, 6)


def inventory(s: DataFrame) -> DataFrame:
    share = F.try_divide(F.lit(100.0) * F.sum("fishing_hours"), F.nullif(F.sum("hours"), F.lit(0.0)))
    return s.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct("cell_id").alias("cells"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), r(F.sum("hours")).alias("hours"), r(F.sum("fishing_hours")).alias("fishing_hours"), r(share).alias("fishing_pct"))


def ratio_buckets(s: DataFrame) -> DataFrame:
    x = F.col("fishing_ratio")
    bucket = F.when(x == 0.0, "0").when(x <= 0.05, "(0, 0.05]").when(x <= 0.25, "(0.05, 0.25]").when(x <= 0.5, "(0.25, 0.50]").when(x <= 0.9, "(0.50, 0.90]").otherwise("(0.90, 1]")
    return s.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("hours")).alias("hours"), r(F.sum("fishing_hours")).alias("fishing_hours"))


def with_gear(s: DataFrame, vessels: DataFrame) -> DataFrame:
    """s with the class of its vessel in its year, _matched telling whether there is a record. vessels: unique on (mmsi, year)."""
    v = vessels.select("mmsi", "year", F.col("vessel_class_gfw").alias("gear"), F.lit(True).alias("_matched"))
    return s.join(v, ["mmsi", "year"], "left")


def join_coverage(s: DataFrame, vessels: DataFrame) -> DataFrame:
    miss = F.col("_matched").isNull()
    return with_gear(s, vessels).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(miss).alias("unmatched_rows"), r(F.lit(100.0) * F.count_if(miss) / F.count(F.lit(1))).alias("unmatched_row_pct"), F.countDistinct("mmsi").alias("mmsis"), F.countDistinct(F.when(miss, F.col("mmsi"))).alias("unmatched_mmsis"))


def unmatched_keys(s: DataFrame, vessels: DataFrame) -> DataFrame:
    return s.select("mmsi", "year").distinct().join(vessels.select("mmsi", "year"), ["mmsi", "year"], "left_anti")


def gear_effort(s: DataFrame, vessels: DataFrame) -> DataFrame:
    g = with_gear(s, vessels).groupBy(F.coalesce("gear", F.lit(UNMATCHED)).alias("gear")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("mmsi").alias("vessels"), F.sum("fishing_hours").alias("f"), F.sum("hours").alias("h"))
    total = g.agg(F.sum("f").alias("all")).withColumn("_one", F.lit(1))
    out = g.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    return out.select("gear", "n_rows", "vessels", r("f").alias("fishing_hours"), r("h").alias("hours"), r(F.lit(100.0) * F.col("f") / F.col("all")).alias("fishing_share_pct"))


def monthly(s: DataFrame) -> DataFrame:
    return s.groupBy("year", "month").agg(r(F.sum("fishing_hours")).alias("fishing_hours"), r(F.sum("hours")).alias("hours"))


def monthly_gear(s: DataFrame, vessels: DataFrame, gears: list[str]) -> DataFrame:
    g = with_gear(s, vessels).withColumn("gear", F.coalesce("gear", F.lit(UNMATCHED))).where(F.col("gear").isin(gears))
    return g.groupBy("year", "month", "gear").agg(r(F.sum("fishing_hours")).alias("fishing_hours"))


def degree_bins(s: DataFrame) -> DataFrame:
    g = s.groupBy((F.floor("cell_ll_lat") + 0.5).alias("lat"), (F.floor("cell_ll_lon") + 0.5).alias("lon")).agg(F.sum("fishing_hours").alias("f"))
    return g.where(F.col("f") > 0.0).select("lat", "lon", r("f").alias("fishing_hours"))


def top_cells(s: DataFrame, n: int = 10) -> DataFrame:
    g = s.groupBy("cell_id").agg(r(F.sum("fishing_hours")).alias("fishing_hours"))
    return g.orderBy(F.col("fishing_hours").desc(), "cell_id").limit(n)


def scope_share(s: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    inside = F.col("cell_ll_lat").between(south, north) & F.col("cell_ll_lon").between(west, east)
    part = F.sum(F.when(inside, F.col("fishing_hours")))
    return s.agg(r(F.sum("fishing_hours")).alias("world"), r(part).alias("inside"), r(F.lit(100.0) * part / F.sum("fishing_hours")).alias("inside_pct"))


def hours_tail(s: DataFrame) -> DataFrame:
    long = F.col("hours") > 24.0
    return s.agg(F.count_if(long).alias("rows_hours_gt_24"), r(F.lit(100.0) * F.count_if(long) / F.count(F.lit(1))).alias("row_pct"), r(F.sum(F.when(long, F.col("hours")))).alias("presence_hours"), r(F.max("hours")).alias("max_hours"), F.count_if(F.col("fishing_hours") > 24.0).alias("rows_fishing_gt_24"))


def active_days(s: DataFrame) -> DataFrame:
    d = s.groupBy("mmsi", "year").agg(F.countDistinct("date").alias("days"))
    return d.groupBy("year").agg(F.count(F.lit(1)).alias("vessels"), F.count_if(F.col("days") > 365).alias("days_gt_365"), F.max("days").alias("max_days"), r(F.avg("days")).alias("mean_days"), F.percentile("days", F.lit(0.5)).alias("median_days"), r(F.percentile("days", F.lit(0.99))).alias("p99_days"))


def mmsi_lengths(s: DataFrame) -> DataFrame:
    return s.groupBy(F.length("mmsi").alias("digits")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("mmsi").alias("vessels"))
