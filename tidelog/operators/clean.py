"""Landed rows to quality-controlled tables, and what is refused on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidelog.functions import exprs as X

SILVER = ["date", "cell_ll_lat", "cell_ll_lon", "mmsi", "hours", "fishing_hours", "cell_id", "fishing_ratio", "year", "month"]
YEARS = (2023, 2024)


def staged(bronze: DataFrame) -> DataFrame:
    """bronze with reject_reason.

    The reason comes by a generator of one value, which the optimizer does not copy into later filters and projections as
    it would a plain expression: it is worked out once a row, and the code of a stage stays small enough to be compiled."""
    return bronze.drop("reject_reason").select("*", F.explode(F.array(X.row_reject_reason())).alias("reject_reason"))


def quarantined(stage: DataFrame) -> DataFrame:
    return stage.where(F.col("reject_reason").isNotNull())


def reject_histogram(stage: DataFrame) -> DataFrame:
    return quarantined(stage).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _repairs() -> dict[str, F.Column]:
    """What is repaired or only noticed in an accepted row."""
    good = F.col("reject_reason").isNull()
    return {
        "accepted": good,
        "null_fishing_hours_to_zero": good & F.col("fishing_hours").isNull(),
        "hours_exceed_calendar_day": good & (F.col("hours") > 24.0),
        "fishing_hours_exceed_calendar_day": good & (F.coalesce("fishing_hours", F.lit(0.0)) > 24.0),
        "mmsi_not_9_digit": good & (F.length(X.trimmed(F.col("mmsi"))) != 9),
    }


def repair_counts(stage: DataFrame) -> DataFrame:
    """What is repaired or only noticed among the accepted rows."""
    return stage.agg(*(F.count_if(test).alias(name) for name, test in _repairs().items()))


def repaired(stage: DataFrame) -> DataFrame:
    """Accepted rows with a date, a cell on the grid, a trimmed mmsi and no missing fishing hours."""
    good = stage.where(F.col("reject_reason").isNull())
    lat, lon = X.snapped(F.col("cell_ll_lat")), X.snapped(F.col("cell_ll_lon"))
    return good.select(X.parsed_day(F.col("date")).alias("date"), lat.alias("cell_ll_lat"), lon.alias("cell_ll_lon"), X.trimmed(F.col("mmsi")).alias("mmsi"), "hours", F.coalesce("fishing_hours", F.lit(0.0)).alias("fishing_hours"), X.cell_id(lat, lon).alias("cell_id"))


def silver(stage: DataFrame, with_sources: bool = False) -> DataFrame:
    """One row per date, cell and vessel; the hours of rows of one key are added up."""
    merged = repaired(stage).groupBy("date", "cell_ll_lat", "cell_ll_lon", "mmsi", "cell_id").agg(F.sum("hours").alias("hours"), F.sum("fishing_hours").alias("fishing_hours"), F.count(F.lit(1)).alias("n_source_rows"))
    out = merged.withColumns({"fishing_ratio": X.ratio(F.col("fishing_hours"), F.col("hours")), "year": F.year("date"), "month": F.month("date")})
    return out.select(*SILVER, *(["n_source_rows"] if with_sources else []))


def duplicate_stats(stage: DataFrame) -> DataFrame:
    n = F.col("n_source_rows")
    return silver(stage, True).agg(F.count_if(n > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(n > 1, n - 1)), F.lit(0)).alias("duplicate_rows_merged"))


def month_summary(stage: DataFrame) -> DataFrame:
    """Per month of the file date: rows in, refused, accepted and repaired; and rows out of the merge of duplicates, whose months are those of their date."""
    month = lambda c: (F.year(c).alias("year"), F.month(c).alias("month"))
    rows = stage.groupBy(*month("file_date")).agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("reject_reason").isNotNull()).alias("quarantined_rows"), *(F.count_if(test).alias(name) for name, test in _repairs().items()))
    out = silver(stage).groupBy("year", "month").agg(F.count(F.lit(1)).alias("output_rows"))
    both = rows.join(out, (rows["year"] == out["year"]) & (rows["month"] == out["month"]), "left").drop(out["year"], out["month"])
    return both.withColumn("output_rows", F.coalesce("output_rows", F.lit(0)))


def year_summary(months: DataFrame) -> DataFrame:
    """The sums of a year's months, and their number."""
    return months.groupBy("year").agg(F.count(F.lit(1)).alias("months"), *(F.sum(c).alias(c) for c in months.columns if c not in ("year", "month")))


def missing_days(bronze: DataFrame) -> DataFrame:
    """Years whose files do not cover the calendar: found and expected days."""
    y = F.col("year")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = bronze.where(F.col("file_date").isNotNull()).groupBy(F.year("file_date").alias("year")).agg(F.countDistinct("file_date").alias("days_found"))
    return days.withColumn("days_expected", F.when(leap, 366).otherwise(365))


def usable_vessels(vessels: DataFrame) -> DataFrame:
    return vessels.where(X.vessel_reject_reason().isNull())


def best_vessel_rows(vessels: DataFrame, row_id: str = "vessel_row_id") -> DataFrame:
    """The usable row of each vessel and year with the most registries (as text), then the most fishing hours, then the smallest id; nulls come last.

    One aggregate that combines map-side, so copies of a hot vessel are thinned out before they move."""
    order = F.struct("registries_listed", "fishing_hours", (-F.col(row_id)).alias("_neg"), F.struct(*vessels.columns).alias("_row"))
    best = usable_vessels(vessels).groupBy(X.trimmed(F.col("mmsi")).alias("_mmsi"), F.col("year").alias("_year")).agg(F.max(order)["_row"].alias("_row"))
    return best.select("_row.*")


def clean_vessels(vessels: DataFrame, years: tuple[int, ...] = YEARS) -> DataFrame:
    return best_vessel_rows(vessels.where(F.col("year").isin(*years))).withColumn("mmsi", X.trimmed(F.col("mmsi")))


def vessel_quarantine(vessels: DataFrame, row_id: str = "vessel_row_id") -> DataFrame:
    """Unusable rows, and usable ones that are not the best of their vessel and year, of all years. row_id must be unique."""
    invalid = vessels.withColumn("reject_reason", X.vessel_reject_reason()).where(F.col("reject_reason").isNotNull())
    doubles = usable_vessels(vessels).join(best_vessel_rows(vessels, row_id).select(row_id), row_id, "left_anti").withColumn("reject_reason", F.lit("duplicate_mmsi_year"))
    return invalid.unionByName(doubles)


def latest_vessels(vessels: DataFrame) -> DataFrame:
    """The row of the latest year of each vessel of a cleaned table; map-side combined, ties to the smallest id."""
    latest = vessels.groupBy("mmsi").agg(F.max(F.struct("year", (-F.col("vessel_row_id")).alias("neg"), "vessel_class_gfw", "flag_gfw", "length_m_gfw", "tonnage_gt_gfw", "engine_power_kw_gfw")).alias("v"))
    return latest.select("mmsi", "v.year", "v.vessel_class_gfw", "v.flag_gfw", "v.length_m_gfw", "v.tonnage_gt_gfw", "v.engine_power_kw_gfw")
