"""Column expressions of the effort pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pipeline.
CELL_STEP = 0.1
OFF_GRID = 1e-4
FISHING_EXCESS = 1e-6
LEAST_RATIO = 0.05
SEASON_FLOOR = 0.25
METRES_PER_MILE = 1852.0
SEASONS = {"summer": (12, 1, 2), "autumn": (3, 4, 5), "winter": (6, 7, 8), "spring": (9, 10, 11)}


# Fixed value: the space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without space separators, of any width, at the ends; tabs stay."""
    return F.btrim(c, F.lit(SPACES))


def parsed_day(c: Column) -> Column:
    """The date of a text like 2023-01-05 or 2023/1/5; null for anything shorter or else."""
    text = F.translate(c, "/", "-")
    return F.when((F.substring_index(text, "-", 2) != text) & ~text.startswith("-"), text.try_cast("date"))


def off_grid(c: Column) -> Column:
    return F.abs(c * F.lit(10.0) - F.rint(c * F.lit(10.0))) > F.lit(OFF_GRID)


def row_reject_reason() -> Column:
    """Why a landed row is refused: the first rule that holds, null if none does. Columns: date (text), file_date, mmsi, cell_ll_lat, cell_ll_lon, hours, fishing_hours."""
    c = F.col
    day, mmsi = parsed_day(c("date")), trimmed(F.col("mmsi"))
    rules = [
        ("invalid_date", day.isNull()),
        ("date_file_mismatch", ~day.eqNullSafe(c("file_date"))),
        ("missing_mmsi", mmsi.isNull() | (mmsi == "")),
        ("mmsi_non_digit", mmsi.rlike("[^0-9]")),
        ("missing_coordinates", c("cell_ll_lat").isNull() | c("cell_ll_lon").isNull()),
        ("lat_out_of_range", ~c("cell_ll_lat").between(-90.0, 90.0)),
        ("lon_out_of_range", ~c("cell_ll_lon").between(-180.0, 180.0)),
        ("off_grid", off_grid(c("cell_ll_lat")) | off_grid(c("cell_ll_lon"))),
        ("missing_hours", c("hours").isNull()),
        ("negative_hours", c("hours") < 0.0),
        ("negative_fishing_hours", c("fishing_hours") < 0.0),
        ("fishing_exceeds_presence", c("fishing_hours") > c("hours") + FISHING_EXCESS),
    ]
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules))


def vessel_reject_reason() -> Column:
    mmsi = trimmed(F.col("mmsi"))
    return F.when(mmsi.isNull() | (mmsi == ""), "missing_mmsi").when(mmsi.rlike("[^0-9]"), "mmsi_non_digit").when(F.col("year").isNull(), "missing_year")


def snapped(c: Column) -> Column:
    """On the grid of tenths of a degree, without a negative zero. Of coordinates near a grid line, as others are refused."""
    return F.rint(c * F.lit(10.0)) / F.lit(10.0) + F.lit(0.0)


def cell_id(lat: Column, lon: Column) -> Column:
    """lat_lon with one decimal each, of coordinates on the grid."""

    def tenths(c: Column) -> Column:
        n = F.rint(c * F.lit(10.0)).cast("int")
        return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 10.0).cast("string"), F.lit("."), (F.abs(n) % 10).cast("string"))

    return F.concat(tenths(lat), F.lit("_"), tenths(lon))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0.0, part / whole).otherwise(F.lit(0.0))


def season_of(day: Column) -> Column:
    """The southern season; December belongs to the summer of its own calendar year."""
    out = F
    for name, months in SEASONS.items():
        out = out.when(F.month(day).isin(*months), name)
    return out


def season_name(name: str | None) -> str | None:
    name = (name or "").strip().lower()
    return name if name in SEASONS else None


def season_weight(hours: Column, peak: Column) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hours / peak))
    return F.when(peak > 0.0, F.lit(SEASON_FLOOR) + F.lit(1.0 - SEASON_FLOOR) * share).otherwise(F.lit(1.0))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nautical_miles(metres: Column) -> Column:
    return finite(metres) / METRES_PER_MILE


def id_coordinate(cell: Column, part: int) -> Column:
    """Latitude (0) or longitude (1) as an id of the form lat_lon spells it; null for other ids."""
    parts = F.split(cell, "_")
    return F.when(F.size(parts) == 2, parts[part].try_cast("double"))


def reason_text(depth: Column, port_m: Column, in_mpa: Column, gear: Column) -> Column:
    """Why a cell is recommended. Numbers are rounded half to even first, as format_string rounds half up."""
    label = F.replace(gear, F.lit("_"), F.lit(" "))
    whole = lambda pattern, x: F.when(x.isNotNull(), F.format_string(pattern, F.rint(x)))
    text = F.concat_ws(", ", whole("%.0fm depth", F.abs(finite(depth))), whole("%.0fnm from port", nautical_miles(port_m)), F.when(in_mpa, "inside a marine protected area"), F.when((label != "") & (label != "unknown"), F.concat(F.lit("typical for "), label)))
    return F.when(text == "", "scored from vessels with similar grounds").otherwise(text)


def between_days(day: Column, start: str | None = None, end: str | None = None, year: Column | None = None) -> Column:
    """start <= day < end; with year, a partition column, also the years that follow from it, so partitions are pruned."""
    test = F.lit(True)
    if start:
        test &= day >= F.lit(start).cast("date")
        if year is not None:
            test &= year >= int(start[:4])
    if end:
        test &= day < F.lit(end).cast("date")
        if year is not None:
            test &= year <= int(end[:4])
    return test
