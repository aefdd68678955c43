"""Column rules shared by the operators: vessel numbers, missing values, normal spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that stand for "no value", in lower case.
NO_VALUE = ["", "-", "--", "?", ".", "na", "n/a", "n.a.", "nan", "nil", "none", "null", "unk", "unknown", "undefined", "missing", "not available", "no data"]

# Exclusive bounds of true measures.
BOUNDS = {"length_m": (0.0, 130.0), "engine_power_kw": (0.0, 8500.0), "tonnage_gt": (0.0, 7500.0)}

# Characters that count as blanks.
BLANKS = " \t\n\x0b\f\r\u00a0\u2007\u202f\u3000\u200b\ufeff"
ANY_BLANK = f"[{BLANKS}]"


def clean_text(c: Column) -> Column:
    """The text without blanks at its ends; null if it is missing."""
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(~F.lower(t).isin(NO_VALUE), t)


def plain_text(c: Column) -> Column:
    """As clean_text, in lower case: the form in which two spellings are compared."""
    return F.lower(clean_text(c))


def measure(c: Column, low: float, high: float) -> Column:
    """The number if it lies strictly between the bounds, else null (NaN is above every number in Spark)."""
    return F.when((c > F.lit(low)) & (c < F.lit(high)), c)


def positive(c: Column) -> Column:
    return F.when((c > F.lit(0.0)) & (c < F.lit(float("inf"))), c)


def vessel_of(c: Column) -> Column:
    """The nine-digit number that c can be read as, else null: blanks, hyphens, a leading word MMSI and a trailing .0 are not part of it."""
    t = F.regexp_replace(F.upper(c), f"^{ANY_BLANK}*(MMSI)?[:#=]?|{ANY_BLANK}+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.0*$", ""), f"[-_]|{ANY_BLANK}", "")
    plain = (F.length(c) == 9) & c.rlike("^[0-9]{9}")  # of most rows, which are spared the rest
    return F.when(plain, c).when(t.rlike("^[0-9]{9}$"), t)


VALUE_RULES = {
    "registries_listed": lambda c: clean_text(c),
    "vessel_class_gfw": lambda c: plain_text(c),
    "flag_gfw": lambda c: plain_text(c),
    "fishing_hours": lambda c: positive(c),
    "length_m_gfw": lambda c: measure(c, *BOUNDS["length_m"]),
    "engine_power_kw_gfw": lambda c: measure(c, *BOUNDS["engine_power_kw"]),
    "tonnage_gt_gfw": lambda c: measure(c, *BOUNDS["tonnage_gt"]),
}


def latest_known(value: Column, known_on: Column, row_id: Column) -> Column:
    """An aggregate: struct(known_on, minus row id, value) of the surviving row, i.e. the latest known_on among rows with a value, ties to the smallest id.

    Rows without known_on come before all others. It combines map-side, so a hot group costs nothing."""
    return F.max(F.when(value.isNotNull(), F.struct(F.coalesce(known_on, F.lit("0001-01-01").cast("date")).alias("at"), (-row_id).alias("neg_id"), value.alias("value"))))
