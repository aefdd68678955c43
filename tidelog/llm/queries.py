"""Queries of the llm operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidelog.llm import distinct, language, leaks, survivor, tokens
from tidelog.plans.training import _VESSEL, _number, _plain
from tidelog.session import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The row whose value survives, per vessel, year and field."""
    return survivor.survivors(table(spark, d, "vessels")).drop("value")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.records(table(spark, d, "vessels"))


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the survivor is found although the dates of a fifth of the records are hidden."""
    return survivor.agreement(table(spark, d, "vessels"), F.pmod(F.xxhash64("vessel_row_id"), F.lit(5)) == 0)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interactions").select("date", "mmsi", "cell_id", "cell_ll_lat", "cell_ll_lon")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vessels and cells per date, month, year, group and union of groups, and vessels per cell, with their standard error."""
    return distinct.distinct_counts(_events(spark, d), cut, texts=distinct.single_cells())


def p5_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable part of each date, vessel group and month, cell group, union, and cell."""
    return distinct.named(distinct.group_sketches(_events(spark, d), cut, texts=distinct.single_cells()))


def p5_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Every exact count but those of single cells, and whether its estimate lies within four standard errors of it."""
    groups, identifiers = distinct.event_groups()
    each = F.array(*(F.struct(F.lit(level).alias("level"), code.cast("long").alias("code")) for level, code in groups.items()))
    two = F.array(*(F.struct(F.lit(what).alias("what"), value.alias("value")) for what, value in identifiers.items()))
    seen = _events(spark, d).select(F.explode(each).alias("g"), two.alias("t")).select("g.*", F.explode("t").alias("v")).select("level", "code", "v.*").where(F.col("code").isNotNull() & F.col("value").isNotNull()).distinct()
    day = F.date_from_unix_date(F.col("code").cast("int"))
    up = lambda level, code: F.struct(F.lit(level).alias("level"), code.cast("long").alias("code"))
    own = F.struct("level", "code")
    all_ = F.when(F.col("level") == "date", F.array(own, up("month", F.year(day) * 12 + F.month(day) - 1), up("year", F.year(day)), up("all", F.lit(0))))
    all_ = all_.when(F.col("level") == "cell_group", F.array(own, up("latitude_band", F.floor(F.col("code") / 100_000)))).otherwise(F.array(own, up("vessel_group", F.floor(F.col("code") / 1_000_000))))
    exact = distinct.named(seen.select(F.explode(all_).alias("u"), "what", "value").select("u.*", "what", "value").distinct().groupBy("level", "code", "what").agg(F.count(F.lit(1)).alias("n")))
    both = exact.join(distinct.distinct_counts(_events(spark, d), cut), ["level", "key", "what"], "full")
    near = F.abs(F.col("estimate") - F.col("n")) <= 4 * F.lit(distinct.ERROR / 2 ** (distinct.P / 2)) * F.col("n")
    return both.select("level", "key", "what", "n", F.coalesce(near, F.lit(False)).alias("within"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item."""
    return p9_leaks(spark, d).where(F.col("longest") >= leaks.LEAST).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item, or with four fifths of its words in passages of five or more, in any order."""
    return leaks.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def _segments(spark: SparkSession, d: str, **more: bool) -> DataFrame:
    return language.language_segments(table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "lang_samples"), **more)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of documents that have several or are labelled otherwise."""
    return language.mislabelled(_segments(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(_segments(spark, d, whole=True))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each run of sentences of one language, with its offsets in the text."""
    return _segments(spark, d, places=True).select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_agreement, p5_counts, p5_sketches, p5_within_bound, p8_ids, p9_found, p9_leaks, p10_found, p10_languages, p10_segments)}

_FIELDS = {
    "registries_listed": f"CASE WHEN ({_plain('registries_listed')}) IS NOT NULL THEN registries_listed END",
    "fishing_hours": "CASE WHEN NOT isnan(fishing_hours) AND fishing_hours > 0 AND fishing_hours < 'inf'::DOUBLE THEN fishing_hours END",
    "flag_gfw": _plain("flag_gfw"),
    "length_m_gfw": _number("length_m_gfw", 0, 130),
}
_GROUPS = f"v AS (SELECT {_VESSEL} AS vessel, * FROM vessels), g AS (SELECT vessel, year FROM v WHERE vessel IS NOT NULL AND year IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"
_LEVELS = [
    *(("date", "CAST(date AS VARCHAR)", "i"), ("month", "ym", "i"), ("year", "CAST(year(date) AS VARCHAR)", "i"), ("all", "CASE WHEN date IS NOT NULL THEN 'all' END", "i")),
    *(("vessel_group_month", "substr(vessel, 1, 3) || '|' || ym", "v"), ("vessel_group", "CASE WHEN date IS NOT NULL THEN substr(vessel, 1, 3) END", "v")),
    *(("cell_group", "a || '_' || b", "i"), ("latitude_band", "CASE WHEN b IS NOT NULL THEN a END", "i")),
]


def _tens(c: str) -> str:
    return f"CAST(CAST(floor({c} / 10) * 10 AS INTEGER) AS VARCHAR)"


SQL = {
    "p3_found": f"WITH {_GROUPS} "
    + " UNION ALL ".join(f"SELECT vessel AS mmsi, year, '{f}' AS field, arg_max(vessel_row_id, (known_on, -vessel_row_id)) AS vessel_row_id FROM v JOIN g USING (vessel, year) WHERE ({rule}) IS NOT NULL GROUP BY ALL" for f, rule in _FIELDS.items()),
    "p3_records": f"WITH v AS (SELECT {_VESSEL} AS vessel, * FROM vessels) SELECT vessel AS mmsi, year, "
    + ", ".join(f"arg_max({value}, (known_on, -vessel_row_id)) FILTER (({rule}) IS NOT NULL) AS {f}, arg_max(vessel_row_id, (known_on, -vessel_row_id)) FILTER (({rule}) IS NOT NULL) AS {f}_row" for f, rule, value in ((f, r, "trim(registries_listed)" if f == "registries_listed" else r) for f, r in _FIELDS.items()))
    + f" FROM v WHERE vessel IS NOT NULL AND year IS NOT NULL GROUP BY ALL HAVING {' OR '.join(f'count({r}) > 0' for r in _FIELDS.values())}",
    "p5_within_bound": f"""WITH i AS (SELECT {_VESSEL} AS vessel, *, strftime(date, '%Y-%m') AS ym, {_tens('cell_ll_lat')} AS a, {_tens('cell_ll_lon')} AS b FROM interactions),
v AS (SELECT * FROM i WHERE vessel IS NOT NULL),
e AS ({" UNION ALL ".join(f"SELECT '{level}' AS level, {key} AS key, vessel, cell_id FROM {source}" for level, key, source in _LEVELS)})
SELECT level, key, what, count(DISTINCT x) AS n, true AS within FROM (SELECT level, key, 'vessels' AS what, vessel AS x FROM e UNION ALL SELECT level, key, 'cells', cell_id FROM e) WHERE x IS NOT NULL AND key IS NOT NULL GROUP BY ALL""",
}
