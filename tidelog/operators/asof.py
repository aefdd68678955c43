"""Attributes as known at event time.

Versions of an entity have a rank and a time from which they count. Sorting an entity's versions by that time and keeping
those that outrank all before gives its validity intervals [from, until). The intervals are cut into time buckets, events
meet them by an equi-join on entity and bucket, and half-open containment picks the one version that was known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOREVER = "9999-12-31"


def validity(versions: DataFrame, entity: Column, start: Column, rank: Column, row_id: Column) -> DataFrame:
    """entity, row_id, valid_from, valid_until: the version with the greatest rank among those that have started.

    rank: a sortable struct that ends in something unique. Versions without entity, start or id are left out. Versions of
    an entity that start on one day are reduced to the best before the window, so a group holds at most one row a day."""
    v = versions.select(entity.alias("entity"), start.cast("date").alias("start"), rank.alias("rank"), row_id.alias("row_id")).where(F.col("entity").isNotNull() & F.col("start").isNotNull() & F.col("row_id").isNotNull())
    v = v.groupBy("entity", "start").agg(F.max(F.struct("rank", "row_id")).alias("best"))
    timeline = Window.partitionBy("entity").orderBy("start")
    before = F.max("best").over(timeline.rowsBetween(Window.unboundedPreceding, -1))
    steps = v.withColumn("before", before).where(F.col("before").isNull() | (F.col("best") > F.col("before")))
    until = F.coalesce(F.lead("start").over(timeline), F.lit(FOREVER).cast("date"))
    return steps.select("entity", F.col("best.row_id").alias("row_id"), F.col("start").alias("valid_from"), until.alias("valid_until"))


def month_of(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def bucketed(intervals: DataFrame, first: int, last: int) -> DataFrame:
    """A row per interval and month bucket between first and last that it overlaps."""
    a = F.greatest(month_of(F.col("valid_from")), F.lit(first))
    b = F.least(month_of(F.date_sub(F.col("valid_until"), 1)), F.lit(last))
    return intervals.where(a <= b).withColumn("bucket", F.explode(F.sequence(a, b)))


def as_known(events: DataFrame, entity: Column, at: Column, timelines: dict[str, DataFrame], span: tuple[int, int]) -> DataFrame:
    """Every event once, with a column per timeline: the row id of the version valid at its time, null if none is.

    span: the first and last month bucket of the events. The bucket is part of the join key, so the events of a hot entity
    are dealt out over its months; AQE splits what is still uneven. Events without entity or time go through the join
    under keys that no version has, spread by their hash. The names of the timelines and _entity, _at, _bucket replace
    columns of the events with these names."""
    spread = F.pmod(F.xxhash64(*events.columns), F.lit(4096)).cast("int")
    e = events.withColumns({"_entity": entity.cast("string"), "_at": at.cast("date"), "_spread": spread}).drop(*timelines)
    known = F.col("_entity").isNotNull() & F.col("_at").isNotNull()
    hit = e.withColumns({"_entity": F.when(known, F.col("_entity")).otherwise(""), "_bucket": F.when(known, month_of(F.col("_at"))).otherwise(-1 - F.col("_spread"))})
    pieces = None
    for name, intervals in timelines.items():  # one join for all timelines: each bucket has a short list per timeline
        b = bucketed(intervals, *span).withColumn("_timeline", F.lit(name))
        pieces = b if pieces is None else pieces.unionByName(b)
    listed = lambda n: F.collect_list(F.when(F.col("_timeline") == n, F.struct("valid_from", "valid_until", "row_id")))
    pieces = pieces.where(F.col("bucket") >= 0).groupBy("entity", "bucket").agg(*(listed(n).alias(n) for n in timelines))
    pieces = pieces.withColumnsRenamed({"entity": "_entity", "bucket": "_bucket"})
    hit = hit.join(pieces, ["_entity", "_bucket"], "left")
    kept = [c for c in events.columns if c not in timelines]
    during = lambda v: (v["valid_from"] <= F.col("_at")) & (F.col("_at") < v["valid_until"])
    return hit.select(*kept, *(F.get(F.filter(F.col(n), during), F.lit(0))["row_id"].alias(n) for n in timelines))
