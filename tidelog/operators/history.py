"""History of changing attributes from periodic snapshots, by Merkle comparison.

A snapshot of a period holds the state of every entity recorded by then: its attributes and the last period in which it was
recorded. Entities fall into leaf buckets by hash. The digest of a leaf is the sum of the hashes of its states, the digest
of a node the sum of the hashes of its children, up to one root. Two snapshots are compared from the roots down into
differing branches only; only the leaf buckets that differ are read, from both snapshots, and diffed entity by entity.
A state that is new or changed opens a version; the last record that the older bucket shows ends the version before. What
is in leaves that do not differ is never looked at, so without the comparison there is no history.

`history` compares all consecutive snapshots of a table of states in one plan, `append_snapshot` compares a new snapshot
with the stored one before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidelog.functions.values import latest_known
from tidelog.session import cut

FANOUT_BITS, MOST_LEVELS = 4, 7
LOW, WIDE = (1 << 32) - 1, (1 << 48) - 1


def recorded_states(df: DataFrame, entity: Column, period: Column, values: dict[str, Column], known_on: Column, row_id: Column) -> DataFrame:
    """entity, period and the chosen value of each attribute for every recorded period.

    Of a period's rows the value known latest survives (ties: smallest id). A missing value goes on from the entity's last
    earlier period that has it or, before the first, from the first. Rows without entity or period are left out. An entity
    has at most one row per period before the windows run."""
    chosen = df.select(entity.alias("entity"), period.cast("int").alias("period"), known_on.alias("_known"), row_id.alias("_id"), *(v.alias(n) for n, v in values.items()))
    chosen = chosen.where(F.col("entity").isNotNull() & F.col("period").isNotNull()).groupBy("entity", "period").agg(*(latest_known(F.col(n), F.col("_known"), F.col("_id"))["value"].alias(n) for n in values))
    order = Window.partitionBy("entity").orderBy("period")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return chosen.select("entity", "period", *(F.coalesce(F.last(n, True).over(before), F.first(n, True).over(after)).alias(n) for n in values))


def levels_for(entities: int, bits: int = FANOUT_BITS) -> int:
    """So many levels below the root that a leaf holds one entity on average, within MOST_LEVELS; the result of a comparison does not depend on it."""
    return min(MOST_LEVELS, max(1, math.ceil(math.log2(max(entities, 2)) / bits)))


def leaf_of(entity: Column, bits: int, levels: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(entity), 64 - bits * levels).cast("int")


def snapshots(states: DataFrame, attributes: list[str], periods: list[int], bits: int, levels: int) -> DataFrame:
    """period, leaf, entity, seen (last recorded period) and attributes: for every period, all entities recorded by then.

    A recorded state goes into its own snapshot and the later ones up to the entity's next record."""
    until = F.lead("period").over(Window.partitionBy("entity").orderBy("period"))
    held = states.withColumn("_until", until)
    every = F.array(*map(F.lit, periods)) if periods else F.array().cast("array<int>")
    at = F.filter(every, lambda p: (p >= F.col("period")) & (F.col("_until").isNull() | (p < F.col("_until"))))
    return held.select(F.explode(at).alias("at"), F.col("period").alias("seen"), "entity", *attributes).select(F.col("at").alias("period"), leaf_of(F.col("entity"), bits, levels).alias("leaf"), "entity", "seen", *attributes)


def _halves(h: Column) -> tuple[Column, Column]:
    """The sums of the lower and upper 32 bits of hashes, modulo 2^48, so no sum overflows at any level."""
    low, high = F.sum(h.bitwiseAND(F.lit(LOW))), F.sum(F.shiftrightunsigned(h, 32))
    return low.bitwiseAND(F.lit(WIDE)).alias("low"), high.bitwiseAND(F.lit(WIDE)).alias("high")


def trees(snapshot: DataFrame, attributes: list[str], bits: int, levels: int) -> list[DataFrame]:
    """Per level, from the root to the leaves: period, node, low, high."""
    state = F.xxhash64("entity", *(F.coalesce(F.col(a).cast("string"), F.lit("\0")) for a in attributes))
    level = [cut(snapshot.groupBy("period", F.col("leaf").alias("node")).agg(*_halves(state)))]
    for _ in range(levels):
        child = F.xxhash64("node", "low", "high")
        level.append(level[-1].groupBy("period", F.shiftright("node", bits).alias("node")).agg(*_halves(child)))
    return level[::-1]


def differing(level: list[DataFrame], pairs: list[tuple[int | None, int]], bits: int) -> DataFrame:
    """(period, leaf): the leaves of each later snapshot that differ from the earlier one of its pair; None is the empty snapshot.

    At each level only the children of differing nodes are compared. Equal digests mean equal states, but for a collision
    of hashes of 64 bits."""
    role = F.array(
        *(F.struct(F.lit(now).alias("period"), F.lit(now).alias("of"), F.lit(1).alias("now")) for _, now in pairs),
        *(F.struct(F.lit(now).alias("period"), F.lit(was).alias("of"), F.lit(0).alias("now")) for was, now in pairs if was is not None),
    ) if pairs else F.array().cast("array<struct<period: int, of: int, now: int>>")
    branches = None
    for nodes in level:
        sides = nodes.withColumn("_r", F.explode(F.filter(role, lambda r: r["of"] == F.col("period")))).select("_r.period", "_r.now", "node", "low", "high")
        if branches is not None:
            parents = branches.select("period", F.col("node").alias("_parent"))
            sides = sides.withColumn("_parent", F.shiftright("node", bits)).join(parents, ["period", "_parent"], "left_semi").drop("_parent")
        side = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c)))
        both = sides.groupBy("period", "node").agg(*(side(c, n).alias(f"{c}{n}") for c in ("low", "high") for n in (0, 1)))
        branches = both.where(~(F.col("low0").eqNullSafe(F.col("low1")) & F.col("high0").eqNullSafe(F.col("high1")))).select("period", "node")
    return branches.withColumnRenamed("node", "leaf")


def opened(before: DataFrame, after: DataFrame, attributes: list[str]) -> DataFrame:
    """entity, period, attributes and ended (the last record of the version before) of states that are new or changed; both sides: period (of the later snapshot), entity, seen, attributes."""
    was = before.select("period", "entity", F.col("seen").alias("_seen"), F.struct(*attributes).alias("_was"))
    both = after.join(was, ["period", "entity"], "left")
    return both.where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.struct(*attributes))).select("entity", "period", *attributes, F.col("_seen").alias("ended"))


def versions(starts: DataFrame, last: DataFrame, attributes: list[str]) -> DataFrame:
    """entity, valid_from, valid_to and attributes, from what was opened and the last snapshot, whose records end the open versions."""
    order = Window.partitionBy("entity").orderBy("period")
    end = F.lead("ended").over(order)
    closed = starts.withColumn("_end", end).join(last.select("entity", F.col("seen").alias("_last")), "entity", "left")
    return closed.select("entity", F.col("period").alias("valid_from"), F.coalesce("_end", "_last").alias("valid_to"), *attributes)


def history(states: DataFrame, attributes: list[str], bits: int = FANOUT_BITS, levels: int | None = None) -> DataFrame:
    """entity, valid_from, valid_to (first and last recorded period) and the attributes of every version; null-safe comparison of attributes.

    Periods without a record do not end a version. No states, no versions. What comes to the driver is the list of periods
    and a count; states should be cheap to read (a checkpoint)."""
    known = states.agg(F.sort_array(F.collect_set("period")).alias("periods"), F.approx_count_distinct("entity").alias("n")).first()
    periods = list(known["periods"])
    levels = levels or levels_for(known["n"], bits)
    stored = cut(snapshots(states, attributes, periods, bits, levels))
    pairs = list(zip([None, *periods], periods, strict=False))
    leaves = cut(differing(trees(stored, attributes, bits, levels), pairs, bits))
    follows = {was: now for was, now in pairs if was is not None}
    after = stored.join(leaves, ["period", "leaf"], "left_semi")
    later = F.create_map(*(F.lit(x) for p in follows.items() for x in p))[F.col("period")] if follows else F.lit(None).cast("int")
    before = stored.withColumn("period", later).join(leaves, ["period", "leaf"], "left_semi")
    last = stored.where(F.col("period") == (periods[-1] if periods else 0))
    return versions(opened(before, after, attributes), last, attributes)


def append_snapshot(spark: SparkSession, path: str, period: int, snapshot: DataFrame, attributes: list[str], bits: int = FANOUT_BITS, levels: int = 4) -> int:
    """Store a snapshot (entity, seen, attributes) below path, compare it with the latest stored one, append what it opened. Gives the number of leaves that were read.

    Stored are states/period=…, digests/level=…/period=… and opened/period=…; a period that is appended again replaces
    itself. `stored_history` gives the versions. All snapshots of a path need the same bits and levels."""
    kept = sorted(p for p in _periods(spark, f"{path}/states") if p < period)
    was = kept[-1] if kept else None
    bucketed = snapshot.select(F.lit(period).alias("period"), leaf_of(F.col("entity"), bits, levels).alias("leaf"), "entity", "seen", *attributes)
    _write(bucketed.repartition("leaf").sortWithinPartitions("leaf"), f"{path}/states/period={period}")
    now = spark.read.parquet(f"{path}/states/period={period}").withColumn("period", F.lit(period))
    for i, nodes in enumerate(trees(now, attributes, bits, levels)):
        _write(nodes, f"{path}/digests/level={i}/period={period}")
    read = lambda i, p: spark.read.parquet(f"{path}/digests/level={i}/period={p}").withColumn("period", F.lit(p))
    level = [read(i, period) if was is None else read(i, period).unionByName(read(i, was)) for i in range(levels + 1)]
    leaves = cut(differing(level, [(was, period)], bits))
    n = leaves.count()
    after = now.join(leaves.select("leaf"), "leaf", "left_semi")
    before = now.limit(0) if was is None else spark.read.parquet(f"{path}/states/period={was}").withColumn("period", F.lit(period)).join(leaves.select("leaf"), "leaf", "left_semi")
    _write(opened(before, after, attributes), f"{path}/opened/period={period}")
    return n


def stored_history(spark: SparkSession, path: str, attributes: list[str]) -> DataFrame:
    """The versions of all snapshots that were appended below path."""
    periods = sorted(_periods(spark, f"{path}/states"))
    parts = [spark.read.parquet(f"{path}/opened/period={p}").withColumn("period", F.lit(p)) for p in periods]
    starts = parts[0]
    for p in parts[1:]:
        starts = starts.unionByName(p)
    return versions(starts, spark.read.parquet(f"{path}/states/period={periods[-1]}"), attributes)


def _write(df: DataFrame, path: str) -> None:
    df.drop("period").write.mode("overwrite").parquet(path)


def _periods(spark: SparkSession, path: str) -> list[int]:
    """The periods below path that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [int(x.getName().split("=")[1]) for x in done if "=" in x.getName()]
