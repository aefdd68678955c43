"""Popularity rankings and ranking metrics. Rankings are rows (mmsi, rank, cell_id); a rank counts from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidelog.session import broadcast_if_small, cut, numbered

EVERYWHERE = "*"
#: Rows of a broadcast head of the catalogues and of a table of groups at most; salts of a larger head.
HEAD, MOST_GROUPS, SALTS = 500_000, 50_000, 32


def catalog(pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """cat, rank, cell_id: cells with hours by hours (to six places), then id; of all vessels, or per group of vessels (mmsi, cat).

    Rows are numbered in one order over all catalogues, spread over many tasks; a catalogue's first number, subtracted,
    gives its ranks."""
    p = pairs.withColumn("cat", F.lit(EVERYWHERE)) if groups is None else pairs.join(groups, "mmsi")
    hours = p.groupBy("cat", "cell_id").agg(F.round(F.sum("hours"), 6).alias("hours")).where(F.col("hours") > 0.0)
    rows = numbered(hours, F.col("cat"), F.col("hours").desc(), F.col("cell_id"))
    first = rows.groupBy("cat").agg(F.min("ix").alias("_first"))
    return rows.join(broadcast_if_small(first, MOST_GROUPS), "cat").select("cat", (F.col("ix") - F.col("_first") + 1).cast("int").alias("rank"), "cell_id")


def topk_unseen(users: DataFrame, ranked: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The first k cells of a user's catalogue that the user has not seen. users: mmsi, cat; ranked: see catalog; seen: mmsi, cell_id.

    At most n_seen of the first k + n_seen entries are seen ones, so each user asks for those ranks only, by an equi-join:
    the rows are as many as seen pairs plus k a user, never users times cells. All users ask for the first ranks: the
    head of the catalogues travels by broadcast up to HEAD rows and is salted beyond."""
    if k < 1:
        raise ValueError("k must be at least 1")
    s = seen.select("mmsi", "cell_id").distinct()
    n = s.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n_seen"))
    who = users.select("mmsi", "cat").distinct().join(n, "mmsi", "left").withColumn("upto", (F.coalesce("n_seen", F.lit(0)) + k).cast("int"))
    head = cut(ranked.join(who.groupBy("cat").agg(F.max("upto").alias("_most")), "cat").where(F.col("rank") <= F.col("_most")).select("cat", "rank", "cell_id"))
    asked = who.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("upto"))))
    if head.limit(HEAD + 1).count() <= HEAD:
        met = asked.join(F.broadcast(head), ["cat", "rank"])
    else:
        salt = F.pmod(F.xxhash64("mmsi"), F.lit(SALTS)).cast("int")
        met = asked.withColumn("_salt", salt).join(head.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cat", "rank", "_salt"])
    open_ = met.join(s, ["mmsi", "cell_id"], "left_anti")
    numbered_ = open_.withColumn("rank", F.row_number().over(Window.partitionBy("mmsi").orderBy("rank")))
    return numbered_.where(F.col("rank") <= k).select("mmsi", "rank", "cell_id")


def popularity(users: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    return topk_unseen(users.select("mmsi").withColumn("cat", F.lit(EVERYWHERE)), catalog(pairs), pairs, k)


def popularity_by_gear(users: DataFrame, pairs: DataFrame, gear: DataFrame, k: int) -> DataFrame:
    """gear: mmsi, gear. A vessel of no or unknown gear, or of one without any catalogue, gets the popularity of all."""
    groups = gear.where(F.col("gear").isNotNull() & ~F.col("gear").isin("", "unknown")).select("mmsi", F.col("gear").alias("cat"))
    ranked = catalog(pairs, groups)
    own = groups.join(ranked.select("cat").distinct(), "cat", "left_semi")
    who = users.select("mmsi").join(own, "mmsi", "left").select("mmsi", F.coalesce("cat", F.lit(EVERYWHERE)).alias("cat"))
    return topk_unseen(who, ranked.unionByName(catalog(pairs)), pairs, k)


def gear_counts(users: DataFrame, gear: DataFrame) -> DataFrame:
    """gear, vessels and fallback (whether they get the popularity of all) of the users; those without a gear are (unknown)."""
    named = F.coalesce(F.nullif(F.col("gear"), F.lit("")), F.lit("(unknown)"))
    counts = users.select("mmsi").distinct().join(gear, "mmsi", "left").groupBy(named.alias("gear")).agg(F.count(F.lit(1)).alias("vessels"))
    return counts.withColumn("fallback", F.col("gear").isin("(unknown)", "unknown"))


def history_ranking(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("mmsi").orderBy(F.round("hours", 6).desc(), "cell_id")
    return pairs.select("mmsi", F.row_number().over(order).alias("rank"), "cell_id")


def metrics(rankings: DataFrame, relevant: DataFrame, catalog_size: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """k, n_eval_users, n_users_in_relevant, n_skipped_empty_relevant, precision, recall, map, coverage, averaged over users with something relevant.

    Users of relevant whose cells are all null have nothing relevant and are skipped.

    Users without a ranking score 0; precision divides by k, however short the ranking. catalog_size: one row, n_items."""
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    named = relevant.select(F.count_distinct("mmsi").alias("n_users_in_relevant"), F.lit(1).alias("_one"))
    truth = relevant.where(F.col("cell_id").isNotNull()).select("mmsi", "cell_id").distinct()
    size = truth.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n_rel"))
    shown = rankings.where(F.col("rank") <= max(ks)).join(size, "mmsi")
    marked = shown.join(truth.withColumn("hit", F.lit(1)), ["mmsi", "cell_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = marked.withColumn("hits_so_far", F.sum("hit").over(Window.partitionBy("mmsi").orderBy("rank")))
    per_k = upto.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    user = per_k.groupBy("k", "mmsi", "n_rel").agg(F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("hits_so_far") / F.col("rank"))).alias("gain"))
    n = size.agg(F.count(F.lit(1)).alias("n_eval_users"))
    sums = user.groupBy("k").agg(F.sum(F.col("hits") / F.col("k")).alias("p"), F.sum(F.col("hits") / F.col("n_rel")).alias("r"), F.sum(F.coalesce("gain", F.lit(0.0)) / F.least("n_rel", "k")).alias("ap"))
    found = per_k.groupBy("k").agg(F.countDistinct("cell_id").alias("distinct_cells"))
    every = n.select("n_eval_users", F.explode(F.array(*map(F.lit, ks))).alias("k"), F.lit(1).alias("_one"))
    out = every.join(sums, "k", "left").join(found, "k", "left").join(catalog_size.select(F.lit(1).alias("_one"), "n_items"), "_one").join(named, "_one")
    mean = lambda c: F.round(F.when(F.col("n_eval_users") > 0, F.coalesce(c, F.lit(0.0)) / F.col("n_eval_users")), 9)
    return out.select("k", "n_eval_users", "n_users_in_relevant", (F.col("n_users_in_relevant") - F.col("n_eval_users")).alias("n_skipped_empty_relevant"), mean("p").alias("precision"), mean("r").alias("recall"), mean("ap").alias("map"), F.round(F.when(F.col("n_items") > 0, F.coalesce("distinct_cells", F.lit(0)) / F.col("n_items")).otherwise(0.0), 9).alias("coverage"))


def leaks_nothing(pairs: DataFrame, relevant: DataFrame, catalog_size: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Metrics of ranking a vessel by its own history on its new grounds, a row per k. If any precision is above 0, the split leaks, which is an error."""
    found = cut(metrics(history_ranking(pairs), relevant, catalog_size, ks))
    if bad := [r["k"] for r in found.where(F.col("precision") > 0.0).collect()]:
        raise ValueError(f"new grounds are in the history of their vessels: precision above 0 at {bad}")
    return found
