"""Queries of the effort pipeline, one per operator, with their SQL for DuckDB.

Landed rows are the interactions with faults put in by row number, so that every reject rule has rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidelog.functions import exprs as X
from tidelog.operators import als, cells, clean, eda, effort, near, ranking, serve
from tidelog.session import cut, shared_dir, table
from tidelog.sources import sinks
from tidelog.sources.geojson import areas, polygon_pieces

SOVEREIGN = "Norvale"


def bronze(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "interactions").select("interaction_id", "date", "cell_ll_lat", "cell_ll_lon", "mmsi", "hours", "fishing_hours")
    f = (F.col("interaction_id") * 31) % 211
    when = lambda c, kind, cases: _cases(f, F.col(c), kind, cases).alias(c)
    null = F.lit(None)
    return i.select(
        "interaction_id", _cases(f, F.col("date").cast("string"), "string", {1: F.lit("no date"), 2: F.lit("1990-01-01")}).alias("date"),
        when("cell_ll_lat", "double", {5: null, 6: F.lit(95.0), 8: F.col("cell_ll_lat") + 0.05}), when("cell_ll_lon", "double", {7: F.lit(200.0)}),
        when("mmsi", "string", {3: F.lit(" "), 4: F.lit("ABC123456"), 13: F.lit("57636")}), when("hours", "double", {9: null, 10: F.lit(-0.1), 14: F.lit(46.5)}),
        when("fishing_hours", "double", {11: F.lit(-1.0), 12: F.col("hours") + 1.0, 15: null}), F.col("date").alias("file_date"),
    )


def _cases(f: F.Column, plain: F.Column, kind: str, cases: dict) -> F.Column:
    out = F
    for n, v in cases.items():
        out = out.when(f == n, v.cast(kind))
    return out.otherwise(plain)


def stage(spark, d):
    return clean.staged(bronze(spark, d))


def silver(spark, d):
    return clean.silver(stage(spark, d))


def _layer(spark: SparkSession, d: str, name: str) -> str:
    """Where a layer of the tables in d is stored while this session runs: in the shared folder, under what tells this state of the interactions from another."""
    status = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/interactions.parquet")
    at = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status)
    state = f"{at.getPath()}|{at.getLen()}|{at.getModificationTime()}"
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:16]}"


def stored_silver(spark, d):
    """The silver table by month, written when it is first asked for; filters on year, month, hours and ratio reach its scan."""
    path = _layer(spark, d, "silver")
    if not sinks.exists(spark, path):
        sinks.write_months(silver(spark, d).select(*clean.SILVER), path)
    return spark.read.parquet(path).select(*clean.SILVER)


def stored_events(spark, d):
    """The fishing events by month, from the silver table, which is not stored for them alone."""
    path = _layer(spark, d, "events")
    if not sinks.exists(spark, path):
        rows = stored_silver(spark, d) if sinks.exists(spark, _layer(spark, d, "silver")) else silver(spark, d)
        sinks.write_months(rows.where(effort.is_event()).select("mmsi", "cell_id", "date", "fishing_hours", "year", "month"), path)
    return spark.read.parquet(path)


def vessels(spark, d):
    return clean.clean_vessels(table(spark, d, "vessels"))


def events(spark, d, sovereign=None):
    return effort.in_scope(stored_events(spark, d), table(spark, d, "cells"), sovereign).select("mmsi", "cell_id", "date", "fishing_hours", "year")


def kept_events(spark, d):
    return events(spark, d)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def quarantine_rows(spark, d):
    return clean.quarantined(stage(spark, d)).select("interaction_id", "reject_reason")


def silver_merge(spark, d):
    return rounded(silver(spark, d), "hours", "fishing_hours", "fishing_ratio")


def vessel_dedupe(spark, d):
    return vessels(spark, d).select("vessel_row_id", "mmsi", "year", "vessel_class_gfw")


def vessel_quarantine(spark, d):
    return clean.vessel_quarantine(table(spark, d, "vessels")).select("vessel_row_id", "reject_reason")


def latest_gear(spark, d):
    return clean.latest_vessels(vessels(spark, d)).select("mmsi", "year", "vessel_class_gfw", "flag_gfw")


def _point():
    lat, lon = (F.col(f"cell_ll_{a}") + X.CELL_STEP / 2 for a in ("lat", "lon"))
    return ("cell_id", lat, lon)


def distinct_cells(spark, d):
    return rounded(cells.distinct_cells(stored_silver(spark, d)), "centroid_lat", "centroid_lon")


def pixels(spark, d):
    """Sixteen pixels a cell with a made-up elevation; some hold no data."""
    c = table(spark, d, "cells").select(F.round(F.col("cell_ll_lat") * 10).cast("long").alias("a"), F.round(F.col("cell_ll_lon") * 10).cast("long").alias("b")).distinct()
    p = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    raw = F.pmod(F.col("a") * 17 + F.col("b") * 5 + F.col("i") * 211 + F.col("j") * 97, F.lit(4001)).cast("double") - 4000.0
    nodata = F.pmod(F.col("a") + F.col("b") + F.col("i") + F.col("j"), F.lit(7)) == 0
    return p.select((F.col("a") / 10.0 + 0.0125 + F.col("i") * 0.025).alias("lat"), (F.col("b") / 10.0 + 0.0125 + F.col("j") * 0.025).alias("lon"), F.when(nodata, F.lit(float("nan"))).otherwise(raw).alias("elevation"))


def cell_depth_zonal(spark, d):
    out = cells.attach_depth(table(spark, d, "cells").select("cell_id", "cell_ll_lat", "cell_ll_lon"), pixels(spark, d), (-60.0, -180.0, 60.0, 180.0))
    return rounded(out.select("cell_id", "depth_mean_m", "depth_min_m"), "depth_mean_m")


def _pieces(spark, d, some=None):
    return polygon_pieces(table(spark, d, "protected_areas") if some is None else some)


def cell_eez(spark, d):
    pieces = _pieces(spark, d)
    sized = table(spark, d, "protected_areas").select("area_id", "area_name").join(areas(pieces), "area_id").select("area_id", F.col("area").alias("area_km2"), "area_name")
    return cells.smallest_area(table(spark, d, "cells"), pieces, sized, _point()).select("cell_id", "area_id", "area_name")


def cell_in_mpa(spark, d):
    marine = cells.marine_areas(table(spark, d, "protected_areas"))
    return cells.attach_mpa(table(spark, d, "cells"), _pieces(spark, d, marine), _point()).select("cell_id", "in_mpa")


def cell_port_distance(spark, d):
    n = cells.nearest(table(spark, d, "cells"), table(spark, d, "anchorages"), _point(), ("s2id", F.col("lat"), F.col("lon")))
    return n.select(F.col("point_id").alias("cell_id"), F.round("distance_m", 3).alias("distance_to_port_m"))


def cell_summary(spark, d):
    return cells.summary(cells.checked(table(spark, d, "cells")))


def cell_territories(spark, d):
    return cells.territories(table(spark, d, "cells"), SOVEREIGN)


def gear_counts(spark, d):
    return ranking.gear_counts(events(spark, d).select("mmsi"), _gear(spark, d))


def serving_cells(spark, d):
    return cells.serving_cells(table(spark, d, "cells"), events(spark, d)).select("cell_id")


def scope_events(spark, d):
    return rounded(events(spark, d, SOVEREIGN).drop("year"), "fishing_hours")


def scope_counts(spark, d):
    return effort.scope_counts(effort.in_scope(stored_silver(spark, d), table(spark, d, "cells"), SOVEREIGN))


def pair_hours(spark, d):
    return rounded(effort.pair_hours(events(spark, d)), "hours")


def matrix_shape(spark, d):
    return effort.matrix_shape(effort.pair_hours(events(spark, d)))


def confidence(spark, d):
    return als.confidence(effort.pair_hours(events(spark, d)), 20.0).select("mmsi", "cell_id", F.round("confidence", 6).alias("confidence"))


def test_relevant(spark, d):
    return rounded(effort.test_relevant(kept_events(spark, d)), "fishing_hours")


def protocol_stats(spark, d):
    return effort.protocol_stats(effort.test_relevant(kept_events(spark, d)))


def new_ground_window(spark, d):
    return effort.new_grounds(kept_events(spark, d), effort.VAL_START, effort.TEST_START)


def _split(spark, d):
    e = kept_events(spark, d)
    return e, cut(effort.pair_hours(e, effort.TEST_START))


def _gear(spark, d):
    return clean.latest_vessels(vessels(spark, d)).select("mmsi", F.col("vessel_class_gfw").alias("gear"))


def popularity_topk(spark, d):
    e, pairs = _split(spark, d)
    return ranking.popularity(e.select("mmsi").distinct(), pairs, 10)


def popularity_by_gear_topk(spark, d):
    e, pairs = _split(spark, d)
    return ranking.popularity_by_gear(e.select("mmsi").distinct(), pairs, _gear(spark, d), 10)


def _warm(e):
    return effort.test_relevant(e).where("is_new_ground AND NOT is_cold_start")


def _size(e):
    return e.agg(F.countDistinct("cell_id").alias("n_items"))


def ranking_metrics(spark, d):
    e, pairs = _split(spark, d)
    return ranking.metrics(cut(ranking.popularity(e.select("mmsi").distinct(), pairs, 50)), _warm(e), _size(e))


def gear_cold_metrics(spark, d):
    e, pairs = _split(spark, d)
    return ranking.metrics(cut(ranking.popularity_by_gear(e.select("mmsi").distinct(), pairs, _gear(spark, d), 50)), effort.test_relevant(e).where("is_cold_start"), _size(e))


def leak_check(spark, d):
    e, pairs = _split(spark, d)
    return ranking.leaks_nothing(pairs, _warm(e), _size(e)).select("k", "precision")


def history_ranking(spark, d):
    return ranking.history_ranking(_split(spark, d)[1])


def season_climatology(spark, d):
    return rounded(effort.climatology(events(spark, d)), "predicted_hours")


def season_weights(spark, d):
    return effort.season_weights(cut(effort.climatology(events(spark, d)))).select("season", "cell_id", F.round("weight", 6).alias("weight"))


def store(spark, d, factors: bool = False) -> serve.Store:
    """What the service reads; each part is made when it is asked for, the factors are read from the stored model."""
    parts = {
        "events": lambda: events(spark, d), "train": lambda: effort.pair_hours(events(spark, d), effort.TEST_START), "cells": lambda: table(spark, d, "cells"),
        "vessels": lambda: cut(vessels(spark, d)), "latest": lambda: cut(clean.latest_vessels(vessels(spark, d))),
    }
    if factors:
        parts |= {"users": lambda: stored_model(spark, d)[0], "items": lambda: stored_model(spark, d)[1]}
    return serve.Store(**parts)


def stored_model(spark, d):
    """The factors of the training window with the defaults of fit_als, fitted and stored when they are first asked for."""
    path = _layer(spark, d, "model")
    if not sinks.exists(spark, f"{path}/items"):
        als.save_model(path, *als.fit_als(_split(spark, d)[1]))
    return als.load_model(spark, path)


def _busiest(s: serve.Store) -> str:
    return s.events.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "mmsi").first()["mmsi"]


def vessel_list(spark, d):
    return serve.vessels(store(spark, d), q="28", limit=50)


def vessel_detail(spark, d):
    s = store(spark, d)
    return serve.vessel(s, _busiest(s)).select("mmsi", "gear", "flag", "active_days", F.transform("top_cells", lambda x: x["cell_id"])[0].alias("top_cell"))


def vessel_history(spark, d):
    s = store(spark, d)
    return serve.history(s, _busiest(s))


def cell_top_gear(spark, d):
    return serve.top_gear(store(spark, d)).select("cell_id", "rank", "gear")


def cell_detail(spark, d):
    s = store(spark, d)
    return serve.cell(s, s.events.orderBy(F.round("fishing_hours", 6).desc(), "cell_id").first()["cell_id"]).withColumn("top_gear_types", F.array_join("top_gear_types", ","))


def mpa_cells(spark, d):
    return serve.mpa_cells(store(spark, d), -180.0, -60.0, 180.0, 60.0, 500)


def forecast(spark, d):
    return serve.forecast(store(spark, d), "spring", True, 80).select("cell_id", "lat", "lon", "predicted_hours", "season")


def engine_stats(spark, d):
    return serve.stats(store(spark, d))


def health(spark, d):
    return serve.health(store(spark, d, True))


def recommendations(spark, d):
    s = store(spark, d, True)
    return serve.recommendations(s, _busiest(s), 20, True, "summer")


def anomalies(spark, d):
    return serve.anomalies(store(spark, d, True))


def als_fit(spark, d):
    e, pairs = _split(spark, d)
    return als.fit_als(pairs)[0]


def als_recommend(spark, d):
    e, pairs = _split(spark, d)
    users, items = als.fit_als(pairs)
    return als.recommend(users, items, pairs, 10)


def _folded(spark, d, tuned=False):
    e, pairs = _split(spark, d)
    users, items = als.fit_als(pairs, **(_tuned(e)[0] if tuned else {}))
    features, _, _ = als.encode_vessels(e.select("mmsi").distinct(), clean.latest_vessels(vessels(spark, d)))
    features = cut(features)
    return e, pairs, users, items, als.fold_in(features, als.fit_foldin(features, users))


def foldin_fit(spark, d):
    return _folded(spark, d)[4]


def hybrid_recommend(spark, d):
    e, pairs, users, items, folded = _folded(spark, d)
    return als.recommend(als.hybrid_factors(users, folded), items, pairs, 10)


def als_metrics(spark, d):
    """Fourteen rows of metrics, at 10 and at 50: each model on warm and on cold vessels, fitted with the best setting of the grid.

    Only the vessels that a protocol evaluates are ranked; metrics() leaves others out."""
    e, pairs, users, items, folded = _folded(spark, d, tuned=True)
    relevant = cut(effort.test_relevant(e))
    warm, cold = relevant.where("is_new_ground AND NOT is_cold_start"), relevant.where("is_cold_start")
    size = cut(_size(e))
    asked = cut(warm.unionByName(cold).select("mmsi").distinct())
    users, folded = cut(als.only(users, asked)), cut(als.only(folded, asked))
    seen = cut(als.seen_numbers(als.only(pairs, asked), items))
    zero = folded.select("mmsi", F.transform("f", lambda x: x * 0.0).alias("f"))
    ranked = {"als": als.hybrid_factors(users, zero), "content": folded, "hybrid": als.hybrid_factors(users, folded)}
    ranked = {name: als.recommend(f, items, seen, 50) for name, f in ranked.items()}
    ranked["popularity_by_gear"] = cut(ranking.popularity_by_gear(als.only(e, cold).select("mmsi").distinct(), pairs, _gear(spark, d), 50))
    out = None
    for model, protocol in (("als", "warm"), ("als", "cold"), ("content", "warm"), ("content", "cold"), ("popularity_by_gear", "cold"), ("hybrid", "warm"), ("hybrid", "cold")):
        m = ranking.metrics(ranked[model], warm if protocol == "warm" else cold, size, (10, 50)).withColumns({"model": F.lit(model), "protocol": F.lit(protocol)})
        out = m if out is None else out.unionByName(m)
    return out


def _tuned(e):
    """The best setting of als.GRID on the validation window, and all trials."""
    pairs, relevant = cut(effort.pair_hours(e, effort.VAL_START)), cut(effort.new_grounds(e, effort.VAL_START, effort.TEST_START))
    size = cut(_size(e))
    score = lambda rankings, rel: ranking.metrics(rankings, rel, size, (10,)).first()["precision"]
    return als.tune(pairs, relevant, score)


def als_tune(spark, d):
    """The trials of the whole grid on the validation window; als_metrics refits with the best."""
    best, trials = _tuned(kept_events(spark, d))
    return spark.createDataFrame([(p["factors"], p["regularization"], p["alpha"], v, p == best) for p, v in trials], "factors int, regularization double, alpha double, precision double, best boolean")


def vessel_features(spark, d):
    features, gears, flags = als.encode_vessels(events(spark, d).select("mmsi").distinct(), clean.latest_vessels(vessels(spark, d)))
    n = len(gears) + len(flags)
    return features.select("mmsi", F.round(F.aggregate(F.slice("x", 2, n) if n else F.array(F.lit(0.0)), F.lit(0.0), lambda s, v: s + v), 6).alias("levels_set"), *(F.round(F.element_at("x", -3 + i), 6).alias(c) for i, c in enumerate(als.NUMBERS)))


def _stand_ins(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("f"))
    users = e.where("vec_id < 100").select(F.col("vec_id").cast("string").alias("mmsi"), "f")
    items = e.where("vec_id >= 100").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("cell_id"), "f")
    pairs = table(spark, d, "embeddings").where("vec_id >= 100").select(F.pmod(F.col("vec_id") * 7, F.lit(100)).cast("string").alias("mmsi"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("cell_id"), (F.col("vec_id") % 13 + 1).cast("double").alias("hours"))
    return users, items, pairs


def factor_recommendations(spark, d):
    """Recommendations with the embeddings as factors: those of the first vectors for vessels, the others for the cells in the order of their ids."""
    vectors, _, _ = _stand_ins(spark, d)
    grid = als.indexed(table(spark, d, "cells"), "cell_id").select("cell_id", (F.col("ix") + 100).cast("long").alias("vec_id"))
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("f"))
    items = grid.join(e, "vec_id").select("cell_id", "f")
    seen = grid.select(F.pmod(F.col("vec_id") * 7, F.lit(100)).cast("string").alias("mmsi"), "cell_id")
    latest = vectors.select("mmsi", F.when(F.col("mmsi") == "7", "drifting_longlines").alias("vessel_class_gfw"))
    s = serve.Store(events=lambda: events(spark, d), train=seen, cells=table(spark, d, "cells"), latest=latest, users=vectors, items=items)
    return rounded(serve.recommendations(s, "7", 20, True, "summer"), "score", "distance_to_port")


def als_solve(spark, d):
    """The vessels' side of one half step with two factors, from given factors of the cells."""
    _, items, pairs = _stand_ins(spark, d)
    users, coded = als.indexed(pairs, "mmsi"), cut(als.indexed(items, "cell_id").join(items, "cell_id").select("cell_id", "ix", F.slice("f", 1, 2).alias("f")))
    rows = als.confidence(pairs.join(users.withColumnRenamed("ix", "u"), "mmsi").join(coded.withColumnRenamed("ix", "i"), "cell_id").select("u", "i", "hours"), 20.0)
    x = als._half_step(als._grouped(rows, "u", "i"), coded.select("ix", "f"), 2, 0.1, coded.count())
    return users.join(x, "ix").select("mmsi", *(F.round(F.get("f", F.lit(k)), 6).alias(f"f{k}") for k in (0, 1)))


def foldin_solve(spark, d):
    """Factors folded in from an intercept and one number, by the ridge weights of the vessels that have factors (every third has none)."""
    users, _, _ = _stand_ins(spark, d)
    n = F.col("mmsi").cast("int")
    features = users.select("mmsi", F.array(F.lit(1.0), (n % 10) / 10.0).alias("x"))
    own = users.where(n % 3 != 0).select("mmsi", F.slice("f", 1, 2).alias("f"))
    folded = als.hybrid_factors(own, als.fold_in(features, als.fit_foldin(features, own)))
    return folded.select("mmsi", *(F.round(F.get("f", F.lit(k)), 6).alias(f"f{k}") for k in (0, 1)))


def factor_scores(spark, d):
    users, items, pairs = _stand_ins(spark, d)
    return rounded(als.pair_scores(pairs, users, items), "score")


def factor_topk(spark, d):
    users, items, pairs = _stand_ins(spark, d)
    return als.recommend(users, items, pairs, 10).select("mmsi", "rank", "cell_id")


def anomaly_scores(spark, d):
    users, items, pairs = _stand_ins(spark, d)
    dated = pairs.select("mmsi", "cell_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("hours") * 20).cast("int")).alias("date"))
    return rounded(serve.lowest_scores(als.pair_scores(pairs, users, items), dated, "2024-02-01", "2024-08-01", 20), "score")


def _eda(name, *more):
    def run(spark, d):
        own = [m(spark, d) if callable(m) else m for m in more]
        return getattr(eda, name)(stored_silver(spark, d), *own)

    return run


GEARS = ["trawlers", "drifting_longlines", "set_gillnets"]
QUERIES = {
    "reject_histogram": lambda s, d: clean.reject_histogram(stage(s, d)),
    "accepted_repairs": lambda s, d: clean.repair_counts(stage(s, d)),
    "duplicate_stats": lambda s, d: clean.duplicate_stats(stage(s, d)),
    "month_summary": lambda s, d: clean.month_summary(stage(s, d)),
    "year_summary": lambda s, d: clean.year_summary(clean.month_summary(stage(s, d))),
    "missing_days": lambda s, d: clean.missing_days(bronze(s, d)),
    **{f.__name__: f for f in (
        quarantine_rows, silver_merge, vessel_dedupe, vessel_quarantine, latest_gear, distinct_cells, cell_depth_zonal, cell_eez, cell_in_mpa, cell_port_distance, cell_summary, cell_territories, gear_counts, serving_cells, scope_events, scope_counts, pair_hours, matrix_shape, confidence,
        test_relevant, protocol_stats, new_ground_window, popularity_topk, popularity_by_gear_topk, ranking_metrics, gear_cold_metrics, leak_check, history_ranking, season_climatology, season_weights, vessel_list, vessel_detail, vessel_history, cell_top_gear,
        cell_detail, mpa_cells, forecast, engine_stats, health, recommendations, factor_recommendations, anomalies, als_fit, als_recommend, foldin_fit, hybrid_recommend, als_metrics, als_tune, als_solve, foldin_solve, vessel_features, factor_scores, factor_topk, anomaly_scores,
    )},
    "eda_inventory": _eda("inventory"),
    "eda_ratio_buckets": _eda("ratio_buckets"),
    "eda_join_coverage": _eda("join_coverage", vessels),
    "eda_unmatched_keys": _eda("unmatched_keys", vessels),
    "eda_gear_effort": _eda("gear_effort", vessels),
    "eda_monthly": _eda("monthly"),
    "eda_monthly_gear": _eda("monthly_gear", vessels, GEARS),
    "eda_degree_bins": _eda("degree_bins"),
    "eda_top_cells": _eda("top_cells"),
    "eda_scope_share": _eda("scope_share", -50.0, -10.0, 110.0, 160.0),
    "eda_hours_tail": _eda("hours_tail"),
    "eda_active_days": _eda("active_days"),
    "eda_mmsi_length": _eda("mmsi_lengths"),
}
