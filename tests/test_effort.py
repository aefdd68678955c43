import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidelog.functions import exprs as X
from tidelog.functions.values import clean_text, vessel_of
from tidelog.operators import als, clean, effort, ranking, serve
from tidelog.plans import effort as plans

BASE = {"date": "2023-01-01", "cell_ll_lat": -42.3, "cell_ll_lon": 147.1, "mmsi": "503000001", "hours": 2.0, "fishing_hours": 1.0, "file_date": dt.date(2023, 1, 1)}
KINDS = "date string, cell_ll_lat double, cell_ll_lon double, mmsi string, hours double, fishing_hours double, file_date date"


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"date": "2023-01"}, "invalid_date"), ({"date": None}, "invalid_date"), ({"date": "1990-01-01"}, "date_file_mismatch"), ({"mmsi": " "}, "missing_mmsi"), ({"mmsi": None}, "missing_mmsi"), ({"mmsi": "ABC"}, "mmsi_non_digit"), ({"cell_ll_lat": None}, "missing_coordinates"),
    ({"cell_ll_lat": 95.0}, "lat_out_of_range"), ({"cell_ll_lon": 200.0}, "lon_out_of_range"), ({"cell_ll_lat": -42.35}, "off_grid"), ({"hours": None}, "missing_hours"), ({"hours": -0.1}, "negative_hours"), ({"fishing_hours": -1.0}, "negative_fishing_hours"), ({"fishing_hours": 3.0}, "fishing_exceeds_presence"),
    ({"fishing_hours": None}, None), ({"hours": 46.5}, None), ({"mmsi": "57636"}, None), ({"date": "2023/1/1"}, None), ({"mmsi": " 503000001 "}, None),
])
def test_reject_rules(spark, change, reason):
    df = spark.createDataFrame([tuple((BASE | change).values())], KINDS)
    assert clean.staged(df).first()["reject_reason"] == reason


def test_silver(spark):
    rows = [tuple((BASE | c).values()) for c in ({}, {}, {"fishing_hours": None, "cell_ll_lat": -0.00001}, {"hours": -1.0})]
    s = clean.silver(clean.staged(spark.createDataFrame(rows, KINDS))).orderBy("hours").collect()
    assert [(r["cell_id"], r["hours"], r["fishing_ratio"]) for r in s] == [("0.0_147.1", 2.0, 0.0), ("-42.3_147.1", 4.0, 0.5)]
    assert clean.silver(clean.staged(spark.createDataFrame([], KINDS))).count() == 0


def test_vessel_years(spark):
    rows = [(1, "280000001", 2023, "A", 1.0), (2, " 280000001 ", 2023, "B", None), (3, "280000001", 2023, "B", 5.0), (4, "280000001", 2023, "B", 5.0), (5, "280000001", 2020, None, None), (6, "28A", 2023, "A", 1.0), (7, None, 2023, "A", 1.0), (8, "280000001", None, "A", 1.0)]
    df = spark.createDataFrame(rows, "vessel_row_id long, mmsi string, year int, registries_listed string, fishing_hours double")
    assert [r["vessel_row_id"] for r in clean.clean_vessels(df).collect()] == [3]
    got = {r["vessel_row_id"]: r["reject_reason"] for r in clean.vessel_quarantine(df).collect()}
    assert got == {1: "duplicate_mmsi_year", 2: "duplicate_mmsi_year", 4: "duplicate_mmsi_year", 6: "mmsi_non_digit", 7: "missing_mmsi", 8: "missing_year"}
    assert clean.clean_vessels(df.limit(0)).count() == 0


def test_values(spark):
    df = spark.createDataFrame([("280 000 711",), ("MMSI 280008450",), ("280000722.0",), ("280-001671",), ("\t280001457 ",), ("28A",), ("",), (None,), ("2800007220",), ("280000722.5",)], "m string")
    assert [r[0] for r in df.select(vessel_of(F.col("m"))).collect()] == ["280000711", "280008450", "280000722", "280001671", "280001457", None, None, None, None, None]
    df = spark.createDataFrame([(" x ",), ("N/A",), ("",), (None,), (" unknown ",)], "m string")
    assert [r[0] for r in df.select(clean_text(F.col("m"))).collect()] == ["x", None, None, None, None]


def test_exprs(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.season_weight(F.lit(0.0), F.lit(10.0))) == 0.25 and get(X.season_weight(F.lit(10.0), F.lit(10.0))) == 1.0 and get(X.season_weight(F.lit(1.0), F.lit(0.0))) == 1.0
    assert X.season_name(" Winter ") == "winter" and X.season_name("x") is None and X.season_name(None) is None
    assert get(X.reason_text(F.lit(-118.5), F.lit(1852.0 * 2.5), F.lit(True), F.lit("set_gillnets"))) == "118m depth, 2nm from port, inside a marine protected area, typical for set gillnets"
    assert get(X.reason_text(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(None).cast("boolean"), F.lit("unknown"))) == "scored from vessels with similar grounds"
    assert get(X.id_coordinate(F.lit("-1.5_20"), 1)) == 20.0 and get(X.id_coordinate(F.lit("bad"), 0)) is None


def rankings(spark, d):
    return spark.createDataFrame([(u, i + 1, c) for u, cells in d.items() for i, c in enumerate(cells)], "mmsi string, rank int, cell_id string")


def test_metrics(spark):
    size = spark.createDataFrame([(4,)], "n_items long")
    truth = spark.createDataFrame([("u", "a"), ("v", "b")], "mmsi string, cell_id string")
    m = ranking.metrics(rankings(spark, {"u": ["x", "a", "y"]}), truth, size, (2,)).first()
    assert (m["n_eval_users"], m["precision"], m["recall"], m["map"], m["coverage"]) == (2, 0.25, 0.5, 0.25, 0.5)
    none = ranking.metrics(rankings(spark, {"u": ["x"]}), truth.limit(0), size, (2,)).first()
    assert none["n_eval_users"] == 0 and none["precision"] is None
    with pytest.raises(ValueError):
        ranking.metrics(rankings(spark, {"u": ["x"]}), truth, size, (0,))


def make_pairs(spark, n_users=40, n_items=25, seed=0):
    rng = random.Random(seed)
    rows = {(f"u{rng.randrange(n_users):03d}", f"c{min(int(rng.expovariate(0.2)), n_items - 1):03d}"): rng.random() * 9 for _ in range(300)}
    return [(u, c, h) for (u, c), h in rows.items()], spark.createDataFrame([(u, c, h) for (u, c), h in rows.items()], "mmsi string, cell_id string, hours double")


def test_topk_unseen_is_brute_force(spark):
    rows, pairs = make_pairs(spark)
    hours = {}
    for _, c, h in rows:
        hours[c] = hours.get(c, 0.0) + h
    order = sorted(hours, key=lambda c: (-round(hours[c], 6), c))
    users = sorted({u for u, _, _ in rows} | {"new"})
    got = {}
    for r in ranking.popularity(spark.createDataFrame([(u,) for u in users], "mmsi string"), pairs, 5).collect():
        got.setdefault(r["mmsi"], {})[r["rank"]] = r["cell_id"]
    for u in users:
        seen = {c for v, c, _ in rows if v == u}
        assert [got.get(u, {})[k] for k in sorted(got.get(u, {}))] == [c for c in order if c not in seen][:5]


def dense_als(rows, rank, alpha, reg, iterations):
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    c = np.ones((len(users), len(items)))
    p = np.zeros_like(c)
    for u, i, h in rows:
        c[users.index(u), items.index(i)] += alpha * np.log1p(h)
        p[users.index(u), items.index(i)] = 1.0
    x, y = np.zeros((len(users), rank)), als.drawn(np.arange(len(items)), rank, 0)
    for _ in range(iterations):
        for u in range(len(users)):
            x[u] = np.linalg.solve(y.T @ np.diag(c[u]) @ y + reg * np.eye(rank), y.T @ (c[u] * p[u]))
        for i in range(len(items)):
            y[i] = np.linalg.solve(x.T @ np.diag(c[:, i]) @ x + reg * np.eye(rank), x.T @ (c[:, i] * p[:, i]))
    return users, items, x, y


def test_als_is_exact_in_every_mode(spark, monkeypatch):
    rows, pairs = make_pairs(spark)
    users, items, x, y = dense_als(rows, 6, 10.0, 0.1, 2)
    for chunk in (50_000, 4):
        monkeypatch.setattr(als, "CHUNK", chunk)
        fu, fi = als.fit_als(pairs, 6, 0.1, 10.0, 2)
        got = {r["mmsi"]: r["f"] for r in fu.collect()}
        assert np.allclose(np.array([got[u] for u in users]) @ y.T, x @ y.T, atol=1e-6)
    top = {}
    for r in als.recommend(fu, fi, pairs, 3, block=7).collect():
        top.setdefault(r["mmsi"], {})[r["rank"]] = r["score"]
    seen = {(u, i) for u, i, _ in rows}
    for k, u in enumerate(users):
        want = sorted((float(s) for i, s in zip(items, x[k] @ y.T) if (u, i) not in seen), reverse=True)[:3]
        assert np.allclose([top[u][j + 1] for j in range(len(want))], want, atol=1e-6)


def test_factor_queries_run_with_the_production_defaults(spark, monkeypatch):
    rows, pairs = make_pairs(spark)
    users, items, x, y = dense_als(rows, min(64, len({c for _, c, _ in rows})), 20.0, 0.1, 12)
    monkeypatch.setattr(plans, "_split", lambda spark, d: (pairs, pairs))
    got = {r["mmsi"]: r["f"] for r in plans.als_fit(spark, "").collect()}
    assert np.allclose(np.array([got[u] for u in users]) @ y.T, x @ y.T, atol=1e-6)
    score = {(r["mmsi"], r["cell_id"]): r["score"] for r in plans.als_recommend(spark, "").collect()}
    assert score and all(abs(s - x[users.index(u)] @ y[items.index(c)]) < 1e-6 for (u, c), s in score.items())


@pytest.fixture
def trained(spark, monkeypatch):
    """Events before, in and after the validation window; every fit is written down and cut to one iteration."""
    days = [dt.date(2024, 3, 1), dt.date(2024, 8, 1), dt.date(2024, 11, 1)]
    rng = random.Random(3)
    rows = {(f"u{u}", f"c{rng.randrange(70):03d}", days[k % 3]): 1.0 + k for u in range(8) for k in range(24)}
    rows |= {("new", f"c{i:03d}", days[2]): 1.0 for i in range(3)}
    e = spark.createDataFrame([(*k, h) for k, h in rows.items()], "mmsi string, cell_id string, date date, fishing_hours double")
    names = [*(f"u{u}" for u in range(8)), "new"]
    vessels = spark.createDataFrame([(k, m, 2024, "trawlers", "NRV", 10.0 + k, 5.0, 3.0) for k, m in enumerate(names)], "vessel_row_id long, mmsi string, year int, vessel_class_gfw string, flag_gfw string, length_m_gfw double, tonnage_gt_gfw double, engine_power_kw_gfw double")
    monkeypatch.setattr(plans, "kept_events", lambda spark, d: e)
    monkeypatch.setattr(plans, "vessels", lambda spark, d: vessels)
    fits, fit = [], als.fit_als
    monkeypatch.setattr(als, "fit_als", lambda pairs, **kw: (fits.append(kw), fit(pairs, **{**kw, "iterations": 1}))[1])
    return fits


def test_tuning_tries_the_grid_and_its_best_is_refitted(spark, trained):
    trials = plans.als_tune(spark, "").collect()
    assert trained == als.GRID and [(r["factors"], r["regularization"], r["alpha"]) for r in trials] == [(g["factors"], g["regularization"], g["alpha"]) for g in als.GRID]
    best = max(trials, key=lambda r: r["precision"])
    assert [r for r in trials if r["best"]] == [best]
    trained.clear()
    plans.als_metrics(spark, "")
    assert trained[:6] == als.GRID and trained[6:] == [{k: best[k] for k in als.GRID[0]}]


def test_models_are_measured_at_both_depths(spark, trained):
    got = {(r["model"], r["protocol"], r["k"]): r["recall"] for r in plans.als_metrics(spark, "").collect()}
    models = {("als", "warm"), ("als", "cold"), ("content", "warm"), ("content", "cold"), ("popularity_by_gear", "cold"), ("hybrid", "warm"), ("hybrid", "cold")}
    assert got.keys() == {(*m, k) for m in models for k in (10, 50)}
    assert all(got[*m, 50] > got[*m, 10] for m in (("als", "warm"), ("content", "warm"), ("hybrid", "warm")))


def test_metrics_rank_only_who_is_evaluated(spark, trained, monkeypatch):
    """u0 has nothing in the test window, so no model ranks it."""
    e = plans.kept_events(spark, "").where("mmsi <> 'u0' OR date < '2024-10-01'").localCheckpoint()
    ranked, recommend = [], als.recommend
    monkeypatch.setattr(plans, "kept_events", lambda spark, d: e)
    monkeypatch.setattr(als, "recommend", lambda users, *more: (ranked.append({r["mmsi"] for r in users.collect()}), recommend(users, *more))[1])
    monkeypatch.setattr(plans, "_tuned", lambda e: ({**als.GRID[0]}, []))
    plans.als_metrics(spark, "")
    assert len(ranked) == 3 and all(r == {*(f"u{u}" for u in range(1, 8)), "new"} for r in ranked[1:]) and "u0" not in ranked[0]


def test_tuning_prepares_the_pairs_once_and_ranks_who_is_scored(spark, monkeypatch):
    _, pairs = make_pairs(spark)
    some = pairs.select("mmsi", "cell_id").where(F.col("mmsi").isin([r[0] for r in pairs.select("mmsi").distinct().orderBy("mmsi").limit(2).collect()]))
    sides, grouped, ranked = [], als._grouped, []
    monkeypatch.setattr(als, "_grouped", lambda p, own, other: (sides.append(own), grouped(p, own, other))[1])
    grid = [{"factors": 3, "alpha": a, "iterations": 1} for a in (10.0, 20.0)]
    als.tune(pairs, some, lambda rankings, relevant: ranked.append({r["mmsi"] for r in rankings.collect()}) or 0.0, grid)
    assert sorted(sides) == ["i", "u"] and ranked == [{r["mmsi"] for r in some.collect()}] * 2


@pytest.mark.parametrize("k", [1, 5, 80])
def test_best_products_are_brute_force(k):
    rng = np.random.default_rng(k)
    y = rng.normal(size=(60, 4)) * rng.exponential(size=(60, 1))
    y[40:50] = y[:10]  # ties
    x = rng.normal(size=(9, 4))
    x[3] = 0.0
    seen = [rng.choice(60, n, False) if n else None for n in (0, 5, 50, 7, 60, 1, 0, 20, 59)]
    norms = np.linalg.norm(y, axis=1)
    row, pos, score = als._best(x, seen, y, np.argsort(-norms, kind="stable"), norms, k, 16)
    for u in range(9):
        s = (x[u] * y).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(60), -s.round(12))) if seen[u] is None or j not in seen[u]][:k]
        assert pos[row == u].tolist() == want and np.allclose(score[row == u], s[want])


def test_few_pairs_are_solved_as_exactly_as_many():
    rng = np.random.default_rng(5)
    table, sizes = rng.normal(size=(50, 12)), np.array([1, 30, 4, 12, 7])
    o, d = rng.integers(0, 50, sizes.sum()), rng.exponential(size=sizes.sum()) * 30
    d[1] = 0.0
    for part, reg in ((table, 0.1), (table * 1e-3, 0.01), (np.where(np.arange(12) < 11, table, 0.0), 1.0)):
        gram, got, at = part.T @ part, als._solved(part, o, d, sizes, part.T @ part, reg), 0
        for n, f in zip(sizes, got, strict=True):
            a, b = als._normal(part[o[at : at + n]], d[at : at + n])
            assert np.allclose(f, np.linalg.solve(a + gram + reg * np.eye(12), b), rtol=1e-8, atol=1e-10)
            at += n


def test_factors_in_files_and_sent_ones_agree(spark, monkeypatch):
    _, pairs = make_pairs(spark)
    got = []
    for mapped in (8 << 30, 0):
        monkeypatch.setattr(als, "MAPPED", mapped)
        users, items = als.fit_als(pairs, 4, 0.1, 10.0, 2)
        got.append((users, {(r["mmsi"], r["rank"]): (r["cell_id"], r["score"]) for r in als.recommend(users, items, pairs, 3, block=9).collect()}))
    (a, first), (b, second) = got
    f = [np.array([r["f"] for r in users.orderBy("mmsi").collect()]) for users in (a, b)]
    assert np.allclose(*f) and first.keys() == second.keys() and all(first[k][0] == second[k][0] and abs(first[k][1] - second[k][1]) < 1e-9 for k in first)


def test_als_by_joins(spark, monkeypatch):
    """With nothing shipped the factors are joined to the pairs; users solved from given item factors agree."""
    rows, pairs = make_pairs(spark, 10, 6)
    y = np.random.default_rng(4).normal(size=(len({r[1] for r in rows}), 3))
    items, users = als.indexed(pairs, "cell_id"), als.indexed(pairs, "mmsi")
    coded = als.confidence(pairs.join(users.withColumnRenamed("ix", "u"), "mmsi").join(items.withColumnRenamed("ix", "i"), "cell_id"), 10.0).select("u", "i", "confidence")
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "ix int, f array<double>")
    grouped = als._grouped(coded, "u", "i")
    shipped = {r["ix"]: r["f"] for r in als._half_step(grouped, factors, 3, 0.1, len(y)).collect()}
    monkeypatch.setattr(als, "SHIPPED", 0)
    joined = {r["ix"]: r["f"] for r in als._half_step(grouped, factors, 3, 0.1, len(y)).collect()}
    assert shipped.keys() == joined.keys() and all(np.allclose(shipped[k], joined[k]) for k in shipped)


def test_fold_in_recovers_a_linear_map(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(60), rng.normal(size=(60, 3))])
    w = rng.normal(size=(4, 2))
    features = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(x)], "mmsi string, x array<double>")
    users = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(x @ w)], "mmsi string, f array<double>")
    assert np.allclose(als.fit_foldin(features, users, 1e-9), w, atol=1e-5)
    assert als.fold_in(features, w).count() == 60


def test_encoding(spark):
    latest = spark.createDataFrame([("a", "trawlers", "NRV", 10.0, None, float("nan")), ("b", None, "TSK", 20.0, 5.0, -3.0)], "mmsi string, vessel_class_gfw string, flag_gfw string, length_m_gfw double, tonnage_gt_gfw double, engine_power_kw_gfw double")
    features, gears, flags = als.encode_vessels(spark.createDataFrame([("a",), ("b",), ("c",)], "mmsi string"), latest)
    got = {r["mmsi"]: r["x"] for r in features.collect()}
    assert gears == ["trawlers"] and flags == ["NRV", "TSK"]
    assert got["a"][:4] == [1.0, 1.0, 1.0, 0.0] and got["c"][:4] == [1.0, 0.0, 0.0, 0.0] and got["b"][-1] == 0.0 and abs(got["a"][-2] - np.log(6)) < 1e-12


def test_split(spark):
    e = spark.createDataFrame([("u", "a", dt.date(2024, 1, 1), 1.0), ("u", "a", dt.date(2024, 11, 1), 2.0), ("u", "b", dt.date(2024, 11, 2), 3.0), ("v", "a", dt.date(2024, 12, 1), 4.0)], "mmsi string, cell_id string, date date, fishing_hours double")
    got = sorted(tuple(r) for r in effort.test_relevant(e).collect())
    assert got == [("u", "a", 2.0, False, False), ("u", "b", 3.0, True, False), ("v", "a", 4.0, True, True)]
    assert effort.new_grounds(e, "2024-06-01", "2024-12-01").collect()[0]["cell_id"] == "b"


def test_serving(spark):
    e = spark.createDataFrame([("u", "1.0_2.0", dt.date(2024, 1, 1), 1.0), ("u", "9.0_9.0", dt.date(2024, 7, 1), 5.0), ("w", "x", dt.date(2024, 7, 1), 5.0)], "mmsi string, cell_id string, date date, fishing_hours double")
    cells = spark.createDataFrame([("1.0_2.0", 1.0, 2.0, -5.0, "Norvale", True, 10.0)], "cell_id string, cell_ll_lat double, cell_ll_lon double, depth_mean_m double, eez_sovereign string, in_mpa boolean, distance_to_port_m double")
    latest = spark.createDataFrame([("u", 2024, "", None, 12.0)], "mmsi string, year int, vessel_class_gfw string, flag_gfw string, length_m_gfw double")
    s = serve.Store(events=e, train=effort.pair_hours(e), cells=cells, latest=latest, vessels=latest)
    v = serve.vessel(s, "u").first()
    assert (v["gear"], v["flag"], v["active_days"], v["top_cells"][0]["cell_id"]) == ("unknown", "UNK", 2, "9.0_9.0")
    assert serve.history(s, "nobody").count() == 0 and serve.vessel(s, "nobody").count() == 0 and serve.history(s, "w").count() == 0
    assert serve.forecast(s, "summer").count() == 0 and serve.forecast(s, "summer", False).count() == 1 and serve.forecast(s, "no season").first()["season"] == "winter"
    assert serve.mpa_cells(s).count() == 1 and serve.mpa_cells(s, 3.0, 0.0, 4.0, 2.0).count() == 0 and serve.mpa_cells(s, west=3.0).count() == 1
    assert serve.stats(s).first()["n_mpa_cells"] == 1 and not serve.health(s).first()["live"] and serve.cell(s, "1.0_2.0").first()["top_gear_types"] == []


def test_a_store_makes_its_parts_when_they_are_asked_for(spark):
    asked = []
    cells = spark.createDataFrame([("1.0_2.0", 1.0, 2.0)], "cell_id string, cell_ll_lat double, cell_ll_lon double")
    s = serve.Store(cells=lambda: asked.append("cells") or cells, events=lambda: asked.append("events") or None)
    assert serve.mpa_cells(s).count() == 0 and serve.mpa_cells(s).count() == 0  # without a column in_mpa no cell is known to be protected
    assert asked == ["cells"]
    for bad in (0, 20_001):
        with pytest.raises(ValueError, match="mpa_cells"):
            serve.mpa_cells(s, limit=bad)


def test_first_factors_do_not_depend_on_the_table():
    whole = als.drawn(np.arange(3_000), 8, 0)
    assert (als.drawn(np.array([17, 2_999]), 8, 0) == whole[[17, 2_999]]).all() and (als.drawn(np.arange(5), 8, 1) != whole[:5]).all()
    assert abs(whole.std() - 0.01) < 3e-4 and abs(whole.mean()) < 3e-4 and np.abs(whole).max() < 0.06


def test_models_are_stored(spark, tmp_path):
    rows, pairs = make_pairs(spark, 6, 5)
    users, items = als.fit_als(pairs, 3, 0.1, 10.0, 1)
    weights = np.arange(6.0).reshape(3, 2)
    als.save_model(str(tmp_path), users, items, weights, pairs)
    u, i = als.load_model(spark, str(tmp_path))
    key = lambda df: sorted((r[0], r["ix"], tuple(r["f"])) for r in df.collect())
    assert key(u) == key(users) and key(i) == key(items) and (als.load_weights(spark, str(tmp_path)) == weights).all()
    assert sorted(map(tuple, als.load_matrix(spark, str(tmp_path)).collect())) == sorted(rows)


def test_large_catalogues_are_salted(spark, monkeypatch):
    rows, pairs = make_pairs(spark, 12, 9)
    users = pairs.select("mmsi").distinct()
    want = sorted(map(tuple, ranking.popularity(users, pairs, 3).collect()))
    monkeypatch.setattr(ranking, "HEAD", 0)
    assert sorted(map(tuple, ranking.popularity(users, pairs, 3).collect())) == want and want


def test_a_leaking_split_is_an_error(spark):
    rows, pairs = make_pairs(spark, 4, 4)
    size = spark.createDataFrame([(4,)], "n_items long")
    with pytest.raises(ValueError, match="new grounds"):
        ranking.leaks_nothing(pairs, pairs, size)
    assert ranking.leaks_nothing(pairs, pairs.limit(0), size).count() == 2
