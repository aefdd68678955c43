import datetime as dt
import random

from pyspark.sql import functions as F
from tidelog.operators import history as history_module
from tidelog.operators.asof import as_known, month_of, validity
from tidelog.operators.history import append_snapshot, history, recorded_states, stored_history


def day(n):
    return dt.date(2023, 1, 1) + dt.timedelta(days=n)


def test_as_known_is_brute_force(spark):
    rng = random.Random(5)
    versions = [(i, rng.choice("abc") if rng.random() < 0.95 else None, rng.choice([2021, 2022, 2023, 2024]), day(rng.randint(-300, 700)) if rng.random() < 0.95 else None) for i in range(300)]
    events = [(i, rng.choice(["a", "a", "b", "c", "d", None]), day(rng.randint(0, 720)) if rng.random() < 0.98 else None, "x") for i in range(500)]
    v = spark.createDataFrame(versions, "id long, who string, year int, known_on date")
    e = spark.createDataFrame(events, "event long, who string, at date, known string")
    begins = F.make_date("year", F.lit(1), F.lit(1))
    start = F.when(F.col("known_on").isNotNull(), F.greatest("known_on", begins))
    known = validity(v, F.col("who"), start, F.struct("year", "known_on", -F.col("id")), F.col("id"))
    low, high = (e.agg(month_of(f("at"))).first()[0] for f in (F.min, F.max))
    got = {r["event"]: r["known"] for r in as_known(e, F.col("who"), F.col("at"), {"known": known}, (low, high)).collect()}

    def best(who, at):
        ok = [(y, k, -i) for i, w, y, k in versions if w is not None and w == who and k is not None and at is not None and k <= at and y <= at.year]
        return -max(ok)[2] if ok else None

    assert got == {i: best(w, at) for i, w, at, _ in events}
    assert len(got) == len(events)
    assert as_known(e.limit(0), F.col("who"), F.col("at"), {"known": known}, (0, -1)).count() == 0
    none = as_known(e, F.col("who"), F.col("at"), {"known": known.limit(0)}, (low, high))
    assert none.count() == len(events) and none.where("known IS NOT NULL").count() == 0


def test_history_is_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([*range(2012, 2022), None]), day(rng.randint(0, 50)), rng.choice(["x", "X ", "y", None, "-"]), rng.choice(["p", "q", ""])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, who string, year int, known_on date, kind string, flag string")
    plain = lambda c: F.when(~F.lower(F.trim(c)).isin("", "-"), F.lower(F.trim(c)))
    states = recorded_states(df, F.col("who"), F.col("year"), {"kind": plain("kind"), "flag": plain("flag")}, F.col("known_on"), F.col("id"))
    got = sorted((r["entity"], r["valid_from"], r["valid_to"], r["kind"] or "", r["flag"] or "") for r in history(states, ["kind", "flag"]).collect())
    want = []
    for who in "abc":
        years = sorted({r[2] for r in rows if r[1] == who and r[2] is not None})
        chosen = {}
        for y in years:
            for k, name in ((4, "kind"), (5, "flag")):
                ok = [(r[3], -r[0], r[k].strip().lower()) for r in rows if r[1] == who and r[2] == y and r[k] is not None and r[k].strip().lower() not in ("", "-")]
                chosen[y, name] = max(ok)[2] if ok else None
        for name in ("kind", "flag"):
            first = next((chosen[y, name] for y in years if chosen[y, name]), None)
            for y in years:
                first = chosen[y, name] = chosen[y, name] or first
        runs = []
        for y in years:
            s = (chosen[y, "kind"] or "", chosen[y, "flag"] or "")
            if runs and runs[-1][2] == s:
                runs[-1][1] = y
            else:
                runs.append([y, y, s])
        want += [(who, a, b, *s) for a, b, s in runs]
    assert got == sorted(want)
    assert history(states.limit(0), ["kind", "flag"]).count() == 0


def test_only_differing_leaves_are_read(spark, tmp_path):
    names = [f"e{i}" for i in range(200)]
    first = {n: ("x", 2020) for n in names}
    second = {n: ("x", 2021) for n in names}  # recorded again, nothing changed
    third = second | {"e3": ("y", 2022), "e7": (None, 2022), "new": ("x", 2022)}
    path, read = str(tmp_path / "h"), []
    for period, states in ((2020, first), (2021, second), (2022, third)):
        df = spark.createDataFrame([(n, seen, kind) for n, (kind, seen) in states.items()], "entity string, seen int, kind string")
        read.append(append_snapshot(spark, path, period, df, ["kind"], levels=3))
    assert read[0] > 150 and read[1] == 0 and 1 <= read[2] <= 3
    got = sorted((r["entity"], r["valid_from"], r["valid_to"], r["kind"] or "") for r in stored_history(spark, path, ["kind"]).collect())
    want = [(n, 2020, 2021, "x") for n in names] + [("e3", 2022, 2022, "y"), ("e7", 2022, 2022, ""), ("new", 2022, 2022, "x")]
    assert got == sorted(want)


def test_history_depends_on_the_comparison(spark, monkeypatch):
    rows = [(f"e{i}", y, "xy"[(i + y) % 3 == 0], "p") for i in range(30) for y in (2020, 2021, 2022)]
    states = spark.createDataFrame(rows, "entity string, period int, kind string, flag string")
    want = sorted(map(tuple, history_module.history(states, ["kind", "flag"]).collect()))
    assert want == sorted(map(tuple, history_module.history(states, ["kind", "flag"], levels=1).collect()))
    monkeypatch.setattr(history_module, "differing", lambda level, pairs, bits: level[-1].selectExpr("period", "node AS leaf").limit(0))
    assert history_module.history(states, ["kind", "flag"]).count() == 0 < len(want)


def test_events_without_entity_or_time_come_out_once(spark):
    e = spark.createDataFrame([(i, None if i % 2 else "a", None if i % 3 else day(1), f"x{i}") for i in range(60)], "event long, who string, at date, _entity string")
    known = validity(spark.createDataFrame([(1, "a", day(0))], "id long, who string, start date"), F.col("who"), F.col("start"), F.struct("id"), F.col("id"))
    low = high = e.agg(month_of(F.max("at"))).first()[0]
    got = as_known(e, F.col("who"), F.col("at"), {"known": known}, (low, high)).collect()
    assert sorted(r["event"] for r in got) == list(range(60)) and {r["event"] for r in got if r["known"] == 1} == set(range(0, 60, 6))
