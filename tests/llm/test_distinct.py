import datetime as dt
import random

import duckdb
import numpy as np
from tidelog.llm import distinct, queries
from tidelog.llm.distinct import ERROR, MERGES, P, counts_of, distinct_counts, estimates, event_groups, merge_sketches, merged, packed, registers_of, single_cells, sketch_of, sketch_parts, statistics, tokens_of, union_of, unpacked


def hashes(n, seed):
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64) * 2 + np.random.default_rng(seed + 1).integers(0, 2, n)


def plain_registers(h):
    """Register by register, rank by rank, one hash at a time."""
    ranks = {}
    for x in h.view(np.uint64).tolist():
        rest, r = x >> P, 1
        while r < 53 and not rest & 1:
            rest, r = rest >> 1, r + 1
        ranks.setdefault(x & ((1 << P) - 1), set()).add(r)
    out = np.zeros(1 << P, np.uint8)
    for k, s in ranks.items():
        top = max(s)
        out[k] = 4 * top + 2 * (top - 1 in s) + (top - 2 in s)
    return out


def test_registers_follow_from_tokens():
    for n in (0, 1, 300, 20_000):
        h = hashes(n, n)
        assert (registers_of(np.unique(tokens_of(h))) == plain_registers(h)).all()


def test_merging_is_lossless_in_any_order():
    parts = [hashes(n, 50 + n) for n in (0, 3, 700, 900, 5_000, 40_000)]
    whole = sketch_of(np.unique(tokens_of(np.concatenate(parts))))
    rng = random.Random(1)
    for _ in range(5):
        rng.shuffle(parts)
        s = b""
        for h in parts:
            s = merge_sketches(s, sketch_of(np.unique(tokens_of(h))))
        assert s == whole
    assert merge_sketches(whole, whole) == whole and len(whole) == 1 << P


def test_the_table_of_merges_is_union_of_ranks():
    a, b = np.meshgrid(np.arange(0, 214), np.arange(0, 214))
    possible = packed(unpacked(np.arange(214))) == np.arange(214)
    ok = possible[a] & possible[b]
    assert (unpacked(MERGES[a, b])[ok] == unpacked(packed(unpacked(a) | unpacked(b)))[ok]).all()


def test_error_is_as_stated():
    for n in (2_000, 50_000, 400_000):
        got = np.array([estimates([statistics(registers_of(np.unique(tokens_of(hashes(n, 7 * i)))))], 1 << P)[0] for i in range(30)])
        assert abs(got.mean() / n - 1) < 4 * ERROR / 2 ** (P / 2) / 30**0.5
        assert got.std() / n < 1.5 * ERROR / 2 ** (P / 2)
    assert estimates([statistics(np.zeros(1 << P, np.uint8))], 1 << P)[0] == 0.0


def test_small_groups_are_exact():
    for n in (0, 1, 17, 400, 1_000):
        e, s = counts_of([sketch_of(np.unique(tokens_of(hashes(n, n))))])
        assert abs(e[0] - n) < 0.1 and s[0] < 0.2


def test_counts_of_events(spark):
    rng = random.Random(2)
    rows = [(dt.date(2023, rng.randint(1, 12), rng.randint(1, 28)) if rng.random() < 0.97 else None, f"28{rng.randint(0, 9)}{rng.randint(0, 900):06d}" if rng.random() < 0.97 else "x", f"c{rng.randint(0, 300)}" if rng.random() < 0.97 else None, rng.uniform(-30, 30) if rng.random() < 0.97 else None, float(rng.choice([-170, 5, 15])), "x") for _ in range(4_000)]
    df = spark.createDataFrame([*rows, *rows[:500]], "date date, mmsi string, cell_id string, cell_ll_lat double, cell_ll_lon double, key string")
    got = {(r["level"], r["key"], r["what"]): r["estimate"] for r in distinct_counts(df.repartition(7)).collect()}
    want = {}
    for day, mmsi, cell, lat, lon, _ in rows:
        vessel = mmsi if mmsi != "x" else None
        keys = []
        if day:
            keys += [("date", str(day)), ("month", str(day)[:7]), ("year", str(day)[:4]), ("all", "all")]
            keys += [("vessel_group_month", f"{vessel[:3]}|{str(day)[:7]}"), ("vessel_group", vessel[:3])] if vessel else []
        if lat is not None:
            a, b = int(lat // 10 * 10), int(lon // 10 * 10)
            keys += [("cell_group", f"{a}_{b}"), ("latitude_band", str(a))]
        for k in keys:
            for what, value in (("vessels", vessel), ("cells", cell)):
                if value:
                    want.setdefault((*k, what), set()).add(value)
    assert got.keys() == want.keys()
    assert all(abs(got[k] / len(v) - 1) <= 4 * ERROR / 2 ** (P / 2) for k, v in want.items())
    assert distinct_counts(df.limit(0)).count() == 0


def test_parts_of_days_make_the_whole(spark):
    df = spark.range(0, 30_000).selectExpr("date_add(DATE'2023-01-01', CAST(id % 40 AS INT)) AS date", "CAST(280000000 + id * 7 % 9001 AS STRING) AS mmsi", "CAST(id % 777 AS STRING) AS cell_id", "1.0D AS cell_ll_lat", "2.0D AS cell_ll_lon")
    groups, identifiers = event_groups()
    one = sketch_parts(df.where("day(date) % 2 = 0"), groups, identifiers)
    two = sketch_parts(df.where("day(date) % 2 = 1"), groups, identifiers)
    again = {tuple(r[:3]): bytes(r[3]) for r in merged(one.unionByName(two)).collect()}
    whole = {tuple(r[:3]): bytes(r[3]) for r in merged(sketch_parts(df, groups, identifiers)).collect()}
    assert again == whole and len(whole) > 80


def test_union_of_many_is_that_of_two_by_two():
    for sizes in ((), (0,), (5, 5, 900), (400, 400, 400), (3, 5_000, 20, 6_000, 1_500)):
        parts = [sketch_of(np.unique(tokens_of(hashes(n, 9 * i)))) for i, n in enumerate(sizes)]
        s = b""
        for x in parts:
            s = merge_sketches(s, x)
        assert union_of(parts) == s == sketch_of(np.unique(tokens_of(np.concatenate([hashes(0, 0), *(hashes(n, 9 * i) for i, n in enumerate(sizes))]))))


def test_counts_of_single_cells(spark, monkeypatch):
    monkeypatch.setattr(distinct, "HELD", 500)  # names are forgotten with the parts
    rng = random.Random(3)
    ids = ["1.0_2.0", "1.0_2.0 ", "", "\u00e9_\u96ea", None, *(f"{i}.5_-179.9" for i in range(150))]
    rows = [(None, f"28{rng.randint(0, 9)}{rng.randint(0, 900):06d}" if rng.random() < 0.9 else "x", rng.choice(ids), None, None) for _ in range(3_000)]
    rows += [(dt.date(2024, 1, 1), f"{277_000_000 + i}", "hot", 1.0, 2.0) for i in range(4_000)] + [(dt.date(2024, 1, 1), "x", "no vessel", 1.0, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, *rows[:500]], "date date, mmsi string, cell_id string, cell_ll_lat double, cell_ll_lon double")
    got = {r["key"]: (r["what"], r["estimate"]) for r in distinct_counts(df.repartition(5), texts=single_cells()).where("level = 'cell'").collect()}
    want = {}
    for _, mmsi, cell, _, _ in rows:
        if mmsi != "x" and cell is not None:
            want.setdefault(cell, set()).add(mmsi)
    assert got.keys() == want.keys() and {"", "hot"} <= got.keys()
    assert all(got[k][0] == "vessels" and abs(got[k][1] / len(v) - 1) <= 4 * ERROR / 2 ** (P / 2) for k, v in want.items())


def test_p5_counts_counts_the_vessels_of_every_cell(spark):
    d = "/root/testdata/sf0.01"
    exact = dict(duckdb.sql(f"SELECT cell_id, count(DISTINCT {queries._VESSEL}) FROM read_parquet('{d}/interactions.parquet') GROUP BY 1 HAVING count({queries._VESSEL}) > 0").fetchall())
    got = queries.p5_counts(spark, d).where("level = 'cell'").collect()
    assert len(got) == len(exact) > 300 and all(abs(r["estimate"] - exact[r["key"]]) < 0.5 for r in got)
    parts = queries.p5_sketches(spark, d).where("level IN ('cell', 'cell_group')").groupBy("level").count().collect()
    assert dict(parts)["cell"] == len(exact) and dict(parts)["cell_group"] > 0
    assert queries.p5_within_bound(spark, d).where("within AND level <> 'cell'").count() == queries.p5_within_bound(spark, d).count() > 2_000
