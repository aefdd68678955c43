import datetime as dt
import random

from pyspark.sql import functions as F
from tidelog.llm.survivor import FIELDS, agreement, chains, depths, records, survivors

SCHEMA = "vessel_row_id long, mmsi string, year int, known_on date, registries_listed string, fishing_hours double, flag_gfw string, length_m_gfw double, value string"
D = dt.date(2020, 1, 1)


def test_latest_known_survives(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["280000001", " 280000002.0", "MMSI 280000003", "junk", None]), rng.choice([2020, 2021, None]), D + dt.timedelta(days=rng.randint(0, 9)), rng.choice(["A", "A|B", "unknown", None]), rng.choice([-1.0, 5.0, float("nan"), None]), rng.choice(["NRV", "nrv ", "-"]), rng.choice([9999.0, 20.0, None]), "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["mmsi"], r["year"], r["field"]): r["vessel_row_id"] for r in survivors(df).collect()}
    names = {"280000001": "280000001", " 280000002.0": "280000002", "MMSI 280000003": "280000003"}
    ok = [lambda r: r[4] in ("A", "A|B"), lambda r: r[5] == 5.0, lambda r: r[6] != "-", lambda r: r[7] == 20.0]
    want = {}
    for r in rows:
        if r[1] in names and r[2]:
            group = [x for x in rows if names.get(x[1]) == names[r[1]] and x[2] == r[2]]
            for f, test in zip(FIELDS, ok):
                if len(group) > 1 and (there := [x for x in group if test(x)]):
                    want[names[r[1]], r[2], f] = max(there, key=lambda x: (x[3], -x[0]))[0]
    assert got == want
    assert survivors(df.limit(0)).count() == 0
    assert survivors(df.unionByName(df)).count() >= len(got)


def test_undated_records_are_placed_by_learned_precedence(spark):
    """Registries only ever grow, flags go from old to new: an undated record with more of both is the latest, one with fewer is not."""
    rows = []
    for g in range(40):
        m = f"28{g:07d}"
        rows += [(10 * g, m, 2020, D, "A", 1.0, "old", 20.0, ""), (10 * g + 1, m, 2020, D + dt.timedelta(days=1), "A|B", 2.0, "new", 20.0, "")]
    rows += [(900, "289999991", 2020, D, "A", 1.0, "old", 20.0, ""), (901, "289999991", 2020, None, "A|B|C", 3.0, "new", 21.0, "")]
    rows += [(910, "289999992", 2020, D, "A|B", 2.0, "new", 20.0, ""), (911, "289999992", 2020, None, "A", 1.0, "old", 19.0, "")]
    rows += [(920, "289999993", 2020, None, "A", None, "old", None, ""), (921, "289999993", 2020, None, "A|B", None, "new", None, "")]
    got = {(r["mmsi"], r["field"]): r["vessel_row_id"] for r in survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got["289999991", f] for f in FIELDS} == {901}
    assert {got["289999992", f] for f in FIELDS} == {910}
    assert got["289999993", "registries_listed"] == 921 and ("289999993", "length_m_gfw") not in got


def test_one_record_each(spark):
    rows = [(1, "280000001", 2020, D, None, 5.0, None, None, ""), (2, "280000001", 2020, D, "A", None, "NRV", 20.0, ""), (3, "280000009", 2020, None, None, None, None, 7.0, "")]
    got = {r["mmsi"]: r for r in records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["280000001"]["registries_listed"], got["280000001"]["fishing_hours_row"], got["280000009"]["length_m_gfw_row"]) == ("A", 1, 3)


def test_depths():
    assert depths([("a", "b"), ("b", "c"), ("a", "c")]) == {"a": 0, "b": 1, "c": 2}
    assert depths([("a", "b"), ("b", "a"), ("x", "y")]) == {"x": 0, "y": 1}


def test_chains_order_words_in_part():
    assert chains([("a", "b"), ("b", "c"), ("x", "y")]) == {("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")}
    assert chains([("a", "b"), ("b", "a"), ("b", "c")]) == {("a", "c"), ("b", "c")}


def test_unrelated_words_and_contrary_signals_decide_nothing(spark):
    rows = []
    for g in range(40):  # a < b < c, x < y; hours grow
        m = f"28{g:07d}"
        rows += [(10 * g + i, m, 2020, D + dt.timedelta(days=i), "A", 1.0 + i, w, 20.0, "") for i, w in enumerate(("a", "b", "c"))]
        rows += [(10_000 + 10 * g + i, m, 2021, D + dt.timedelta(days=i), "A", 1.0 + i, w, 20.0, "") for i, w in enumerate(("x", "y"))]
    case = lambda n, dated, undated: [(n, f"28999{n:04d}", 2020, D, "A", *dated, 20.0, ""), (n + 1, f"28999{n:04d}", 2020, None, "A", *undated, 21.0, "")]
    rows += case(5000, (None, "y"), (None, "c")) + case(5010, (None, "a"), (None, "c")) + case(5020, (5.0, "a"), (4.0, "c")) + case(5030, (5.0, "c"), (6.0, "a")) + case(5040, (5.0, "y"), (6.0, "c"))
    got = {r["mmsi"]: r["vessel_row_id"] for r in survivors(spark.createDataFrame(rows, SCHEMA)).where("field = 'length_m_gfw' AND mmsi LIKE '28999%'").collect()}
    assert [got[f"28999{n}"] for n in (5000, 5010, 5020, 5030, 5040)] == [5000, 5011, 5020, 5030, 5041]


def test_hidden_dates_are_made_up_for(spark):
    rows = []
    for g in range(300):
        rows += [(10 * g + i, f"28{g:07d}", 2020, D + dt.timedelta(days=i), "A|B|C|D"[: 1 + 2 * i], 10.0 * g + i, "old" if i < 2 else "new", 20.0 + i, "") for i in range(4)]
    r = agreement(spark.createDataFrame(rows, SCHEMA), F.pmod(F.xxhash64("vessel_row_id"), F.lit(4)) == 0).collect()
    assert len(r) == 4 and all(x["agreed"] == x["groups"] > 150 and x["agreed_without"] < 0.8 * x["groups"] for x in r)
