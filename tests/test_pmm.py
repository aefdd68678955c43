import math

import pandas as pd
import pytest
from tidelog.operators.pmm import FIELDS, _candidates, _matcher, checked_fills, fill_missing, with_fills

SCHEMA = "vessel_row_id long, mmsi string, year int, vessel_class_inferred string, vessel_class_registry string, vessel_class_gfw string, " + ", ".join(f"{m}_{s} double" for m in ("length_m", "engine_power_kw", "tonnage_gt") for s in ("inferred", "registry", "gfw"))


def row(i, mmsi, kind, length, gaps=(), year=2020):
    size = {"length_m": length, "engine_power_kw": 12.0 * length, "tonnage_gt": 0.02 * length**2.2}
    values = []
    for m in ("length_m", "engine_power_kw", "tonnage_gt"):
        values += [size[m] * 1.02, None if i % 3 else size[m], gaps[f"{m}_gfw"] if f"{m}_gfw" in gaps else size[m]]
    return (i, mmsi, year, kind, None, gaps["vessel_class_gfw"] if "vessel_class_gfw" in gaps else kind, *values)


@pytest.fixture(scope="module")
def filled(spark):
    rows = [row(i, f"{280000000 + i}", "trawlers" if i % 2 else "squid_jigger", 8.0 + i % 40 + (i % 2) * 20) for i in range(400)]
    rows += [row(1000, "280000001", "trawlers", 29.0, {"length_m_gfw": float("nan"), "vessel_class_gfw": " n/a "}), row(1001, "junk", "trawlers", 40.0, {"tonnage_gt_gfw": 9999.0}), row(1002, None, None, 15.0, {"engine_power_kw_gfw": -1.0, "vessel_class_gfw": None})]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, fill_missing(df, rows_per_task=50)


def test_every_gap_is_filled_once(filled):
    _, fills = filled
    got = sorted((r["vessel_row_id"], r["field"]) for r in fills.collect())
    assert got == [(1000, "length_m_gfw"), (1000, "vessel_class_gfw"), (1001, "tonnage_gt_gfw"), (1002, "engine_power_kw_gfw"), (1002, "vessel_class_gfw")]


def test_donors_are_near_and_observed(filled):
    df, fills = filled
    by = {(r["vessel_row_id"], r["field"]): r for r in fills.collect()}
    assert by[1000, "length_m_gfw"]["donor_id"] == 1 and by[1000, "length_m_gfw"]["donor_group"] == "v:280000001"
    out = {r["vessel_row_id"]: r for r in with_fills(df, fills).where("vessel_row_id >= 1000").collect()}
    assert out[1000]["vessel_class_gfw"] == "trawlers" and out[1000]["vessel_class_gfw_filled"] and not out[1000]["tonnage_gt_gfw_filled"]
    assert abs(math.log(out[1001]["tonnage_gt_gfw"] / (0.02 * 40.0**2.2))) < 0.2
    assert all(out[i][f] is not None for i in out for f in FIELDS)


def test_split_groups_find_the_same_donors(spark, filled):
    """One partition against many: the outermost donors of other partitions make up for the cut."""
    df, fills = filled
    one = {tuple(r) for r in fill_missing(df, rows_per_task=10**9).collect()}
    assert one == {tuple(r) for r in fills.collect()}


def test_held_out_values(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/vessels.parquet").where("length_m_gfw > 0 AND length_m_gfw < 130 AND NOT isnan(length_m_gfw)")
    held = df.withColumn("held_out", df["length_m_gfw"]).selectExpr("* EXCEPT (length_m_gfw)", "CASE WHEN vessel_row_id % 5 = 0 THEN NULL ELSE length_m_gfw END AS length_m_gfw")
    out = with_fills(held, fill_missing(held)).where("vessel_row_id % 5 = 0").selectExpr("percentile(abs(ln(length_m_gfw / held_out)), 0.5) AS e").first()["e"]
    assert out < 0.12


def test_nothing_to_copy(spark):
    df = spark.createDataFrame([row(1, "280000001", "trawlers", 20.0, dict.fromkeys(FIELDS))], SCHEMA)
    got = fill_missing(df).collect()
    assert len(got) == 4 and all(r["donor_id"] is None for r in got)
    assert fill_missing(df.limit(0)).count() == 0


def plain_match(rows, draws, fewest):
    """Each gap against every donor of its narrowest group."""
    out = {}
    donors = {}
    for r in rows:
        if r["value"] is not None:
            for key in (f"v:{r['vessel']}" if r["vessel"] else None, f"k:{r['kind']}", "*"):
                donors.setdefault((r["field"], key), []).append((r["pred"], r["id"], r["value"]))
    for r in rows:
        if r["value"] is None:
            ladder = [(f"v:{r['vessel']}", 1)] if r["vessel"] else []
            key = next(k for k, n in [*ladder, (f"k:{r['kind']}", fewest), ("*", 1)] if len(donors.get((r["field"], k), ())) >= n)
            near = sorted(donors[r["field"], key], key=lambda d: (abs(d[0] - r["pred"]), d[1]))[: 1 if key[0] == "v" else draws]
            chosen = near[((r["id"] * 0x9E3779B97F4A7C15) % 2**64 >> 33) % len(near)]
            out[FIELDS[r["field"]], r["id"]] = (key, round(abs(chosen[0] - r["pred"]), 9))
    return out


def test_donors_are_the_nearest_whatever_the_batches(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/vessels.parquet").cache()
    want = plain_match(_candidates(df, "vessel_row_id").collect(), 5, 5)
    for size, rows_per_task in ((10_000, 10**6), (1, 1_000), (2, 200), (7, 50)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            got = {(r["field"], r["vessel_row_id"]): (r["donor_group"], round(abs(r["donor_predicted"] - r["predicted"]), 9)) for r in fill_missing(df, rows_per_task=rows_per_task).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and len(want) > 400
    assert checked_fills(df, fill_missing(df)).where("NOT (observed AND copied AND in_group)").count() == 0


def test_groups_that_end_with_their_batches_stay_apart():
    """The last batches of a partition hold one group each."""
    batch = lambda field, key, first: pd.DataFrame({"field": field, "key": key, "pred": [10.0, 11.0, 10.6], "id": [first, first + 1, first + 2], "gap": [False, False, True], "value": ["a", "b", None]})
    batches = [batch("length_m_gfw", "v:1", 0), batch("length_m_gfw", "v:2", 10), batch("tonnage_gt_gfw", "v:2", 20)]
    got = pd.concat(_matcher(5, [])(iter(batches)))
    assert sorted(zip(got["field"], got["id"], got["donor_id"], got["donor_group"])) == [("length_m_gfw", 2, 1, "v:1"), ("length_m_gfw", 12, 11, "v:2"), ("tonnage_gt_gfw", 22, 21, "v:2")]


def test_one_vessel_with_a_third_of_all_rows(spark):
    """The hot group is spread over many tasks and still finds its nearest donors."""
    rows = [row(i, "280000001", "trawlers", 10.0 + i % 97 / 10, {"length_m_gfw": None} if i % 7 == 0 else {}) for i in range(300)]
    rows += [row(1_000 + i, f"{281000000 + i}", "trawlers", 12.0 + i % 50) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    fills = fill_missing(df, rows_per_task=40).collect()
    want = plain_match(_candidates(df, "vessel_row_id").collect(), 5, 5)
    assert len(fills) == len(want) == 43 and {r["donor_group"] for r in fills} == {"v:280000001"}
    assert all((r["donor_group"], round(abs(r["donor_predicted"] - r["predicted"]), 9)) == want[r["field"], r["vessel_row_id"]] for r in fills)
