import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from tidelog.session import files, peak_memory_mb, register_views
from tidelog.sources import daily, sinks
from tidelog.sources.geojson import polygon_pieces
from tidelog.streaming.landing import land_new_files

HEAD = "date,cell_ll_lat,cell_ll_lon,mmsi,hours,fishing_hours"
DAY = f"{HEAD}\n2023-01-01,-42.3,147.1,503000001,2.0,1.0\n2023-01-01,-42.3,147.1,503000001,2.0,NA\n2023-01-01,-42.3,147.1\n2023-01-01,x,147.1,503000001,2.0,1.0\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "effort-2023").mkdir()
    (tmp_path / "effort-2023" / "daily-2023-01-01.csv").write_text(DAY)
    (tmp_path / "effort-2023" / "readme.csv").write_text("a,b\n")
    with zipfile.ZipFile(tmp_path / "effort-2024.zip", "w") as z:
        z.writestr("x/daily-2024-02-02.csv", DAY.replace("2023-01-01", "2024-02-02"))
        z.writestr("x/daily-2024-02-03.csv", HEAD + "\n")
        z.writestr("notes.txt", "no")
    return tmp_path


@pytest.mark.parametrize("year", [2023, 2024])
def test_daily(spark, folder, year):
    good, bad = daily.land(daily.open_daily(spark, str(folder), year))
    rows = good.orderBy(F.col("fishing_hours").desc_nulls_last()).collect()
    assert [(r["fishing_hours"], r["file_date"].year, r["source_format"]) for r in rows] == [(1.0, year, "zip" if year == 2024 else "csv_dir"), (None, year, "zip" if year == 2024 else "csv_dir")]
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid_number", "structure: insert_delimiter x3"]


def test_no_source(spark, folder):
    with pytest.raises(FileNotFoundError):
        daily.open_daily(spark, str(folder), 1999)


def test_stream_lands_each_file_once(spark, folder):
    where = [str(folder / x) for x in ("bronze", "bad", "checkpoint")]
    assert land_new_files(spark, str(folder / "effort-2023"), *where) == 1
    (folder / "effort-2023" / "daily-2023-01-02.csv").write_text(DAY)
    assert land_new_files(spark, str(folder / "effort-2023"), *where) == 1
    assert land_new_files(spark, str(folder / "effort-2023"), *where) == 0
    assert spark.read.parquet(where[0]).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2023, 1, "a"), (2023, 2, "b")], "year int, month int, v string")
    out = str(tmp_path / "t")
    sinks.write_months(df, out)
    sinks.write_months(df.where("month = 2").withColumn("v", F.lit("c")), out)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == ["a", "c"]
    assert sinks.exists(spark, out)
    sinks.write_quarantine(df.where("month = 2"), out, [(2023, 1), (2023, 2)])
    assert [r["v"] for r in spark.read.parquet(out).collect()] == ["b"]
    calls = []
    build = lambda: calls.append(1) or df
    for force in (False, False, True):
        assert sinks.stage(spark, str(tmp_path / "s"), build, force).count() == 2
    assert len(calls) == 2
    report = sinks.write_report(str(tmp_path / "r.json"), rows=df, total=df.agg(F.count(F.lit(1)).alias("n")))
    assert json.loads((tmp_path / "r.json").read_text())["total"] == {"n": 2} and len(report["rows"]) == 2
    f = tmp_path / "f"
    f.write_text("x")
    assert sinks.verified(str(f), sinks.md5_of(str(f))) and not sinks.verified(str(f), "0") and not f.exists()


def test_vessels_and_areas(spark, tmp_path):
    (tmp_path / "v.csv").write_text("mmsi,year,length_m_gfw,extra\n0503,2023,12.5,x\n,bad,y,z\n".replace("mmsi,year,length_m_gfw,extra", ",".join([n for n, _ in daily.VESSEL_COLUMNS][:2] + ["length_m_gfw", "extra"] + [n for n, _ in daily.VESSEL_COLUMNS if n not in ("mmsi", "year", "length_m_gfw")])))
    rows = daily.vessel_table(spark, str(tmp_path / "v.csv")).collect()
    assert rows[0]["mmsi"] == "0503" and rows[0]["length_m_gfw"] == 12.5 and rows[1]["year"] is None
    (tmp_path / "long_name.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    (tmp_path / "a.json").write_text("{}")
    found = daily.find_area_source(str(tmp_path))
    assert found.name == "long_name.geojson" and daily.find_area_source(str(tmp_path / "none")) is None
    f = daily.geojson_features(spark, str(found))
    assert f.first()["properties"]["NAME"] == "x" and polygon_pieces(f).first()["max_lon"] == 1.0
    with pytest.raises(ValueError):
        daily.geojson_features(spark, str(tmp_path / "a.json"))
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.shp").write_text("")
    with pytest.raises(ValueError, match="shp"):
        daily.find_area_source(str(tmp_path / "only"))


def test_a_partition_per_member(spark, folder):
    for path in (str(folder / "effort-2024.zip"), f"file://{folder}/effort-2024.zip"):
        lines = daily.zip_lines(spark, path)
        got = {(r["source_file"], r["row_number"], r["p"]) for r in lines.withColumn("p", F.spark_partition_id()).collect()}
        assert {p for *_, p in got} == {0, 1} and max(n for _, n, _ in got) == 5 and len(got) == 6


def test_files_with_other_columns_and_views(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "t" / "one.parquet"))
    spark.createDataFrame([("y", 2.0)], "b string, c double").write.parquet(str(tmp_path / "t" / "two.parquet"))
    assert sorted((r["a"] or 0, r["b"], r["c"] or 0.0) for r in files(spark, str(tmp_path / "t" / "*.parquet")).collect()) == [(0, "y", 2.0), (1, "x", 0.0)]
    register_views(spark, str(tmp_path / "t"), ["one"])
    assert spark.sql("SELECT b FROM one").first()["b"] == "x"


def test_artefacts_come_from_a_verified_archive(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(tmp_path / "a.txt", "in/a.txt")
    digest = sinks.md5_of(str(tmp_path / "t.tar"))
    assert sinks.unpacked(str(tmp_path / "t.tar"), str(tmp_path / "out"), digest) == ["in/a.txt"] and (tmp_path / "out" / "in" / "a.txt").read_text() == "x"
    with pytest.raises(ValueError, match="digest"):
        sinks.unpacked(str(tmp_path / "t.tar"), str(tmp_path / "out"), "0")
    assert min(peak_memory_mb(spark).values()) > 1
