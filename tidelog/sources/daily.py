"""Daily effort files, as members of a zip or in a folder, and the tables beside them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from tidelog.operators.error_parse import NO_NUMBER, parsed

# The columns that are read, the names of daily files.
COLUMNS = ["date", "cell_ll_lat", "cell_ll_lon", "mmsi", "hours", "fishing_hours"]
NUMBERS = ["cell_ll_lat", "cell_ll_lon", "hours", "fishing_hours"]
DAILY_NAME = r"(\d{4})-(\d{2})-(\d{2})\.csv$"
VESSEL_COLUMNS = [
    *(("mmsi", "string"), ("year", "int"), ("flag_ais", "string"), ("flag_registry", "string"), ("flag_gfw", "string")),
    *(("vessel_class_inferred", "string"), ("vessel_class_inferred_score", "double"), ("vessel_class_registry", "string"), ("vessel_class_gfw", "string"), ("self_reported_fishing_vessel", "boolean")),
    *((f"{m}_{s}", "double") for m in ("length_m", "engine_power_kw", "tonnage_gt") for s in ("inferred", "registry", "gfw")),
    *(("registries_listed", "string"), ("active_hours", "double"), ("fishing_hours", "double")),
]
LINES = "source_file string, source_format string, row_number long, line string"


def file_date(name: F.Column) -> F.Column:
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.csv$", 1).try_cast("date")


def opened(path: str):
    """A seekable file of any file system that Arrow knows by its address; a plain path is local."""
    if "://" in path or path.startswith("file:"):
        fs, at = FileSystem.from_uri(path)
        return fs.open_input_file(at)
    return open(path, "rb")


class Member(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class ZipReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Member]:
        """A partition per daily member; only the zip's directory is read for it."""
        with opened(self.path) as f, zipfile.ZipFile(f) as z:
            return [Member(m) for m in sorted(z.namelist()) if re.search(DAILY_NAME, m)] or [Member("")]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.name:
            return
        name = member.name.rsplit("/", 1)[-1]
        with opened(self.path) as f, zipfile.ZipFile(f) as z, z.open(member.name) as raw:
            held, first = [], 1
            for line in io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"):
                held.append(line.rstrip("\n"))
                if len(held) == 50_000:
                    yield self.batch(name, first, held)
                    first, held = first + len(held), []
            yield self.batch(name, first, held)

    @staticmethod
    def batch(name: str, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(["zip"] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], names=["source_file", "source_format", "row_number", "line"])


class ZipSource(DataSource):
    """spark.read.format("daily_zip").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "daily_zip"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"])


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the daily members of a zip (never unpacked to disk): source_file, source_format, row_number (from 1; the header is 1), line.

    A task reads one member, line by line. Members with other names are ignored. path: an address of a file system that
    Arrow knows (hdfs, s3, gs, file), or a plain path that all workers see."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("daily_zip").load(path)


def dir_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the daily files in a folder. Spark splits large files, so row numbers are not known and null."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    name = F.col("_metadata.file_name")
    return lines.where(name.rlike(DAILY_NAME)).select(name.alias("source_file"), F.lit("csv_dir").alias("source_format"), F.lit(None).cast("long").alias("row_number"), F.col("value").alias("line"))


def open_daily(spark: SparkSession, root: str, year: int) -> DataFrame:
    """The lines of a year: of <root>/*<year>*.zip if there is one, else of the folder <root>/*<year>*; else an error. root is on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s.isDirectory(), s.getPath().toString()) for s in fs.listStatus(p) if str(year) in s.getPath().getName())
    for name, folder, path in found:
        if name.endswith(".zip") and not folder:
            return zip_lines(spark, path)
    for _, folder, path in found:
        if folder:
            return dir_lines(spark, path)
    raise FileNotFoundError(f"no daily source of {year} in {root}")


def land(lines: DataFrame, header: list[str] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(bronze rows, malformed lines) of daily lines whose files have the columns `header`, of which the six that are wanted are kept.

    A line with a wrong number of columns, broken quoting or a number that cannot be read is malformed and comes out with a
    reason; header lines and blank lines are neither. Null tokens are null; source and file date are added."""
    row = lines.where((F.trim("line") != "") & (F.rtrim("line") != ",".join(header))).withColumn("p", parsed(F.col("line"), len(header)))
    value = {c: F.col("p.values")[header.index(c)] for c in COLUMNS}
    plain = {c: F.when(~v.isin(NO_NUMBER), v) for c, v in value.items()}
    bad_number = F.lit(False)
    for c in NUMBERS:
        bad_number |= plain[c].isNotNull() & plain[c].try_cast("double").isNull()
    reason = F.when(F.col("p.cost") > 0, F.concat(F.lit("structure: "), F.col("p.edits"))).when(bad_number, "invalid_number")
    row = row.withColumn("reason", reason)
    good = row.where(F.col("reason").isNull()).select(*(plain[c].cast("double" if c in NUMBERS else "string").alias(c) for c in COLUMNS), "source_file", "source_format", file_date(F.col("source_file")).alias("file_date"))
    return good, row.where(F.col("reason").isNotNull()).select("source_file", "row_number", F.col("line").alias("text"), "reason")


def vessel_table(spark: SparkSession, path: str) -> DataFrame:
    """The yearly vessel records of a CSV with a header, cast to their types; what cannot be cast is null."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*(F.col(name).try_cast(kind).alias(name) for name, kind in VESSEL_COLUMNS))


def anchorage_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path).select("s2id", *(F.col(c).try_cast("double").alias(c) for c in ("lat", "lon"))).dropna(subset=["lat", "lon"])


# Kinds of polygon files, the preferred first.
SUFFIXES = [".gdb", ".gpkg", ".shp", ".geojson", ".json"]
READABLE = [".gpkg", ".geojson", ".json"]


def find_area_source(root: str) -> Path | None:
    """The preferred polygon file below root that can be read here: by kind, then by the length of its name. If there are only files of other kinds, an error names them."""
    every = [p for p in Path(root).rglob("*") if p.suffix.lower() in SUFFIXES] if Path(root).is_dir() else []
    found = [p for p in every if p.suffix.lower() in READABLE]
    if every and not found:
        raise ValueError(f"no reader for {', '.join(sorted({p.suffix.lower() for p in every}))}: areas are read from GeoPackage and GeoJSON")
    return min(found, key=lambda p: (SUFFIXES.index(p.suffix.lower()), len(p.name), p.name), default=None)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """area_id (the number of the feature), properties (a map) and geometry (text) of a FeatureCollection; an error if it has no feature."""
    text = spark.read.option("wholetext", "true").text(path)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<struct<properties: map<string, string>, geometry: string>>")
    out = text.select(F.posexplode(features).alias("n", "f")).select(F.col("n").cast("string").alias("area_id"), "f.properties", "f.geometry")
    if not out.limit(1).count():
        raise ValueError(f"{path} has no features")
    return out


def area_features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """area_id, properties and geometry of a polygon file of one of the kinds that can be read."""
    from tidelog.sources.geopackage import geopackage_features  # it opens its files as this module does

    return geopackage_features(spark, path, layer) if path.lower().endswith(".gpkg") else geojson_features(spark, path)
