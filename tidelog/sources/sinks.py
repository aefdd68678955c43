"""Writing tables: by month, repeatably, with a report."""

from __future__ import annotations

import hashlib
import json
import tarfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


MOST_ROWS = 10_000


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table at path was written to its end."""
    fs, p = _file(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(p)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; it is built and written only if it is not there yet or force is set."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_months(df: DataFrame, path: str) -> None:
    """df by year and month; only months that df has are replaced. A month is brought together in as few files as its size allows: the rebalancing splits big months and joins small ones."""
    df.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(path)
    fs, p = _file(df.sparkSession, path.rstrip("/") + "/_SUCCESS")  # Spark leaves it out when it replaces partitions
    fs.create(p, True).close()


def write_quarantine(df: DataFrame, path: str, months: list[tuple[int, int]]) -> None:
    """Refused rows (with year and month) of the given months; months without any lose what an earlier run left there."""
    write_months(df, path)
    spark = df.sparkSession
    there = {(r["year"], r["month"]) for r in df.select("year", "month").distinct().collect()}  # one row a month
    for year, month in months:
        if (year, month) not in there:
            fs, p = _file(spark, f"{path}/year={year}/month={month}")
            fs.delete(p, True)


def write_sidecar(malformed: DataFrame, path: str) -> None:
    malformed.write.mode("overwrite").json(path)


def write_report(path: str, **parts: object) -> dict:
    """A JSON file with the parts and the time; one-row DataFrames become objects, others lists. A part of more than MOST_ROWS rows is an error: a report is no table."""
    out: dict = {"written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = [r.asDict(True) for r in part.limit(MOST_ROWS + 1).collect()]
            if len(rows) > MOST_ROWS:
                raise ValueError(f"{name} has more than {MOST_ROWS} rows")
            part = rows[0] if len(rows) == 1 else rows
        out[name] = part
    Path(path).write_text(json.dumps(out, default=str, indent=1))
    return out


def md5_of(path: str) -> str:
    h = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def verified(path: str, expected: str) -> bool:
    """Whether the file is there with this digest; a file with another digest is deleted."""
    p = Path(path)
    if not p.exists():
        return False
    if md5_of(path) == expected:
        return True
    p.unlink()
    return False


def unpacked(archive: str, into: str, expected: str) -> list[str]:
    """Unpack a tar of stored artefacts (as save_model and the tables write them) if its digest is the expected one, else an error. Gives the names of its files; none may lead out of the folder."""
    if not verified(archive, expected):
        raise ValueError(f"{archive} is not there or has another digest")
    with tarfile.open(archive) as t:
        t.extractall(into, filter="data")
        return [m.name for m in t.getmembers() if m.isfile()]
