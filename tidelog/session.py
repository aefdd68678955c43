"""Session builder and the few helpers that need a running session."""

from __future__ import annotations

import atexit
import os
import resource
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is written for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelog")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names. Where none is named, a temporary one that ends with the process, on local masters only; else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def mounted_dir(spark: SparkSession) -> str | None:
    """The shared folder as a path, where it is one of a mounted file system; else None."""
    scheme, _, path = shared_dir(spark).rpartition(":")
    return path if scheme in ("", "file") and os.path.isdir(path) else None


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark df for broadcast if it has at most most_rows rows; otherwise it is joined by a shuffle.

    df should be cheap to count (a checkpoint or a small aggregate)."""
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df


def numbered(df: DataFrame, *order: Column, name: str = "ix") -> DataFrame:
    """df with the number of each row from 0 in the given order, without a window over all rows: it is range-partitioned and sorted, and the driver adds up a count per partition."""
    part = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = {r["p"]: r["n"] for r in part.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    start = F.array(*(F.lit(b).cast("long") for b in before or [0]))
    return part.withColumn(name, F.get(start, F.shiftright("_m", 33).cast("int")) + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files that match a pattern, as one table; their columns may differ and are brought together by name."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """The tables as temporary views, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def peak_memory_mb(spark: SparkSession) -> dict[str, float]:
    """The most memory that the driver's Python and the driver's JVM heap have taken so far, for reports."""
    pools = spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    heap = sum(p.getPeakUsage().getUsed() for p in pools if p.getType().toString().startswith("Heap"))
    return {"python": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024.0, 1), "jvm_heap": round(heap / 2**20, 1)}
