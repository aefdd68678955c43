"""Landing daily files as they arrive. The checkpoint is the record of what was landed, so each file is landed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidelog.sources.daily import COLUMNS, DAILY_NAME, land


def land_new_files(spark: SparkSession, source: str, bronze: str, malformed: str, checkpoint: str, header: list[str] = COLUMNS) -> int:
    """Land all files of the folder `source` that no earlier call with this checkpoint has landed, then stop. Gives the number of batches."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").format("text").load(source)
    name = F.col("_metadata.file_name")
    rows = lines.select(name.alias("source_file"), F.lit("csv_dir").alias("source_format"), F.lit(None).cast("long").alias("row_number"), F.col("value").alias("line")).where(F.col("source_file").rlike(DAILY_NAME))

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is run again after a failure replaces its own folder."""
        good, bad = land(batch, header)
        good.write.mode("overwrite").parquet(f"{bronze}/batch={number}")
        bad.write.mode("overwrite").json(f"{malformed}/batch={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
