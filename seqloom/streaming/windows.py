"""Event-time windows over streams and tables: the same functions serve readStream and read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.storage import shared


def timed(rows: DataFrame, column: str, late: str | None = "10 minutes") -> DataFrame:
    """The column as a zoned timestamp, with a watermark on streams."""
    own = rows.withColumn(column, F.col(column).cast("timestamp"))
    return own.withWatermark(column, late) if late and rows.isStreaming else own


def tumbling(rows: DataFrame, column: str, size: str, *by: str) -> DataFrame:
    return sliding(rows, column, size, size, *by)


def sliding(rows: DataFrame, column: str, size: str, step: str, *by: str) -> DataFrame:
    own = rows.groupBy(F.window(column, size, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, column: str, gap: str, *by: str) -> DataFrame:
    own = rows.groupBy(F.session_window(column, gap), *by).agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end and return its result table. Progress, state and result lie in the shared folder, so a lost
    driver or executor costs a batch at most, and no row of the result is held by the driver. In complete mode the result is
    that of the last batch, otherwise that of all batches; a batch that is run again replaces what it wrote."""
    base = f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/part={0 if mode == 'complete' else number}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/result")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return out.parquet(f"{base}/result")
