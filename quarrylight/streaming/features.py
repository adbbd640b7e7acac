"""The feature stage as a stream: new files are described once, and what is known already is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def missing(files: DataFrame, known: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """files (path, mtime, ...) that known (path, mtime) does not have within `tolerance` seconds; a file that is listed
    more than once comes once, by its latest time."""
    latest = files.groupBy("path").agg(F.max("mtime").alias("mtime"))
    near = (F.col("f.path") == F.col("k.path")) & (F.abs(F.col("f.mtime") - F.col("k.mtime")) < tolerance)
    todo = latest.alias("f").join(known.select("path", "mtime").alias("k"), near, "left_anti")
    return files.join(todo, ["path", "mtime"], "left_semi").dropDuplicates(["path"])


def upsert(describe: Callable[[DataFrame], DataFrame], table: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch of files (path, mtime, ...): those that the table lacks are described and appended,
    as a part named by the batch, so a batch that runs again replaces its own rows. describe gives rows of schema."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        whole = StructType(list(schema.fields)).add("batch", "long")
        known = spark.read.schema(whole).parquet(table) if there else spark.createDataFrame([], whole)
        known = known.filter(F.col("batch") != number)
        found = describe(missing(batch, known)).withColumn("batch", F.lit(number).cast("long"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return run


def latest(features: DataFrame) -> DataFrame:
    """One row a path of a feature table that has grown by batches: the one with the latest mtime."""
    rest = [c for c in features.columns if c != "path"]
    return features.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("mtime", "batch")).alias("x")).select("path", "x.*")


def feature_stream(spark: SparkSession, files: DataFrame, describe: Callable[[DataFrame], DataFrame], table: str, schema: StructType, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a stream of files (path, mtime, ...) into the feature table. once: what is there now, then it ends."""
    out = files.writeStream.foreachBatch(upsert(describe, table, schema)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def sampled_windows(events: DataFrame, length: str = "15 seconds", gap: int = 45, late: str = "1 minute") -> DataFrame:
    """(start, n, total) of a stream of events (ts, value): in every `gap` seconds only the first `length` counts; events that
    come later than `late` behind the newest are dropped, as the state of their window is."""
    seconds = int(length.split()[0])
    rows = events.withWatermark("ts", late).filter(F.unix_seconds("ts") % gap < seconds)
    out = rows.groupBy(F.window("ts", f"{gap} seconds")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "n", "total")
