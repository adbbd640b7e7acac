"""Shared storage of the session: where lineage is cut, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 64 << 20  #: of a table that is broadcast, about


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder under spark.checkpoint.dir; what lies in it goes when the driver's JVM ends.

    Only a session on a local master may do without that setting; it gets a temporary folder. On a cluster a local folder
    would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[[^,]*\]|\[[^,]*,[^,]*\])?$", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrylight-"))
    own = context._jsc.sc().getCheckpointDir().get()
    if getattr(context, "_quarrylight_own", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._quarrylight_own = own
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; its plan is not run again after a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. For larger intermediate tables: columnar and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark reaches, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    return F.lit(8)


def fits(df: DataFrame, limit: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether df has at most limit rows and about most_bytes bytes. df is read once, where it lies; only two sums return."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n <= limit and (total or 0) <= most_bytes


def small(df: DataFrame, limit: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df, marked for a broadcast if it fits; otherwise as it is, so that Spark shuffles it."""
    return F.broadcast(df) if fits(df, limit, most_bytes) else df
