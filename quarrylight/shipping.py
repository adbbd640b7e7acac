"""What Python functions in Spark need: this package in the workers, and Arrow batches of a bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession, rows: int = 1000) -> None:
    """Makes this package importable in the Python workers and bounds the rows and the bytes of an Arrow batch.

    Both are settings of the session, which are lowered but never raised."""
    context = spark.sparkContext
    if not getattr(context, "_quarrylight_shipped", False):  # the folder is read by the driver alone, which sends the file
        top = os.path.dirname(os.path.abspath(__file__))
        path = f"{tempfile.mkdtemp(prefix='quarrylight-')}/quarrylight_package.zip"
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        context._quarrylight_shipped = True
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        if not 0 < int(spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
