"""Running numbers within groups, also where one group holds most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.storage import small, written

MOST = 500_000  #: rows of a group that one task numbers


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number", most: int = MOST) -> DataFrame:
    """rows with `name`: 1, 2, ... within each group of equal keys (nulls are equal), in ascending order; no keys, one group.

    If a group has more than `most` rows, all rows are dealt by ranges of keys and order; each range numbers its own, from
    the number of rows that the ranges before it have of the group. Ties of order are numbered in any order.
    """
    by = [F.col(k) for k in keys]
    largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-largest // most) * 4)
    dealt = written(rows.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same: Column = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.col("__part") == F.col("__of"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    out = dealt.withColumn("__own", own).join(small(base, 2_000_000), same)
    return out.withColumn(name, (F.col("__own") + F.col("__base")).cast("long")).select(*rows.columns, name)
