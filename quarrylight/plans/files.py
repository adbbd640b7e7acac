"""Plans of what would be moved, renamed or put in folders. Nothing is touched: a plan is rows (item_id, src_path, dst_path)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import strings as S
from quarrylight.operators.numbering import numbered


def target_path(path: Column, ext: str, tail: str = "") -> Column:
    """The path with another extension, and `tail` before it."""
    return F.concat(S.stem(path), F.lit(tail + ext))


def move_plan(items: DataFrame, folder: str = "Duplicate") -> DataFrame:
    """(item_id, src_path, dst_path, group_id) of what is not primary: name_dup.ext, then _dup1, _dup2 for equal names."""
    base = F.element_at(F.split("name", "/"), -1)
    moved = items.filter(~F.col("primary")).withColumn("stem", S.stem(base)).withColumn("ext", S.extension(F.col("name")))
    rows = numbered(moved, ["stem", "ext"], ["item_id"])
    tail = F.when(F.col("number") == 1, "_dup").otherwise(F.concat(F.lit("_dup"), (F.col("number") - 1).cast("string")))
    return rows.select("item_id", F.col("name").alias("src_path"), F.concat(F.lit(folder + "/"), "stem", tail, "ext").alias("dst_path"), "group_id")


def rename_plan(tags: DataFrame) -> DataFrame:
    """(item_id, src_path, dst_path): suggested name, running number in order of item_id, lower-cased extension."""
    rows = numbered(tags.filter("error is null"), ["suggested_name"], ["item_id"])
    return rows.select("item_id", F.col("name").alias("src_path"), F.concat("suggested_name", F.format_string("_%04d", "number"), S.suffix(F.col("name"))).alias("dst_path"))


def group_plan(tags: DataFrame) -> DataFrame:
    """(item_id, folder, dst_path): scene/theme if both are accepted, _unclassified otherwise; equal names in a folder numbered."""
    folder = F.when(F.col("scene_ok") & F.col("theme_ok"), F.concat_ws("/", "scene", "theme")).otherwise("_unclassified")
    rows = numbered(tags.filter("error is null").withColumn("folder", folder), ["folder", "name"], ["item_id"])
    tail = F.concat(S.stem(F.col("name")), F.lit("_"), (F.col("number") - 1).cast("string"), S.suffix(F.col("name")))
    return rows.select("item_id", "folder", F.concat_ws("/", "folder", F.when(F.col("number") == 1, F.col("name")).otherwise(tail)).alias("dst_path"))


def person_plan(found: DataFrame) -> DataFrame:
    """(item_id, src_path, dst_path) of rows (item_id, name, person): into the person's folder, a second file of that name as
    name_dup.ext. There is no third name: from the third on, dst_path is null and the file stays."""
    rows = numbered(found, ["person", "name"], ["item_id"])
    again = F.concat(S.stem(F.col("name")), F.lit("_dup"), S.extension(F.col("name")))
    name = F.when(F.col("number") == 1, F.col("name")).when(F.col("number") == 2, again)
    return rows.select("item_id", F.col("name").alias("src_path"), F.concat(F.col("person"), F.lit("/"), name).alias("dst_path"))


def _series(prefix: str) -> str:
    return "^" + re.escape(prefix) + r"_(\d+)_(\d+)$"


def not_in_series(files: DataFrame, prefix: str) -> DataFrame:
    """Of files (stem, ...) those that no series of the prefix has named: prefix, two numbers, nothing else, in the same case."""
    return files.filter(~F.coalesce(F.col("stem").rlike(_series(prefix)), F.lit(False)))


def last_series(files: DataFrame, prefix: str) -> DataFrame:
    """One row (last, named): the highest number of a series of the prefix, 0 without one, and how many files have such a name."""
    number = F.regexp_extract("stem", _series(prefix), 1)
    return files.agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0)).alias("last"), F.count_if(number != "").alias("named"))


def series_plan(named: DataFrame, there: DataFrame) -> DataFrame:
    """(item_id, src_path, dst_path) of rows (item_id, path, name): the name with the path's lower-cased extension, or, where
    `there` (path) has that already, the name with the first free (1), (2), ... before the extension.

    Files that the plan itself moves are out of the way, as they are renamed in two steps."""
    rows = named.withColumn("ext", S.suffix(F.col("path")))
    taken = there.join(named.select("path"), "path", "left_anti")
    number = F.regexp_extract("path", r"\((\d{1,9})\)(\.[^.]*)?$", 1)  # '' is the name itself, without a number
    used = taken.select(F.regexp_replace("path", r"\(\d{1,9}\)(?=(\.[^.]*)?$)", "").alias("base"), F.when(number == "", 0).otherwise(number.cast("int")).alias("n"))
    used = used.groupBy("base").agg(F.collect_set("n").alias("used"))
    out = rows.join(used, F.concat("name", "ext") == F.col("base"), "left")
    known = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(known)), known))
    free = F.when(F.array_contains(known, 0), free).otherwise(0)
    dst = F.concat("name", F.when(free > 0, F.concat(F.lit("("), free.cast("string"), F.lit(")"))).otherwise(""), "ext")
    return out.select("item_id", F.col("path").alias("src_path"), dst.alias("dst_path"))
