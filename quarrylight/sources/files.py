"""File sources: listings of folders without file contents, what the tools take from them, lists of addresses, feature tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.functions import strings as S
from quarrylight.operators.numbering import numbered
from quarrylight.shipping import ship

#: Extensions and folders of each kind of listing.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".gif")
PHOTOS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
ANIMATED = (".gif", ".webp")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv", ".ts", ".mts")
COMPRESSIBLE = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".wmv", ".flv", ".webm", ".ts", ".mts", ".m2ts")
DUPLICATES, SORTED = ("Duplicate",), ("Others", "Group")


@dataclass(frozen=True)
class Listing:
    """Which files a tool takes: extensions (none: all), folder names below which it looks at none, and its order."""

    extensions: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    order: tuple[str, ...] = ("parts",)


LISTINGS = {
    "stills": Listing(IMAGES, DUPLICATES),
    "animated": Listing(ANIMATED, DUPLICATES),
    "videos": Listing(VIDEOS, DUPLICATES),
    "faces": Listing(PHOTOS, SORTED),
    "tagger": Listing(PHOTOS),
    "organizer": Listing(IMAGES, order=("mtime", "lower_name")),
    "convert": Listing(),
    "jpg": Listing((".jpg",)),
    "compress": Listing(COMPRESSIBLE),
    "mp4": Listing((".mp4",)),
}


def named(files: DataFrame) -> DataFrame:
    """files (path, ...) with name, stem, ext (lower-cased), lower_name and parts, by which paths are ordered: a folder's files
    stand together, so a/b comes before a-b."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.withColumns({"name": name, "stem": S.stem(name), "ext": S.suffix(name), "lower_name": F.lower(name), "parts": parts})


def select_files(files: DataFrame, listing: Listing, recursive: bool = True, subtree: str | None = None) -> DataFrame:
    """Of files (path relative to the folder, ext, ...) those of a listing. subtree: a folder, relative too, of which no file
    is taken, such as one of references."""
    parts = F.split("path", "/")
    out = files.filter(F.col("ext").isin(*listing.extensions)) if listing.extensions else files
    if listing.without:
        out = out.filter(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, listing.without))))
    if subtree:
        out = out.filter(~F.col("path").startswith(subtree.strip("/") + "/"))
    return out if recursive else out.filter(F.size(parts) == 1)


def media_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (), recursive: bool = True, without: tuple[str, ...] = DUPLICATES) -> DataFrame:
    """(path, name, stem, ext, size, mtime) of the files under folder; contents are not read.

    extensions: lower-case, with the dot; none for all files. A file below a folder named in `without` is left out; only
    names below `folder` count. Spark lists neither hidden files (., _) nor files
    of zero bytes. An empty folder gives no rows. Sort where order matters.
    """
    return listed(spark, folder, Listing(extensions, without), recursive)


def listed(spark: SparkSession, folder: str, listing: Listing, recursive: bool = True, subtree: str | None = None) -> DataFrame:
    """(path, name, stem, ext, size, mtime) of the files under folder that a listing takes; in its order after `ordered`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("full"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    # the path of a file as Spark names it has a scheme, the folder may have none: cut after the folder's own name
    top = F.lit("/" + folder.split("://")[-1].strip("/") + "/")
    inner = found.withColumn("top", top).withColumn("path", F.expr("substring(full, instr(full, top) + length(top))"))
    out = select_files(named(inner), listing, recursive, subtree)
    return out.select(F.col("full").alias("path"), "name", "stem", "ext", "size", "mtime", "lower_name").drop("lower_name")


def ordered(files: DataFrame, listing: Listing) -> DataFrame:
    """files in a listing's order, by the parts of their paths as a tie."""
    keys = {"lower_name": F.lower("name"), "parts": F.split("path", "/")}
    rows = files.withColumns(keys).orderBy(*dict.fromkeys((*listing.order, "parts")))
    return rows.drop(*(k for k in keys if k not in files.columns))


def file_or_folder(spark: SparkSession, path: str, listing: Listing) -> DataFrame:
    """The files of a folder, or the one file that path names, if its extension is the listing's; neither is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(path)
    if store.getFileStatus(at).isDirectory():
        return listed(spark, path, listing)
    if listing.extensions and not path.lower().endswith(listing.extensions):
        raise ValueError(f"{path} is none of {', '.join(listing.extensions)}")
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    return listed(spark, folder, Listing(listing.extensions), recursive=False).filter(F.col("name") == name)


def valid_size(most: int = 50 * 1024 * 1024) -> Column:
    """Whether a file is neither empty nor larger than `most` bytes."""
    return F.col("size").between(1, most)


def large_enough(size: Column, least: int = 1024, more: bool = False) -> Column:
    """Whether an output is no stump: at least `least` bytes, or more than that."""
    return F.coalesce(size > least if more else size >= least, F.lit(False))


def validated(files: DataFrame, extensions: tuple[str, ...] = IMAGES, most: int = 50 * 1024 * 1024, readable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(files that can be used, the others with the first reason as `error`); readable: whether the content could be read."""
    error = (
        F.when(F.col("path").isNull(), "no path")
        .when(~F.coalesce(F.col("ext").isin(*extensions), F.lit(False)), "extension")
        .when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "empty")
        .when(F.col("size") > most, "too large")
    )
    if readable is not None:
        error = error.when(~F.coalesce(readable, F.lit(False)), "unreadable")
    rows = files.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def animated_webp(data: bytes | None) -> bool:
    """Whether the head of a file says that it is an animated WebP: a flag of the extended format, or a chunk that says so.
    Chunks stand on even places; a file that is cut short says no."""
    data = bytes(data or b"")
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return False
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"ANIM" or (kind == b"VP8X" and at + 8 < len(data) and data[at + 8] & 2):
            return True
        at += 8 + size + size % 2
    return False


def is_animated(ext: Column, head: Column) -> Column:
    """Whether a file of the `animated` listing is: each GIF, and a WebP whose first bytes say so. Others are not read."""
    ship(SparkSession.active())

    @F.pandas_udf("boolean")
    def animated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for heads in batches:
            yield pd.Series([animated_webp(x) for x in heads])

    return (ext == ".gif") | F.coalesce(animated(F.when(ext == ".webp", head)) & (ext == ".webp"), F.lit(False))


def address_list(lines: DataFrame) -> DataFrame:
    """(source_index, url) of rows (line_no, line): trimmed, without blank ones, numbered from 1 in order."""
    rows = lines.select("line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("url")).filter("url != ''")
    return numbered(rows, [], ["line_no"], "source_index").select("source_index", "url")


def address_file(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, url) of a text file with one address a line."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return address_list(lines.withColumn("line_no", F.monotonically_increasing_id()))


def feature_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table of cached features at path; no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
