"""Which encoder a codec gets on a host: a table of profiles, what the host has, and the order of preference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.storage import small

#: Codec, mode and encoder.
PROFILES = (
    ("av1", "soft", "libsvtav1"),
    ("av1", "nvenc", "av1_nvenc"),
    ("av1", "qsv", "av1_qsv"),
    ("av1", "amf", "av1_amf"),
    ("h265", "soft", "libx265"),
    ("h265", "nvenc", "hevc_nvenc"),
    ("h265", "qsv", "hevc_qsv"),
    ("h265", "amf", "hevc_amf"),
    ("h265", "vtb", "hevc_videotoolbox"),
    ("h264", "soft", "libx264"),
    ("h264", "nvenc", "h264_nvenc"),
    ("h264", "qsv", "h264_qsv"),
    ("h264", "amf", "h264_amf"),
    ("h264", "vtb", "h264_videotoolbox"),
)
PREFERENCE = ("nvenc", "qsv", "amf", "vtb")  #: the order in which `auto` tries hardware, a fixed value too


def profiles(spark: SparkSession) -> DataFrame:
    """(codec, mode, encoder, place): place is null for software."""
    place = {m: k for k, m in enumerate(PREFERENCE)}
    return spark.createDataFrame([(*p, place.get(p[1])) for p in PROFILES], "codec string, mode string, encoder string, place int")


def choose_encoders(asked: DataFrame, available: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """asked (host, codec, mode, ...) with encoder, hardware and fell_back.

    cpu: the codec's software; auto: the first hardware encoder, in order of preference, that the host has, else software; a
    name of hardware: that, if the codec has one and the host has it, else software, which fell_back tells. Any other mode
    falls back as well; a codec without a profile has no encoder. available (host, encoder), in any case, may repeat; a host
    that it does not name has software alone. What a host can do is one row a codec, so requests are joined once.
    """
    table = profiles(asked.sparkSession) if table is None else table
    soft = table.filter("place is null").select("codec", F.col("encoder").alias("__soft"))
    hard = table.filter("place is not null").select("codec", F.col("mode").alias("name"), "place", "encoder", F.lower("encoder").alias("key"))
    have = available.select("host", F.lower("encoder").alias("key")).distinct().join(small(hard, 10_000), "key")
    able = have.groupBy("host", "codec").agg(F.min_by("encoder", "place").alias("__auto"), F.map_from_entries(F.collect_list(F.struct("name", "encoder"))).alias("__named"))
    rows = asked.join(small(able, 500_000), ["host", "codec"], "left").join(small(soft, 10_000), "codec", "left")
    mode = F.col("mode")
    found = F.when(mode == "auto", F.col("__auto")).when(mode != "cpu", F.try_element_at("__named", mode))
    known = F.col("__soft").isNotNull()
    rows = rows.withColumns({"encoder": F.coalesce(found, "__soft"), "hardware": F.when(known, found.isNotNull()), "fell_back": F.when(known, ~F.coalesce(mode.isin("cpu", "auto"), F.lit(False)) & found.isNull())})
    return rows.select(*asked.columns, "encoder", "hardware", "fell_back")
