"""Rule tables as ordered conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def optimal_fps(duration: Column, size_mb: Column, width: Column) -> Column:
    """10 frames a second, scaled by length, size and width; within 5 and 15."""
    by_time = F.when(duration > 30, 0.6).when(duration > 15, 0.75).when(duration > 5, 0.9).otherwise(1.0)
    by_size = F.when(size_mb <= 8, 0.7).when(size_mb <= 12, 0.85).when(size_mb <= 20, 1.0).otherwise(1.2)
    by_width = F.when(width >= 800, 0.8).when(width >= 600, 0.9).otherwise(1.0)
    return F.greatest(F.lit(5), F.least(F.lit(15), (10 * by_time * by_size * by_width).cast("int")))


def file_format(size_mb: Column, name: Column) -> Column:
    low = F.lower(name)
    return F.when(size_mb > 100, "webp").when(low.contains("gif") | low.contains("animated"), "gif").when(size_mb < 10, "gif").otherwise("webp")


def folder_format(files: Column, mean_mb: Column) -> Column:
    return F.when(files > 10, "webp").when(mean_mb > 50, "webp").otherwise("gif")


def trim(duration: Column, longest: float = 15.0) -> Column:
    """What is longer is clipped and its source kept; the rest is converted whole and its source may go."""
    long = duration > longest
    return F.struct(F.lit(0.0).alias("start_s"), F.least(duration, F.lit(longest)).alias("end_s"), F.when(long, "keep").otherwise("delete").alias("source"))


def delete_allowed(ext: Column, verified: Column, size: Column, keep_source: Column, delete_source: Column) -> Column:
    """An explicit keep wins over an explicit delete; without either the source stays."""
    wanted = F.when(keep_source.isNotNull(), ~keep_source).otherwise(F.coalesce(delete_source, F.lit(False)))
    return wanted & (ext == ".mp4") & F.coalesce(verified, F.lit(False)) & (size >= 1024)


def convertible(ext: Column, animated: Column, has_heic: bool = True) -> Column:
    kinds = [".png", ".bmp", ".tiff", ".tif", ".webp", ".jpeg"] + [".heic", ".heif"] * has_heic
    return ext.isin(kinds) & ~(ext.isin(".webp", ".heic", ".heif") & F.coalesce(animated, F.lit(False)))


def vmaf_band(score: Column) -> Column:
    return F.when(score >= 95, "transparent").when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair").otherwise("poor")


def target_width(requested: Column, original: Column, widest: int = 800) -> Column:
    return F.least(F.coalesce(requested, original), F.lit(widest))


def frame_ms(fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(1000 / F.greatest(fps, F.lit(1)), 0).cast("int"))


def inference_size(width: Column, height: Column, longest: int = 1280) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def posture(shoulder: Column, hip: Column, knee: Column, ankle: Column, wrist: Column) -> Column:
    """From heights in the image, 0 at the top; null for what is not visible. The first rule that holds decides."""
    torso = F.abs(hip - shoulder)
    crouch = knee.isNotNull() & ankle.isNotNull() & (torso > 0.05) & (F.abs(knee - hip) < 0.12) & (F.abs(ankle - knee) < 0.12)
    sit = knee.isNotNull() & (F.abs(knee - hip) < 0.10) & (torso > 0.05)
    rules = ((torso < 0.08, "lying_down", 0.80), (crouch, "crouching", 0.75), (sit, "sitting", 0.78), (wrist < shoulder - 0.06, "standing_arms_raised", 0.82))
    label, score = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for holds, name, value in rules:
        label, score = label.when(holds, name), score.when(holds, value)
    return F.struct(label.otherwise("standing").alias("label"), score.otherwise(0.88).alias("score"))


def landmarks(one: Column, listed: Column, nested: Column) -> Column:
    """The landmarks of a picture from whichever form its detector gives: one struct with `landmark`, a list of such structs,
    or a list of lists, the first person's in either. Null if there are none."""
    return F.coalesce(one["landmark"], F.get(listed, F.lit(0))["landmark"], F.get(nested, F.lit(0)))


def visible_mean(a: Column, b: Column, least: float = 0.40) -> Column:
    """Mean height of two landmarks (y, visibility), or that of the visible one; the second's if neither is."""
    on_a, on_b = a["visibility"] > least, b["visibility"] > least
    return F.when(on_a & on_b, (a["y"] + b["y"]) / 2).when(on_a, a["y"]).otherwise(b["y"])
