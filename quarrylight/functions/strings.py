"""Text and path expressions. All are plain Column expressions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit names, and the characters that file names may not hold.
UNITS = ("B", "KB", "MB", "GB", "TB")
FORBIDDEN = r'[<>:"/\\|?*]'


def format_size(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Bytes with one decimal and no space; 0 is 0B; the last unit takes all that is larger."""
    out = F.when(n == 0, "0B")
    for k, unit in enumerate(units):
        value = F.format_string("%.1f" + unit, F.bround(n / F.lit(float(1024**k)), 1))
        out = out.when(n < 1024 ** (k + 1), value) if k < len(units) - 1 else out.otherwise(value)
    return out


def format_size_spaced(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Bytes with two decimals and a space; 0 and less is 0 B; the last unit takes all that is larger."""
    out = F.when(n <= 0, "0 B")
    for k, unit in enumerate(units):
        value = F.format_string("%.2f " + unit, F.bround(n / F.lit(float(1024**k)), 2))
        out = out.when(n < 1024 ** (k + 1), value) if k < len(units) - 1 else out.otherwise(value)
    return out


def extension(path: Column) -> Column:
    """The extension of a path with its dot, '' without one."""
    return F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1)


def suffix(path: Column) -> Column:
    """The lower-cased extension."""
    return F.lower(extension(path))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def safe_filename(name: Column, longest: int = 255) -> Column:
    """Forbidden characters as _, without blanks and dots at the ends, `unnamed` if nothing is left, cut before the extension."""
    clean = F.regexp_replace(F.regexp_replace(name, FORBIDDEN, "_"), r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(clean, r"[^.](\.[^.]*)$", 1)
    cut = F.concat(F.substring(clean, F.lit(1), F.greatest(F.lit(longest) - F.length(ext), F.lit(0))), ext)
    return F.when(clean == "", "unnamed").when(F.length(clean) > longest, F.substring(cut, 1, longest)).otherwise(clean)


def sanitize_filename(name: Column) -> Column:
    """Blanks as _, only letters, digits, _ . -, no dots in front, `image` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.trim(name), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_.-]", ""), r"^\.+", "")
    return F.when(clean == "", "image").otherwise(clean)


def safe_title(title: Column) -> Column:
    """Forbidden characters as _, nothing else changed."""
    return F.regexp_replace(title, FORBIDDEN, "_")


def thumbnail(content: Column) -> Column:
    """Picture bytes as base64 text, '' for none. Scaling is left to whoever makes the bytes."""
    return F.coalesce(F.replace(F.base64(content), F.lit("\r\n"), F.lit("")), F.lit(""))


def encoders(listing: Column) -> Column:
    """Names in a listing of encoders: the second word of each line whose first has six letters or dots, first V for video."""
    lines = F.filter(F.transform(F.split(listing, "\n"), F.trim), lambda x: x.rlike(r"^V[A-Z.]{5}\s+[^\s=]"))
    return F.transform(lines, lambda x: F.get(F.split(x, r"\s+"), F.lit(1)))


def slug(label: Column) -> Column:
    """The label before its first ` or `, lower-cased, other characters than letters and digits as single _."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(label, " or ", 1)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def group_key(scene: Column, theme: Column) -> Column:
    return F.when(scene == theme, scene).otherwise(F.concat(scene, F.lit("__"), theme))


def person_key(name: Column) -> Column:
    return F.regexp_replace(name, r"_\d+$", "")


def clock_seconds(text: Column) -> Column:
    """Seconds of the first HH:MM:SS.ff after `Duration:`; 0 without one."""
    part = lambda k: F.regexp_extract(text, r"Duration: (\d+):(\d+):(\d+\.?\d*)", k).cast("double")
    return F.when(text.rlike(r"Duration: \d+:\d+:\d+"), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.lit(0.0))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def elapsed(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1)))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")))
    )


def dimensions(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("×"), height.cast("string"))


def metadata_line(width: Column, height: Column, frames: Column, size: Column) -> Column:
    return F.concat_ws(" · ", dimensions(width, height), F.concat(frames.cast("string"), F.lit(" frames")), format_size(size))


def quality_label(vmaf: Column, ssim: Column) -> Column:
    return F.when(vmaf.isNotNull(), F.format_string("VMAF %.1f", F.bround(vmaf, 1))).when(ssim.isNotNull(), F.format_string("SSIM %.4f", F.bround(ssim, 4))).otherwise("—")


def plain_url(url: Column) -> Column:
    """Escapes of scripts undone."""
    return reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("\\/", "/"), ("\\u0026", "&")), url)


def absolute_url(base: Column, url: Column) -> Column:
    """The url as seen from a page at base: absolute ones as they are, //host, /path, and others beside the page."""
    origin = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*:)", 1), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(folder, url))
    )


def first_score(log: Column) -> Column:
    """The score of a quality log: the first `"mean": x`, else `VMAF score: x`, else that of the JSON object in it, its pooled
    mean or, where that is missing or 0, its `VMAF score`, written as text; 3 decimals, null without one."""
    a = F.regexp_extract(log, r'"mean"\s*:\s*([0-9.]+)', 1)
    b = F.regexp_extract(log, r"VMAF score\s*[:=]\s*([0-9.]+)", 1)
    whole = F.coalesce(*(F.when(x != "", x) for x in (F.regexp_extract(log, r'(?s)(\{"version".*\})', 1), F.regexp_extract(log, r'(?s)(\{"VMAF.*\})', 1))))
    inside = lambda path: F.get_json_object(whole, path).try_cast("double")
    pooled, score = inside("$.pooled_metrics.vmaf.mean"), inside("$['VMAF score']")
    text = lambda x: F.when(x != "", x).try_cast("double")
    return F.round(F.coalesce(text(a), text(b), F.when(pooled != 0, pooled), score), 3)


def last_value(log: Column, name: str) -> Column:
    """The number after the last `name:` of a log."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(name + r":\s*([0-9.]+)"), F.lit(1)), F.lit(-1)).try_cast("double")


def stream_fields(probe: Column) -> Column:
    """codec, width, height and bit rate of a probe's JSON, with the defaults of a missing stream."""
    got = F.from_json(probe, "streams array<struct<codec_name:string,width:int,height:int,bit_rate:string>>")
    first = F.get(got["streams"], F.lit(0))
    return F.struct(
        F.coalesce(first["codec_name"], F.lit("unknown")).alias("codec"),
        F.coalesce(first["width"], F.lit(0)).alias("width"),
        F.coalesce(first["height"], F.lit(0)).alias("height"),
        F.coalesce(first["bit_rate"].try_cast("long"), F.lit(0)).alias("bitrate"),
    )
