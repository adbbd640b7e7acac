"""What the operators share: samples by hash, spans of regular expressions, texts cut and put together by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.arrays import bound

SPAN = "array<struct<s:int,e:int,m:string>>"
SHARE = 1 << 63  #: hashes, taken without their sign bit, lie below
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def among(key: Column, sample: int, n: int) -> Column:
    """Whether the hash `key` is among about `sample` of n different ones. The bound is a whole number of 63 bits, never 0."""
    return F.shiftrightunsigned(key, 1) < F.lit(min(SHARE - 1, max(1, SHARE * sample // max(n, 1))))


def running(values: Column, both) -> Column:
    """Running results of an array of integers under both(a, b), such as sums or maxima. Each step lets every place take in
    the one 1, 2, 4, ... before it, so n values cost n log n, and no array grows by one."""

    def over(v: Column) -> Column:
        steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda k: k < F.size(v))
        return F.aggregate(steps, v, lambda a, k: F.transform(a, lambda x, i: F.when(i >= k, both(x, F.get(a, i - k))).otherwise(x)))

    return bound(values, over)


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,e,m>>: code points, end exclusive; m is the given group.

    The pieces between matches and the matches themselves, laid end to end, give the offsets.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("p"), hits.alias("h"), inner.alias("m")), lambda x: x["h"].isNotNull())

    def spans(rows: Column) -> Column:
        ends = sums(F.transform(rows, lambda x: F.length(x["p"]) + F.length(x["h"])))
        return F.zip_with(rows, ends, lambda x, e: F.struct((e - F.length(x["h"])).alias("s"), e.alias("e"), x["m"].alias("m")))

    return bound(rows, spans)


def none_found() -> Column:
    return F.array().cast(SPAN)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def wide(text: Column) -> Column:
    """The text as four bytes a character, in which a place is found at once and not by counting from the start."""
    return F.encode(text, "UTF-32")


def part(of: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a wide text. The mark of byte order in front keeps one that the text itself begins with."""
    return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(of, 4 * start + 1, 4 * (end - start))), "UTF-32")


def disjoint(spans: Column) -> Column:
    """Of spans sorted by start, those that begin inside no earlier one: array of (before, s, e, x); x is the span, e the end
    of all that begin inside it, before the end of the one before it."""

    def over(v: Column) -> Column:
        return bound(running(F.transform(v, lambda x: x["e"]), F.greatest), lambda ends: apart(v, ends))

    def apart(v: Column, ends: Column) -> Column:
        rows = F.transform(v, lambda x, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("before"), x.alias("x")))
        return bound(F.filter(rows, lambda y: y["x"]["s"] >= y["before"]), lambda new: closed(new, ends))

    def closed(new: Column, ends: Column) -> Column:
        last = F.get(ends, F.size(ends) - 1)
        return F.transform(new, lambda y, i: F.struct(y["before"], y["x"]["s"].alias("s"), F.coalesce(F.get(new, i + 1)["before"], last).alias("e"), y["x"].alias("x")))

    return bound(spans, over)


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each of the spans, sorted by start, replaced by by(x), x of `disjoint`: a span that begins inside an earlier
    one only widens it."""

    def over(w: Column) -> Column:
        return bound(disjoint(spans), lambda d: F.concat(F.array_join(F.transform(d, lambda x: F.concat(part(w, x["before"], x["s"]), by(x))), ""), rest(w, d)))

    def rest(w: Column, d: Column) -> Column:
        return part(w, F.get(d, F.size(d) - 1)["e"], F.octet_length(w) / 4)

    return F.when(F.size(spans) == 0, text).otherwise(bound(wide(text), over))
