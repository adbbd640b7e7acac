"""Reports and logs as rows that Spark writes: HTML in order of its lines, JSON logs, feature tables.

A report's lines are (section, place, part, html); sorted by these they are the document, so it is written by all tasks and
never gathered on the driver. `one_file` gathers it in one task, for reports that a person opens.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import strings as S
from quarrylight.operators.matching import category_order
from quarrylight.operators.numbering import numbered
from quarrylight.storage import remove, written

ALL = {"ignoreNullFields": "false"}  #: a log says what is missing, too
STYLE = "body{font-family:sans-serif}section{margin:1em 0}.card{display:inline-block;margin:.4em;padding:.4em;border:1px solid #999}.primary{border-color:#080}"


def escaped(text: Column) -> Column:
    """Text that may stand in HTML, in an attribute too."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _card(kind: Column, *rows: Column, thumb: Column | None = None) -> Column:
    """thumb: a JPEG in base64; without one, or where it is null, the card has no picture."""
    lines = [F.concat(F.lit("<div>"), escaped(x), F.lit("</div>")) for x in rows]
    picture = [] if thumb is None else [F.when(thumb.isNotNull(), F.concat(F.lit('<img src="data:image/jpeg;base64,'), escaped(thumb), F.lit('">'))).otherwise("")]
    return F.concat(F.lit('<div class="card '), F.lower(kind), F.lit('"><b>'), kind, F.lit("</b>"), *picture, *lines, F.lit("</div>"))


def _line(section, place, part, html) -> list[Column]:
    return [F.lit(section).cast("int").alias("section") if isinstance(section, int) else section.cast("int").alias("section"), place.cast("long").alias("place"), part.cast("long").alias("part"), html.alias("html")]


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """One row of totals of rows (group_id, match_type, primary, size): groups, redundant members by kind, bytes to regain."""
    extra = ~F.col("primary")
    return groups.agg(
        F.count_if("primary").alias("groups"),
        F.count_if(extra).alias("redundant"),
        F.count_if(extra & (F.col("match_type") == "exact")).alias("redundant_exact"),
        F.count_if(extra & (F.col("match_type") == "near")).alias("redundant_near"),
        F.coalesce(F.sum(F.when(extra, F.col("size"))), F.lit(0)).alias("recoverable"),
    )


def sorted_groups(groups: DataFrame) -> DataFrame:
    """(group_id, match_type, members, place): groups by number of members, largest first, then by group_id."""
    per = groups.groupBy("group_id", "match_type").agg(F.count(F.lit(1)).alias("members")).withColumn("fewer", -F.col("members"))
    return numbered(per, [], ["fewer", "group_id"], "place").drop("fewer")


def duplicate_report(groups: DataFrame, title: str = "Duplicates", executed: bool = False, threshold: float | None = None, source: str | None = None) -> DataFrame:
    """Lines of a report of rows (group_id, item_id, match_type, primary, name, size): whether files were moved, totals, then
    exact and near groups, the larger first, the primary member first in each. A section without groups is left out.

    executed: whether the plan was carried out, as the report says in its first line. Rows may have `meta`, a line about the
    item that stands in place of its size, and `thumb`, a picture in base64; either may be null. threshold and source are
    told where they are given."""
    more = [c for c in ("meta", "thumb") if c in groups.columns]
    groups = written(groups.select("group_id", "item_id", "match_type", "primary", "name", "size", *more), "report")
    t = duplicate_totals(groups)
    facts = [f"{name} {value:g}" if isinstance(value, float) else f"{name} {value}" for name, value in (("threshold", threshold), ("source", source)) if value is not None]
    told = F.concat(F.lit("<p>"), escaped(F.lit(", ".join(facts))), F.lit("</p>")) if facts else F.lit("")
    head = F.concat(F.lit(f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1><p class=\"mode\">{'EXECUTED: files were moved' if executed else 'DRY RUN: no files were moved'}</p>"), told, F.lit("<p>"), F.col("groups").cast("string"), F.lit(" groups, "), F.col("redundant").cast("string"), F.lit(" duplicates ("), F.col("redundant_exact").cast("string"), F.lit(" exact, "), F.col("redundant_near").cast("string"), F.lit(" near), "), S.format_size(F.col("recoverable")), F.lit(" recoverable</p>"))
    zero = F.lit(0)
    out = t.select(*_line(0, zero, zero, head)).unionByName(t.select(*_line(9, zero, zero, F.lit("</body></html>"))))
    kind = F.when(F.col("match_type") == "exact", 1).otherwise(2)
    sections = groups.select("match_type").distinct()
    name = F.concat(F.lit("<h2>"), F.initcap("match_type"), F.lit(" duplicates</h2>"))
    out = out.unionByName(sections.select(*_line(kind, zero, zero, name)))
    places = sorted_groups(groups)
    opened = F.concat(F.lit("<section><h3>Group of "), F.col("members").cast("string"), F.lit("</h3>"))
    out = out.unionByName(places.select(*_line(kind, F.col("place"), zero, opened))).unionByName(places.select(*_line(kind, F.col("place"), F.lit((1 << 62)), F.lit("</section>"))))
    cards = numbered(groups.withColumn("later", F.when(F.col("primary"), 0).otherwise(1)), ["group_id"], ["later", "item_id"]).join(places.select("group_id", "place"), "group_id")
    line = F.coalesce("meta", S.format_size(F.col("size"))) if "meta" in more else S.format_size(F.col("size"))
    card = _card(F.when(F.col("primary"), "PRIMARY").otherwise("DUP"), F.col("name"), line, thumb=F.col("thumb") if "thumb" in more else None)
    return out.unionByName(cards.select(*_line(kind, F.col("place"), F.col("number"), card)))


def match_report(found: DataFrame, title: str = "Matches") -> DataFrame:
    """Lines of a report of rows (item_id, name, person, score): a section for each person by name, then Group, then Others;
    in each the best scores first."""
    found = written(found.select("item_id", "name", "person", "score"), "report")
    zero = F.lit(0)
    per = found.groupBy("person").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", category_order(F.col("person")))
    places = numbered(per, [], ["rank", "person"], "place")
    ends = found.sparkSession.range(1).select(F.lit(0).alias("x"))
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1>"
    out = ends.select(*_line(0, zero, zero, F.lit(head))).unionByName(ends.select(*_line(9, zero, zero, F.lit("</body></html>"))))
    opened = F.concat(F.lit("<section><h2>"), escaped(F.col("person")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2>"))
    out = out.unionByName(places.select(*_line(1, F.col("place"), zero, opened))).unionByName(places.select(*_line(1, F.col("place"), F.lit((1 << 62)), F.lit("</section>"))))
    cards = numbered(found.withColumn("worse", -F.col("score")), ["person"], ["worse", "item_id"]).join(places.select("person", "place"), "person")
    return out.unionByName(cards.select(*_line(1, F.col("place"), F.col("number"), _card(F.col("person"), F.col("name"), F.format_string("%.4f", "score")))))


def write_html(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """The document, as text files that are it when joined in order of their names."""
    rows = lines.coalesce(1) if one_file else lines
    order = ["section", "place", "part"]
    rows = rows.sortWithinPartitions(*order) if one_file else rows.orderBy(*order)
    rows.select("html").write.mode("overwrite").text(path)


def match_log(found: DataFrame) -> DataFrame:
    """(json) of each match (item_id, name, person, score, face_count): a line of a JSON log; scores to 4 decimals."""
    return found.select("item_id", F.to_json(F.struct("item_id", F.col("name").alias("path"), "person", F.round("score", 4).cast("decimal(10,4)").alias("score"), "face_count"), ALL).alias("json"))


def tag_log(tags: DataFrame) -> DataFrame:
    """(json) of each tagged item, rows with an error included: what failed is part of the log."""
    label = lambda x: F.struct(F.col(x).alias("label"), F.col(f"{x}_score").cast("decimal(10,4)").alias("score"), F.col(f"{x}_ok").alias("accepted"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    row = F.struct("item_id", F.col("name").alias("file"), good(label("scene")).alias("scene"), good(label("theme")).alias("theme"), good(F.col("posture")).alias("posture"), good(F.col("group_key")).alias("group_key"), "error")
    return tags.select("item_id", F.to_json(row, ALL).alias("json"))


def tag_document(tags: DataFrame, **meta) -> DataFrame:
    """(place, json): lines which, in order of place, are one JSON object: `meta` with what is given and total_images, then
    `images`, an object of `tag_log` a line in order of item_id, so that the document is written by all tasks."""
    logged = written(tag_log(tags), "tags")
    n = logged.count()
    rows = numbered(logged, [], ["item_id"], "place").select("place", F.concat("json", F.when(F.col("place") < n, ",").otherwise("")).alias("json"))
    head = json.dumps({"meta": {**meta, "total_images": n}}, ensure_ascii=False)[:-1] + ', "images": ['
    ends = tags.sparkSession.createDataFrame([(0, head), (n + 1, "]}")], "place long, json string")
    return rows.unionByName(ends)


def outcome_log(rows: DataFrame, **run) -> DataFrame:
    """(json) of each outcome (file, status, error, orig_size, new_size), with the settings of the run."""
    settings = [F.lit(v).alias(k) for k, v in run.items()]
    row = F.struct(*settings, "file", "status", "error", "orig_size", "new_size")
    return rows.select("file", F.to_json(row, ALL).alias("json"))


def write_log(log: DataFrame, path: str) -> None:
    log.select("json").write.mode("overwrite").text(path)


def save_features(spark: SparkSession, features: DataFrame, path: str) -> None:
    """The feature table at path, anew: written beside it first, then put in its place, so that a failure leaves the old one,
    also where features was read from it. The two moves are not one step: a reader between them finds no table."""
    temporary, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    try:
        features.write.parquet(temporary)
    except Exception:
        remove(spark, temporary)
        raise
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = store.exists(jvm.Path(path))
    if there and not store.rename(jvm.Path(path), jvm.Path(old)):
        remove(spark, temporary)
        raise OSError(f"{path} could not be replaced")
    if not store.rename(jvm.Path(temporary), jvm.Path(path)):
        if there:
            store.rename(jvm.Path(old), jvm.Path(path))
        raise OSError(f"{path} could not be written")
    if there:
        remove(spark, old)
