"""Labels, timelines, outcomes and caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.operators.matching import LARGEST_REFERENCES
from quarrylight.operators.pairs import across
from quarrylight.shipping import ship
from quarrylight.storage import fits

# --- labels


def zero_shot(vectors: DataFrame, labels: DataFrame, scale: float = 100.0, threshold: float = 0.20, top: int = 3) -> DataFrame:
    """(item_id, label, score, accepted, top array of (label, score)): softmax of scaled cosines over labels (label, ord,
    label_emb); a label may have several vectors, the nearest counts.

    Scores are rounded to 4 decimals before the threshold; ties go by the labels' order. Cosines are matrix products, and a
    call gives an item's `top` best labels, their largest cosine and the sum of what it saw. Labels that fit are sent to every
    task, and nothing is shuffled; more meet the items in blocks, all vectors of a label in one, and only these few numbers
    of each block are put together.
    """
    ship(vectors.sparkSession)
    items = vectors.filter("emb is not null").select("item_id", "emb")
    own = labels.filter("label_emb is not null").groupBy("label", "ord").agg(F.collect_list("label_emb").alias("embs"))
    kinds = StructType([items.schema["item_id"], *StructType.fromDDL("high double, total double, best array<struct<down:double,ord:bigint,label:string>>").fields])

    def seen(part: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(names):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in kinds})
        names = names.sort_values(["ord", "label"], ignore_index=True)
        y = np.stack([e for embs in names["embs"] for e in embs]).astype(np.float64)
        x = np.stack(part["emb"].to_numpy()).astype(np.float64)
        cosine = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1)) + 1e-8)
        of = scale * np.maximum.reduceat(cosine, np.cumsum([0] + [len(e) for e in names["embs"]][:-1]), axis=1)
        high = of.max(axis=1)
        first = np.argsort(-of, axis=1, kind="stable")[:, :top]
        best = [[{"down": -of[i, j], "ord": int(names["ord"][j]), "label": names["label"][j]} for j in row] for i, row in enumerate(first)]
        return pd.DataFrame({"item_id": part["item_id"].to_numpy(), "high": high, "total": np.exp(of - high[:, None]).sum(axis=1), "best": best})

    if fits(own, LARGEST_REFERENCES):
        sent = items.sparkSession.sparkContext.broadcast(own.toPandas())

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield seen(part, sent.value)

        rows = items.mapInPandas(batches, kinds)
    else:
        parts = across(items, own, seen, kinds)
        rows = parts.groupBy("item_id").agg(F.max("high").alias("all_high"), F.collect_list(F.struct("high", "total")).alias("sums"), F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
        total = F.aggregate("sums", F.lit(0.0), lambda a, r: a + r["total"] * F.exp(r["high"] - F.col("all_high")))
        rows = rows.select("item_id", F.col("all_high").alias("high"), total.alias("total"), "best")
    score = lambda r: F.round(F.exp(-r["down"] - F.col("high")) / F.col("total"), 4)
    best = rows.select("item_id", F.transform(F.slice("best", 1, top), lambda r: F.struct(r["label"].alias("label"), score(r).alias("score"))).alias("top"))
    first = F.get("top", F.lit(0))
    return best.select("item_id", first["label"].alias("label"), first["score"].alias("score"), (first["score"] >= threshold).alias("accepted"), "top")


def tag_summary(tags: DataFrame) -> DataFrame:
    """Per group_key of tags without error: count, mean scores, postures seen."""
    good = tags.filter("error is null")
    return good.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("scene_score").alias("avg_scene"),
        F.avg("theme_score").alias("avg_theme"),
        F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set("posture")), ", "), F.lit("")), F.lit("—")).alias("postures"),
    )


# --- timelines


def segments(items: DataFrame, length: float = 15.0, gap: float = 45.0) -> DataFrame:
    """(item_id, seg_idx, start_s, end_s): a segment of `length` at each multiple of `gap` under duration_s."""
    if length < 0.1 or gap < length:
        raise ValueError("a segment lasts 0.1 s at least and the gap at least as long")
    n = F.ceil(F.col("duration_s") / gap).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(gap)))).otherwise(F.array().cast("array<double>"))
    rows = items.select("item_id", "duration_s", F.posexplode(starts).alias("seg_idx", "start_s"))
    return rows.select("item_id", "seg_idx", "start_s", F.least(F.col("start_s") + length, F.col("duration_s")).alias("end_s"))


def sub_clip(frames: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Of frames (t, duration_s) those from start, before the end of the clip or of the whole."""
    last = F.col("duration_s") if end is None else F.least(F.lit(end), F.col("duration_s"))
    return frames.filter((F.col("t") >= start) & (F.col("t") < last))


def gapped_window(seconds: Column, length: float, gap: float) -> Column:
    """The number of the window that holds a time, null in the gaps; windows begin at each multiple of gap."""
    k = F.floor(seconds / gap)
    return F.when(seconds - k * gap < length, k)


# --- outcomes


def savings_pct(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.lit(0.0)).otherwise(F.round((1 - new / old) * 100, 1))


def with_status(rows: DataFrame) -> DataFrame:
    """status: error, skipped if nothing was saved, ok."""
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("new_size") >= F.col("orig_size"), "skipped").otherwise("ok"))


def compress_summary(rows: DataFrame) -> DataFrame:
    """Counts by status; what was saved and how well, of those that succeeded. The mean SSIM only where no VMAF is known."""
    ok = F.col("status") == "ok"
    of = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("double")
    vmaf, ssim = F.avg(F.when(ok, of("vmaf"))), F.avg(F.when(ok, of("ssim")))
    return rows.agg(
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.sum(F.when(ok, F.col("orig_size") - F.col("new_size"))).alias("saved"),
        F.avg(F.when(ok, savings_pct(F.col("orig_size"), F.col("new_size")))).alias("avg_savings_pct"),
        vmaf.alias("avg_vmaf"),
        F.when(vmaf.isNull(), ssim).alias("avg_ssim"),
    )


def recompress_summary(rows: DataFrame) -> DataFrame:
    """In place: what was skipped or failed keeps its size in the final total."""
    ok = F.col("status") == "ok"
    final = F.when(ok, F.col("new_size")).otherwise(F.col("orig_size"))
    saved = F.coalesce(F.sum(F.when(ok, F.col("orig_size") - F.col("new_size"))), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("compressed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.sum("orig_size").alias("orig_total"),
        F.sum(final).alias("final_total"),
        saved.alias("saved"),
        F.when(F.sum("orig_size") > 0, saved / F.sum("orig_size") * 100).alias("saved_pct"),
    )


def throughput(n: Column, seconds: Column) -> Column:
    """Pieces a second, 0 if no time has passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def run_summary(rows: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """total, succeeded, failed of rows (success); with elapsed seconds, also the rate."""
    ok = F.coalesce("success", F.lit(False))
    total = F.count(F.lit(1))
    parts = [total.alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")]
    return rows.agg(*parts, *([] if elapsed is None else [throughput(total, F.max(elapsed)).alias("rate")]))


def conversion_summary(rows: DataFrame, longest: float = 15.0) -> DataFrame:
    """Of rows (success, duration_s, source_deleted, size): only sources of up to `longest` seconds were to be deleted."""
    ok = F.coalesce("success", F.lit(False))
    gone = F.coalesce("source_deleted", F.lit(False))
    short = ok & (F.col("duration_s") <= longest)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(short & gone).alias("deleted"),
        F.count_if(short & ~gone).alias("not_deleted"),
        F.coalesce(F.sum(F.when(short & gone, F.col("size"))), F.lit(0)).alias("freed"),
    )


def sample_mean(rows: DataFrame, value: str, order: list[str], n: int = 3) -> DataFrame:
    """mean of the first n rows in order: a rough guess, as it is meant to be."""
    return rows.orderBy(*order).limit(n).agg(F.avg(value).alias("mean"))


def convert_summary(rows: DataFrame) -> DataFrame:
    """Originals of all tries against conversions that succeeded, as reported, and of the same files, as is true."""
    ok = F.col("status") == "ok"
    return rows.agg(
        F.count_if(ok).alias("converted"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.sum("orig_size").alias("orig_total"),
        F.sum(F.when(ok, F.col("new_size"))).alias("new_total"),
        (F.sum("orig_size") - F.sum(F.when(ok, F.col("new_size")))).alias("saved_reported"),
        F.sum(F.when(ok, F.col("orig_size") - F.col("new_size"))).alias("saved_true"),
    )


#: What is tried, in order, to bring a picture under a size: a quality, every n-th frame, a number of colours.
PHASES = (("quality", (85, 75, 65, 55, 45, 35, 25)), ("frames", (2, 3, 4)), ("palette", (128, 64, 32, 16)))


def search_steps(items: DataFrame, phases=PHASES) -> DataFrame:
    """items (item_id, frames, ...) with phase, place and step: a row for each try. Each phase begins from the original, not from
    what the one before has made of it. A try that would leave fewer than two frames is none."""
    tries = F.flatten(F.array(*(F.array(*(F.struct(F.lit(name).alias("phase"), F.lit(100 * k + i).alias("place"), F.lit(step).alias("step")) for i, step in enumerate(steps))) for k, (name, steps) in enumerate(phases))))
    rows = items.withColumn("try", F.explode(tries)).select(*items.columns, "try.*")
    return rows.filter((F.col("phase") != "frames") | (F.ceil(F.col("frames") / F.col("step")) >= 2))


def first_fitting(items: DataFrame, size, phases=PHASES) -> DataFrame:
    """`first_under` of `search_steps` where size(phase, step), columns, says how large a try of an item (item_id, original,
    target, frames, ...) is: the tries stay in the item's own row, so nothing is shuffled or sorted. A row for each item."""
    tries = F.array(*(F.struct(F.lit(name).alias("phase"), F.lit(step).alias("step")) for name, steps in phases for step in steps))
    enough = lambda x: (x["phase"] != "frames") | (F.ceil(F.col("frames") / x["step"]) >= 2)
    sized = F.transform(F.filter(tries, enough), lambda x: F.struct(x["phase"].alias("phase"), x["step"].alias("step"), size(x["phase"], x["step"]).alias("size")))
    rows = items.withColumn("p", F.get(F.filter(sized, lambda x: x["size"] <= F.col("target")), F.lit(0)))
    return _outcomes_of(rows)


def _outcomes_of(rows: DataFrame) -> DataFrame:
    """(item_id, outcome, phase, step, size) of rows (item_id, original, target, p), p the first try that fits, or null."""
    whole = F.col("original") <= F.col("target")
    outcome = F.when(whole, "unchanged").when(F.col("p").isNotNull(), "reduced").otherwise("restored")
    kept = lambda c: F.when(F.coalesce(~whole, F.lit(True)), F.col(f"p.{c}"))
    return rows.select("item_id", outcome.alias("outcome"), kept("phase").alias("phase"), kept("step").alias("step"), F.coalesce(kept("size"), "original").alias("size"))


def first_under(tries: DataFrame) -> DataFrame:
    """(item_id, outcome, phase, step, size) of tries (item_id, original, target, phase, place, step, size): `unchanged` where the
    original is at or under the target; `reduced`, with the first try in place that is; else `restored`. The size is that of
    what is kept, so the original's but for `reduced`. A try without a size has failed and is passed over.

    Tries of an item meet in partial minima, so the order of phases costs no sort."""
    fits_in = F.col("size") <= F.col("target")
    per = tries.groupBy("item_id").agg(F.first("original").alias("original"), F.first("target").alias("target"), F.min(F.when(fits_in, F.struct("place", "phase", "step", "size"))).alias("p"))
    return _outcomes_of(per)


# --- caches


def cache_delta(items: DataFrame, cached: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """items with `hit`: the cache has the path with an mtime less than `tolerance` away, and a value."""
    known = cached.select("path", F.col("mtime").alias("cached_mtime"), F.col("value").isNotNull().alias("there"))
    near = F.abs(F.col("cached_mtime") - F.col("mtime")) < tolerance
    return items.join(known, "path", "left").withColumn("hit", F.coalesce(near & F.col("there"), F.lit(False))).drop("cached_mtime", "there")
