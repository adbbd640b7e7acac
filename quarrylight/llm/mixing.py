"""13. Mixing sources to target weights: entropy balancing, whose convex dual is solved by distributed Newton steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table
from quarrylight.operators.numbering import numbered
from quarrylight.shipping import ship
from quarrylight.storage import small, written

WORD = r"[^\x20\x09-\x0D]++"
CLOSE = 1e-10  #: share of its target by which a source may miss it before copies are whole
ROUNDS = 200
BROADCAST = 500_000
NUMBERED = 1_000  #: documents of one size of a source; with more, all are numbered in ranges of about equally many


def target_sizes(sources: DataFrame, most: int) -> DataFrame:
    """sources (rank, weight, source_size, ...) with target: shares of the sum of all sizes by weight, but `most` times the
    source's size at most; what is over is shared by weight among the others until none is above. Each round gives the
    driver three numbers; a round caps a source or is the last."""
    over = lambda level: F.col("weight") * F.lit(level) > most * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        over_now = over(level)
        free = F.when(~over_now, F.col("weight"))
        total, held, weight, n = sources.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(over_now, most * F.col("source_size"))), F.lit(0)), F.sum(free), F.count(F.when(over_now, 1))
        ).first()
        if n == capped or not weight:
            break
        level, capped = (total - held) / weight, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    """Copies of a document of x (its size by its source's mean): 1 without tilt, between 0 and most, exponential while small."""
    return most / (1 + (most - 1) * F.exp(-tilt * x))


def tilts(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(rank, tilt) for each source: rates exp(tilt * size), bounded by `most`, that are nearest to one copy of each document
    in relative entropy among all whose tokens add up to the target.

    sizes: (rank, size, weight), a row for each different size of a source; weight is how many documents have it. The dual is
    a sum over sources, one variable each; a round adds up its gradient and curvature by source in partial sums, and takes a
    Newton step where it stays between the bounds known so far, half the way between them where not. State is a table. The
    driver gets one number a round.
    """
    infinite = F.lit(float("inf"))
    mean = sizes.groupBy("rank").agg((F.sum(F.col("size") * F.col("weight")) / F.sum("weight")).alias("mean"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = sources.join(small(mean, BROADCAST), "rank").select(
        "rank", "target", "mean", F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, infinite).otherwise(F.lit(0.0)).alias("tilt"), (-infinite).alias("low"), infinite.alias("high"), (full | (F.col("source_size") == 0)).alias("done")
    )
    state = written(state, "tilts")
    for _ in range(ROUNDS):
        if state.filter("not done").isEmpty():
            return state.select("rank", "tilt", "mean")
        at = sizes.join(small(state.filter("not done"), BROADCAST), "rank")
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, most)
        words = F.col("size") * F.col("weight")
        sums = at.groupBy("rank").agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (most - rate) / most).alias("curve"))
        now = state.join(small(sums, BROADCAST), "rank", "left")
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") < F.col("target"), F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + (F.col("target") - F.col("got")) / F.when(F.col("curve") > 0, F.col("curve"))
        far = 4 * (1 + F.abs("tilt"))  # a step goes no further, and where no bound is known yet just as far
        half = F.when(low == -infinite, F.col("tilt") - far).when(high == infinite, F.col("tilt") + far).otherwise((low + high) / 2)
        fits_in = (step > low) & (step < high) & (F.abs(step - F.col("tilt")) <= far)
        done = F.coalesce((F.abs(F.col("got") - F.col("target")) <= CLOSE * F.col("target")) | (half == F.col("tilt")), F.lit(False))
        settled = F.col("done") | done
        new = F.when(settled, F.col("tilt")).when(F.coalesce(fits_in, F.lit(False)), step).otherwise(half)
        state = written(now.select("rank", "target", "mean", new.alias("tilt"), F.when(settled, F.col("low")).otherwise(low).alias("low"), F.when(settled, F.col("high")).otherwise(high).alias("high"), settled.alias("done")), "tilts")
    raise RuntimeError(f"tilts did not settle in {ROUNDS} rounds")


def _rounded(most: int):
    def rounded(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies of all documents of a size, large sizes first. What rounding missed is spread over all that follows."""
        for rows in groups:
            rows = rows.sort_values(["unit", "size"], ascending=False)
            planned = (rows["unit"] * rows["n"] * rows["rate"]).tolist()
            left, ahead, out = rows["target"].iloc[0], sum(planned), []
            for unit, n, plan in zip(rows["unit"].tolist(), rows["n"].tolist(), planned):
                wanted = 0.0 if unit == 0 or ahead <= 0 else plan * left / ahead / unit
                copies = min(most * n, max(0, round(wanted)))
                out.append(copies)
                left -= copies * unit
                ahead -= plan
            yield rows.assign(total=out)[["rank", "size", "rows", "total"]]

    return lambda rows: next(rounded(iter([rows])))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, text_hash, rows, size, source_size, target, rate, copies) for each different row (doc_id, source,
    text); `rows` is how often the table has it, and each of these is to be taken `copies` times.

    size: words of the text, parted by ASCII white space. Sources, by code point and null last, have the weights in turn;
    targets by `target_sizes`. Rates by `tilts`; then copies of a source's sizes are made whole, the large ones first, each
    taking up what the ones before missed, so that a source misses its target by about half its smallest document. Which
    documents of one size get the odd copies is decided by a hash of id and text; reruns agree.

    Only (doc_id, source, hash, size) is shuffled. What follows reads rows by source and size: those of a source go to one
    task for rounding, and as different sizes they are fewer than the root of twice its words. Documents of one size are
    numbered by `numbered`, in ranges where they are many.

    Nulls: a null text has size 0 and 0 copies are as good as any, it gets 0; a null source is a source; a null doc_id is an
    id. Repeated rows count each and are taken alike. An empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    found = written(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    sources = found.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")).withColumn("nameless", F.col("source").isNull())
    sources = numbered(written(sources, "sources"), [], ["nameless", "source"], "rank").drop("nameless")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = target_sizes(written(sources.withColumn("weight", weight), "sources"), most)
    ranks = sources.select(F.col("source").alias("__source"), "rank", "source_size", "target")
    found = written(found.join(small(ranks, BROADCAST), F.col("source").eqNullSafe(F.col("__source"))).drop("__source"), "sizes")
    sizes = written(found.groupBy("rank", "size", "rows").agg(F.count(F.lit(1)).alias("n")), "histogram")
    weighed = sizes.groupBy("rank", "size").agg(F.sum(F.col("n") * F.col("rows")).alias("weight"))
    tilt = tilts(weighed, sources, most)
    rate = F.when(F.col("tilt") == float("inf"), F.lit(float(most))).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), most))
    # sums of doubles differ in their last digits with the order of their terms; copies follow from rates without these
    rate = F.round(F.when(F.col("size") == 0, F.lit(0.0)).otherwise(rate), 9)
    planned = sizes.join(small(tilt, BROADCAST), "rank").join(small(sources.select("rank", "target"), BROADCAST), "rank")
    planned = written(planned.select("rank", "size", "rows", "n", "target", rate.alias("rate"), (F.col("size") * F.col("rows")).alias("unit")), "rates")
    whole = planned.groupBy("rank").applyInPandas(_rounded(most), "rank long, size long, rows long, total long")
    whole = written(whole.join(planned.select("rank", "size", "rows", "n", "rate"), ["rank", "size", "rows"]), "copies")
    order = found.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    order = numbered(order, ["rank", "size", "rows"], ["key", "doc_id", "text_hash"], most=NUMBERED)
    out = order.join(small(whole, BROADCAST), ["rank", "size", "rows"])
    copies = F.expr("total div n") + (F.col("number") <= F.col("total") % F.col("n")).cast("long")
    return out.select("doc_id", "source", "text_hash", "rows", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs, same columns, each row as often as the plan takes it. Texts stay where they are if the plan is small enough to be
    broadcast; else both meet by id, source and text."""
    plan = mixing_plan(docs, weights, most).filter("copies > 0")
    plan = written(plan.select(F.col("doc_id").alias("__ql_id"), F.col("source").alias("__ql_source"), F.col("text_hash").alias("__ql_hash"), F.col("copies").alias("__ql_copies")), "plan")
    same = F.col("doc_id").eqNullSafe(F.col("__ql_id")) & F.col("source").eqNullSafe(F.col("__ql_source")) & (F.xxhash64("text") == F.col("__ql_hash"))
    out = docs.join(small(plan, BROADCAST), same)
    return out.withColumn("__ql_copy", F.explode(F.sequence(F.lit(1), F.col("__ql_copies")))).select(*docs.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
