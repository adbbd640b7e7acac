"""Groups of near duplicates that grow: batches of new items meet an index of what is known, and leave their links beside it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.operators.dedup import DedupSpec, exact_edges, grouped, same_block
from quarrylight.operators.hamming import bands, links
from quarrylight.storage import small, written

TABLES = {
    "items": "item_id long, sha256 string, sig long, batch string",
    "links": "src long, dst long, batch string",
}


def _table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store, all batches; no rows where there is none yet."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{store}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in TABLES[name].split(", "))))


def add_batch(new: DataFrame, store: str, batch: int | str, spec: DedupSpec | None = None) -> None:
    """Adds items (item_id, sha256, sig) to a store as one batch: a part of each of its tables, written anew if the batch is
    run again, so that a batch that failed half way or comes twice leaves one trace.

    What is new meets by its bands, as in one run, what the store has under the same bands; no other part of the store is
    shuffled by bands, and what the store has is not compared with itself again. Links are spanning ones, at most one for each
    signature of a band, whatever the number of copies. A null signature is alike to none; an empty batch adds nothing. Batches
    go in one after the other.
    """
    spec = spec or DedupSpec.stills()
    spark = new.sparkSession
    own = written(new.select("item_id", "sha256", "sig"), "batch")
    known = _table(spark, store, "items").filter(F.col("batch") != str(batch))
    both = own.select("sig", F.lit(True).alias("new")).unionByName(known.select("sig", F.lit(False).alias("new")))
    both = written(both.filter("sig is not null").groupBy("sig").agg(F.max("new").alias("new")), "both")
    block = spec.block if spec.block is not None else F.lit(0)
    band = F.explode(bands(F.col("sig"), spec.bits, int(spec.threshold)))
    spread = both.select("sig", "new", block.alias("block"), band.alias("x")).select("sig", "new", F.xxhash64("block", "x.band", "x.value").alias("anchor"))
    touched = small(written(spread.filter("new").select("anchor").distinct(), "touched"), 2_000_000)
    near = same_block(links(spread.join(touched, "anchor", "left_semi"), int(spec.threshold)), spec)
    for name, rows in (("links", near.select(F.col("x").alias("src"), F.col("y").alias("dst"))), ("items", own)):
        rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")


def groups(spark: SparkSession, store: str, spec: DedupSpec | None = None) -> DataFrame:
    """(group_id, item_id, match_type) of all that the store has, as `duplicate_groups` of all batches together gives, in
    whatever order they came."""
    items = _table(spark, store, "items").select("item_id", "sha256", "sig")
    first = items.filter("sig is not null").groupBy("sig").agg(F.min("item_id").alias("src"))
    equal = items.join(first, "sig").filter("item_id != src").select("src", F.col("item_id").alias("dst"))
    name = lambda side: first.select(F.col("sig").alias(f"{side}_sig"), F.col("src").alias(side))
    known = _table(spark, store, "links").select(F.col("src").alias("a_sig"), F.col("dst").alias("b_sig")).distinct()
    near = known.join(name("a"), "a_sig").join(name("b"), "b_sig").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return grouped(written(exact_edges(items), "exact"), equal.unionByName(near).withColumn("kind", F.lit("near")))


def follow(stream: DataFrame, store: str, checkpoint: str, spec: DedupSpec | None = None, once: bool = True) -> StreamingQuery:
    """Adds a stream of items (item_id, sha256, sig) to a store, each micro-batch as a batch of its number; once: what there is
    now, then the query ends. A query that starts again from its checkpoint repeats the batch that it was in, which replaces it."""
    query = stream.writeStream.foreachBatch(lambda rows, k: add_batch(rows, store, k, spec)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
