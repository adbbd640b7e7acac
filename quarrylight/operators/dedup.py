"""Exact and near-duplicate groups of items, survivors and move plans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import vectors as V
from quarrylight.operators.components import connected_components
from quarrylight.operators.frame_lists import list_links, list_pairs
from quarrylight.operators.hamming import bands, first_band, links
from quarrylight.shipping import ship
from quarrylight.storage import written


@dataclass(frozen=True)
class DedupSpec:
    """What makes items alike: columns for the content hash, the signature and the block, a distance of two signatures."""

    distance: object  # (Column, Column) -> Column
    block: Column | None = None
    signature: str = "sig"
    content: str = "sha256"
    threshold: float = 8
    band: object = None  # (a, b) -> Column, on whole rows: checked before the distance
    bits: int = 0  # the low bits outside the block, if signatures are longs and the distance is Hamming's
    lists: bool = False  # signatures are lists of longs, the distance is Hamming's mean by position, a band that of durations

    @staticmethod
    def stills(threshold: int = 8) -> DedupSpec:
        """64-bit signatures in blocks of the first 8 bits."""
        return DedupSpec(V.hamming, F.shiftrightunsigned("sig", 56), threshold=threshold, bits=56)

    @staticmethod
    def frames(threshold: float = 8) -> DedupSpec:
        """Lists of signatures in blocks of the first frame's first 8 bits; without frames in a block of their own."""
        first = F.get("frame_hashes", F.lit(0))
        return DedupSpec(V.mean_hamming, F.when(first.isNull(), F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(first, 56)), "frame_hashes", threshold=threshold, lists=True)

    @staticmethod
    def timed_frames(threshold: float = 8) -> DedupSpec:
        """Lists of signatures in blocks of about 3 seconds of duration, durations within 2 s or 5 % of the longer."""
        near = lambda a, b: F.abs(a("duration_s") - b("duration_s")) <= F.greatest(F.lit(2.0), 0.05 * F.greatest(a("duration_s"), b("duration_s")))
        return DedupSpec(V.mean_hamming, F.bround(F.col("duration_s") / 3, 0).cast("long"), "frame_hashes", threshold=threshold, band=near, lists=True)


WORDS = re.compile("[^ \\t\\n\\r]+")
REMEMBERED = 300_000  #: words whose hashes a worker holds


def _word_hash(word: str, known: dict[str, int]) -> int:
    """The first 16 hex digits of a word's MD5."""
    h = known.get(word)
    if h is None:
        if len(known) >= REMEMBERED:
            known.clear()
        h = known[word] = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8])
    return h


def simhash(words: list[str], known: dict[str, int]) -> int:
    """64-bit SimHash of words, as a signed long: a bit is set if more of their hashes set it than not; 0 without words. Votes
    are added up some thousand words at a time, so a long text costs no more memory than its words."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(words), 1 << 16):
        hashed = np.fromiter((_word_hash(w, known) for w in words[at : at + (1 << 16)]), ">u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(words)).view(">i8")[0])


def text_signatures(items: DataFrame) -> DataFrame:
    """items (item_id, text, ...) with sig, the SimHash of the different words of a text, 0 without words. A text is signed where
    it lies; what is kept as a table has no texts, so that what follows reads a few columns and hashes no word again."""
    ship(items.sparkSession)

    @F.pandas_udf("long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            yield pd.Series([simhash(list(set(WORDS.findall(t or ""))), known) for t in texts], dtype="int64")

    return written(items.withColumn("sig", signed("text")).drop("text"), "signatures")


def chunk_signatures(items: DataFrame, chunks: int = 8) -> DataFrame:
    """items (item_id, text) with frame_hashes: the whole text in at most `chunks` consecutive parts of about equally many
    words, the SimHash of each, in order; empty without words."""
    ship(items.sparkSession)

    def parts(text: str | None, known: dict[str, int]) -> list[int]:
        words = WORDS.findall(text or "")
        n = min(chunks, len(words))
        ends = [-(-len(words) * k // n) for k in range(n + 1)] if n else []
        return [simhash(words[a:b], known) for a, b in zip(ends, ends[1:])]

    @F.pandas_udf("array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            yield pd.Series([parts(t, known) for t in texts], dtype=object)

    return items.withColumn("frame_hashes", signed("text")).drop("text")


def exact_edges(items: DataFrame, content: str = "sha256") -> DataFrame:
    """Stars (src = smallest item_id of a content, dst); null contents are alike to none. Minima meet before the shuffle."""
    first = items.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min("item_id").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return items.join(first, content).filter("item_id != src").select("src", F.col("item_id").alias("dst"), F.lit("exact").alias("kind"))


def blocked_pairs(items: DataFrame, spec: DedupSpec) -> DataFrame:
    """(i, j, d), i < j, of the same block at distance threshold or less; null signatures pair with none.

    An equi-join on the block; AQE splits a block that is too large. Signatures of bits meet in bands within their block, of
    which near ones share at least one, so that fewer pairs are compared and each is found once; lists of them are compared in
    chunks of their block (`list_pairs`). Without a block every
    pair is compared: only for small inputs. All pairs are the result; for groups, `near_edges` has fewer.
    """
    keys = ["item_id", spec.signature] + (["duration_s"] if spec.band else [])
    if spec.lists and spec.block is not None and spec.threshold >= 0:
        lists = items.filter(F.col(spec.signature).isNotNull()).select("item_id", F.col(spec.signature).alias("frames"), spec.block.alias("block"), *keys[2:])
        return list_pairs(lists, spec.threshold, spec.band is not None)
    rows = items.filter(F.col(spec.signature).isNotNull()).select(*keys, (spec.block if spec.block is not None else F.lit(0)).alias("block"))
    meet = ["block"]
    if spec.bits and 0 <= spec.threshold < spec.bits:
        rows = rows.withColumn("x", F.explode(bands(F.col(spec.signature), spec.bits, int(spec.threshold)))).select(*keys, "block", "x.*")
        meet = ["block", "band", "value"]
    a, b = (rows.select(*meet, *(F.col(c).alias(f"{side}_{c}") for c in keys)) for side in "ab")
    both = a.join(b, meet).filter("a_item_id < b_item_id")
    if spec.band:
        both = both.filter(spec.band(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    d = spec.distance(F.col(f"a_{spec.signature}"), F.col(f"b_{spec.signature}")).cast("double")
    both = both.withColumn("d", d).filter(F.col("d") <= spec.threshold)
    if len(meet) > 1:
        both = both.filter(first_band(F.col(f"a_{spec.signature}"), F.col(f"b_{spec.signature}"), F.col("band"), spec.bits, int(spec.threshold)))
    return both.select(F.col("a_item_id").alias("i"), F.col("b_item_id").alias("j"), "d")


def near_edges(items: DataFrame, spec: DedupSpec) -> DataFrame:
    """Links of near items, which connect them as all near pairs would. Equal signatures are one representative in the pair
    join, so copies do not multiply pairs; of signatures of bits, and of lists of them, a spanning tree of each group is given,
    not its pairs. An empty list, and a list without a duration where that counts, is near none, not even its equals."""
    keys = [spec.signature] + (["duration_s"] if spec.band else [])
    rows = items.filter(F.col(spec.signature).isNotNull())
    if spec.lists:
        rows = rows.filter((F.size(spec.signature) > 0) & (F.col("duration_s").isNotNull() if spec.band else F.lit(True)))
    first = rows.groupBy(*keys).agg(F.min("item_id").alias("src"))
    own = rows.join(first, keys).filter("item_id != src").select("src", F.col("item_id").alias("dst"))
    if spec.threshold < 0:
        own = own.limit(0)
    if spec.bits and 0 <= spec.threshold < spec.bits:
        band = F.explode(bands(F.col(spec.signature), spec.bits, int(spec.threshold)))
        anchor = F.xxhash64("block", "x.band", "x.value")  # two keys that share a hash would only be compared more
        spread = first.withColumn("block", spec.block if spec.block is not None else F.lit(0)).select(F.col(spec.signature).alias("sig"), "block", band.alias("x"))
        found = same_block(links(spread.select("sig", anchor.alias("anchor")), int(spec.threshold)), spec)
        name = lambda side: first.select(F.col(spec.signature).alias(f"{side}_sig"), F.col("src").alias(side))
        pairs = found.join(name("a"), F.col("x") == F.col("a_sig")).join(name("b"), F.col("y") == F.col("b_sig"))
        return own.unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumn("kind", F.lit("near"))
    if spec.lists and spec.threshold >= 0:
        lists = first.select(F.col("src").alias("item_id"), F.col(spec.signature).alias("frames"), spec.block.alias("block"), *keys[1:])
        return own.unionByName(list_links(written(lists.filter("block is not null"), "lists"), spec.threshold, spec.band is not None)).withColumn("kind", F.lit("near"))
    pairs = blocked_pairs(first.select(F.col("src").alias("item_id"), *keys), spec).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return own.unionByName(pairs).withColumn("kind", F.lit("near"))


def duplicate_groups(items: DataFrame, spec: DedupSpec | None = None) -> DataFrame:
    """(group_id, item_id, match_type) of groups of two and more; group_id is the smallest item_id.

    A group is `exact` if each member has an exact copy somewhere, as the sets are compared, not the contents: two exact
    groups that a near link joins are still `exact`. Without a spec only exact copies are found.
    """
    exact = written(exact_edges(items, spec.content if spec else "sha256"), "exact")
    return grouped(exact, None if spec is None else near_edges(items, spec))


def grouped(exact: DataFrame, near: DataFrame | None) -> DataFrame:
    """duplicate_groups from exact and near edges (src, dst, kind)."""
    edges = exact if near is None else exact.unionByName(near)
    groups = connected_components(edges.select("src", "dst")).select(F.col("component").alias("group_id"), F.col("node").alias("item_id"))
    member = exact.select(F.col("src").alias("item_id")).unionByName(exact.select(F.col("dst").alias("item_id"))).distinct().withColumn("in_exact", F.lit(True))
    label = groups.join(member, "item_id", "left").groupBy("group_id").agg(F.min(F.coalesce("in_exact", F.lit(False))).alias("all_exact"))
    return groups.join(label, "group_id").select("group_id", "item_id", F.when(F.col("all_exact"), "exact").otherwise("near").alias("match_type"))


def same_block(found: DataFrame, spec: DedupSpec) -> DataFrame:
    """(x, y): links of equal blocks. A hash that two blocks share can bring others together."""
    if spec.block is None:
        return found.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    blocks = found.withColumnRenamed("src", spec.signature).withColumn("a_block", spec.block).withColumnRenamed(spec.signature, "x")
    blocks = blocks.withColumnRenamed("dst", spec.signature).withColumn("b_block", spec.block).withColumnRenamed(spec.signature, "y")
    return blocks.filter("a_block = b_block").select("x", "y")


def merges(items: DataFrame, spec: DedupSpec) -> DataFrame:
    """near_merges: by how many the near links lower the number of components that exact links leave."""
    exact = exact_edges(items, spec.content).select("src", "dst")
    lost = lambda edges: connected_components(edges).agg((F.count(F.lit(1)) - F.countDistinct("component")).alias("n"))
    before, after = lost(exact), lost(exact.unionByName(near_edges(items, spec).select("src", "dst")))
    return after.select(F.col("n").alias("a")).crossJoin(F.broadcast(before.select(F.col("n").alias("b")))).select((F.col("a") - F.col("b")).cast("long").alias("near_merges"))


def ranked(groups: DataFrame, *order: Column) -> DataFrame:
    """groups with `primary`: true for the first of a group by order, all ascending and nulls last, then item_id.

    The first of a group is a minimum, of which tasks have partial ones, so no group is sorted; it meets the rows by item_id,
    which has no groups. An item is in one group."""
    groups = written(groups, "groups")
    keys = [F.struct(c.isNull(), c).alias(f"key{k}") for k, c in enumerate(order)]
    first = groups.groupBy("group_id").agg(F.min(F.struct(*keys, "item_id")).alias("key"))
    first = first.select(F.col("key.item_id").alias("__first"), F.lit(True).alias("primary"))
    return groups.join(first, F.col("item_id") == F.col("__first"), "left").withColumn("primary", F.coalesce("primary", F.lit(False))).drop("__first")


def by_pixels(*more: str) -> list[Column]:
    """The order in which a still's best copy comes first: fewest votes for a mark, most pixels; then `more`, such as the most
    frames or the longest, largest first; then the smallest file. What is missing counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [zero("votes"), -zero("pixels"), *(-zero(c) for c in more), zero("size")]


def compared_pixels(items: DataFrame, step: int = 20) -> DataFrame:
    """(i, j, changed, edge_i, edge_j) of the pairs of a group of items (group_id, item_id, pixels, edges), arrays of equal
    length: how many pixels differ by more than `step`, and the mean edge strength of either there, null if none does."""
    side = lambda s: items.select("group_id", *(F.col(c).alias(f"{s}_{c}") for c in ("item_id", "pixels", "edges")))
    both = side("a").join(side("b"), "group_id").filter("a_item_id < b_item_id")
    rows = F.filter(F.arrays_zip("a_pixels", "b_pixels", "a_edges", "b_edges"), lambda x: F.abs(x["a_pixels"] - x["b_pixels"]) > step)
    both = both.withColumn("rows", rows).withColumn("changed", F.size("rows"))
    mean = lambda c: F.when(F.col("changed") > 0, V.total(F.transform("rows", lambda x: x[c].cast("double"))) / F.col("changed"))
    return both.select(F.col("a_item_id").alias("i"), F.col("b_item_id").alias("j"), "changed", mean("a_edges").alias("edge_i"), mean("b_edges").alias("edge_j"))


def pixel_votes(pairs: DataFrame, least_pixels: int = 200, ratio: float = 1.3) -> DataFrame:
    """(item_id, votes) from pairs (i, j, changed, edge_i, edge_j): where at least least_pixels changed, the side whose mean
    edge strength there is over `ratio` times the other's gets a vote, as it is likelier to bear a mark."""
    side = F.when(F.col("edge_i") > ratio * F.col("edge_j"), F.col("i")).when(F.col("edge_j") > ratio * F.col("edge_i"), F.col("j"))
    return pairs.filter(F.col("changed") >= least_pixels).select(side.alias("item_id")).filter("item_id is not null").groupBy("item_id").agg(F.count(F.lit(1)).alias("votes"))
