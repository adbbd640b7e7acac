"""Links of 64-bit signatures at a small Hamming distance, from keys that near signatures share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.shipping import ship
from quarrylight.storage import cut, small

BUCKET = 20_000  #: a key with more signatures is compared in pairs of chunks of about half that size
NODES = 500_000  #: signatures whose trees a task holds before it gives out its links
FEW = 64  #: signatures of a key up to which those of many keys are compared at once
TILE = 1 << 18  #: comparisons in one call
HELD = 1 << 16  #: rows that a task gathers before it compares


class Forest:
    """Union-find over signatures; keeps the links that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def frame(self) -> pd.DataFrame:
        pairs = np.array(self.links, np.uint64).reshape(-1, 2).astype(np.int64)
        return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(self.frame(), preserve_index=False)


def _compare(sig: np.ndarray, key: np.ndarray, threshold: int, forest: Forest, new: np.ndarray | None = None) -> None:
    """Links all signatures at threshold bits or less under the same key; rows are sorted by key. With `new`, those that are not
    need no links to each other.

    Small groups are compared at once for all groups, so that no row costs a call.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    after = np.repeat(starts + sizes, sizes) - np.arange(len(key))  # rows of the group from this one on
    at = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    for d in range(1, int(sizes[sizes <= FEW].max(initial=1))):
        at = at[after[at] > d]
        near = np.bitwise_count(sig[at + d] ^ sig[at]) <= threshold
        if new is not None:
            near &= new[at + d] | new[at]
        found = at[near]
        for x, y in zip(sig[found].tolist(), sig[found + d].tolist()):
            forest.link(x, y)
    for at, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        _compare_many(sig[at : at + n], None if new is None else new[at : at + n], threshold, forest)


def _compare_many(sig: np.ndarray, new: np.ndarray | None, threshold: int, forest: Forest) -> None:
    """Links a large group: a tile of its signatures, new ones first, meets all that are left in one call. Where a tile has many
    near pairs, all that is linked to the densest of its signatures leaves the group first, so a dense group costs little more
    than its size."""
    if new is None:
        left = np.unique(sig)
        todo = len(left)
    else:
        first = np.unique(sig[new])
        left, todo = np.r_[first, np.setdiff1d(sig[~new], first)], len(first)
    while todo and len(left) > 1:
        tile = min(todo, max(16, TILE // len(left)))
        near = np.bitwise_count(left[:tile, None] ^ left) <= threshold
        rows, alive = np.ones(tile, bool), np.ones(len(left), bool)
        while np.count_nonzero(near) - np.count_nonzero(rows) > 16 * tile:
            x = int(near.sum(axis=1).argmax())
            alive[x] = False
            gone = np.r_[left[x : x + 1], _leaving(left[x], left[alive], threshold, forest)]
            alive &= ~np.isin(left, gone)
            rows &= alive[:tile]
            near &= rows[:, None] & alive
        i, j = np.nonzero(near)
        for x, y in zip(left[i[i < j]].tolist(), left[j[i < j]].tolist()):
            forest.link(x, y)
        alive[:tile] = False
        todo = int(np.count_nonzero(alive[:todo]))
        left = left[alive]


def _leaving(seed: np.uint64, left: np.ndarray, threshold: int, forest: Forest) -> np.ndarray:
    """What of `left` is linked to the seed, over others of it too; the links go to the forest. What is found leaves before the
    next is compared."""
    seeds, gone = [seed], []
    while seeds and len(left):
        x = seeds.pop()
        near = np.bitwise_count(left ^ x) <= threshold
        if near.any():
            found = left[near]
            left = left[~near]
            for y in found.tolist():
                forest.link(int(x), y)
            seeds.extend(found)
            gone.append(found)
    return np.concatenate(gone) if gone else left[:0]


def dealt(spread: DataFrame, bucket: int, by: str) -> DataFrame:
    """spread (anchor, ...) with key, by which it is compared: the anchor, or, where an anchor has more than `bucket` rows, one
    key for each pair of chunks of about half that size, by the column `by`."""
    large = cut(spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket))
    if large.isEmpty():
        return spread.withColumn("key", F.col("anchor"))
    pairs = spread.join(small(large, 200_000), "anchor", "left").withColumn("chunks", F.ceil(2 * F.coalesce("n", F.lit(0)) / bucket))
    mine = F.pmod(F.xxhash64(by), F.greatest("chunks", F.lit(1)))
    pairs = pairs.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("chunks", F.lit(1)) - 1)))
    keyed = pairs.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    # a key of one column for the comparison; two chunk pairs that share it would only be compared more
    return keyed.withColumn("key", F.when(F.col("chunks") > 1, F.xxhash64("anchor", "low", "high")).otherwise(F.col("anchor")))


def links(spread: DataFrame, threshold: int, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) of rows (sig, anchor): links that connect signatures as all links at threshold bits or less under the same
    anchor would. Not all links are given: of a group, a spanning tree, so copies and dense groups do not multiply. With a column
    `new`, links of two that are both not new are left out.

    An anchor's signatures are compared in one task, or, where there are more than `bucket`, in a task for each pair of
    chunks, so memory is bounded and no link is lost.
    """
    ship(spread.sparkSession)
    keyed = dealt(spread, bucket, "sig")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; a key's rows may lie in several batches, which are gathered until there are HELD rows."""
        forest, held, n = Forest(), [], 0

        def compare(whole: bool) -> list[pa.RecordBatch]:
            """Compares the keys of what is held and keeps the rows of the last one, which may go on, unless it is the whole."""
            now = pa.Table.from_batches(held)
            key = now["key"].to_numpy()
            last = len(key) if whole else int(np.searchsorted(key, key[-1]))
            if last:
                new = now["new"].to_numpy()[:last] if "new" in now.column_names else None
                _compare(now["sig"].to_numpy().view(np.uint64)[:last], key[:last], threshold, forest, new)
            return now.slice(last).to_batches()

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= HELD:
                held = compare(False)
                n = -sum(b.num_rows for b in held) // 2  # a key that goes on is looked at again when it has grown by half
            if len(forest.up) > NODES:
                yield forest.batch()
                forest = Forest()
        if held:
            compare(True)
        yield forest.batch()

    more = ["new"] if "new" in spread.columns else []
    return keyed.select("sig", "key", *more).repartition("key").sortWithinPartitions("key").mapInArrow(found, "src long, dst long")


def bands(sig: Column, bits: int, threshold: int) -> Column:
    """The low `bits` bits in threshold + 1 bands, each with its number: two signatures at threshold bits or less agree in one."""
    n = min(threshold + 1, bits)
    ends = [bits * k // n for k in range(n + 1)]
    part = lambda k: F.shiftrightunsigned(sig, ends[k]).bitwiseAND(F.lit((1 << ends[k + 1] - ends[k]) - 1).cast("long"))
    return F.array(*(F.struct(F.lit(k).alias("band"), part(k).alias("value")) for k in range(n)))


def first_band(a: Column, b: Column, band: Column, bits: int, threshold: int) -> Column:
    """Whether no earlier band of two signatures agrees, so that a pair is taken from one band only."""
    n = min(threshold + 1, bits)
    ends = [bits * k // n for k in range(n + 1)]
    masks = F.array(*(F.lit((1 << ends[k + 1]) - (1 << ends[k])).cast("long") for k in range(n)))
    return F.forall(F.slice(masks, F.lit(1), band), lambda m: a.bitwiseXOR(b).bitwiseAND(m) != 0)
