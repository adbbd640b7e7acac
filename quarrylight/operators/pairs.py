"""All pairs of rows by blocks: every block meets every block, in a call each; blocks are read again, not shuffled for each other block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.shipping import ship
from quarrylight.storage import cut

BLOCK = 2048  #: rows of a block, about; a call holds two blocks, so memory does not grow with the table
CHUNKS = 24  #: chunks of a table that is met all with all, about, while they have between BLOCK and MOST_BLOCK rows
MOST_BLOCK = 16_384
SIDE = 16  #: partitions of a side of a product of chunks, whose square is the number of tasks
CELLS = 1 << 20  #: distances that are worked out and given on at once, about
SLICE = 256  #: rows of the one block that are compared with all of the other at once


def all_pairs(items: DataFrame, distance, below: float | None = None, block: int | None = None, keep=None, prepare=lambda rows: rows, places: int | None = None, found=None) -> DataFrame:
    """(i, j, d) of all i < j of items (item_id, ...); with below, only those at d < below; with keep, where keep(d); with places, d
    is rounded to so many. A null item_id pairs with none.

    distance(a, b) of two pandas frames with the columns of items, or of what prepare makes of them, gives the matrix of
    distances. In its stead found(a, b) may give, in pieces, the cells of that matrix that it finds: rows, columns and distances.
    """
    chunks, n = packed(items.filter("item_id is not null"), block)
    m = n + 1 - n % 2  # odd: of two chunks either the one or the other is less than half a turn ahead, so all tasks have as much to do
    left, right = _sides(chunks, chunks, n, n)
    met = left.hint("shuffle_replicate_nl").join(right, F.pmod(F.col("b") - F.col("a"), F.lit(m)) <= m // 2)

    def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[tuple]:
        one, two = (t["item_id"].to_numpy(np.int64) for t in (a, b))
        unlike = not same and not np.isin(one, two).any()
        for x, y, d in found(prepare(a), prepare(b)) if found else _matrices(a, b, distance, prepare):
            x, y = (one[x], two[y]) if found else np.broadcast_arrays(one[x, None], two)
            wanted = np.broadcast_to(True, d.shape) if unlike else x < y if same else x != y
            if below is not None:
                wanted = wanted & (d < below)
            if keep is not None:
                wanted = wanted & keep(d)
            x, y, d = (t.ravel() if wanted.all() else t[wanted] for t in (x, y, d))
            yield np.minimum(x, y), np.maximum(x, y), d

    return _met(met, compare, places)


def against(queries: DataFrame, items: DataFrame, distance, below: float | None = None, block: int | None = None, prepare=lambda rows: rows, places: int | None = None) -> DataFrame:
    """(i, j, d) of each query i with each item j but itself; with below, only those at d < below; with places, d is rounded to so
    many. Both have item_id and what distance(a, b) of two pandas frames, or of what prepare makes of them, asks for; it gives the
    matrix of distances. A null item_id meets none."""
    (few, n), (many, m) = (packed(t.filter("item_id is not null"), block) for t in (queries, items))
    left, right = _sides(few, many, n, m)
    met = left.hint("shuffle_replicate_nl").crossJoin(right)

    def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[tuple]:
        one, two = (t["item_id"].to_numpy(np.int64) for t in (a, b))
        for x, _, d in _matrices(a, b, distance, prepare):
            x, y = np.broadcast_arrays(one[x, None], two)
            wanted = x != y
            if below is not None:
                wanted &= d < below
            yield x[wanted], y[wanted], d[wanted]

    return _met(met, compare, places)


def packed(items: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """(chunk, rows) with about `block` rows of items as Arrow bytes in each row, and how many chunks there may be. Each chunk is a
    partition of its own, kept in the shared folder: the table is dealt once, however many chunks a chunk meets."""
    ship(items.sparkSession)
    rows = items.count()
    n = max(1, math.ceil(rows / (block or min(max(BLOCK, math.ceil(rows / CHUNKS)), MOST_BLOCK))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batches[0].schema) as to:
                to.write_table(pa.Table.from_batches(batches).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    return cut(items.repartition(n).mapInArrow(pack, "chunk long, rows binary")), n


def _sides(a: DataFrame, b: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a product of chunks, in a bounded number of partitions, so of tasks."""
    return tuple(t.select(F.col("chunk").alias(k), F.col("rows").alias(v)).coalesce(min(size, SIDE)) for t, size, k, v in ((a, n, "a", "x"), (b, m, "b", "y")))


def _matrices(a: pd.DataFrame, b: pd.DataFrame, distance, prepare) -> Iterator[tuple]:
    """Slices of a and their distances to all of b, at most about a million at once."""
    size, others = max(1, min(SLICE, CELLS // max(1, len(b)))), prepare(b)
    for at in range(0, len(a), size):
        some = slice(at, at + size)
        yield some, slice(None), distance(prepare(a.iloc[some]), others)


def rounded(d: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as round does in SQL; for what is not negative."""
    d = d * 10.0**places
    whole = np.floor(d)
    whole += d - whole >= 0.5
    whole /= 10.0**places
    return whole


def _met(met: DataFrame, compare, places: int | None) -> DataFrame:
    """compare(frame, frame, whether they are one chunk) of each row of met (a, x, b, y), in batches of a bounded size."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch["a"][k].as_py(), batch["b"][k].as_py()
                if kept[0] != a:
                    kept = a, _unpacked(batch["x"][k])
                for x, y, d in compare(kept[1], _unpacked(batch["y"][k]), a == b):
                    d = d if places is None else rounded(d, places)
                    for at in range(0, len(d), CELLS):
                        yield pa.RecordBatch.from_arrays([pa.array(t[at : at + CELLS]) for t in (x, y, d)], schema=schema)

    return met.mapInArrow(call, "i long, j long, d double")


def _unpacked(rows: pa.BinaryScalar) -> pd.DataFrame:
    return pa.ipc.open_stream(rows.as_buffer()).read_all().to_pandas()


def across(a: DataFrame, b: DataFrame, f, schema, block_a: int = BLOCK, block_b: int = BLOCK) -> DataFrame:
    """f(x, y) of every block x of a with every block y of b, as rows of schema. Rows are dealt by their content, so a block
    is about as large as asked; each row goes to as many calls as the other side has blocks."""
    ship(a.sparkSession)
    n, m = (max(1, math.ceil(t.count() / size)) for t, size in ((a, block_a), (b, block_b)))
    own = lambda t, parts: F.pmod(F.xxhash64(*t.columns), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = a.withColumn("__a", own(a, n)).withColumn("__b", every(m))
    right = b.withColumn("__b", own(b, m)).withColumn("__a", every(n))
    return left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInPandas(f, schema)
