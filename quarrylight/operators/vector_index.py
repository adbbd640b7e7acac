"""The best of many reference vectors by cosine, from an index of cells that are passed over where they cannot hold a better one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.pairs import BLOCK
from quarrylight.shipping import ship
from quarrylight.storage import small, written

MOST_CELLS = 2048
SAMPLE = 20_000  #: references from which the centres of cells are made, about; all are indexed
ROWS = 5_000  #: queries with a cell that a task gives out at once
DIGITS = 9  #: to which scores are rounded before they are ranked, so that equal vectors tie in any block
SLACK = 1e-6  #: by which a bound may be off in floating point


@dataclass(frozen=True)
class Index:
    """Centres of cells, the distance of the farthest member of each, and members (cell, ref_id, emb)."""

    centres: np.ndarray
    radii: np.ndarray
    members: DataFrame

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors the nearest centre of each, and bounds: no member of a cell has a larger product with the vector."""
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T, 0))
        near = np.maximum(d - self.radii, 0)
        most = np.maximum(((x * x).sum(axis=1)[:, None] + 1 - near**2) / 2, 0)  # a vector of zeros has products of 0
        return d.argmin(axis=1), np.where(self.radii >= 0, most, -np.inf)


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    n = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; an empty cell keeps its centre."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 1024] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1) for at in range(0, len(x), 1024)])
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build(references: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index of references (ref_id long, emb). Centres are made from about `sample` of them, chosen by a hash of the vector; each
    reference is put in the cell of the nearest centre, and the root of their number is how many cells there are, MOST_CELLS at
    most. What reaches the driver is the sample and one number a cell. Null vectors are left out; an empty table gives an index
    that finds nothing."""
    ship(references.sparkSession)
    rows = references.filter("emb is not null").select("ref_id", "emb")
    n = rows.count()
    key = F.shiftrightunsigned(F.xxhash64("emb"), 1)
    chosen = rows if n <= sample else rows.filter(key < F.lit(int((1 << 63) * sample / n)))
    x = unit(chosen.limit(4 * sample).toPandas()["emb"])
    if n and not len(x):  # all vectors have one hash: any of them is the centre
        x = unit(rows.limit(1).toPandas()["emb"])
    cells = cells or max(1, min(MOST_CELLS, int(np.sqrt(n))))
    centres = _centres(x, cells) if len(x) else np.zeros((1, 1))
    sent = references.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y, c = unit(batch["emb"]), sent.value
            d = (y * y).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * y @ c.T
            own = d.argmin(axis=1)
            yield batch.assign(cell=own.astype(np.int32), d=np.sqrt(np.maximum(d[np.arange(len(y)), own], 0)))

    members = written(rows.mapInPandas(assign, f"ref_id long, emb {dict(rows.dtypes)['emb']}, cell int, d double"), "cells")
    radii = np.full(len(centres), -1.0)
    for cell, d in members.groupBy("cell").agg(F.max("d")).collect():  # a row a cell
        radii[cell] = d + SLACK
    return Index(centres, radii, members.select("cell", "ref_id", "emb"))


def _meet(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(item_id, top): of queries (item_id, emb, cell) the k best members of that cell. Both sides of a cell meet in chunks."""
    chunks = lambda rows: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    q = small(chunks(queries).select("cell", F.col("chunks").alias("qs")), 500_000)
    m = small(chunks(index.members).select("cell", F.col("chunks").alias("ms")), 500_000)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(q, "cell").join(m, "cell").withColumn("a", F.pmod(F.xxhash64("item_id"), F.col("qs")).cast("int")).withColumn("b", every("ms")).select("cell", "a", "b", "item_id", "emb")
    right = index.members.join(m, "cell").join(q, "cell").withColumn("b", F.pmod(F.xxhash64("ref_id"), F.col("ms")).cast("int")).withColumn("a", every("qs")).select("cell", "a", "b", "ref_id", "emb")

    def best(mine: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(refs):
            return pd.DataFrame({"item_id": pd.Series([], dtype="int64"), "top": pd.Series([], dtype=object)})
        refs = refs.sort_values("ref_id", ignore_index=True)
        x, y = (np.stack([np.asarray(v, np.float64) for v in t["emb"]]) for t in (mine, refs))
        score = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1)) + 1e-8)
        down = np.round(-score, DIGITS)
        first = np.argsort(down, axis=1, kind="stable")[:, :k]
        ids = refs["ref_id"].to_numpy()
        return pd.DataFrame({"item_id": mine["item_id"].to_numpy(), "top": [[{"down": down[i, j], "ref_id": int(ids[j])} for j in row] for i, row in enumerate(first)]})

    key = ["cell", "a", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "item_id long, top array<struct<down:double,ref_id:bigint>>")


def visits(queries: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """(first, others): the k best of each query's home cell (item_id, top), and the other cells (item_id, emb, cell) that could
    hold a better one or as good a one."""
    ship(queries.sparkSession)
    asked = queries.filter("emb is not null").select("item_id", "emb")
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radii))
    emb = dict(asked.dtypes)["emb"]

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(*sent.value, None)
        for batch in batches:
            if len(batch) and (own.radii >= 0).any():
                _, most = own.cells(unit(batch["emb"]))
                yield batch.assign(cell=most.argmax(axis=1).astype(np.int32))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(*sent.value, None)
        for batch in batches:
            if not len(batch) or (own.radii < 0).all():
                continue
            _, most = own.cells(unit(batch["emb"]))
            known = batch["least"].to_numpy(float, na_value=-np.inf)
            there = most + SLACK >= known[:, None]
            there[np.arange(len(batch)), most.argmax(axis=1)] = False
            there &= np.isfinite(most)
            i, cell = np.nonzero(there)
            for at in range(0, len(i), ROWS):  # a query may ask for all cells: its vector is repeated a bounded number of times at once
                yield batch.iloc[i[at : at + ROWS]][["item_id", "emb"]].assign(cell=cell[at : at + ROWS].astype(np.int32))

    first = written(_meet(asked.mapInPandas(home, f"item_id long, emb {emb}, cell int"), index, k).groupBy("item_id").agg(_top(k)), "first")
    # fewer than k found leave everything open
    least = first.select("item_id", F.when(F.size("top") == k, -F.element_at("top", -1)["down"]).alias("least"))
    others = asked.join(least, "item_id", "left").mapInPandas(further, f"item_id long, emb {emb}, cell int")
    return first, written(others, "further")


def _top(k: int):
    return F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")


def search(queries: DataFrame, index: Index, k: int = 1) -> DataFrame:
    """(item_id, rank, ref_id, score): for each query (item_id, emb) its k best references by cosine, ranked from 1; scores to 9
    decimals, equal ones by ref_id. Exact: a cell is passed over only if the triangle inequality leaves no better or equal member in
    it. item_ids must differ; a query without a vector has no rows, one with fewer references than k has those."""
    first, others = visits(queries, index, k)
    both = first.unionByName(_meet(others, index, k)).groupBy("item_id").agg(_top(k))
    return both.select("item_id", F.posexplode("top").alias("pos", "x")).select("item_id", (F.col("pos") + 1).alias("rank"), "x.ref_id", (-F.col("x.down")).alias("score"))


def visited_share(queries: DataFrame, index: Index, k: int = 1) -> float:
    """The share of (query, cell) that a search looks into, of all with members."""
    first, others = visits(queries, index, k)
    n = first.count()
    return (n + others.count()) / max(1, n * int((index.radii >= 0).sum()))
