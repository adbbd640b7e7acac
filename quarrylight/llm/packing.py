"""6. Packing: non-negative least squares over shallow combinations of lengths that fill a window, then a greedy rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import table
from quarrylight.llm.tokens import encoder, wide
from quarrylight.shipping import ship
from quarrylight.storage import written

WINDOW, END_ID = 4096, 2
BUCKET = 500  #: pieces of one length, about, that are numbered in one task; a frequent length has many
MOST_BUCKETS = 2_000_000  #: beyond so many buckets, their pieces grow instead: what the driver holds stays bounded
FREQUENT, TRIPLES, QUADS = 24, 24, 2  #: lengths that count as frequent; combinations kept for each largest length
WAYS = ((4, 0), (3, 0), (2, 16), (2, 0))  #: (lengths of a combination, ids that a pair may leave free)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of each document's ids and end_id, cut after each `window` ids.

    ids: little-endian unsigned 32-bit, null unless with_ids."""
    ship(docs.sparkSession)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = wide(encode(text), encode.width) + end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut_up, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def combinations(histogram: np.ndarray, window: int, depth: int = 4, slack: int = 0) -> list[tuple[int, ...]]:
    """Descending combinations of up to `depth` lengths that fill the window: any pair, which may leave up to `slack` ids
    free; for each length the TRIPLES most frequent pairs, none of them longer, that complete it; and with each of the
    FREQUENT most frequent lengths, QUADS more. At most window * (slack + TRIPLES + FREQUENT * QUADS + 1), however large the data."""
    there = np.flatnonzero(histogram)
    often = there[np.argsort(-histogram[there], kind="stable")][:FREQUENT].tolist()
    out = {(window,)} if histogram[window] else set()

    def pairs(total: int, longest: int, most: int) -> list[int]:
        """The longer ones of pairs of lengths with this sum."""
        b = there[(there >= (total + 1) // 2) & (there < total) & (there <= longest)]
        b = b[histogram[total - b] > 0]
        return b[np.argsort(-np.minimum(histogram[b], histogram[total - b]), kind="stable")[:most]].tolist()

    for total in range(window - slack, window + 1):
        out.update((b, total - b) for b in pairs(total, window, window))
    for a in there.tolist() if depth > 2 else ():
        out.update((a, b, window - a - b) for b in pairs(window - a, a, TRIPLES))
        for d in often if depth > 3 else ():
            if a + d < window:
                out.update(tuple(sorted((a, b, window - a - d - b, d), reverse=True)) for b in pairs(window - a - d, a, QUADS))
    return sorted(out, reverse=True)


def least_squares(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with least |A x - histogram|, A counting the lengths of each pattern; projected gradient with momentum."""
    if not patterns:
        return np.zeros(0)
    depth = max(map(len, patterns))
    index = np.zeros((len(patterns), depth), np.int64)
    for i, p in enumerate(patterns):
        index[i, : len(p)] = p
    weight = (index > 0).astype(float)
    h = histogram.astype(float)
    apply = lambda x: np.bincount(index.ravel(), (weight * x[:, None]).ravel(), len(h))
    back = lambda r: (weight * r[index]).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    for k in range(1, rounds + 1):
        new = np.maximum(y - back(apply(y) - h) / top, 0)
        y = new + (k - 1) / (k + 2) * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """Where the pieces go: (length, low, repeats, sequence, offset, solved); the pieces of a length numbered low..low +
    repeats - 1 lie at offset in sequences sequence, sequence + 1, ...; solved: by least squares, not by the greedy rest.
    Its size is bounded by the window, not by the data. Deeper combinations use up short pieces that long ones may need, so
    of a few depths the one with the fewest sequences is taken, the deepest of equals; none is tried once the bound is met."""
    least = -(-int((histogram * np.arange(len(histogram))).sum()) // window)  # no plan has fewer
    best, fewest = None, 0
    for depth, slack in WAYS:
        way = _plan(histogram, window, depth, slack)
        n = int((way["sequence"] + way["repeats"]).max()) if len(way) else 0
        if best is None or n < fewest:
            best, fewest = way, n
        if fewest <= least:
            break
    return best


def _plan(histogram: np.ndarray, window: int, depth: int, slack: int) -> pd.DataFrame:
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(pattern: tuple[int, ...], times: int, solved: int) -> None:
        nonlocal sequence
        at = 0
        for n in pattern:
            rows.append((n, used[n], times, sequence, at, solved))
            used[n] += times
            left[n] -= times
            at += n
        sequence += times

    def most(pattern: tuple[int, ...]) -> int:
        return min(int(left[n]) // pattern.count(n) for n in set(pattern))

    patterns = combinations(histogram, window, depth, slack)
    x = least_squares(patterns, histogram)
    for i in np.argsort(-x, kind="stable"):  # rounded up while there are pieces: a full window wastes nothing
        times = min(int(np.ceil(x[i] - 1e-6)), most(patterns[i]))
        if times > 0:
            place(patterns[i], times, 1)
    while left.any():  # the rest, largest first, each sequence filled with the largest that still fits
        there = np.flatnonzero(left)
        space, pattern = window, []
        taken: dict[int, int] = {}
        while True:
            k = int(np.searchsorted(there, space, "right")) - 1
            while k >= 0 and taken.get(int(there[k]), 0) >= left[there[k]]:
                k -= 1
            if k < 0:
                break
            n = int(there[k])
            many = min(int(left[n]) - taken.get(n, 0), space // n)
            pattern += [n] * many
            taken[n] = taken.get(n, 0) + many
            space -= n * many
        place(tuple(pattern), most(tuple(pattern)), 0)
    return pd.DataFrame(rows, columns=["length", "low", "repeats", "sequence", "offset", "solved"]).astype(np.int64)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of docs with sequence_id and offset. Sequences hold at most `window` ids, gapless from 0.

    Pieces are numbered within each length: in buckets by hash, as many as its pieces ask for, then bucket by bucket. The
    histogram (at most `window` bins) is solved on the driver, and each piece finds its place by its length and number.
    Texts are encoded once.

    Nulls: a null text is empty, its one piece is end_id; a null doc_id stays null. Repeated rows are packed each. An
    empty table gives no rows. Other columns are ignored, whatever their names. A very long text is many pieces; its ids are
    in a worker's memory once.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, window, end_id, with_ids), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in rows.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most `window` rows
        histogram[length] = n
    size = max(BUCKET, -(-int(histogram.sum()) // MOST_BUCKETS))
    buckets = np.maximum(1, -(-histogram // size))
    often = spark.createDataFrame([(int(n), int(buckets[n])) for n in np.flatnonzero(buckets > 1)], "often long, buckets int")
    own = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")).cast("int")
    rows = rows.join(F.broadcast(often), F.col("length") == F.col("often"), "left").withColumn("bucket", F.coalesce(own, F.lit(0))).drop("often", "buckets")
    first = np.cumsum(buckets) - buckets  # a bucket's place among all: its length's first, and its number
    base = np.zeros(int(buckets.sum()), np.int64)
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most window + MOST_BUCKETS
    base[first[counts["length"].to_numpy(np.int64)] + counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    base = np.cumsum(base) - base  # pieces in all buckets before
    base -= np.repeat(base[first], buckets)  # of the same length
    where = plan(histogram, window).sort_values(["length", "low"], kind="stable")
    sent = spark.sparkContext.broadcast((first, base, *(where[c].to_numpy() for c in ("length", "low", "sequence", "offset"))))

    def placed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        first, base, length, low, sequence, offset = sent.value
        steps = (length << 40) + low  # lengths and numbers in one ascending key
        for n, bucket, number in batches:
            n = n.to_numpy(np.int64)
            rank = base[first[n] + bucket.to_numpy(np.int64)] + number.to_numpy(np.int64) - 1
            at = np.searchsorted(steps, (n << 40) + rank, "right") - 1
            yield pd.DataFrame({"sequence_id": sequence[at] + rank - low[at], "offset": offset[at]})

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    rows = rows.withColumn("number", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("at", F.pandas_udf(placed, "sequence_id long, offset long")("length", "bucket", "number"))
    ids = ["ids"] if with_ids else []
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *ids, "at.sequence_id", "at.offset")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
