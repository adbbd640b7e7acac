"""3. SimHash near-duplicates by anchor-point covering: fingerprints meet at the codewords of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table
from quarrylight.operators import hamming
from quarrylight.operators.components import connected_components
from quarrylight.shipping import ship
from quarrylight.storage import cut, small, written

SHINGLE, SEED, THRESHOLD = 4, 42, 4
WIDE = 5  #: words of the shingles whose sets are compared
BANDS, ROWS = 16, 4
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: (first bit, bits, distance) of three parts of a fingerprint. Two fingerprints at 4 bits or less differ by at most 1
#: in the first part, or at most 1 in the second, or not at all in the third: otherwise 2 + 2 + 1 bits would differ.
PARTS = ((0, 25, 1), (25, 25, 1), (50, 14, 0))
CODE = 15  #: the first 15 bits of a part at distance 1 are covered by the perfect Hamming(15, 11) code, radius 1; the others by themselves
PIECES = 5  #: of the bits outside a part, one more than THRESHOLD, so that two fingerprints at 4 bits or less agree in one of them
FINE = 200_000_000  #: different fingerprints beyond which an anchor is divided by these pieces: more replicas, far fewer comparisons
BUCKET = hamming.BUCKET
TEXTS, HELD = 4096, 4_000_000  #: texts of a band, and shingles of them, that one task compares; more are dealt to pairs of chunks


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of each shingle of so many words; of a shorter text the hash of all its words, without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, "<u8")
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(join(words), SEED)], "<u8")
    return np.fromiter((digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))), "<u8", len(words) - shingle + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the hashes of shingles, repeats included; a bit is set if over half of the shingles set it."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long), a row for each row of docs. A null text has no words: fingerprint 0. Words of a whole text are in a
    worker's memory, and votes are added up 65,536 shingles at a time."""
    ship(docs.sparkSession)

    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", F.pandas_udf(own, "long")("text").alias("fp"))


def _nearest(x: np.ndarray) -> np.ndarray:
    """The codeword of Hamming(15, 11) nearest to the low 15 bits, other bits as they are."""
    syndrome = np.zeros_like(x)
    for i in range(CODE):
        syndrome ^= np.where((x >> np.uint64(i)) & np.uint64(1) != 0, np.uint64(i + 1), np.uint64(0))
    wrong = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome, np.uint64(1)) - np.uint64(1), np.uint64(0))
    return x ^ wrong


def _others(fp: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The bits outside a part, those above it first."""
    shift = first + bits
    low = fp & np.uint64((1 << first) - 1)
    return low if shift == 64 else (fp >> np.uint64(shift)) | (low << np.uint64(64 - shift))


def anchors(fp: np.ndarray, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place in fp, anchor) of every anchor that a fingerprint is replicated to: in each part, the codewords that are home
    to it or to something within the part's distance of it. The anchor holds the part's number in its top bits; if `fine`,
    each is divided into PIECES by what the fingerprint has in each piece of the bits outside the part."""
    at, out = [], []
    for k, (first, bits, distance) in enumerate(PARTS):
        part = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        if distance:
            around = np.stack([part, *(part ^ np.uint64(1 << i) for i in range(bits))])
            home = np.sort(_nearest(around), axis=0)
            new = np.vstack([np.ones((1, len(fp)), bool), home[1:] != home[:-1]])
        else:
            home, new = part[None], np.ones((1, len(fp)), bool)
        _, where = np.nonzero(new)
        own = home[new] | np.uint64(k << 40)
        if not fine:
            at.append(where)
            out.append(own)
            continue
        rest, ends = _others(fp, first, bits), [(64 - bits) * j // PIECES for j in range(PIECES + 1)]
        for j, (low, high) in enumerate(zip(ends, ends[1:])):
            piece = (rest >> np.uint64(low)) & np.uint64((1 << high - low) - 1)
            at.append(where)
            out.append(own | (piece[where] << np.uint64(25)) | np.uint64(j << 36))
    return np.concatenate(at), np.concatenate(out)


def links(distinct: DataFrame, bucket: int = BUCKET, fine: bool | None = None) -> DataFrame:
    """(src, dst): links that connect all different fingerprints (column fp) as all links at THRESHOLD or less would.

    fine: whether anchors are divided; None decides by the number of fingerprints. The links are as whole either way. Each fingerprint
    goes to its anchors, and the fingerprints of an anchor are compared, those of one with more than `bucket` in chunks.
    """
    ship(distinct.sparkSession)
    divided = distinct.count() > FINE if fine is None else fine

    def replicated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy().astype(np.int64)
            at, anchor = anchors(fp.view(np.uint64), divided)
            yield pd.DataFrame({"sig": fp[at], "anchor": anchor.astype(np.int64)})

    return hamming.links(distinct.select("fp").mapInPandas(replicated, "sig long, anchor long"), THRESHOLD, bucket)


def bands_of(text: str | None, shingle: int = WIDE) -> list[int]:
    """BANDS hashes, each of ROWS minima of the hashes of a text's shingles under different multipliers; none without words. A
    band of two texts is equal with the probability similarity ** ROWS."""
    import xxhash

    hashes = np.unique(shingle_hashes(text, shingle))
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * MULTIPLIERS
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def link_sets(names: list[int], sets: list[np.ndarray], similar: float, forest: hamming.Forest) -> None:
    """Links the names of all sets, each without repeats, of which two are at least `similar`, |A ∩ B| / |A ∪ B|.

    What is linked to a set leaves the others before the next is compared, so a dense group costs little more than its size; sets
    that are near none are each met with all that hold something of theirs.
    """
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        if common >= similar * (len(sets[0]) + len(sets[1]) - common):
            forest.link(*names)
        return
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, row, left = np.split(code, np.cumsum(size)[:-1]), np.repeat(np.arange(len(sets)), size), np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        """The rows that are left by what they hold, and where those of each begin and end."""
        kept = left[row]
        return row[kept][np.argsort(code[kept], kind="stable")], np.r_[0, np.cumsum(np.bincount(code[kept], minlength=code.max() + 1))]

    (rows, ends), indexed = postings(), len(sets)
    for first in range(len(sets)):
        seeds, left[first] = [first] if left[first] else [], False
        while seeds:
            x = seeds.pop()
            if 2 * left.sum() < indexed:
                (rows, ends), indexed = postings(), int(left.sum())
            common = np.bincount(np.concatenate([rows[ends[k] : ends[k + 1]] for k in own[x]]), minlength=len(sets))
            near = np.flatnonzero(left & (common >= similar * (size[x] + size - common))).tolist()
            for y in near:
                forest.link(names[x], names[y])
            left[near] = False
            seeds += near


def _of_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """All rows of one key after the other, from batches that are sorted by it."""
    rest = None
    for batch in batches:
        now = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        k = now[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else [0]
        for at, end in zip(starts, starts[1:]):
            yield now.iloc[at:end]
        rest = now.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def similar_links(docs: DataFrame, similar: float = 0.8, shingle: int = SHINGLE, wide: int = WIDE, bucket: int = TEXTS, held: int = HELD) -> DataFrame:
    """(src, dst): fingerprints of texts whose sets of `wide` words in a row are at least `similar`, |A ∩ B| / |A ∪ B|: a spanning
    tree of the texts of a band, not their pairs.

    Different texts meet by bands, and the whole sets of a band are compared in one task, or, of more than `bucket` texts or
    `held` shingles, in a task for each pair of chunks, so memory is bounded and no link of texts that share a band is lost. Bands of
    the same texts are one. No row is made of a pair: a text is a row for each of its bands, for each chunk of a large one.
    This adds to the links of fingerprints and takes none away; that near texts share a band is likely, not certain: recall is
    measured. What is broadcast is measured before.
    """
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            bands = [np.array(bands_of(t, wide), np.uint64).view(np.int64).tolist() for t in texts]
            yield pd.DataFrame({"fp": fps, "bands": bands, "n": [len(np.unique(shingle_hashes(t, wide))) for t in texts]})

    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, wide)).view(np.int64).tolist() for t in texts], dtype=object)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = hamming.Forest()
        for own in _of_keys(batches, "part"):
            names = own["fp"].to_numpy().astype(np.int64).view(np.uint64).tolist()
            if len(own) > 1:
                link_sets(names, [np.asarray(x, np.int64) for x in own["shingles"]], similar, forest)
            if len(forest.up) > hamming.NODES:
                yield forest.frame()
                forest = hamming.Forest()
        yield forest.frame()

    key = F.xxhash64("text").alias("key")
    rows = docs.filter("text is not null").select(key, F.pandas_udf(sketch, "fp long, bands array<long>, n int")("text").alias("x"))
    texts = written(rows.groupBy("key").agg(F.first("x").alias("x")).select("key", "x.*"), "sketches")
    in_band = texts.select("key", "fp", "n", F.posexplode("bands").alias("at", "value")).select("key", "fp", "n", F.xxhash64("at", "value").alias("band"))
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"same{k}") for k in range(2)] + [F.min("key").alias("low"), F.max("key").alias("high")]
    bands = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), *same).filter("m > 1")
    bands = bands.groupBy("m", "total", "same0", "same1", "low", "high").agg(F.min("band").alias("band"))
    large = (F.col("m") > bucket) | (F.col("total") > held)
    chunks = F.when(large, F.ceil(F.greatest(2 * F.col("m") / bucket, 2 * F.col("total") / held))).otherwise(1).cast("int")
    bands = written(bands.select("band", chunks.alias("chunks")), "bands")
    dealt = in_band.join(small(bands, 2_000_000), "band").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.when(F.col("chunks") > 1, F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("band"))
    dealt = written(dealt.select("key", "fp", part.alias("part")), "parts")
    wanted = written(dealt.select(F.col("key").alias("wanted")).distinct(), "wanted")
    found = docs.filter("text is not null").join(small(wanted, 2_000_000), F.xxhash64("text") == F.col("wanted"), "left_semi")
    sets = found.select(key, F.pandas_udf(shingles, "array<long>")("text").alias("shingles")).groupBy("key").agg(F.first("shingles").alias("shingles"))
    both = dealt.join(sets, "key").select("part", "fp", "shingles")
    return both.repartition("part").sortWithinPartitions("part").mapInPandas(compared, "src long, dst long")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET, shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id that chains of links reach. With
    similar, `similar_links` are links too.

    Exact copies and equal fingerprints meet first, with partial minima, so that a group of copies is one fingerprint.
    Nulls: a null text has fingerprint 0; null doc_ids are never smallest unless all are null, then the component is null.
    Repeated rows are rows of the result; an empty table gives none. Other columns are ignored.
    """
    all_ = written(fingerprints(docs, shingle), "fingerprints")
    distinct = all_.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    distinct = cut(distinct)
    near = links(distinct, bucket)
    if similar is not None:
        near = near.unionByName(similar_links(docs, similar, shingle))
    roots = connected_components(near).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = linked.join(least, "root").select("fp", F.col("component_id").alias("linked_id"))
    # cut, so that both sides of the last join come from a shuffle, and Spark can split a large group of copies there
    label = cut(distinct.join(label, "fp", "left").select("fp", F.coalesce("linked_id", "least_id").alias("component_id")))
    return all_.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, broadcast_rows: int = 2_000_000, shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """One row of docs for each component of `near_duplicates`, the one with the smallest doc_id; all columns. Of repeated rows
    with that id, one. A very long text is whole; its words and the set of its shingles are in a worker's memory.

    Nulls: texts that are null have fingerprint 0 and are one component with empty ones; a component of null ids only keeps
    one row for each different row of docs. An empty table gives none; columns of any name stay.
    """
    near = near_duplicates(docs, shingle=shingle, similar=similar).select("doc_id", "component_id")
    near = cut(near.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")))
    gone = near.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__ql_gone")).distinct()
    twice = near.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n") > 1)).select(F.col("doc_id").alias("__ql_twice"))
    left = docs.join(small(gone, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("__ql_gone")), "left_anti")
    if twice.isEmpty():
        return left
    twice = small(twice, broadcast_rows)
    same = F.col("doc_id").eqNullSafe(F.col("__ql_twice"))
    again = left.join(twice, same, "left_semi")
    again = again.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(again.filter("doc_id is null").distinct())
    return left.join(twice, same, "left_anti").unionByName(again)


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
