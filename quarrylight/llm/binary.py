"""9. Token-id files: documents compressed one by one with a shared zstandard dictionary, and an index of their places.

A file is a table of blocks, so that any store that Spark reaches can hold it. A block is self-contained bytes, all
integers little-endian:

    4s  magic QLT1          B   bytes of an id           3x
    8s  hash of the dictionary (sha256, first 8 bytes)   I   documents n
    then n entries          q   doc_id                   B   1 if the id is null   7x
                            Q   place of its frame, from the end of the entries
                            I   bytes of its frame       I   ids
    then the frames: zstandard with the dictionary, each one document's ids
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import among, table
from quarrylight.llm.tokens import encoder, wide
from quarrylight.shipping import ship
from quarrylight.storage import shared_dir, small, written

MAGIC, HEAD, ENTRY = b"QLT1", struct.Struct("<4sB3x8sI"), struct.Struct("<qB7xQII")
SAMPLE = 1500  #: different documents, at most, that the dictionary is trained on: those with the least hashes of doc_id
SLICE = 1 << 14  #: characters of each of them, from a place that its hash chooses
DICTIONARY = 64 << 10  #: bytes of the dictionary, at most
BLOCK = 4 << 20  #: bytes of frames after which a block is closed
RANGES = 12  #: least ranges of doc_id that are sorted apart; sessions with more shuffle partitions use as many
RANGE_IDS = 50_000_000  #: ids of a range, about, where there are more
WORDS = 600_000  #: words whose ids a worker remembers, at most


def digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


@lru_cache(maxsize=2)
def _packer(dictionary: bytes, level: int):
    import zstandard as z

    data = z.ZstdCompressionDict(dictionary) if dictionary else None
    return z.ZstdCompressor(level=level, dict_data=data, write_content_size=True)


@lru_cache(maxsize=2)
def _unpacker(dictionary: bytes):
    import zstandard as z

    return z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None)


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from serialized ids; samples too few to train on stand in it as they are, none give none."""
    import zstandard as z

    samples = [s for s in samples if s]
    try:
        return z.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def dictionary(docs: DataFrame, tokenizer: str, sample: int = SAMPLE, slice_: int = SLICE) -> bytes:
    """A dictionary trained on slices of `sample` different documents. It changes the size of the files, never their ids.

    Documents are chosen by a hash of doc_id: first about twice as many as needed, then, rows of one id met as one, exactly
    those with the least hashes, so that neither the order of rows nor an id with many matters. Only their ids reach the driver."""
    key = F.xxhash64("doc_id")
    rows = docs.filter("text is not null")
    n = docs.agg(F.approx_count_distinct(key)).first()[0]
    if n > 2 * sample:
        rows = rows.filter(among(key, 2 * sample, n))
    place = F.pmod(F.xxhash64(key), F.greatest(F.length("text") - slice_, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(key.alias("key"), F.substring("text", place, F.lit(slice_)).alias("text"))

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, WORDS)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "ids": [encode(t) for t in batch["text"].tolist()]})

    found = rows.mapInPandas(ids, "key long, ids binary").groupBy("key").agg(F.min("ids").alias("ids")).orderBy("key").limit(sample).collect()
    return train([bytes(r[1]) for r in found])


def build_block(rows: list[tuple[int | None, bytes, int]], key: bytes, width: int) -> bytes:
    """(doc_id, frame, ids) of each document, in order."""
    head, entries, at = HEAD.pack(MAGIC, width, key, len(rows)), [], 0
    for doc_id, frame, n in rows:
        entries.append(ENTRY.pack(doc_id or 0, doc_id is None, at, len(frame), n))
        at += len(frame)
    return b"".join([head, *entries, *(r[1] for r in rows)])


def index(block: bytes) -> tuple[int, bytes, list[tuple[int | None, int, int, int]]]:
    """(bytes of an id, dictionary hash, [(doc_id, place, size, ids)]), places counted from the block's start."""
    magic, width, key, n = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    first = HEAD.size + n * ENTRY.size
    return width, key, [(None if null else doc_id, first + at, size, ids) for doc_id, null, at, size, ids in ENTRY.iter_unpack(block[HEAD.size : first])]


def read_document(block: bytes, entry: int, dictionary: bytes) -> bytes:
    """The ids of the entry-th document of a block, as little-endian unsigned 32-bit integers; no other frame is touched."""
    width, key, entries = index(block)
    if key != digest(dictionary):
        raise ValueError("another dictionary")
    _, at, size, ids = entries[entry]
    return wide(_unpacker(dictionary).decompress(block[at : at + size], max_output_size=ids * width or 1), width)


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, level: int = 3, sample: int = SAMPLE) -> str:
    """Writes the ids of docs, each document's with end_id, as blocks in ascending doc_id; returns the folder.

    Texts are encoded and compressed where they are read; only compressed frames are sorted by ranges of doc_id, and kept
    in the shared folder first, so a lost executor costs its own part. There are as many ranges as the ids ask for.

    Nulls: a null text is empty, its only id is end_id; null doc_ids come first. Repeated ids stand by the hash of their
    ids and are all kept. An empty table gives a folder without blocks. Other columns are ignored, whatever their names. A
    very long text is one frame: its ids are in a worker's memory once, and a block holds at least one frame whole.
    Without a path the folder lies with the session's own tables and goes with them.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{shared_dir(spark)}/token-ids/{uuid.uuid4().hex}"
    shared = dictionary(docs, tokenizer, sample)
    sent = spark.sparkContext.broadcast(shared)
    spark.createDataFrame([(bytearray(shared), bytearray(digest(shared)))], "dictionary binary, hash binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(tokenizer, WORDS), _packer(sent.value, level)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            ids = [encode(t) + end for t in batch["text"].tolist()]
            out = pd.DataFrame({"n": [len(x) // encode.width for x in ids], "check": [zlib.crc32(x) for x in ids], "frame": [packer.compress(x) for x in ids]})
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(frames, "doc_id long, n long, check long, frame binary")
    rows = written(rows, "frames")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_IDS))
    order = (F.col("doc_id").asc_nulls_first(), F.col("check").asc(), F.col("n").asc())  # rows of one id, or without any, are no one range
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "frame")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, key = encoder(tokenizer, WORDS).width, digest(sent.value)
        held: list[tuple[int | None, bytes, int]] = []
        size = number = 0

        def close(part: int) -> pd.DataFrame:
            nonlocal held, size, number
            out = pd.DataFrame({"part": [part], "number": [number], "documents": [len(held)], "ids": [sum(r[2] for r in held)], "block": [build_block(held, key, width)]})
            held, size, number = [], 0, number + 1
            return out

        part = 0
        for batch in batches:
            null = batch["doc_id"].isna().tolist()
            for empty, doc_id, n, frame, part in zip(null, batch["doc_id"].tolist(), batch["n"].tolist(), batch["frame"].tolist(), batch["part"].tolist()):
                held.append((None if empty else int(doc_id), frame, n))
                size += len(frame)
                if size >= BLOCK:
                    yield close(part)
        if held:
            yield close(part)

    dealt = dealt.withColumn("part", F.spark_partition_id())
    dealt.mapInPandas(blocks, "part int, number int, documents long, ids long, block binary").write.parquet(f"{path}/blocks")
    return path


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in a folder of write_ids; start: ids of all before it.

    Starts add up in three steps: ranges (as many as partitions, on the driver), blocks of a range, documents of a block."""
    ship(spark)
    shared = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    sent = spark.sparkContext.broadcast(shared)
    blocks = spark.read.schema("part int, number int, documents long, ids long, block binary").parquet(f"{path}/blocks")
    sums = sorted(blocks.groupBy("part").agg(F.sum("ids")).collect())
    bases, at = {}, 0
    for part, n in sums:
        bases[part], at = at, at + n
    known = spark.createDataFrame(list(bases.items()), "part int, base long")
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "number", "ids").withColumn("inside", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    starts = starts.join(F.broadcast(known), "part").select("part", "number", (F.col("base") + F.col("inside")).alias("at"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker, key = _unpacker(sent.value), digest(sent.value)
        for batch in batches:
            for start, block in zip(batch["at"].tolist(), batch["block"].tolist()):
                width, own, entries = index(block)
                if own != key:
                    raise ValueError("another dictionary")
                rows = []
                for doc_id, place, size, n in entries:
                    ids = wide(unpacker.decompress(block[place : place + size], max_output_size=n * width or 1), width)
                    if len(ids) != 4 * n:
                        raise ValueError("a frame does not have the ids that its entry says")
                    rows.append((doc_id, start, n, zlib.crc32(ids), ids if with_ids else None))
                    start += n
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    # blocks are few and large: their starts travel, they do not, if a broadcast is small enough
    found = blocks.select("part", "number", "block").join(small(starts, 200_000), ["part", "number"]).select("at", "block")
    out = found.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(spark, write_ids(docs, public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)
