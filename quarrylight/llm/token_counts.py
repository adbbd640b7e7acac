"""8. Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only; long texts are split."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table
from quarrylight.shipping import ship

BATCH = 1 << 18  #: bytes that are encoded at a time, about
LONG = 1 << 10  #: characters after which a text is parted at the next safe place; shorter parts cost the encoder less
#: One space between characters that are neither a space nor the mark that stands for one. No piece of the vocabulary has
#: that mark after another character, so no merge crosses such a place, and the encoder puts the mark before the next
#: part in place of the space.
SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    dummy = model.encode("a", out_type=str)[:1] == ["▁a"] and model.encode("　 a", out_type=str) != model.encode("a", out_type=str)
    return model, dummy and not crossing


def split_safely(text: str, long: int = LONG) -> list[str]:
    """Parts, of about `long` characters at least, whose counts add up to the text's; a text without safe places stays whole."""
    parts, at = [], 0
    while len(text) - at > long:
        m = SAFE.search(text, at + long)
        if m is None:
            break
        parts.append(text[at : m.start()])
        at = m.end()
    parts.append(text[at:])
    return parts


def counts(texts: list[str | None], path: str, batch: int = BATCH, long: int = LONG) -> list[int]:
    """Tokens of each text; null counts as empty. Parts of texts are gathered into batches of about `batch` bytes, whatever
    texts they are of; a batch is encoded in one call, and the lengths are added to the parts' texts."""
    model, splits = _model(path)
    out = [0] * len(texts)
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for k, ids in zip(owner, model.encode(held, num_threads=1)):
            out[k] += len(ids)
        held.clear()
        owner.clear()
        size = 0

    for k, text in enumerate(texts):
        for x in split_safely(text, long) if text and splits else [text or ""]:
            bytes_ = len(x.encode())
            if held and size + bytes_ > batch:
                flush()
            held.append(x)
            owner.append(k)
            size += bytes_
    if held:
        flush()
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. A map over the rows: nothing is shuffled, ids never leave the function.

    Nulls: a null text is empty; null ids stay. Repeated rows are counted each, an empty table gives none, and other
    columns stay, but for those of the three names, which are replaced. A long text is encoded in parts, so memory is bounded
    by an Arrow batch and one part; a part ends at a space, so a text without any is one part.
    """
    ship(docs.sparkSession)

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counts(texts.tolist(), path), dtype="int64")

    out = docs.withColumn("n_tokens", F.pandas_udf(lengths, "long")("text"))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")
