"""Documents, from quality rules to packed sequences. Each stage's rows are written as Parquet and read as the next one's input.

Very long texts are whole in every stage, and extra columns stay to the last one, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import decontaminate, packing, quality, secrets, simhash
from quarrylight.llm.common import table
from quarrylight.storage import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep. Null and empty texts have too few words and go;
    null ids, repeated rows and ties are judged each; no labels leave the base rules; an empty table stays empty."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("__ql_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: near by fingerprint, or at 0.8 by sets of
    five words in a row, as a fingerprint of a short text moves too far by one word. Repeated rows become one; rows with a
    null id go where their group has an id, else one of each different row stays; an empty table stays empty."""
    return simhash.keep_one(docs, similar=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words occurs in the benchmark. Null texts and ids stay, repeated rows
    stay or go together; an empty table stays empty, an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; n_chars follows. Null texts stay null, repeated rows are redacted
    each; an empty table stays empty."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 4096. A null text is its end id alone, repeated rows are
    packed each, a null id stays null; an empty table gives no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", pack),
]
#: Learned rules, XXH64 and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Intermediate tables lie in the shared folder, so a lost executor repeats no earlier stage."""
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
