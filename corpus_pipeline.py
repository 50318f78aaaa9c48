"""Cleaning and packing of a corpus: stages of (name, function), each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.packing import pack_documents
from spanforge.llm.queries import near_copies, set_batches, shared_passages, tokenizer_file, toxic_rejects
from spanforge.llm.store import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 4096 tokens (see :func:`pack_documents`).

    Null and empty texts are an end token alone; repeated rows and rows without
    id are packed like any other; columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    set_batches(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_rejects),
    ("simhash", near_copies),
    ("substrings", shared_passages),
    ("packing", packing),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
