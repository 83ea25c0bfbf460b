"""Corpus pipeline: STAGES applied to ``documents`` in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

Edge cases, stage by stage: null, empty and short texts go with the quality
rules; a null id stays a row of its own (it is the last choice to stay of equal
or near texts); a null source is a source; repeated rows and ties leave one row
in the dedup stages, by id, text and then all columns; a document that the mix
takes twice is two rows, packed each; very long texts are read whole and cut
into full sequences; an empty table gives an empty result; further columns,
whatever their names, pass through to the last stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tally.llm.common import Scratch
from tally.llm.exact_dedup import exact_dedup
from tally.llm.mixing import mix
from tally.llm.packing import pack_documents
from tally.llm.quality_rules import quality_filter
from tally.llm.queries import tokenizer_path
from tally.llm.simhash import simhash_dedup

#: SQL cannot express hashed n-gram ratios, SimHash links or tokenizers; the
#: stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or whose n-gram ratio
    is too low go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each component stays."""
    return simhash_dedup(docs, words=4, max_bits=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each epoch that takes a document."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece, with its sequence and place there."""
    return pack_documents(docs, tokenizer_path(), 4096, call=2 << 20)  # its executors hold other stages' memory, too


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. Each stage's result is
    written to the shared folder and dropped once the next has been written."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
