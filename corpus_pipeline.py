"""From raw documents to packed training sequences, in five stages.

Each stage is an operator of `wrenchlake.llm` applied to all that the stage before it kept. The result of a stage is written as
Parquet and read again, so a lost executor costs its tasks only and the next stage is planned on true sizes. What a stage has
staged for itself is dropped when the next one begins, as its result is written by then; so one pipeline runs at a time in a process.
Texts go to Python in batches of `BATCH_BYTES`: Spark's usual ones are as large as all that an operator keeps, and are held several times over, in the
JVM and in the worker. No result depends on where a batch ends.

Null texts count as empty and are rejected by the quality rules, as is any text of under 50 words; very long texts are worked on whole. Of equal
rows of one id one stays, of different rows of one id each is judged for itself; ties go to the smaller id. A null id may be kept or dropped as any other.
An empty table gives an empty table. Columns beyond those of documents are kept up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wrenchlake.llm import jaccard_join, mixing, packing, quality_rules, repeats
from wrenchlake.llm.common import stage_text
from wrenchlake.session import drop_folder, folders_made

#: Near copies: shingles of so many words, and a similarity of at least so many percent.
WORDS, PERCENT = 5, 80

#: Bytes of rows that Spark hands to a Python task at a time.
BATCH_BYTES = "4m"

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage staged for itself.
_LEFT: list[str] = []


def _alone(apply: _Stage) -> _Stage:
    """Drop what the stage before has staged, bound the batches, and note what this one stages."""

    @wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            drop_folder(spark, _LEFT.pop())
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        before = len(folders_made())
        out = apply(spark, docs, sf_dir)
        _LEFT.extend(folders_made()[before:])
        return out

    return run_stage


@_alone
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quality rules reject go."""
    return quality_rules.keep_good(docs)


@_alone
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one(docs, WORDS, PERCENT)


@_alone
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that came before are cut out of the texts."""
    return repeats.without_repeats(docs)


@_alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per take of a document, in the order of the curriculum."""
    return mixing.mixed_documents(docs)


@_alone
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good_documents),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no form of the near-copy groups, the tokenizer and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage_text(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
