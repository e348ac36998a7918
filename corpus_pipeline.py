"""A corpus pipeline: toxic documents go, exact copies go, near copies go, repeated passages go, the rest is packed.

Each stage reads what its predecessor has written.  All but the last return the
columns of documents.  A stage begins by deleting the tables that the stage
before it has worked with, whose result has been written by then."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from widegrain.llm import exact_dedup, jaccard_groups, packing, suffix_dedup, toxicity
from widegrain.llm.common import documents, reads, release, save, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not reads(docs, "pipeline"):  # else the stage before hasn't been written, and still needs them
            release(spark, "pipeline")
        with scope("pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity stays below their language's threshold.

    A null text is scored as an empty one, and rows with null doc_id or lang by
    their text and the common threshold; repeated rows stay or go together;
    without labels of both classes nothing goes; whole texts are scored, however
    long; other columns and an empty table pass unchanged."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it too, one.

    A null text equals an empty one, so one of them stays; a null doc_id is less
    than any other; other columns and an empty table pass unchanged."""
    return exact_dedup.keep_one(docs)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by sets of five words with a similarity of 0.8 the least doc_id.

    Null, empty and wordless texts are linked with nothing and stay; of rows that
    repeat the least doc_id the first stays, and so does the first row of a group
    without any; other columns and an empty table pass unchanged."""
    return jaccard_groups.one_of_each(docs)


@_tidy
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without bytes that lie in a string of 200 bytes which also starts elsewhere; n_chars follows.

    Null texts, and those that keep all their bytes, stay as they are; a text may
    become empty; rows that repeat each other lose all of a text of 200 bytes or
    more; other columns and an empty table pass unchanged."""
    return suffix_dedup.remove_repeats(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens.

    A null text packs as the end token alone, repeated rows and rows with null
    doc_id as rows of their own; a text that is too long is cut; other columns
    are left out; an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: The classifier, the tokenizer and the suffix array can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes when the next one's has been written."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = stage(spark, docs, sf_dir)
        with scope(f"stage {k}"):
            docs = save(made, "stage")
        release(spark, f"stage {k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
