"""A corpus pipeline of five stages over ``documents``; each works on all that the stage before it kept.

The first four return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm import langid, minhash, packing, quality, secrets
from framespark.llm.storage import materialize, remove, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, kept by being written, and its column's name, which no column has: ids may be null or
    repeat, and columns may have any names."""
    name = "row_id"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return quality.keep_drawn(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a language learned from all that have a label."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    rows, row = _numbered(docs)
    decided = minhash.near_duplicates(rows, words=5, percent=80, id_col=row)
    return rows.join(decided.filter("kept").select(row), row, "left_semi").drop(row)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced by a mark."""
    rows, row = _numbered(docs)
    return secrets.redact(rows, secrets.scan(rows, id_col=row), id_col=row).drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Each result is written; what a stage wrote for itself, and its input, are deleted then, so one
    table is left in the shared folder, and none within ``storage.scope``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, path = settled(spark, partial(stage, spark, docs, sf_dir), f"stage{k}")
        if before:
            remove(spark, [before])
        before = path
    return docs


#: SQL has no n-gram models, centroids, signatures, forests or tokenizers: tests hold the stages to brute force.
ORACLE_SQL: str | None = None
