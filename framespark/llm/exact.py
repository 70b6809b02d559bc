"""Exact duplicates: counting quotient filters of fingerprints, and bytes for those counted more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, quotient
from .storage import materialize

#: Fingerprints in a block of the merged filter, about; at least 2**LEAST_BLOCKS blocks.
BLOCK, LEAST_BLOCKS = 1 << 18, 6
#: Largest bitmap of repeated fingerprints that is broadcast, in bits (32 MB): beyond some ten million of them more texts
#: than need be are compared, none fewer.
MAX_BITS = 1 << 28


def fingerprint(text: Column, bits: int = 64) -> Column:
    """``bits`` of a 64-bit hash of a text (null: empty), as a long."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - bits) if bits < 64 else F.xxhash64(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)


def repeated_fingerprints(prints: DataFrame, bits: int = 64) -> DataFrame:
    """The values of ``prints.fp`` that stand there more than once.

    Each task builds a filter of its own fingerprints, cut by their first bits into blocks; equal blocks of all tasks merge
    in one group, which holds about ``BLOCK`` fingerprints whatever their number, each once for a task that has it.
    """
    rows = prints.count()
    top = min(bits, max(LEAST_BLOCKS, int(np.ceil(np.log2(max(rows, 1) / BLOCK)))))
    width = bits - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_prints, counts = quotient.tally(np.zeros(0, np.uint64))
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            all_prints, counts = quotient.tally(np.concatenate((all_prints, new)), np.concatenate((counts, np.ones(len(new), np.int64))))
        block = (all_prints >> np.uint64(width)).astype(np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        low = all_prints & np.uint64((1 << width) - 1)
        spans = list(zip(edges[:-1], edges[1:])) if len(block) else []
        for k in range(0, len(spans), 1024):
            some = spans[k : k + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[a]) for a, _ in some]), pa.array([quotient.pack(low[a:b], counts[a:b], width) for a, b in some], pa.binary())],
                names=["block", "filter"],
            )

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        found, counts = quotient.merge(table.column("filter").to_pylist(), width)
        fp = found[counts > 1] | (np.uint64(key[0].as_py()) << np.uint64(width))
        return pa.table({"fp": pa.array(fp.view(np.int64))})

    filters = prints.select("fp").mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merged, "fp long")


def _may_repeat(repeats: DataFrame, count: int):
    """A function of a column of fingerprints: whether they may be in ``repeats.fp``."""
    found, size = bitmap.build(repeats, "fp", count, MAX_BITS)
    shared = repeats.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def marked(fp: pd.Series) -> pd.Series:
        return pd.Series(bitmap.marked(shared.value, size, fp.to_numpy(np.int64)))

    return marked


def classes(prints: DataFrame, docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """``(sha, size, smallest, largest)`` of every text that stands in more than one row.

    ``prints`` is a written table of a row for each document: ``row`` (unique), ``doc_id``, ``fp``, ``sha`` (of the text).
    ``smallest`` and ``largest`` are structs of doc_id and row; a null id is smaller than others. Only texts whose
    fingerprint may be counted more than once are read again, and met byte for byte in an aggregate that combines within
    tasks: equal digests of different texts would raise an error.
    """
    repeats = materialize(repeated_fingerprints(prints, bits), "repeats")
    fp = fingerprint(F.col(text_col), bits)
    texts = docs.select(fp.alias("fp"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.filter(_may_repeat(repeats, repeats.count())("fp")).groupBy("text").agg(F.count("*").alias("rows"))
    texts = texts.filter("rows > 1").select(digest(F.col("text")).alias("sha"), "rows")
    verified = texts.groupBy("sha").agg(
        F.when(F.count("*") > 1, F.raise_error(F.lit("different texts have one SHA-256"))).otherwise(F.max("rows")).alias("size")
    )
    own = F.struct("doc_id", "row")
    ends = prints.join(repeats, "fp", "left_semi").groupBy("sha").agg(F.min(own).alias("smallest"), F.max(own).alias("largest"))
    return materialize(ends.join(verified, "sha"), "classes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", bits: int = 64) -> DataFrame:
    """Groups of documents with equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, a row for each document.

    Of equal texts the row with the ``largest`` (or ``smallest``) id stays. Null texts are empty and equal to one another.
    Rows may repeat an id: of those with the chosen id one stays. Null ids are smaller than others, and keep_id is null
    where the row that stays has none. No rows give none; other columns are left out, whatever their names. ``bits`` is the
    length of fingerprints (more than ``LEAST_BLOCKS``).
    """
    text = F.col(text_col)
    prints = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), fingerprint(text, bits).alias("fp"), digest(text).alias("sha")
    )
    prints = materialize(prints, "prints")
    found = classes(prints, docs, text_col, bits).select("sha", "size", F.col(keep).alias("stays"))
    return prints.join(found, "sha", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
