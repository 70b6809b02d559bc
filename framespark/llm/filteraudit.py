"""How filters interact: what each removes, before and after the others, in every order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact
from .storage import materialize
from .worker import texts

_CAPITALS, _MARKS, _CONTINUATION = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Of one text: under 100 words; under 80 different ones in 100; over 10 capitals A-Z in 100 characters; a mark."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    characters = len(text.translate(None, _CONTINUATION))
    few_different = 100 * len(set(words)) < 80 * len(words)
    return len(words) < 100, few_different, 100 * capitals > 10 * characters, len(text.translate(None, _MARKS)) < len(text)


def document_failures(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows of ``documents`` as ``(row, part, good, toxic)``, and for each filter A to E the written table of the rows
    that fail it. A row whose text is that of a smaller id fails E; of rows that share text and id none fails by the other.

    Null texts are empty, a null lang is the part ''. An id with several labels is good or toxic if one of them says so;
    rows with null ids have no label, and their id is smaller than others.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = [text_failures(t) for _, _, some in texts(batch.column("text")) for t in some]
            flags = [pa.array([f[k] for f in failed], pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *flags], names=[*batch.schema.names[:-1], *"abcd"])

    text = F.col("text")
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).cast("string").alias("part"),
        exact.fingerprint(text).alias("fp"),
        exact.digest(text).alias("sha"),
        "text",
    )
    schema = "row long, doc_id long, part string, fp long, sha string, a boolean, b boolean, c boolean, d boolean"
    narrow = materialize(narrow.mapInArrow(judged, schema), "judged")
    first = exact.classes(narrow, docs).select("sha", F.struct(F.col("smallest.doc_id").alias("id")).alias("smallest"))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    repeats = F.col("smallest").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("smallest.id"))
    rows = narrow.join(first, "sha", "left").join(labels, "doc_id", "left").select(
        "row", "part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *"abcd", repeats.alias("e")
    )
    rows = materialize(rows, "rows")
    return rows.select("row", "part", "good", "toxic"), {k: materialize(rows.filter(k.lower()).select("row"), f"fails_{k}") for k in "ABCDE"}


def cells(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``(part, failed, docs, good, toxic)``: documents by the set of filters they fail, bit k for the k-th filter.

    Every id table splits the rows once, by a left-semi join into those it removes and by a left-anti join into those that
    survive it. A prefix's survivors are the rows outside all its tables, so all prefixes of all orders are sums of cells.
    """
    left = rows.withColumn("failed", F.lit(0))
    for k, ids in enumerate(failing.values()):
        removed = left.join(ids, "row", "left_semi").withColumn("failed", F.col("failed") + (1 << k))
        left = materialize(removed.unionByName(left.join(ids, "row", "left_anti")), "split")
    total = [F.count("*").alias("docs"), *(F.count_if(c).alias(c) for c in ("good", "toxic"))]
    return materialize(left.groupBy("part", "failed").agg(*total), "cells")


def audit(rows: DataFrame, failing: dict[str, DataFrame], orders: list[str] | None = None) -> DataFrame:
    """What each filter of each order does, by part: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, zeros included.

    ``rows`` has a unique ``row``, ``part`` and the booleans ``good`` and ``toxic``; ``failing`` has for each filter, named
    by one letter, the table of the rows that fail it (each row once). ``orders`` are all permutations of the names unless
    given; a filter's ``shapley`` is its removals summed over all permutations in any case.
    """
    names = list(failing)
    n, bit = len(names), {name: 1 << k for k, name in enumerate(names)}
    ways = [(before, b) for before in range(1 << n) for b in bit.values() if not before & b]
    failed, before, own = F.col("failed"), F.col("way.before"), F.col("way.own")
    found = cells(rows, failing)
    met = found.withColumn("way", F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(b).alias("own")) for s, b in ways))))
    fails, survives = failed.bitwiseAND(own) > 0, failed.bitwiseAND(before) == 0

    def total(which, what="docs"):
        return F.sum(F.when(which, F.col(what)).otherwise(0)).cast("long")

    sums = met.groupBy("part", before.alias("before"), own.alias("own")).agg(
        total(survives & ~fails).alias("kept"),
        total(survives & fails).alias("removed"),
        total(fails & ~survives).alias("redundant"),
        total(failed == own).alias("unique_fails"),
        total(survives & fails, "good").alias("good_lost"),
        total(survives & fails, "toxic").alias("toxic_lost"),
    )
    sums = materialize(sums, "sums")
    weight = reduce(
        lambda c, k: c.when(F.bit_count("before") == k, F.lit(factorial(k) * factorial(n - 1 - k))), range(1, n), F.when(F.bit_count("before") == 0, F.lit(factorial(n - 1)))
    )
    shapley = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    orders = ["".join(p) for p in permutations(names)] if orders is None else orders
    steps = [(o, k + 1, sum(bit[x] for x in o[:k]), bit[o[k]]) for o in orders for k in range(len(o))]
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    return sums.join(shapley, ["part", "own"]).join(steps, ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
