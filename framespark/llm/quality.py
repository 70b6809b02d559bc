"""Quality selection by importance resampling of hashed n-grams.

Two bag-of-n-grams models over hash buckets are counted: one of the target text (documents labelled good) and one
of all raw text. A document's weight is the log ratio of its likelihoods; documents are drawn without replacement by
the Gumbel top-k rule, that is, the k largest of log weight plus Gumbel noise. Log weights are taken per n-gram and
multiplied by one strength for all documents: sums over whole texts would rank documents by their length above all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .wordhash import U, hash_words, mix
from .worker import begin_task, texts

BUCKETS = 1 << 14
#: A pseudo-count for each bucket, so that n-grams never seen in the target get no infinite weight.
SMOOTHING = 1.0
#: The length of the passage whose likelihood ratio is a document's weight: the log weight per n-gram times this many.
#: Plain importance resampling takes the whole document's (several hundred n-grams), so noise counts for more here.
STRENGTH = 200.0
#: N-grams of weight 0 added to every document: a few words say little for or against a text.
PRIOR = 20


def bucketed(raw: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of each text, and the text each belongs to."""
    words, off = hash_words(raw)
    n = np.diff(off)
    owner = np.repeat(np.arange(len(raw)), n)
    pair = owner[1:] == owner[:-1]
    twos = mix(words[:-1][pair] * U(0xD6E8FEB86659FD93) + words[1:][pair])
    all_h = np.concatenate((words, twos)) % U(buckets)
    return all_h.astype(np.int64), np.concatenate((owner, owner[1:][pair]))


def ngram_models(docs: DataFrame, target: str, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Counts (2 x buckets) over all documents: of raw text, and of rows whose column ``target`` is true.

    Every task adds up its own documents, so at most tasks x buckets rows are shuffled and ``buckets`` come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, part in texts(batch.column(0)):
                b, owner = bucketed(part, buckets)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[good[lo:hi][owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]])], ["raw", "target"])

    rows = docs.select(F.col(text_col).cast("string"), F.col(target).cast("boolean")).mapInArrow(
        run, "raw array<long>, target array<long>"
    )
    # one array per task; they meet in a few partial sums
    flat = rows.select(F.posexplode(F.arrays_zip("raw", "target")).alias("bucket", "c"))
    summed = flat.groupBy("bucket").agg(F.sum("c.raw").alias("raw"), F.sum("c.target").alias("target"))
    out = np.zeros((2, buckets), np.int64)
    for r in summed.filter("raw > 0").collect():
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p = counts + smoothing
    p = p / p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weights_of(raw: list[bytes], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams, log weight) of each text."""
    b, owner = bucketed(raw, len(ratios))
    return np.bincount(owner, minlength=len(raw)), np.bincount(owner, ratios[b], len(raw)).astype(np.float64)


def gumbel_noise(id_col: str, text_col: str, seed: int | Column) -> Column:
    """Gumbel noise as a function of id, text and seed: a task that runs again draws the same."""
    draw = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(seed))
    uniform = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)
    return (-F.log(-F.log(uniform))).alias("noise")


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``id_col, noise, n_grams, log_weight``, a row per document, of whole texts.

    Null and empty texts have no n-grams and weight 0; null and repeated ids are carried along. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi, part in texts(batch.column(1)):
                n, weight = weights_of(part, ratios)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in (0, 2)), pa.array(n, pa.int64()), pa.array(weight)],
                    [id_col, "noise", "n_grams", "log_weight"],
                )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), gumbel_noise(id_col, text_col, seed))
    return source.mapInArrow(run, f"{id_col} long, noise double, n_grams long, log_weight double")


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value of a column, by histograms of an ever smaller interval: no global sort."""
    lo, hi, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while True:
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            return hi
        inside = scores.filter(F.col(column).between(lo, hi))
        which = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("bin")
        rows = inside.groupBy(which).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for r in sorted(rows.collect(), key=lambda r: -r["bin"]):  # at most a row per bin
            if k <= r["n"]:
                break
            k -= r["n"]
        if k == 1:
            return r["b"]
        if r["a"] == r["b"]:
            return r["a"]
        lo, hi = r["a"], r["b"]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``good``: true or false by the documents' labels (any good label counts), null without one."""
    marks = labels.filter(f"{id_col} is not null and quality is not null").groupBy(F.col(id_col).alias("label_of")).agg(
        (F.max("quality") == 1).alias("good")
    )
    # labels grow with the documents: never broadcast
    return docs.drop("good").join(marks.hint("merge"), docs[id_col] == F.col("label_of"), "left").drop("label_of")


def _scored(docs, labels, k, id_col, text_col, buckets, seed, strength) -> tuple[DataFrame, float, np.ndarray]:
    """Scores of all documents, the k-th largest of them, and the log ratios."""
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    marked = labelled(source, labels, id_col)
    counts = ngram_models(marked, "good", text_col, buckets)
    ratios = log_ratios(counts) if counts[1].any() else np.zeros(buckets)
    weights = weigh(source, ratios, id_col, text_col, seed)
    weights = weights.withColumn("per_gram", F.col("log_weight") / (F.col("n_grams") + PRIOR))
    scored = materialize(weights.withColumn("gumbel_score", strength * F.col("per_gram") + F.col("noise")), "weights")
    if k is None:
        margin = best_margin(scored, labels, id_col)
        k = scored.filter(F.col("per_gram") >= -margin).count()
    return scored, kth_largest(scored, "gumbel_score", k), ratios


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    seed: int = 0,
    strength: float = STRENGTH,
) -> DataFrame:
    """One row per document: ``id_col, n_grams, log_weight, gumbel_score, kept``.

    ``k`` documents are kept, those with the largest ``gumbel_score``; ties at the k-th place are all kept. By
    default k is the number of documents that the target model explains about as well as the raw one: the log
    weight per n-gram is not under minus the margin that best parts good labels from bad ones. Null and empty texts
    have weight 0. Without any good label the two models agree, all weights are 0 and all documents are kept. A null
    id is weighed like any other. Rows that repeat an id share its label; equal rows have equal scores. Other columns
    are ignored; no rows give no rows.
    """
    scored, bar, _ = _scored(docs, labels, k, id_col, text_col, buckets, seed, strength)
    return scored.select(id_col, "n_grams", "log_weight", "gumbel_score", (F.col("gumbel_score") >= bar).alias("kept"))


def keep_drawn(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    seed: int = 0,
    strength: float = STRENGTH,
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``resample`` keeps; null and repeated ids, null texts and ties as there.

    The score depends on id, text and models alone, so rows are weighed again as they are read: no join of texts.
    """
    _, bar, ratios = _scored(docs, labels, k, id_col, text_col, buckets, seed, strength)
    at, names = docs.columns.index(text_col), docs.columns
    drawn = "noise"
    while drawn in names:
        drawn += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi, part in texts(batch.column(at)):
                n, weight = weights_of(part, ratios)
                rows = batch.slice(lo, hi - lo)
                noise = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False)
                kept = rows.filter(pa.array(strength * (weight / (n + PRIOR)) + noise >= bar))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names)

    return docs.select("*", gumbel_noise(id_col, text_col, seed).alias(drawn)).mapInArrow(run, docs.schema)


#: How much losing the good documents counts against keeping the bad ones when the margin is chosen.
KEEP_GOOD = 4


def best_margin(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", bins: int = 400) -> float:
    """The margin per n-gram, in hundredths from 0 to 4, that best parts good labels from bad ones."""
    marked = labelled(scored.filter("n_grams > 0"), labels, id_col).filter("good is not null")
    step = F.greatest(F.lit(0), F.least(F.lit(bins), F.ceil(-100 * F.col("per_gram"))))
    rows = marked.groupBy(step.alias("step"), "good").agg(F.count("*").alias("n")).collect()
    at = np.zeros((2, bins + 1))
    for r in rows:
        at[int(r["good"]), r["step"]] += r["n"]
    if not at.sum(axis=1).all():
        return bins / 100
    share = np.cumsum(at, axis=1) / at.sum(axis=1, keepdims=True)  # kept, of bad and of good
    gain = KEEP_GOOD * share[1] - share[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / 100
