"""Language identification by the nearest of several centroids per language.

A text is a vector of its byte n-grams (lengths 1 to 3 over lower-cased letters, with single spaces between words),
hashed to a fixed number of places, weighted by (1 + log count) times inverse document frequency and normalised.
Every language has a few centroids, clustered by cosine; the nearest one names the language. A text is rejected if its
cosine is below nearly all that texts of that language, with about as many n-grams, have when held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import begin_task, stretches

DIMS = 4096
#: Labelled texts of each language that its centroids are fitted on, about: the bound of the training sample.
PER_LANGUAGE = 400
CENTROIDS = 4
#: A text is rejected below this quantile of the cosines of held-out texts of its nearest language and either level.
REJECT_QUANTILE = 0.005
#: Levels are half octaves, one of the number of different n-grams and one of all (few of them differ where words are
#: repeated). A level with fewer held-out texts takes in those around it.
LEVELS = 64
LEAST_HELD_OUT = 100
#: Lengths at which held-out texts are cut, besides being judged whole, so that short texts have examples too.
CUTS = tuple(1 << k for k in range(2, 14))
#: Bytes of text counted at once, about, and texts.
STRETCH, ROWS = 1 << 20, 256

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def counts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """N-gram counts, a row for each text."""
    out = np.zeros((len(texts), dims), np.float32)
    raw = [t.lower().encode() for t in texts]
    parts, owner = [], []
    for i, t in enumerate(raw):
        lo = 0
        while True:  # a long text is counted in stretches that end at spaces
            hi = len(t)
            if hi - lo > STRETCH:
                hi = t.rfind(b" ", lo + 1, lo + STRETCH)
                hi = hi if hi > lo else lo + STRETCH
            parts.append(t[lo:hi])
            owner.append(i)
            lo = hi
            if lo >= len(t):
                break
    lo, size = 0, 0
    for hi in range(1, len(parts) + 1):
        size += len(parts[hi - 1])
        if size >= STRETCH or hi == len(parts):
            np.add.at(out, owner[lo:hi], _counted(parts[lo:hi], dims))
            lo, size = hi, 0
    return out


def _counted(raw: list[bytes], dims: int) -> np.ndarray:
    data = _CLASS[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    owner = np.repeat(np.arange(len(raw)), np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw)))
    owner = np.concatenate(([0], owner))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data, base = data[keep].astype(np.uint32), owner[keep].astype(np.int64) * dims
    two = (data[:-1] << np.uint32(8)) | data[1:]
    three = (two[:-1] << np.uint32(8)) | data[2:]
    total = np.zeros(len(raw) * dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for n, code in enumerate((data, two, three), 1):
        place = (code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> shift
        at = base[n - 1 :] + place
        total += np.bincount(at[code != 32] if n == 1 else at, minlength=len(total))
    return total.reshape(len(raw), dims)


def measured(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector and the two levels of each text."""
    x = counts(texts, len(idf))
    size = np.maximum(np.stack([np.count_nonzero(x, axis=1), x.sum(axis=1)], axis=1), 1)
    levels = np.minimum((2 * np.log2(size)).astype(np.int64), LEVELS - 1)
    np.log1p(x, out=x)  # log(1 + count) rises from 0 as 1 + log(count) does, without a jump
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12), levels


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return measured(texts, idf)[0]


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer centroids where there are fewer rows."""
    centroids = x.mean(axis=0, keepdims=True)
    first = [int(np.argmax(x @ centroids[0]))]
    near = x @ x[first[0]]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
    return c


def held_out_bars(texts: list[str], x: np.ndarray, idf: np.ndarray, k: int) -> np.ndarray | None:
    """The cosine below which a text is rejected, a row for each kind of level: each half of ``texts`` (vectors ``x``)
    is held against centroids of the other half, whole and cut. None where nothing can be held out."""
    if len(texts) < 2:
        return None
    folds = [np.arange(h, len(texts), 2) for h in (0, 1)]
    against = [cluster(x[folds[1 - h]], k) for h in (0, 1)]
    seen = np.full((2, len(texts), LEVELS), np.nan)  # one value of a text in each level, that of its longest cut
    for cut in (*CUTS, None):
        for h in (0, 1):
            for lo in range(0, len(folds[h]), 256):
                at = folds[h][lo : lo + 256]
                at = at[[cut is None or len(texts[i]) > cut and any(c.isalpha() for c in texts[i][:cut]) for i in at]]
                v, level = measured([texts[i][:cut] for i in at], idf)
                for kind in (0, 1):
                    seen[kind, at, level[:, kind]] = (v @ against[h].T).max(axis=1)
    bars = np.zeros((2, LEVELS))
    for kind, level in np.ndindex(bars.shape):
        for reach in range(LEVELS):
            near = seen[kind][:, max(0, level - reach) : level + reach + 1]
            near = near[~np.isnan(near)]
            if len(near) >= LEAST_HELD_OUT or reach == LEVELS - 1:
                bars[kind, level] = np.quantile(near, REJECT_QUANTILE)
                break
    return bars


@dataclass
class LanguageModel:
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # centroids x 2 x LEVELS

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, bar that the cosine should reach) of each text."""
        x, level = measured(texts, self.idf)
        cosine = x @ self.centroids.T
        at = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(at)), at].astype(np.float64), 0.0, 1.0)
        return at, score, self.reject_below[at[:, None], [0, 1], level].max(axis=1)

    def judge(self, texts: list[str | None], lettered: list[bool]) -> tuple[list[str], np.ndarray, list[bool]]:
        """(language, cosine, rejected) of each text; ``lettered`` says which hold a letter."""
        lang, score, bar = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        at = [i for i, x in enumerate(lettered) if x and self.languages]
        if at:
            which, score[at], bar[at] = self.nearest([texts[i] for i in at])
            for i, w in zip(at, which.tolist(), strict=True):
                lang[i] = self.languages[w]
        return lang, score, [n == "und" or low for n, low in zip(lang, (score < bar).tolist(), strict=True)]


def fit(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    k: int = CENTROIDS,
    dims: int = DIMS,
) -> LanguageModel:
    """Learns from labelled texts; rows without a text or language, or without a letter, teach nothing.

    Document frequencies are counted over all of ``train``; centroids are fitted, one task a language, on about
    ``per_language`` of its texts (at most twice as many) drawn by a hash of id and text. The same texts, held out by
    halves, set the bars of rejection.
    """
    rows = (
        train.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .filter("lang is not null and text is not null")
        .filter(F.col("text").rlike(r"\p{L}"))
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for lo, hi in stretches(batch.column(0), STRETCH, ROWS):
                texts = batch.column(0).slice(lo, hi - lo).to_pylist()
                df += (counts(texts, dims) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df])], ["n", "df"])

    per_task = rows.select("text").mapInArrow(frequencies, "n long, df array<long>")
    places = per_task.select("n", F.posexplode("df").alias("place", "df"))
    summed = places.groupBy("place").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()  # a row per place
    df, n = np.zeros(dims), 0
    for r in summed:
        df[r["place"]], n = r["df"], r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").filter(draw * F.col("size") < per_language)  # a row per language

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"]).head(2 * per_language)
        x = vectors(pdf["text"].tolist(), idf)
        c = cluster(x, k)
        bars = held_out_bars(pdf["text"].tolist(), x, idf, k)
        bars = None if bars is None else bars.ravel().tolist()
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "v": [v.tolist() for v in c], "bars": [bars] * len(c)})

    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, k int, v array<float>, bars array<double>")
    got = sorted(found.collect(), key=lambda r: (r["lang"], r["k"]))  # languages x k rows
    known = [r["bars"] for r in got if r["bars"]]
    lowest = np.min(known, axis=0) if known else np.zeros(2 * LEVELS)  # for a language of one text
    return LanguageModel(
        [r["lang"] for r in got],
        np.array([r["v"] for r in got], np.float32).reshape(-1, dims),
        idf,
        np.array([r["bars"] or lowest for r in got]).reshape(-1, 2, LEVELS),
    )


def predict(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col, lang_pred, score, rejected``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 and rejected if the text is null or has no letter or
    nothing was learned. ``score`` is the cosine to the nearest centroid; a text below the bars of its language and
    levels is marked rejected and keeps its nearest language. Ties go to the language first in order. Whole texts are
    compared. Null and repeated ids are carried along row by row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi in stretches(batch.column(1), STRETCH, ROWS):
                part = batch.slice(lo, hi - lo)
                lang, score, reject = model.judge(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang), pa.array(score), pa.array(reject)],
                    [id_col, "lang_pred", "score", "rejected"],
                )

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long"), text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return source.mapInArrow(run, f"{id_col} long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``predict`` would not reject: null texts and those without a letter go,
    equal texts go or stay together, ids do not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi in stretches(batch.column(at), STRETCH, ROWS):
                part = batch.slice(lo, hi - lo)
                texts, lettered = (part.column(k).to_pylist() for k in (at, part.num_columns - 1))
                _, _, reject = model.judge(texts, lettered)
                kept = part.filter(pa.array([not r for r in reject]))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names)

    at, names = docs.columns.index(text_col), docs.columns
    marked = docs.select("*", F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, docs.schema)
