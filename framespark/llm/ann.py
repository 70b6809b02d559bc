"""Nearest neighbours by inner product: inverted lists, scanned with early abandoning on rotated vectors.

Vectors get one more component, which makes their norms equal; then the largest inner product is the smallest
distance. They are rotated at random, so that the squared distance over the first t of D components, times D / t, is
a good estimate of the whole. In every probed list the components are read in blocks of columns; after each block
a candidate whose estimate is over the query's bound by more than chance allows is abandoned. What is left is scored
exactly on the original vectors. All answers come from the lists; a sample of the rows gives first bounds alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .vectors import lists, matrix, rotation
from .worker import begin_task

#: Rows that lists and probes are fitted on, about, and rows of those that give queries their first bounds.
SAMPLE, BOUND_ROWS = 20_000, 4_096
#: Lists number about the square root of the rows: up to FIRST centroids, each with up to SECOND shared offsets.
FIRST, SECOND = 512, 128
#: The recall on the sample for which the number of probed lists is chosen.
TARGET_RECALL = 0.985
#: Vectors of a list that meet its queries at once, and queries that are held against them at once.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 256
COLUMNS = 16
#: Of the test: a candidate is abandoned if its estimate exceeds the bound by a factor of (1 + EPSILON / sqrt(t))**2.
EPSILON = 2.1
#: Vectors that are met so often that a task remembers their smallest ids.
OFTEN = 10_000


@dataclass
class Index:
    dim: int
    turn: np.ndarray
    top: float  # the largest squared norm
    first: np.ndarray  # centroids of turned vectors
    second: np.ndarray  # offsets from them
    probes: int
    bound_rows: np.ndarray
    bound_ids: np.ndarray
    bound_lists: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.first) * len(self.second)

    def turned(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))
        return np.column_stack((x, rest)) @ self.turn

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q)))) @ self.turn

    def assign(self, y: np.ndarray) -> np.ndarray:
        """The list of each turned vector: the nearest centroid, then the nearest offset from it."""
        a = _nearest(y, self.first)
        return a * len(self.second) + _nearest(y - self.first[a], self.second)

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Squared distances of turned vectors to all lists, less what is the same for all of them."""
        cross = 2 * (self.first @ self.second.T)
        own = (self.first**2).sum(axis=1)[:, None] + (self.second**2).sum(axis=1) + cross
        far = -2 * (y @ self.first.T)[:, :, None] - 2 * (y @ self.second.T)[:, None, :]
        return (far + own).reshape(len(y), -1)


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (y @ c.T), axis=1)


def _kmeans(y: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = y[np.random.default_rng(3).choice(len(y), min(k, len(y)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(y, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, y)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE) -> Index | None:
    """Fits rotation, lists and the number of probes on about ``sample_rows`` rows drawn by a hash of the id.

    None where no row can take part.
    """
    lengths = vectors.filter(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), "dim").first()
    if common is None:
        return None
    dim, n = common["dim"], common["count"]

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        top = 0.0
        for batch in batches:
            x, _ = matrix(batch.column(0), dim)
            top = max(top, float((x * x).sum(axis=1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

    top = vectors.select(vec_col).mapInArrow(norms, "top double").agg(F.max("top")).first()[0]
    share = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < F.lit(min(1 << 30, int(sample_rows / n * (1 << 30)) + 1))
    got = vectors.filter(share).select(F.col(id_col).cast("long"), vec_col).limit(2 * sample_rows).toArrow()
    sample, places = matrix(pa.concat_arrays(got.column(1).chunks) if got.num_rows else pa.array([], pa.list_(pa.float64())), dim)
    if not len(sample):
        return None
    ids = np.array([-1 if v is None else v for v in got.column(0).to_pylist()], np.int64)[places]
    turn, none = rotation(dim + 1), np.zeros((1, dim + 1))
    index = Index(dim, turn, top, none, none, 1, sample[:BOUND_ROWS], ids[:BOUND_ROWS], np.zeros(0, np.int64))
    y, wanted = index.turned(sample), round(n**0.5)
    index.first = _kmeans(y, max(1, min(FIRST, wanted, len(y) // 8)))
    if wanted > FIRST:
        index.second = _kmeans(y - index.first[_nearest(y, index.first)], min(SECOND, -(-wanted // FIRST)))
    of = index.assign(y)
    index.bound_lists = of[:BOUND_ROWS]
    if index.lists > 1:
        some = np.arange(0, len(sample), max(1, len(sample) // 250))
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-score, min(k, len(sample)) - 1, axis=1)[:, :k]
        rank = np.argsort(np.argsort(index.distances(index.turned_queries(sample[some])), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, of[near], axis=1).reshape(-1))
        index.probes = 1 + int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))])
    return index


def scan(index: Index, x: np.ndarray, y: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int):
    """(query row, vector row, score) of the hits in one block of a list (vectors ``x``, turned ``y``): at most k of each
    query, and none worse than its bound on the score."""
    p = index.turned_queries(q)
    dims = y.shape[1]
    norm = (p * p).sum(axis=1)
    limit = norm + index.top - 2 * bound  # the bound as a squared distance
    b = min(COLUMNS, dims)
    part = (p[:, :b] ** 2).sum(axis=1)[:, None] + (y[:, :b] ** 2).sum(axis=1) - 2 * (p[:, :b] @ y[:, :b].T)
    np.maximum(part, 0.0, out=part)
    own = ids[None, :] == q_ids[:, None]
    part[own] = np.inf
    if len(x) > k:  # the k that look best so far give a bound of their own
        best = np.argpartition(part, k - 1, axis=1)[:, :k]
        exact = np.einsum("qd,qkd->qk", q, x[best])
        exact[np.take_along_axis(own, best, axis=1)] = -np.inf
        limit = np.minimum(limit, norm + index.top - 2 * exact.min(axis=1))
    limit = limit * (1 + 1e-12) + 1e-12
    keep = ~own & (part <= (limit * (b / dims) * (1 + EPSILON / np.sqrt(b)) ** 2)[:, None])
    qi, vi = np.nonzero(keep)
    part = part[qi, vi]
    while b < dims and len(qi):
        e = min(b + COLUMNS, dims)
        part = part + ((p[qi, b:e] - y[vi, b:e]) ** 2).sum(axis=1)
        b = e
        slack = (1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else 1.0
        keep = part <= limit[qi] * (b / dims) * slack + 1e-9
        qi, vi, part = qi[keep], vi[keep], part[keep]
    score = (q[qi] * x[vi]).sum(axis=1)
    order = np.lexsort((ids[vi], -score, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    first = np.searchsorted(qi, qi, "left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], vi[keep], score[keep]


def _few_of_each(x: np.ndarray, ids: np.ndarray, most: int, often: dict[bytes, list[int]]) -> np.ndarray:
    """Which rows to keep: of equal vectors, those that are not beyond the ``most`` smallest ids this task has met.

    Equal vectors have equal scores and ties go to smaller ids, so others are in no result.
    """
    _, group, size = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True, return_counts=True)
    keep = np.ones(len(x), bool)
    for g in np.flatnonzero(size >= most):
        rows = np.flatnonzero(group == g)
        name = (x[rows[0]] + 0.0).tobytes()
        before = often.get(name, [])
        least = np.sort(np.concatenate((np.array(before, np.int64), ids[rows])), kind="stable")[:most]
        keep[rows] = ids[rows] <= least[-1]
        if name in often or len(often) < OFTEN:
            often[name] = least.tolist()
    return keep


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    index: Index | None = None,
) -> DataFrame:
    """The k nearest found of every query: ``query_id, rank, vec_id, score``, best first, ties to the smaller id.

    Vectors that are null, zero, of an uncommon length, or hold null or non-finite components take no part, nor do
    rows with a null id. A query is never near rows with its own id. Rows of ``vectors`` that repeat an id are candidates
    of their own; rows of ``queries`` that repeat an id are answered each by itself under that id. Other columns are
    ignored; no rows give no rows.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    queries = queries.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    )
    vectors, queries = vectors.filter("id is not null"), queries.filter("id is not null")
    index = index or fit(vectors, k, "id", "v")
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = index.dim

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        often: dict[bytes, list[int]] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x, places = matrix(batch.column(1), dim)
                if not len(x):
                    continue
                ids = batch.column(0).to_numpy()[places]
                keep = _few_of_each(x, ids, k + 1, often)
                x, ids = x[keep], ids[keep]
                of = index.assign(index.turned(x))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(ids), lists(x)], ["list", "id", "v"])

    placed = materialize(vectors.mapInArrow(assign, "list int, id long, v array<double>"), "lists")
    sizes = np.zeros(index.lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query for every block of the lists it probes: the nearest that hold over k rows, and ``probes`` at least."""
        begin_task()
        step = max(1, min(256, (1 << 21) // index.lists))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                q, places = matrix(part.column(2), dim)
                if not len(q):
                    continue
                rows, q_ids = part.column(0).to_numpy()[places], part.column(1).to_numpy()[places]
                order = np.argsort(index.distances(index.turned_queries(q)), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                enough = np.where(held[:, -1] > k, np.argmax(held > k, axis=1) + 1, index.lists)
                near = np.arange(index.lists) < np.maximum(enough, index.probes)[:, None]
                which, query = order[near], np.nonzero(near)[0]
                probed = np.zeros((len(q), index.lists), bool)
                probed[query, which] = True
                score = np.where(probed[:, index.bound_lists], q @ index.bound_rows.T, -np.inf)
                score[index.bound_ids[None, :] == q_ids[:, None]] = -np.inf
                # over k rows of the probed lists are at least this near: some may be abandoned, and k are still found
                rank = k + k // 2
                bound = np.partition(score, -rank, axis=1)[:, -rank] - 1e-9 if score.shape[1] >= rank else np.full(len(q), -np.inf)
                which, query = which[sizes[which] > 0], query[sizes[which] > 0]
                times = blocks[which]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                which, query = np.repeat(which, times), np.repeat(query, times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(which, pa.int32()), pa.array(block, pa.int32()), pa.array(np.ones(len(which), np.int32)),
                        pa.array(q_ids[query]), lists(q[query]), pa.array(rows[query]), pa.array(bound[query]),
                    ],
                    ["list", "block", "side", "id", "v", "row", "bound"],
                )

    asked = queries.mapInArrow(probe, "list int, block int, side int, id long, v array<double>, row long, bound double")
    counts = placed.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(blocks) if sizes[i]], "list int, blocks int")
    held = placed.join(F.broadcast(counts), "list").select(  # a row for each list: their number is bounded
        "list",
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.lit(0).alias("side"),
        "id",
        "v",
        F.lit(None).cast("long").alias("row"),
        F.lit(None).cast("double").alias("bound"),
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by list, block and side: a block's vectors, which are held, and then its queries, however many."""
        begin_task()
        key, x, ids, y = None, np.zeros((0, dim)), np.zeros(0, np.int64), None
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_QUERIES):
                batch = whole.slice(lo, BLOCK_QUERIES)
                lists_, blocks_, sides = (batch.column(c).to_numpy() for c in range(3))
                v = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, dim)
                name = (lists_.astype(np.int64) << 32) + blocks_
                cut = np.flatnonzero((np.diff(name) != 0) | (np.diff(sides) != 0)) + 1
                for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [batch.num_rows])), strict=True):
                    if name[a] != key:
                        key, x, ids = name[a], np.zeros((0, dim)), np.zeros(0, np.int64)
                    own = batch.column(3).slice(a, b - a).to_numpy()
                    if sides[a] == 0:
                        x, ids, y = np.concatenate((x, v[a:b])), np.concatenate((ids, own)), None
                        continue
                    if not len(x):
                        continue
                    y = index.turned(x) if y is None else y
                    rows, bound = (batch.column(c).slice(a, b - a).to_numpy() for c in (5, 6))
                    qi, vi, score = scan(index, x, y, ids, v[a:b], own, bound, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[qi]), pa.array(own[qi]), pa.array(ids[vi]), pa.array(score)], ["row", "query_id", "vec_id", "score"]
                    )

    # each vector is moved once; hot lists are many blocks of bounded size
    dealt = held.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "side")
    hits = dealt.mapInArrow(meet, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
