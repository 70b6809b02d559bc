"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import meet_in_blocks
from .components import connected_components
from .storage import materialize
from .wordhash import U, hash_words, mix, shingles
from .worker import begin_task, texts

BANDS, ROWS = 28, 5
LEADER_ROUNDS = 2
#: Documents of a bucket that meet in one task, of each side, and columns of their items that are compared at once.
BLOCK_ROWS, COLUMNS = 400, 4096
#: Elements whose permutations are walked at once, and draws from which a permutation is told without a table of it.
STRETCH, TOLD = 1 << 16, 8


def superminhash(h: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m) of element sets given by ``offsets`` (Ertl 2017); an empty set's row holds infinity.

    Every element walks through one random permutation of the m places and, in its step j, offers j + (a fraction)
    to the place drawn. A set stops as soon as no place of it could still fall below j. Elements walk in stretches of
    bounded number: the least offer over stretches is the least over all.
    """
    out = np.full((len(offsets) - 1, m), np.inf)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for lo in range(0, len(h), STRETCH):
        _walk(h[lo : lo + STRETCH], owner[lo : lo + STRETCH], out)
    return out


def _walk(state: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Lowers ``out`` by the offers of these elements; the walks of all sets that still go on are advanced together.

    The permutation after a few draws is told from the draws alone; a table of it is kept for long walks only, which
    the elements of small sets take.
    """
    m, whole = out.shape[1], out.reshape(-1)
    draws: list[np.ndarray] = []
    perm = None
    for j in range(m):
        state = mix(state + U(0x9E3779B97F4A7C15))
        k = j + ((state & U(0xFFFFFFFF)).astype(np.int64) * (m - j) >> 32)
        if perm is None and j == TOLD:
            perm = np.broadcast_to(np.arange(m, dtype=np.int16), (len(state), m)).copy()
            rows = np.arange(len(state))
            for i, drawn in enumerate(draws):
                perm[rows, drawn] = perm[:, i]
        if perm is None:
            place = k
            for i in range(j - 1, -1, -1):  # place i was moved to where draw i came from
                place = np.where(draws[i] == place, i, place)
            draws.append(k)
        else:
            rows = np.arange(len(state))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        value = j + (state >> U(33)).astype(np.float64) * 2.0**-31
        np.minimum.at(whole, owner * m + place, value)
        going = (out.max(axis=1) >= j + 1)[owner]
        if not going.any():
            return
        if not going.all():
            owner, state = owner[going], state[going]
            if perm is None:
                draws = [d[going] for d in draws]
            else:
                perm = perm[going]


def _signing(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi, part in texts(batch.column(1)):
                h, off = shingles(*hash_words(part), words)
                sign = superminhash(h, off, bands * rows)
                bits = np.where(np.isinf(sign), 0.0, sign).view(np.uint64)
                key = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    key = mix(key * U(0xD6E8FEB86659FD93) + bits[:, r::rows][:, :bands] + U(r + 1))
                n = np.diff(off)
                two = []
                for seed in (1, 2):
                    s = np.concatenate(([U(0)], np.cumsum(mix(h + U(seed)), dtype=np.uint64)))
                    two.append(mix((s[off[1:]] - s[off[:-1]]) ^ n.astype(np.uint64)).view(np.int64))
                flat = pa.array(key.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        *map(pa.array, two),
                        pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat),
                    ],
                    ["id", "n", "h1", "h2", "keys"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for lo, hi, part in texts(batch.column(1)):
                h, off = shingles(*hash_words(part), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(off), pa.int64()),
                        pa.ListArray.from_arrays(off.astype(np.int32), pa.array(h.view(np.int64))),
                    ],
                    ["id", "n", "items"],
                )

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The sets of b travel to those of a: a row for each pair, so a document that many pairs share is not copied.
    """
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("of_b"))
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("of_a"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return (
        pairs.join(b.hint("merge"), "b")
        .join(a.hint("merge"), "a")
        .filter(100 * both >= percent * (F.col("na") + F.col("nb") - both))
        .select("a", "b")
    )


FACING = "band int, key long, first int, second int, id long, n long, component long, piece int, keys array<long>"


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = pa.concat_arrays(column.chunks)
    return whole.flatten().to_numpy(), np.concatenate(([0], np.cumsum(whole.value_lengths().to_numpy())))


def _open_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both stretches of a block, and which of them must be compared: documents of different components
    whose sizes allow a link and whose first common band is this one."""
    component, n, piece = (table.column(c).to_numpy() for c in ("component", "n", "piece"))
    band, first, second = (table.column(c)[0].as_py() for c in ("band", "first", "second"))
    keys = _flat(table.column("keys"))[0].reshape(len(n), -1)
    left, right = np.flatnonzero(piece == first), np.flatnonzero(piece == second)
    less, more = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    open_ = (component[left][:, None] != component[right]) & (100 * less >= percent * more)
    for earlier in range(band):
        open_ &= keys[left, earlier][:, None] != keys[right, earlier]
    return left, right, open_


def _facing(percent: int):
    def run(table: pa.Table) -> pa.Table:
        left, right, open_ = _open_pairs(table, percent)
        rows = np.union1d(left[open_.any(axis=1)], right[open_.any(axis=0)])
        return table.take(pa.array(rows)).select(["band", "key", "first", "second", "id", "n", "component", "piece", "keys"])

    return run


def _link_block(percent: int):
    """Links between components of one bucket: a link for each two components, if any of their documents allow it."""

    def run(table: pa.Table) -> pa.Table:
        left, right, open_ = _open_pairs(table, percent)
        component, n = table.column("component").to_numpy(), table.column("n").to_numpy()
        items, off = _flat(table.column("items"))
        # items that only one document has are in no intersection; the others become columns of 0 and 1
        owner = np.repeat(np.arange(len(n)), np.diff(off))
        _, column, times = np.unique(items, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        place = np.cumsum(times > 1) - 1
        owner, column = owner[shared], place[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            s = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
            dense = np.zeros((len(n), COLUMNS), np.float32)
            dense[owner[s], column[s] - lo] = 1
            both += dense[left] @ dense[right].T
        union = n[left][:, None] + n[right] - both
        i, k = np.nonzero(open_ & (100 * both >= percent * union))
        pairs = np.unique(np.column_stack((component[left[i]], component[right[k]])), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Documents with equal shingle sets are one node (their smallest id). Nodes that share a band of their signature
    meet in a bucket. In each of a few rounds every node of a bucket is held against one leader of it. In buckets
    that still hold several components all documents then meet, in blocks that compare full sets and give one link
    for each two components; so no link within a bucket is left out and no list of all pairs is made. Links are
    confirmed on full sets.

    Null or blank texts have an empty set and link with nothing. A null id stays, as a component of its own
    (``component_id`` null, kept). Rows that repeat an id are documents of their own with that id. Other columns of
    the input are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        source.mapInArrow(_signing(words, bands, rows), "id long, n long, h1 long, h2 long, keys array<long>"),
        "signed",
    )
    usable = signed.filter("n > 0 and id is not null")
    # band keys of equal sets are equal, so any of them will do
    nodes = materialize(
        usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.any_value("keys").alias("keys")), "nodes"
    )
    spots = nodes.select("id", "n", F.posexplode("keys").alias("band", "key"))
    crowded = spots.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = materialize(crowded, "crowded")  # with plain exchanges on both sides a full bucket can be split
    # a node whose buckets are full is central: of a group of copies, the one with the fewest edits of its own
    central = F.sum("size").over(Window.partitionBy("id")).alias("central")
    spots = materialize(spots.join(crowded, ["band", "key"]).select("band", "key", "id", "n", central), "spots")
    # ids grow with the input, so they are never broadcast: one plan at every size
    wanted = spots.select("id").distinct().hint("merge")
    sets = materialize(
        source.join(wanted, "id").mapInArrow(_sets(words), "id long, n long, items array<long>"),
        "sets",
    )
    links, labels = None, None

    def held() -> DataFrame:
        if labels is None:
            return spots.withColumn("component", F.col("id"))
        known = spots.join(labels.withColumnRenamed("node", "id"), "id", "left")
        return known.withColumn("component", F.coalesce("component", "id"))

    def split(lead: Column) -> DataFrame:
        """The buckets that hold several components, and a leader of each: the row with the least ``lead``."""
        ends = F.min("component").alias("lo"), F.max("component").alias("hi")
        top = F.min(F.struct(lead.alias("lead"), "id", "n", "component")).alias("top")
        return materialize(held().groupBy("band", "key").agg(*ends, top).filter("lo < hi").drop("lo", "hi"), "split")

    for step in range(LEADER_ROUNDS):
        led = split(F.xxhash64("id", F.lit(step)) if step else -F.col("central"))
        met = held().join(led, ["band", "key"]).filter("component <> top.component")
        pairs = materialize(
            met.filter(100 * F.least("n", "top.n") >= percent * F.greatest("n", "top.n"))
            .select(F.greatest("id", "top.id").alias("b"), F.least("id", "top.id").alias("a"))
            .distinct(),
            "pairs",
        )
        new = materialize(verify(pairs, sets, percent), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = connected_components(links)
    rest = held().join(split(F.col("id")).select("band", "key"), ["band", "key"]).drop("central")
    rest = materialize(rest.join(nodes.select("id", "keys"), "id"), "rest")
    block = ["band", "key", "first", "second"]
    dealt = meet_in_blocks(rest, ["band", "key"], BLOCK_ROWS)
    # only documents that have someone left to meet travel with their sets
    facing = materialize(dealt.groupBy(*block).applyInArrow(_facing(percent), FACING), "facing")
    joined = materialize(
        facing.join(sets.select("id", "items"), "id").groupBy(*block).applyInArrow(_link_block(percent), "a long, b long"),
        "joined",
    )
    if not joined.isEmpty():
        links = joined if links is None else links.unionByName(joined)
        labels = connected_components(links)
    out = signed.join(nodes.select("h1", "h2", "n", F.col("id").alias("node")), ["h1", "h2", "n"], "left")
    if labels is not None:
        out = out.join(labels, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
