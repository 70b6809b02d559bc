"""Frequent phrases and how strongly they hold together, from suffix subtrees built group by group.

Every word of a text begins a suffix, cut after ``max_words`` words. Suffixes are dealt out by prefix: one word, or more
where a prefix is so frequent that its suffixes would fill a group. Prefixes are packed into groups by a memory budget;
each group's subtree is built on its own, and the counts of all its phrases are sums of the leaves below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from .storage import materialize
from .worker import stretches
from .wordhash import mix

#: Suffixes in a group, about, and least number of groups on large tables.
GROUP, GROUPS = 2_000_000, 32
#: Suffixes that a task turns to arrays at once, and different words it remembers meanwhile.
TOKENS, WORDS = 3_000_000, 500_000
#: Prefixes too frequent for a group are broadcast: at most so many, as the budget grows with the table beyond that.
MAX_FREQUENT = 1 << 20
#: Largest bitmap of words that may be frequent, in bits (16 MB), which is broadcast.
MAX_BITS = 1 << 27
#: Texts longer than this are cut into words stretch by stretch.
STRETCH = 1 << 20

#: A-Z become a-z; every byte that ends a piece becomes a full stop.
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), b"." * 10 + bytes(range(97, 123)))
U = np.uint64


class _Words(dict):
    """Numbers for the words of one part, from 1 up; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and a full stop for each end of a piece, in stretches cut at white space."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + STRETCH)
        while hi < len(text) and text[hi] not in b" \t\n":
            hi = min((x for x in (text.find(c, hi) for c in (b" ", b"\t", b"\n")) if x >= 0), default=len(text))
        yield text[lo:hi].translate(_FOLD).replace(b".", b" . ").split()
        lo = hi


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(part, its words, their numbers in the order of the texts, each text ended by zeros): about ``TOKENS`` at a time."""
    parts: dict[str, tuple[_Words, list[np.ndarray]]] = {}
    end, held, words = np.zeros(1, np.int32), 0, 0

    def flush():
        for part, (known, arrays) in parts.items():
            yield part, known.words, np.concatenate(arrays)
        parts.clear()

    for batch in batches:
        column, names = batch.column("text"), batch.column("part").to_pylist()
        for lo, hi in stretches(column):
            for part, text in zip(names[lo:hi], column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                if part not in parts:
                    parts[part] = (_Words(), [])
                known, arrays = parts[part]
                before = len(known)
                for tokens in _tokens(text):
                    arrays.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                    held += len(tokens)
                arrays.append(end)
                held, words = held + 1, words + len(known) - before
                if held > TOKENS or words > WORDS:
                    yield from flush()
                    held = words = 0
    yield from flush()


def _hashes(part: str, words: list[bytes]) -> np.ndarray:
    head = part.encode() + b"\t"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def _follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that are one word longer."""
    return mix(h * U(0x9E3779B97F4A7C15) + word)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, words, numbers in _numbered(batches):
        n = np.bincount(numbers, minlength=len(words))[1:]
        h = _hashes(part, words)[1:].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * (len(n) + 1)), pa.array([None, *(w.decode() for w in words[1:])], pa.string()), pa.array(np.append(0, h)), pa.array(np.append(n.sum(), n))],
            names=["part", "phrase", "h", "n"],
        )


class _Plan:
    """What tasks need to deal out suffixes: a bitmap of words that may be frequent, prefixes that must be longer, groups."""

    def __init__(self, frequent_words: np.ndarray, bits: int) -> None:
        self.frequent_words, self.bits = frequent_words, bits
        #: For each part and number of words: {phrase: node}, and for the next word {(node, word): node}.
        self.frequent: dict[str, dict[str, int]] = {}
        self.depth = 0
        self.group_of: np.ndarray | None = None

    def add(self, rows: list) -> None:
        for row in rows:
            nodes = self.frequent.setdefault(row["part"], {})
            nodes[row["phrase"]] = len(nodes) + 1
        self.depth += 1

    def suffixes(self, part: str, words: list[bytes], numbers: np.ndarray, longest: int):
        """Columns of numbers (0 after a suffix's end), each suffix's prefix length and node, and hashes of prefixes."""
        h = _hashes(part, words)
        may = bitmap.marked(self.frequent_words, self.bits, h)
        may[0] = False
        numbers = np.concatenate((np.where(may[numbers], numbers, 0), np.zeros(longest, np.int32)))
        starts = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        columns = [numbers[starts]]
        for k in range(1, longest):
            columns.append(np.where(columns[-1] > 0, numbers[starts + k], 0))
        known, phrases = {w: k for k, w in enumerate(words) if may[k]}, self.frequent.get(part, {})
        by_length: list[list[tuple[int, int, int]]] = [[] for _ in range(longest)]
        for phrase, node in phrases.items():
            *head, last = phrase.split(" ")
            number = known.get(last.encode())
            if number is not None:
                by_length[len(head)].append((phrases[" ".join(head)] if head else 0, number, node))
        size = len(words)
        length, node = np.ones(len(starts), np.uint8), np.zeros(len(starts), np.int64)
        prefix = _follow(np.zeros(len(starts), U), h[columns[0]])
        for k in range(longest - 1):
            if not by_length[k]:
                break
            keys, to = np.array([(p * size + w, x) for p, w, x in by_length[k]], np.int64).T
            order = np.argsort(keys)
            keys, to = keys[order], to[order]
            mine = node * size + columns[k]
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            more = (keys[at] == mine) & (length == k + 1)
            node = np.where(more, to[at], node)
            length[more] += 1
            prefix = np.where(more, _follow(prefix, h[columns[k + 1]]), prefix)
        return columns, length, node, prefix


def _combine(columns: list[np.ndarray], more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes in which equal ones stand together, and where each run begins. ``more`` sorts before."""
    keys, width = [more], int(max(c.max(initial=0) for c in columns)).bit_length()
    at_once = max(1, 63 // max(width, 1))
    for lo in range(0, len(columns), at_once):
        key = np.zeros(len(more), np.int64)
        for c in columns[lo : lo + at_once]:
            key = (key << width) | c
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for x in keys:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def _blocks(plan, longest: int):
    """Suffixes as blocks for their groups, equal ones of a task together: words of the block, then arrays of numbers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, numbers in _numbered(batches):
            columns, length, _, prefix = plan.value.suffixes(part, words, numbers, longest)
            whole = np.ones(len(length), bool)  # a suffix that ends before its prefix does is counted already
            for k in range(1, longest):
                whole &= (columns[k] > 0) | (length <= k)
            columns, length, prefix = [c[whole] for c in columns], length[whole], prefix[whole]
            group = plan.value.group_of[(prefix & U(len(plan.value.group_of) - 1)).astype(np.int64)]
            if not len(group):
                continue
            order, runs = _combine(columns, group)
            counts = np.diff(np.append(runs, len(order))).astype(np.uint32)
            at = order[runs]
            columns, length, group = [c[at] for c in columns], length[at], group[at]
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            spell, local = np.array(words, object), np.zeros(len(words), np.int64)
            for lo, hi in zip(edges[:-1], edges[1:]):
                used = np.zeros(len(words), bool)
                for c in columns:
                    used[c[lo:hi]] = True
                used[0] = True
                found = np.flatnonzero(used)
                local[found] = np.arange(len(found))
                kind = "<u2" if len(found) < 1 << 16 else "<u4"
                data = b"".join(x.tobytes() for x in [*(local[c[lo:hi]].astype(kind) for c in columns), counts[lo:hi].astype("<u4"), length[lo:hi]])
                text = b" ".join(spell[found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(group[lo])]), pa.array([part]), pa.array([hi - lo]), pa.array([len(text)]), pa.array([len(data)])]
                    + [pa.array([pa.compress(x, "zstd", asbytes=True)], pa.binary()) for x in (text, data)],
                    names=["group", "part", "rows", "words_bytes", "data_bytes", "words", "data"],
                )

    return deal


def _subtree(longest: int, least: int):
    """Phrases of a group with at least ``least`` occurrences that are no shorter than their prefix."""

    def count(table: pa.Table) -> pa.Table:
        out: list[tuple[str, str, int, int]] = []
        by_part: dict[str, list[int]] = {}
        for i, part in enumerate(table.column("part").to_pylist()):
            by_part.setdefault(part, []).append(i)
        for part, some in by_part.items():
            known = _Words()
            columns: list[list[np.ndarray]] = [[] for _ in range(longest)]
            counts, lengths = [], []
            for i in some:
                cell = {c: table.column(c)[i].as_py() for c in table.column_names}
                words = pa.decompress(cell["words"], cell["words_bytes"], "zstd", asbytes=True).split(b" ")
                to = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                data, n, at = pa.decompress(cell["data"], cell["data_bytes"], "zstd", asbytes=True), cell["rows"], 0
                kind = np.dtype("<u2" if len(words) < 1 << 16 else "<u4")
                for c in columns:
                    c.append(to[np.frombuffer(data, kind, n, at)])
                    at += n * kind.itemsize
                counts.append(np.frombuffer(data, "<u4", n, at))
                lengths.append(np.frombuffer(data, np.uint8, n, at + 4 * n))
            level = [np.concatenate(c) for c in columns]
            leaves, length, node = np.concatenate(counts).astype(np.int64), np.concatenate(lengths), level[0].astype(np.int64)
            spelled: list[str] = [w.decode() for w in known.words]
            for k in range(1, longest):  # the subtree's nodes of k + 1 words; branches below a rare node are not grown
                has = level[k] > 0
                level, leaves, length, node = [c[has] for c in level], leaves[has], length[has], node[has]
                if not len(node):
                    break
                key = node * len(known) + level[k]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                total = np.add.reduceat(leaves[order], first)
                grows = total >= least
                size = np.diff(np.append(first, len(order)))
                level, leaves, length = [c[order] for c in level], leaves[order], length[order]
                at = first[grows]
                spelled = [spelled[p] + " " + known.words[w].decode() for p, w in zip(node[order][at], level[k][at])]
                out += [(part, s, k + 1, int(n)) for s, n, d in zip(spelled, total[grows], length[at]) if d <= k + 1]
                stays = np.repeat(grows, size)
                node = np.repeat(np.arange(len(at)), size[grows])
                level, leaves, length = [c[stays] for c in level], leaves[stays], length[stays]
        parts, phrases, sizes, n = zip(*out) if out else ((), (), (), ())
        return pa.table({"part": pa.array(parts, pa.string()), "phrase": pa.array(phrases, pa.string()), "words": pa.array(sizes, pa.int32()), "n": pa.array(n, pa.int64())})

    return count


def _packed(loads: list[tuple[int, int]], buckets: int, budget: int) -> np.ndarray:
    """The group of each bucket: first-fit decreasing by the suffixes in it. A bucket above the budget stands alone."""
    group_of, room = np.full(buckets, -1, np.int64), []
    for bucket, load in sorted(loads, key=lambda x: -x[1]):
        g = next((g for g, free in enumerate(room) if free >= load), len(room)) if len(room) <= 4096 else int(np.argmax(room))
        if g == len(room) or room[g] < load:
            g = len(room)
            room.append(budget)
        group_of[bucket] = g
        room[g] -= load
    return np.where(group_of < 0, np.arange(buckets) % max(len(room), 1), group_of)


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", part_col: str = "lang", group: int = GROUP) -> DataFrame:
    """``(part, phrase, words, n)``: phrases of 1 to ``longest`` (3 or more) words with at least ``least`` occurrences, and
    with ``words`` 0 and a null phrase the number of all words of the part.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs;
    phrases lie within pieces and overlap. Null texts are empty, null parts are ``und``. ``group`` is the budget of
    suffixes in a group: some 20 bytes each in one task, a few times that while they are sorted.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.col(text_col).alias("text"))
    words = texts.mapInArrow(_count_words, "part string, phrase string, h long, n long").groupBy("part", "phrase").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    words = materialize(words.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    single = words.filter("phrase is not null")
    count, suffixes = single.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = max(min(group, max(suffixes // GROUPS, 1 << 14)), 4 * suffixes // MAX_FREQUENT)
    plan, prefixes, counted = _Plan(*bitmap.build(single, "h", count, MAX_BITS)), [], [words.select("part", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(1).alias("words"), "n")]
    buckets = 1 << min(20, max(8, (16 * suffixes // budget).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.int64).view(np.uint64)
            first = _follow(np.zeros(len(h), U), h)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("phrase"), pa.array(first.view(np.int64)), batch.column("n")], names=["part", "phrase", "h", "n"])

    level = single.mapInArrow(hashed, "part string, phrase string, h long, n long")
    for k in range(1, longest):
        prefixes.append(level.filter(F.col("n") <= budget // 4))
        frequent = level.filter(F.col("n") > budget // 4).select("part", "phrase").collect()
        if not frequent:
            break
        plan.add(frequent)
        if k == longest - 1:
            break
        shared = spark.sparkContext.broadcast(plan)

        def longer(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            for part, words, numbers in _numbered(batches):
                columns, length, node, prefix = shared.value.suffixes(part, words, numbers, longest)
                mine = np.flatnonzero((length == k + 1) & (columns[k] > 0))
                if not len(mine):
                    continue
                key = node[mine] * len(words) + columns[k][mine]
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                at = mine[first]
                spell = [" ".join(words[columns[j][i]].decode() for j in range(k + 1)) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at)), pa.array(spell, pa.string()), pa.array(prefix[at].view(np.int64)), pa.array(n)], names=["part", "phrase", "h", "n"])

        level = texts.mapInArrow(longer, "part string, phrase string, h long, n long").groupBy("part", "phrase").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
        level = materialize(level, f"prefixes{k + 1}")
        counted.append(level.filter(F.col("n") > budget // 4).select("part", "phrase", F.lit(k + 1).alias("words"), "n"))
    loads = [p.groupBy(F.col("h").bitwiseAND(buckets - 1).alias("bucket")).agg(F.sum("n").alias("n")) for p in prefixes]
    total: dict[int, int] = {}
    for load in loads:
        for row in load.toLocalIterator():
            total[row["bucket"]] = total.get(row["bucket"], 0) + row["n"]
    plan.group_of = _packed(list(total.items()), buckets, budget)
    shared = spark.sparkContext.broadcast(plan)
    blocks = texts.mapInArrow(_blocks(shared, longest), "group long, part string, rows long, words_bytes long, data_bytes long, words binary, data binary")
    grown = blocks.groupBy("group").applyInArrow(_subtree(longest, least), "part string, phrase string, words int, n long")
    counted.append(grown)
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return materialize(result, "phrases")


def collocations(counts: DataFrame, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each part by how far they exceed chance: ``part, rank, phrase, a, l, r, n, score``.

    ``counts`` is the result of ``count_phrases``. A phrase of a occurrences is cut in two, after its first words with l
    occurrences and before the others with r: floor(1000 a n / (l r)), the cut with the lowest score, the first of such.
    A phrase that a longer one holds with as many occurrences is dropped. Ties go to larger a, then to the smaller phrase.
    """
    total = counts.filter("words = 0").select("part", F.col("n").alias("all"))
    counts = counts.filter("words > 0").select("part", "phrase", "words", "n")
    candidates = counts.filter("words > 1").select("part", "phrase", "words", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    piece = lambda lo, n: F.array_join(F.slice(parts, lo, n), " ")
    inner = candidates.filter("words > 2").select("part", F.explode(F.array(piece(F.lit(1), F.col("words") - 1), piece(F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("part", "phrase").agg(F.max("a").alias("a"))
    free = candidates.join(inner, ["part", "phrase", "a"], "left_anti")
    cut = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"left": piece(F.lit(1), F.col("k")), "right": piece(F.col("k") + 1, F.col("words") - F.col("k"))})
    cut = cut.join(counts.select("part", F.col("phrase").alias("left"), F.col("n").alias("l")), ["part", "left"])
    cut = cut.join(counts.select("part", F.col("phrase").alias("right"), F.col("n").alias("r")), ["part", "right"]).join(total, "part")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(all as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.groupBy("part", "phrase", "a", F.col("all").alias("n")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    best = best.select("part", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("part", "rank", "phrase", "a", "l", "r", "n", "score")
