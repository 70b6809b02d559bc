"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a piece has one valid last token: the last token of the prefix's own encoding. The last token of
prefix i is the one token t ending there for which the last token of the prefix before t may stand before t; two
tokens may stand side by side if the encoding of their joined bytes is just those two. The table of last tokens
holds the encoding of every prefix, so appending bytes only adds entries, and after an edit entries are computed
anew only until they fall in with the old ones again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunks, simple_pieces
from .worker import kept, stretches

#: Bytes of memory for the chunks, and number of token pairs, that one worker remembers; others are worked out again.
REMEMBERED, PAIRS = 64 << 20, 300_000
#: What one remembered chunk takes besides its characters and ids.
ENTRY_BYTES = 170
#: Ids decoded at once, about.
DECODED = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pairs: int = PAIRS):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for octets, rank in ranks.items():
            self.bytes_of[rank] = octets
        self.beside: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.room = pairs

    def merged(self, octets: bytes) -> list[int]:
        """The encoding by its definition: the lowest-ranked pair merges first, the leftmost of equals."""
        parts = [octets[i : i + 1] for i in range(len(octets))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.beside) < self.room:
                self.beside[left, right] = known
        return known

    def last_token(self, octets: bytes, last: list[int], end: int) -> int:
        """The valid last token of ``octets[:end]``, given those of all shorter prefixes in ``last[1:end]``."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(octets[start:end])
            if token is not None and (self.may_follow(last[start], token) if start else self.stands_alone(token)):
                return token
        raise ValueError("bytes outside the vocabulary")

    def table(self, octets: bytes) -> list[int]:
        """The last token of every prefix; entry 0 stands for the empty prefix."""
        last = [-1]
        for end in range(1, len(octets) + 1):
            last.append(self.last_token(octets, last, end))
        return last

    def append(self, octets: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The piece with ``more`` at its end and its table; ``last`` itself is extended."""
        octets += more
        for end in range(len(last), len(octets) + 1):
            last.append(self.last_token(octets, last, end))
        return octets, last

    def edit(self, octets: bytes, last: list[int], lo: int, hi: int, new: bytes) -> tuple[bytes, list[int], int]:
        """The piece with ``octets[lo:hi]`` replaced, its table, and how many entries were worked out.

        Once as many entries in a row as the longest token has bytes agree with the old ones, and their tokens all
        lie behind the edit, the others agree too.
        """
        after = octets[:lo] + new + octets[hi:]
        table, same, shift, worked = last[: lo + 1], 0, len(new) - (hi - lo), 0
        for end in range(lo + 1, len(after) + 1):
            token = self.last_token(after, table, end)
            table.append(token)
            worked += 1
            old = end - shift
            same = same + 1 if end > lo + len(new) and token == last[old] else 0
            if same >= self.longest and end - same >= lo + len(new):
                table += last[old + 1 :]
                break
        return after, table, worked

    def read(self, octets_length: int, last: list[int]) -> list[int]:
        """The ids of the whole piece, walking back through its table."""
        ids, end = [], octets_length
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode_piece(self, octets: bytes) -> list[int]:
        whole = self.ranks.get(octets)
        return [whole] if whole is not None else self.read(len(octets), self.table(octets))


class TextBpe:
    """Encodes texts: each match of the pattern on its own; matches are remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.bpe, self.matches = PrefixBpe(ranks), regex.compile(pattern).findall
        self.spaced: dict[str, bytes] = {}  # by the piece without its leading space
        self.bare: dict[str, bytes] = {}
        self.room = remembered

    @classmethod
    def shared(cls, rank_file: str, pattern: str) -> TextBpe:
        """One encoder for the tasks of a stage that a worker runs."""
        return kept(("bpe", rank_file, pattern), lambda: cls(load_ranks(rank_file), pattern))

    def chunk(self, text: str) -> bytes:
        out = []
        pieces = simple_pieces(text)
        for piece in self.matches(text) if pieces is None else pieces:
            table, key = (self.spaced, piece[1:]) if piece[0] == " " else (self.bare, piece)
            known = table.get(key)
            if known is None:
                known = np.array(self.bpe.encode_piece(piece.encode()), "<i4").tobytes()
                if self.room > 0 and len(key) < 48:
                    table[key] = known
                    self.room -= ENTRY_BYTES + len(key) + len(known)
            out.append(known)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        words = chunks(text)
        if words is None:
            return self.chunk(text)
        out, find = [self.chunk(words[0])], self.spaced.get
        for word in words[1:]:
            known = find(word)
            out.append(self.chunk(" " + word) if known is None else known)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every whole text; null and empty texts have no ids.

    A null id and repeated ids are carried along row by row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TextBpe.shared(rank_file, pattern)
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids = [bpe.packed(t.as_py() or "") for t in part.column(1)]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, flat)], [id_col, "ids"]
                )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds ``out_col``, the bytes that a column of ids stands for (null ids: null, no ids: no bytes).

    All rows and columns stay; a column that has the name of ``out_col`` gives way to it.
    """
    encoded = encoded.select(*(f"`{c}`" for c in encoded.columns if c != out_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out_col}` binary"
    place = encoded.columns.index(ids_col)

    def table() -> list[bytes]:
        ranks = load_ranks(rank_file)
        out = [b""] * (max(ranks.values()) + 1)
        for octets, rank in ranks.items():
            out[rank] = octets
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = kept(("bytes", rank_file), table).__getitem__
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            ends, lo = np.cumsum(lengths, dtype=np.int64), 0
            while lo < len(ends):  # stretches of a bounded number of ids; a longer row stands alone
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + DECODED, "right")))
                part = batch.slice(lo, hi - lo)
                out = [b"".join(map(find, v.values.to_numpy().tolist())) if v.is_valid else None for v in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, out_col])
                lo = hi

    return encoded.mapInArrow(run, schema)
