"""Ids of whole texts by the tokenizers library, with a bounded memory of the pieces already met.

A byte-level tokenizer first splits a text by its pattern and then encodes every match on its own, so equal matches
have equal ids. Many texts are cut at once by their bytes (see ``chunks``), and of a stretch of texts each distinct piece
is looked up once, and encoded only if it is not remembered. Texts that must not be cut are encoded whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import SIMPLE, cuttable, piece_starts
from .worker import kept

#: Bytes of memory for the pieces that one worker remembers, about; others are encoded again in each stretch.
REMEMBERED = 80 << 20
#: What one remembered piece takes besides its bytes and ids: a place in a table and two objects' heads.
ENTRY_BYTES = 170

#: Characters as a byte-level tokenizer writes them: every byte of their UTF-8 as one visible character.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _VISIBLE]
_BYTE = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
_WRITTEN = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(256) if c < 128 or c > 159}


class ChunkEncoder:
    """``encode(text)`` gives little-endian unsigned ids as bytes, of two bytes each if the vocabulary allows."""

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.whole.model.tokenize
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces: dict[bytes, bytes] = {}
        self.room = remembered

    @classmethod
    def shared(cls, tokenizer_file: str) -> ChunkEncoder:
        """One encoder for the tasks of a stage that a worker runs."""
        return kept(("tokens", tokenizer_file), lambda: cls(tokenizer_file))

    def _ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        if SIMPLE.fullmatch(text):
            ids = [t.id for t in self.model(text.translate(_WRITTEN))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        known = array(self.code, ids).tobytes()
        if self.room > 0 and len(piece) < 48:
            self.pieces[piece] = known
            self.room -= ENTRY_BYTES + len(piece) + len(known)
        return known

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """Every text's ids (null: none), followed by ``end_id`` if there is one, in a column of bytes."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, places, octets = texts.buffers()
        offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(octets or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets, np.flatnonzero([not cuttable(t) for t in texts.to_numpy(zero_copy_only=False)]))
        bounds = np.append(starts, len(data)).astype(np.int32)
        distinct = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        pieces, which = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()
        ids = [self._ids(p) if known is None else known for p, known in zip(pieces, map(self.pieces.get, pieces), strict=True)]
        ends = np.searchsorted(starts, offsets[1:])  # a text's pieces by number
        if end_id is not None:
            which = np.insert(which, ends, len(ids))
            ends += np.arange(1, len(ends) + 1)
            ids.append(array(self.code, [end_id]).tobytes())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        length = size[which]
        after = np.append(0, np.cumsum(length, dtype=np.int32))
        place = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - after[:-1], length)
        place += np.arange(len(place), dtype=np.int32)
        out = np.frombuffer(b"".join(ids), self.dtype)[place]
        bounds = np.append(0, after[ends]).astype(np.int32) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
