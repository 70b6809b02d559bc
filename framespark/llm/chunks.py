"""Cutting texts into the matches of the byte-level pattern, fast for common texts.

The pattern (words, numbers and punctuation, each with at most one space before it, and white space) always begins a
match at a space that follows something other than white space, or that is the last of its run and comes before
something else. So a text may be cut before its spaces, and equal chunks have equal matches.
"""

from __future__ import annotations

import re

import numpy as np

#: White space whose split depends on its neighbours, characters that libraries class differently, special tokens.
ODD = re.compile(r"\s (?=\s|\Z)|\A (?=\s|\Z)|[\x00-\x08\x0e-\x1f\x7f-\x9f᠎​﻿]|<\|")
#: Bytes of texts that need no such search unless one of PAIRS is in them: printable ASCII, newline, Latin-1 letters.
_COMMON = bytes([10, *range(32, 127), 0xC3, *range(0x80, 0xC0)])
_PAIRS = ("  ", "\n ", " \n", "<|")
#: Chunks of these characters alone are split by SIMPLE as the full pattern would split them.
_SAFE = re.compile(r"(?: (?!\n))?[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~\n]+")
SIMPLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n+(?!\S)|\n+")

#: Kinds of bytes in ``piece_starts``: those of SIMPLE (letters by all their bytes), the space, and all others.
_SPACE, _NEWLINE, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[c for c in range(33, 127) if c != 39]] = _MARK
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[[32, 10]] = _SPACE, _NEWLINE


def cuttable(text: str) -> bool:
    """Whether the text may be cut before its spaces."""
    if text[:1] in ("", " ") or text[-1] == " " or text.encode().translate(None, _COMMON) or any(p in text for p in _PAIRS):
        return not ODD.search(text)
    return True


def chunks(text: str) -> list[str] | None:
    """The text cut before its spaces: the first chunk, then the others without the space that each begins with.

    None if the text must not be cut.
    """
    return text.split(" ") if cuttable(text) else None


def simple_pieces(chunk: str) -> list[str] | None:
    """The matches in a chunk of common characters; None if it has others."""
    return SIMPLE.findall(chunk) if _SAFE.fullmatch(chunk) else None


def piece_starts(data: np.ndarray, offsets: np.ndarray, uncut: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of many texts, one after the other: text i is data[offsets[i] : offsets[i + 1]].

    A piece is a match in a chunk of common characters, a whole chunk of others, or a whole text if i is among ``uncut``.
    """
    first = np.zeros(len(data) + 1, bool)  # bytes that begin a text, and the end
    first[offsets] = True
    kind = np.append(_KIND[data], np.uint8(_OTHER))
    chunk = kind == _SPACE
    chunk |= first
    cut = np.zeros(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut[1:] &= kind[:-1] != _SPACE
    # of newlines before something that is not white space, the last is a match of its own
    line = np.flatnonzero(kind[:-1] == _NEWLINE)
    after_space = line[(line > 0) & (kind[line - 1] == _SPACE)]
    line = line[(line > 0) & (kind[line - 1] == _NEWLINE)]
    cut[line[(kind[line + 1] != _NEWLINE) & ~chunk[line + 1]]] = True
    cut |= chunk
    for i in uncut:
        for marks in (chunk, cut):
            marks[offsets[i] + 1 : offsets[i + 1]] = False
    # chunks that hold other characters are not cut further: all others, multiplication and division signs, " \n"
    signs = np.flatnonzero(data == 0xC3)
    signs = signs[np.isin(data[np.minimum(signs + 1, len(data) - 1)], (0x97, 0xB7))]
    chunk_starts = np.flatnonzero(chunk)
    other = np.concatenate((np.flatnonzero(kind[:-1] == _OTHER), signs, after_space))
    whole = np.zeros(len(chunk_starts), bool)
    whole[np.searchsorted(chunk_starts, other, "right") - 1] = True
    starts = np.flatnonzero(cut[:-1])
    begins = chunk[starts]
    return starts[begins | ~whole[np.cumsum(begins) - 1]]
