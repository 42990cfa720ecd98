"""Words, shingles and per-text sums over Arrow string columns, with numpy over the raw bytes.

A batch is cut into pieces of about a megabyte (or one longer text), so the working memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A-Z only
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(2 * n, U(0x9E3779B97F4A7C15) | U(1), U)
        steps[0] = U(1)
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


#: Odd factors for the words of a shingle, by place.
PLACES = mixed(np.arange(1, 65, dtype=U)) | U(1)


@dataclass
class Piece:
    """Some texts: their bytes, where each begins (one more at the end), and the batch's row of the first."""

    first: int
    data: np.ndarray
    begins: np.ndarray


def pieces(column: pa.Array) -> Iterator[Piece]:
    """The texts of a string column in order; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + PIECE, "right")) - 1)
        yield Piece(at, data[begins[at] : begins[end]], begins[at : end + 1] - begins[at])
        at = end


@dataclass
class Words:
    """Hashes of the words of a piece; text i has hashes[begins[i]:begins[i + 1]]. starts, ends: of each word in the bytes."""

    hashes: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(piece: Piece, lower: bool = True) -> Words:
    """Word hashes, equal for equal words; A-Z are lowered first if asked for."""
    inside = ~IS_SPACE[piece.data]
    n = len(inside)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = piece.begins[:-1]
    edges = edges[edges < n]
    starts[edges] = inside[edges]
    first = np.flatnonzero(starts)
    flat = np.flatnonzero(inside)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(len(piece.begins), np.int64), none, none)
    begin = np.searchsorted(flat, first)
    lengths = np.diff(np.append(begin, len(flat)))
    place = np.arange(len(flat)) - np.repeat(begin, lengths)
    bytes_ = piece.data[flat]
    value = (LOWERED[bytes_] if lower else bytes_).astype(U) + U(1)
    value *= powers(int(lengths.max()))[place]
    hashes = mixed(np.add.reduceat(value, begin))
    return Words(hashes, np.searchsorted(first, piece.begins), first, first + lengths)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): the shingles of `size` words in order, and the text that each is of.

    A text with fewer words, but one at least, has them all as its only shingle.
    """
    count = np.diff(words.begins)
    n = max(0, len(words.hashes) - size + 1)
    out = np.zeros(n, U)
    for j in range(size):
        out += words.hashes[j : j + n] * PLACES[j]
    text = np.repeat(np.arange(len(count)), count)
    fits = text[:n] == text[size - 1 :] if n else np.zeros(0, bool)
    out, of = mixed(out[fits]), text[:n][fits]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        more = np.array([int(mixed(np.array([(words.hashes[words.begins[i] : words.begins[i + 1]] * PLACES[: count[i]]).sum(dtype=U) + U(count[i])]))[0]) for i in short], U)
        at = np.searchsorted(of, short)
        out, of = np.insert(out, at, more), np.insert(of, at, short)
    return out, of


def per_text(marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of `marks` over each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[begins[1:]] - total[begins[:-1]]
