"""Vectorised text kernels for Arrow batches: words, hashes, rolling windows, content-chosen anchors.

Every function works on a block of whole documents held as one byte array with document offsets, so that the
cost per byte is a few array passes and no Python object is made per word. Hashes are 64-bit polynomials over
randomised symbols with a final mix; they depend on content only and are equal on every machine. Polynomials modulo
2^64 coincide for some long texts of two letters (from 1,024 letters on), so long words are hashed by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Words longer than this are hashed by a digest of their bytes.
LONG_WORD = 256
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=U64)
    return table


class Rolling:
    """Hashes of any range of a sequence of 64-bit symbols in constant time."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * _power_table(_BASE, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power_table(_INVERSE, len(self.sums))[start]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text with A-Z lower-cased.
ALNUM = _bytes_in((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words `[^\x20\x09-\x0D]+`.
NONSPACE = ~_bytes_in((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Block:
    """Whole documents lo..hi of a batch as bytes; at[i]..at[i+1] are the bytes of document lo+i."""

    lo: int
    hi: int
    raw: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a text column (null: empty) into blocks of about `limit` bytes, never inside a document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at byte ranges start..end."""
    out = Rolling(_BYTE_VALUE[raw]).of(start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of a block: byte ranges start..end, and first[i]..first[i+1] are those of its i-th document."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def bytes_of(self, low: int, high: int) -> list[bytes]:
        return [self.raw[a:b].tobytes() for a, b in zip(self.start[low:high], self.end[low:high], strict=True)]


def words(block: Block, kind: np.ndarray, lower: bool) -> Words:
    raw = _LOWER[block.raw] if lower else block.raw
    inside = kind[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    full = block.at[:-1][np.diff(block.at) > 0]
    before[full] = False
    after[block.at[1:][np.diff(block.at) > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(raw, start, end, np.searchsorted(start, block.at))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a window of k symbols lies inside one document."""
    counts = np.diff(first)
    position = np.arange(first[-1])
    return position[position + k <= np.repeat(first[1:], counts)]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """minimum of x[i : i + width] for every i at which it fits."""
    size, low = 1, x
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


@dataclass
class Anchors:
    """Content-chosen anchors: windows first..last (their starts) all have the anchor gram `gram` as minimiser.

    `extent` identifies the symbols from the first window's start to the last window's end, with the place of the
    anchor among them. Two equal windows in any documents have anchors with equal gram at the same place.
    """

    doc: np.ndarray
    gram: np.ndarray
    extent: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(symbols: np.ndarray, at: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of all windows of `window` symbols; at: document offsets into symbols."""
    n = len(symbols)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return Anchors(none, none.astype(U64), none.astype(U64), none, none)
    rolling = Rolling(symbols)
    place = np.arange(n - gram + 1)
    grams = rolling.of(place, place + gram)
    packed = (grams & U64(0xFFFFFFFF00000000)) | place.astype(U64)
    least = (_sliding_minimum(packed, window - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    starts = window_starts(at, window)
    if not len(starts):
        return Anchors(none, none.astype(U64), none.astype(U64), none, none)
    chosen = least[starts]
    doc = np.searchsorted(at, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(starts)) - 1
    first, last, spot = starts[opens], starts[closes], chosen[opens]
    extent = mix(rolling.of(first, last + window) + mix((spot - first).astype(U64) + U64(1)))
    base = at[doc[opens]]
    return Anchors(doc[opens], grams[spot], extent, first - base, last - base)


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[raw]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal disjoint ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    opens = np.flatnonzero(new)
    return starts[opens], reach[np.append(opens[1:], len(starts)) - 1]
