"""Vectorised reading of texts in Arrow batches: bytes, words, hashes.

A batch is cut into blocks of a few megabytes, so memory in a Python worker does not follow the
number of rows. Every text is read whole; a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(_STEP))


_EXACT, _LOWER = _table(False), _table(True)

#: Bytes that end a word: space and the five controls around the line feed.
BLANKS = np.ones(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of a word made of digits, lower-case or upper-case ASCII letters, and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def powers(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        # Twice what is asked for, up to a block: who reads short texts holds short tables.
        out = np.full(max(1, n, min(2 * n, BLOCK_BYTES + 1)), base & _MASK, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= BLOCK_BYTES + 1:
            _powers[name] = have
    return have[:n]


@dataclass
class Block:
    """Rows first .. last of a batch, their bytes end to end, and where each starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of strings or binaries into blocks; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"" if pa.types.is_large_binary(kind) else "", kind))
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield Block(at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def _edges(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of marked bytes; a run never goes on into the next row."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cuts = block.offsets[:-1]
    before[cuts[cuts < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = block.offsets[1:]
    after[ends[ends > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hash(block: Block, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span, by differences of one running polynomial sum."""
    n = len(block.data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _EXACT)[block.data] * powers("up", _STEP, n), out=sums[1:])
    value = (sums[end] - sums[start]) * powers("down", _INVERSE, n + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(block: Block, inside: np.ndarray = BLANKS, lower: bool = False) -> Words:
    start, end = _edges(block, inside[block.data])
    row = np.searchsorted(block.offsets, start, side="right") - 1
    return Words(start, end, row, span_hash(block, start, end, lower))


def lines(block: Block) -> Words:
    """Pieces between line feeds, empty ones included only if a word stands in them elsewhere."""
    start, end = _edges(block, block.data != 10)
    row = np.searchsorted(block.offsets, start, side="right") - 1
    return Words(start, end, row, span_hash(block, start, end))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one row, and the index of its first word."""
    n = len(found) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(found.row[:n] == found.row[size - 1 :])
    value = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        value = value * np.uint64(0xF1357AEA2E62A9C5) + found.hash[at + i]
    return mix(value), at


def keyed(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key for (row, value)."""
    return mix(value + row.astype(np.uint64) * np.uint64(_STEP))
