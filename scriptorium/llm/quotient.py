"""Counting quotient filters over packed n-grams: exact counters in little room.

An n-gram of word ids (each of ``bits`` bits) is packed into one to five 64-bit columns.
The first column is permuted, invertibly and depending on the others, so that its high
bits spread evenly: they are the quotient, what is left of it and the other columns are
the full remainder, and the n-gram can be had back from both. A filter keeps its entries
sorted: a bit for each quotient that occurs, a bit that ends each run of one quotient, the
remainders at whole bytes, and a byte a count, with larger counts apart.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQ")
# odd multipliers of the permutation
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def layout(n: int, bits: int) -> list[int]:
    """Bits of each column of an n-gram: as many whole ids as fit into 64."""
    per = 64 // bits
    return [bits * min(per, n - at) for at in range(0, n, per)]


def pack(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of n-grams given as ``n`` arrays of ids, the first id highest."""
    out, per = [], 64 // bits
    for at in range(0, len(ids), per):
        column = np.zeros(len(ids[0]), dtype=np.uint64)
        for i in ids[at : at + per]:
            column = (column << np.uint64(bits)) | i.astype(np.uint64)
        out.append(column)
    return out


def unpack(columns: list[np.ndarray], n: int, bits: int) -> np.ndarray:
    """(rows x n) ids of packed n-grams."""
    out, mask = [], np.uint64((1 << bits) - 1)
    for column, width in zip(columns, layout(n, bits), strict=True):
        out += [(column >> np.uint64(shift)) & mask for shift in range(width - bits, -1, -bits)]
    return np.stack(out, axis=1).astype(np.int64)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        h = (h ^ column) * np.uint64(_A)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_B)
        h ^= h >> np.uint64(29)
    return h


def _round(x: np.ndarray, width: int, factor: int) -> np.ndarray:
    x = (x * np.uint64(factor)) & np.uint64((1 << width) - 1)
    return x ^ (x >> np.uint64((width + 1) // 2))


def permute(columns: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The first column, ``width`` bits wide, so that its high bits depend on all of it and the rest."""
    first = columns[0]
    if len(columns) > 1:
        first = first ^ (mixed(columns[1:]) >> np.uint64(64 - width))
    return [_round(_round(first, width, _A), width, _B), *columns[1:]]


def restore(columns: list[np.ndarray], width: int) -> list[np.ndarray]:
    """What :func:`permute` was given."""
    first, mask = columns[0], np.uint64((1 << width) - 1)
    for factor in (_B, _A):
        first = first ^ (first >> np.uint64((width + 1) // 2))  # its own inverse
        first = (first * np.uint64(pow(factor, -1, 1 << 64))) & mask
    if len(columns) > 1:
        first = first ^ (mixed(columns[1:]) >> np.uint64(64 - width))
    return [first, *columns[1:]]


def tally(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and how often each occurs (or the sum of its counts)."""
    if len(columns) == 1:
        # merges runs that are sorted already
        order = np.argsort(columns[0], kind="stable") if counts is not None else None
        columns = [columns[0][order] if order is not None else np.sort(columns[0])]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
    if not len(columns[0]):
        return columns, np.zeros(0, dtype=np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    if counts is None:
        return [c[at] for c in columns], np.diff(np.append(at, len(new)))
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def _bytes(column: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of each number, at whole bytes."""
    return column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]


def dump(columns: list[np.ndarray], counts: np.ndarray, widths: list[int], shard_bits: int) -> bytes:
    """A filter of permuted, sorted, distinct rows that share their first ``shard_bits`` bits."""
    entries = len(counts)
    q = min(max(entries - 1, 1).bit_length(), widths[0] - shard_bits)
    rest = widths[0] - shard_bits - q
    quotient = (columns[0] >> np.uint64(rest)) & np.uint64((1 << q) - 1)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    remainder = np.hstack([_bytes(columns[0] & np.uint64((1 << rest) - 1), rest), *(_bytes(c, w) for c, w in zip(columns[1:], widths[1:], strict=True))])
    large = counts > 254
    small = np.where(large, 255, counts).astype(np.uint8)
    shard = int(columns[0][0]) >> (widths[0] - shard_bits) if shard_bits else 0
    return _HEAD.pack(entries, q, shard) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainder.tobytes() + small.tobytes() + counts[large].astype("<u8").tobytes()


def load(data: bytes, widths: list[int], shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What :func:`dump` was given."""
    entries, q, shard = _HEAD.unpack_from(data)
    rest, at = widths[0] - shard_bits - q, _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, dtype=np.uint8, count=size, offset=at - size)

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q)).astype(np.uint64)
    ends = np.unpackbits(take(-(-entries // 8)), count=entries)
    quotient = occupied[np.cumsum(ends) - ends]
    sizes = [-(-rest // 8), *(-(-w // 8) for w in widths[1:])]
    remainder, columns, done = take(entries * sum(sizes)).reshape(entries, -1), [], 0
    for size in sizes:
        whole = np.zeros((entries, 8), dtype=np.uint8)
        whole[:, :size] = remainder[:, done : done + size]
        columns.append(whole.view("<u8")[:, 0].astype(np.uint64))
        done += size
    counts = take(entries).astype(np.int64)
    large = counts == 255
    counts[large] = take(8 * int(large.sum())).view("<u8").astype(np.int64)
    top = np.uint64(shard << (widths[0] - shard_bits)) if shard_bits else np.uint64(0)
    columns[0] = columns[0] | (quotient << np.uint64(rest)) | top
    return columns, counts


def merged(filters: list[bytes], widths: list[int], shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted rows and summed counts of filters of one shard."""
    parts = [load(f, widths, shard_bits) for f in filters]
    columns = [np.concatenate([p[0][i] for p in parts]) for i in range(len(widths))]
    return tally(columns, np.concatenate([p[1] for p in parts]))


class Counter:
    """Counts rows of a task in sorted runs; hands out filters by shard when it holds ``most`` distinct rows."""

    def __init__(self, widths: list[int], shard_bits: int, most: int = 1 << 21):
        self.widths, self.shard_bits, self.most = widths, shard_bits, most
        self.waiting: list[list[np.ndarray]] = []
        self.size, self.columns, self.counts = 0, None, None

    def add(self, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
        self.waiting.append(permute(columns, self.widths[0]))
        self.size += len(columns[0])
        if self.size < self.most:
            return []
        self._settle()
        return self.flush() if len(self.counts) >= self.most else []

    def _settle(self) -> None:
        if self.waiting:
            new, counts = tally([np.concatenate([w[i] for w in self.waiting]) for i in range(len(self.widths))])
            self.waiting, self.size = [], 0
            if self.columns is None:
                self.columns, self.counts = new, counts
            else:
                both = [np.concatenate(c) for c in zip(self.columns, new, strict=True)]
                self.columns, self.counts = tally(both, np.concatenate((self.counts, counts)))

    def flush(self) -> list[tuple[int, bytes]]:
        """(shard, filter) of all that is held; starts afresh."""
        self._settle()
        if self.columns is None:
            return []
        shard = self.columns[0] >> np.uint64(self.widths[0] - self.shard_bits) if self.shard_bits else np.zeros(len(self.counts), dtype=np.uint64)
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else [], len(shard)).astype(int)
        out = [(int(shard[a]), dump([c[a:b] for c in self.columns], self.counts[a:b], self.widths, self.shard_bits)) for a, b in zip(edges, edges[1:])]
        self.columns = self.counts = None
        return out
