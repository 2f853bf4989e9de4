"""Vectorised words of whole texts: positions and 64-bit hashes from Arrow buffers, a bounded chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _table(allowed) -> np.ndarray:
    return np.array([bool(allowed(b)) for b in range(256)])


#: Words [^\x20\x09-\x0D]+ and words of digits, letters and non-ASCII characters, as byte classes of UTF-8.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


LOWER = _lowered()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        p = 0xD6E8FEB86659FD93
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (p, pow(p, -1, 1 << 64)):
            out = np.ones(size, dtype=np.uint64)
            done, step = 1, base
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(step)
                done, step = done + more, step * step % (1 << 64)
            made.append(out)
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[e]-S[s] = p**s * hash(values[s:e]), so ranges hash in constant time."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many ranges at once; their lengths are part of the hash."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _MULT)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of at most about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and for each row the range of its words."""

    data: np.ndarray  # bytes, lower-cased where asked for
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # row r has words first[r]:first[r+1]

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def words(column: pa.Array, allowed: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, off = text_buffers(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = allowed[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = prefix_sums(_BYTE_VALUES[data])
    return Words(data, begin, end, range_hash(sums, begin, end), np.searchsorted(begin, off))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash at each word of the n words from there, and whether they lie in one row."""
    total = len(w.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(total - n + 1)
    last = np.repeat(w.first[1:], np.diff(w.first))[: total - n + 1]
    return range_hash(prefix_sums(w.hashes), at, at + n), at + n <= last


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each full window, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
