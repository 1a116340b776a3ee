"""numpy kernels over concatenated UTF-8 texts: word hashes, gram hashes, window minima.

A batch of texts is one byte array with the texts' starts and ends. What must tell different words or slices apart is a
128-bit xxh3 hash of their bytes. Grams, which only route, are polynomials modulo 2**64 over a random table of unit
values, mixed afterwards: those can collide for texts made to do so, which costs time, never a result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def settle() -> None:
    """Give freed memory back: workers live on between tasks, and an executor's memory holds them all."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept between calls."""
    have = _powers.get(1)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for k, b in ((1, _BASE), (-1, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[1][:n], _powers[-1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefixes(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows."""
    p = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units))[0], out=p[1:])
    return p


def digests(pieces) -> np.ndarray:
    """128-bit hashes of byte strings: two columns."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)


def slice_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of slices of ``data`` by their bytes."""
    raw, width = data.tobytes(), data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return digests(raw[a:b] for a, b in zip((start * width).tolist(), (end * width).tolist(), strict=True))


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, with each text's start and end; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # more than 2 GB, or no chunk at all
            column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start, end = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        end[gone] = start[gone]
    return data, start, end


def pieces(start: np.ndarray, end: np.ndarray, data: np.ndarray, limit: int):
    """Cut a batch into runs of texts of about ``limit`` bytes; a longer text is cut at white space.

    Yields (lowest byte, highest byte, starts, ends) with starts and ends inside the run.
    """
    k, n = 0, len(start)
    while k < n:
        stop = int(np.searchsorted(end, start[k] + limit, "right"))
        if stop > k:
            yield int(start[k]), int(end[stop - 1]), start[k:stop], end[k:stop]
            k = stop
            continue
        at, last = int(start[k]), int(end[k])
        while at < last:
            to = min(at + limit, last)
            while to < last and not _SPACE[data[to]]:  # to the end of a word, by blocks
                ahead = np.flatnonzero(_SPACE[data[to : min(to + limit, last)]])
                to = to + int(ahead[0]) if len(ahead) else min(to + limit, last)
            yield at, to, np.array([at]), np.array([to])
            at = to
        k += 1


def word_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after another in ``data`` (positions from 0)."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    s = start[start < len(data)]
    first[s] = solid[s]
    e = end[end > 0] - 1
    last[e] = solid[e]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, limit: int = 1 << 19):
    """All words of a batch: (starts, ends, 128-bit hashes) with positions in ``data``, and each text's first and last word's place."""
    s, e, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
    for lo, hi, a, b in pieces(start, end, data, limit):
        ws, we = word_spans(data[lo:hi], a - lo, b - lo)
        raw = data[lo:hi].tobytes()
        raw = raw.lower() if lower else raw
        h.append(digests(raw[x:y] for x, y in zip(ws.tolist(), we.tolist(), strict=True)))
        s.append(ws + lo)
        e.append(we + lo)
    s = np.concatenate(s)
    return s, np.concatenate(e), np.concatenate(h), np.searchsorted(s, start), np.searchsorted(s, end)


def byte_units(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def packed(values: np.ndarray, first: np.ndarray | None = None) -> pa.Array:
    """A binary column: the rows of a two-dimensional array, or a record array cut at ``first``."""
    if first is None:
        at = np.arange(len(values) + 1) * (values[:1].nbytes if len(values) else 0)
    else:
        at = np.append(first, len(values)) * values.dtype.itemsize
    kind, offsets = (pa.binary(), at.astype(np.int32)) if at[-1] < 2**31 else (pa.large_binary(), at.astype(np.int64))
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
