"""Arrow text columns as flat byte arrays, and the word and hash kernels on them.

Every kernel sees whole texts: a batch is cut into runs of whole documents of
about ``CHUNK`` bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCK = 1 << 19

_U = np.uint64
_BYTE_SEED = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_GRAM_BASE = 0x2545F4914F6CDD1D


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that hands freed memory back to the system at the end of its partition: Python workers live on and serve other
    tasks, and several of them share an executor with its JVM."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc: it keeps what it freed
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


_BYTES = mix((np.arange(1, 257, dtype=np.uint64)) * _BYTE_SEED)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k up to n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cached powers for ordinary blocks; longer ones are made for the call and let go."""
    if n > 2 * BLOCK:
        return _powers(base, n)
    if base not in _cache:
        _cache[base] = _powers(base, 2 * BLOCK)
    return _cache[base]


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Boolean table over the 256 byte values, true inside the inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


class Texts:
    """Documents of one run: their bytes back to back and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def document_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the document that holds each byte position."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def per_document(self, starts: np.ndarray) -> np.ndarray:
        """First item index of each document (one more entry at the end) for sorted item starts."""
        return np.searchsorted(starts, self.offsets, side="left")

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array) -> Texts:
    """A string column as one Texts without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return Texts(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return Texts(b, o - o[0])


def runs(t: Texts, size: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Whole documents in runs of about ``size`` bytes: (first, end, Texts)."""
    n, i = len(t), 0
    while i < n:
        j = int(np.searchsorted(t.offsets, t.offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        a, b = t.offsets[i], t.offsets[j]
        yield i, j, Texts(t.data[a:b], t.offsets[i : j + 1] - a)
        i = j


def spans(t: Texts, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of words, which never cross documents."""
    if not len(t.data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~separators[t.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = inside[0]
    edge[-1] = inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = t.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first = edge[:-1] & inside
    last = edge[1:] & inside
    if len(cut):
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def byte_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and scales: (sums[e] - sums[s]) * scales[s] is the polynomial hash of the bytes from s to e."""
    up, down = powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return total, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span, for sorted spans that do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        part = data[low : ends[j - 1]]
        total, down = byte_hashes(part)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive item hashes (across documents too: mask those)."""
    if len(items) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(items) - n + 1, np.uint64)
    for low in range(0, len(out), BLOCK):
        part = items[low : min(low + BLOCK, len(out)) + n - 1]
        up, down = powers(_GRAM_BASE, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[low : low + len(part) - n + 1] = mix((total[n:] - total[:-n]) * down[: len(part) - n + 1])
    return out


def whole_windows(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of n items lie in one document; first: item index where each document begins."""
    count = total - n + 1
    if count <= 0:
        return np.empty(0, bool)
    ok = np.ones(count + n, np.int32)
    change = np.zeros(count + n + 1, np.int32)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < total)]
    np.add.at(change, np.maximum(inner - n + 1, 0), 1)
    np.add.at(change, inner, -1)
    return (np.cumsum(change)[:count] == 0) & (ok[:count] == 1)


def covered(starts_at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Items covered by windows of n items; starts_at: boolean per window start."""
    change = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(starts_at)
    change[at] += 1
    np.subtract.at(change, at + n, 1)
    return np.cumsum(change[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.empty(0, bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return member(keys, twice)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted distinct array."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values of each document; first: item index where each document begins, and the end."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for sizes[0] values, then first[1] and so on."""
    total = np.cumsum(sizes)
    if not len(total):
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(first - (total - sizes), sizes)
