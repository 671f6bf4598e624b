"""Words of a column of texts as 64-bit hashes, straight from the Arrow buffers.

A batch is handled in chunks that fit a processor cache. No Python string is made:
separators come from a byte table, and a word's hash is a difference of
prefix sums of ``random[byte] * p**position`` (mod 2**64), shifted back to
position zero and mixed. Equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from omiclattice.llm.storage import give_back, process_cache

#: Bytes of text handled at once; one longer text is a chunk by itself.
CHUNK = 256 << 10

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]

#: White space only: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits; every byte beyond ASCII belongs to a word.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse."""
    cache = process_cache("powers")
    if len(cache.get("p", ())) < n:
        for name, base in (("p", _P), ("q", _INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            cache[name] = np.multiply.accumulate(x)
    return cache["p"], cache["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows whose texts stay below ``limit`` bytes.

    Who reads words needs no token ids: what a worker remembers of an earlier stage's is left.
    """
    give_back("encoders", "word_encoders")
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offs = buffers(batch.column(text))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
                yield batch.slice(at, to - at), buf[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
                at = to
    finally:
        give_back()


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True, separators: np.ndarray = SPACE):
    """(hashes, row of each word, start byte, end byte); words never span two rows."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    gap = separators[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, gap[:-1]
    edge = offs[1:-1]
    before[edge[edge < len(buf)]] = True
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edge[edge > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    powers, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[buf] * powers[:len(buf)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return h, np.searchsorted(offs, starts, "right") - 1, starts, ends


def word_hash(word: str, lower: bool = True) -> int:
    """Hash of one word, as :func:`words` gives it."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]), lower, np.zeros(256, bool))[0][0])


def spans(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's words in a sorted row index: n + 1 numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
