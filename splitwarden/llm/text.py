"""Word arrays over Arrow text columns, used inside Spark tasks.

Words are runs of ``0-9``, ``A-Z``, ``a-z`` and of every character from U+0080 up, with A-Z
lower-cased; in UTF-8 that is a test of single bytes, so a whole slice of texts is cut into
words by a few NumPy calls. Word keys are 64-bit hashes: they only propose candidates, and
operators compare the bytes of the words before they report anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20  # texts handled at once by one task; a longer text is a slice alone

_bytes = np.arange(256)
_upper = (_bytes >= 65) & (_bytes <= 90)
LOWER = np.where(_upper, _bytes + 32, _bytes).astype(np.uint8)
IS_WORD = (
    ((_bytes >= 48) & (_bytes <= 57)) | _upper | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
)
# For bytes.translate: words in lower case, everything else a blank.
WORD_TABLE = np.where(IS_WORD, LOWER, 32).astype(np.uint8).tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: one 64-bit hash per element."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LONG = 1024  # bytes; longer ranges are few, the library hashes them one by one
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has more than ``limit`` bytes of text, single rows apart."""
    _, offsets = as_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of every range, eight bytes of all ranges at a time.

    Every step is a bijection of the state, so ranges of one length up to eight bytes never share
    a hash; hashes of different seeds are independent.
    """
    size = end - start
    state = mix(np.full(len(start), seed, np.uint64) + size.astype(np.uint64))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.where(size > _LONG, 0, size)
    active = np.flatnonzero(left > 0)
    at = start[active]
    while len(active):
        rest = left[active]
        short = np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64)
        state[active] = mix((state[active] * np.uint64(0xD1342543DE82EF95)) ^ (lanes[at] & (_ONES >> short)))
        left[active] = rest - 8
        more = rest > 8
        active, at = active[more], at[more] + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        state[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return state


@dataclass
class Words:
    """The words of a column: row, byte range in ``data`` and key of each, in text order."""

    data: np.ndarray
    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def first(self) -> np.ndarray:
        """Number of the first word of every row, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))

    def joined(self, word: int, n: int) -> bytes:
        """The lower-case words [word, word + n) with a blank between them."""
        text = self.data[self.start[word] : self.end[word + n - 1]].tobytes()
        return b" ".join(text.translate(WORD_TABLE).split())


def words_of(column: pa.Array) -> Words:
    data, offsets = as_bytes(column)
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(data, len(column), none, none, none, none.astype(np.uint64))
    inside = IS_WORD[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    before = np.empty(size, bool)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets[1:], start, "right")
    key = range_hash(LOWER[data], start, end)
    return Words(data, len(column), row, start, end, key)


def grams(key: np.ndarray, n: int, factor: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of every run of ``n`` consecutive keys (rows are told apart by the caller)."""
    count = len(key) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, scale = np.zeros(count, np.uint64), 1
    for k in range(n):
        total += key[k : k + count] * np.uint64(scale)
        scale = scale * factor % (1 << 64)
    return mix(total)
