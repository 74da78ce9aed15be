"""Packing of token sequences by minimum bin slack.

A document is cut into full windows of ``CAPACITY`` ids and one rest. Full windows are
sequences of their own. The rests are packed by their lengths alone: there are fewer than
``CAPACITY`` different ones, so a table of counts by length, not the rows, reaches the driver.
Window after window, the longest length left is placed and a subset-sum over bitsets, bounded
by the counts, finds the multiset of the other lengths that comes closest to the capacity;
walking the bitsets back gives how often each length is used. The pattern is repeated as often
as the counts allow. Each pattern uses up one length at least to below its own multiplicity, so
the number of patterns depends on the capacity and not on the number of documents.

Spark numbers the pieces of each length in a global order (``number_rows``) and joins them to
the few pattern rows. A sequence is padded to ``CAPACITY``, except when its length is a power
of two; where the capacity cannot be reached, a sum that is a power of two is taken first.

Cases: a null or empty text is the end id alone; a null doc_id is packed like any other;
repeated rows are packed once each; an empty table gives no sequence; a very long text gives
as many full windows as it needs; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import slices
from splitwarden.llm.tokens import encoder
from splitwarden.operators.scale import materialise, number_rows

CAPACITY = 1024
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder().encode(part.column("text"))):
                    packed, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
                    rows += [
                        (doc, at, min(capacity, n - at), zlib.crc32(packed[4 * at : 4 * (at + capacity)]), n)
                        for at in range(0, n, capacity)
                    ]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per full window and rest of every document, with the checksum of its ids."""
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return narrow.mapInArrow(_cut(capacity), _PIECES)


def closest_fill(counts: dict[int, int], room: int, unpadded: Sequence[int] = ()) -> dict[int, int]:
    """Lengths (with counts) of the multiset whose sum is closest to ``room`` from below.

    ``counts`` bounds each length. Bit s of a set says that sum s can be made. ``unpadded``
    lists sums, best first, that are taken when ``room`` itself cannot be reached.
    """
    sets: list[tuple[int, int]] = []  # length, sums before it was allowed
    sums, mask = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        sets.append((length, sums))
        left, step = min(counts[length], room // length), 1
        while left:  # copies in groups of 1, 2, 4, ... cover every number up to the bound
            step = min(step, left)
            sums |= (sums << (length * step)) & mask
            left, step = left - step, step * 2
        if sums >> room & 1:
            break
    total = sums.bit_length() - 1
    if total < room:  # no full window: a sum that needs no padding is better than a larger one
        total = next((x for x in unpadded if x <= room and sums >> x & 1), total)
    used: dict[int, int] = {}
    for length, before in reversed(sets):
        times = 0
        while not before >> total & 1:
            total -= length
            times += 1
        if times:
            used[length] = times
    return used


def fill_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: count}, number of windows)] that use every piece exactly once."""
    left = {length: n for length, n in counts.items() if n}
    patterns = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        powers = [1 << b for b in range(capacity.bit_length(), -1, -1)]
        unpadded = [p - longest for p in powers if longest <= p <= capacity]
        pattern = closest_fill(rest, capacity - longest, unpadded)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[length] // n for length, n in pattern.items())
        patterns.append((pattern, times))
        for length, n in pattern.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return patterns


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``padded_to`` to every piece."""
    spark = pieces.sparkSession
    order = ["length", "doc_id", "start", "ids_crc32"]
    numbered = number_rows(pieces, order, {"_ordinal": ["length"]})
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, sequence = [], 0
    used = dict.fromkeys(counts, 0)
    for pattern, times in fill_windows(counts, capacity):
        offset = 0
        total = sum(length * n for length, n in pattern.items())
        padded = total if total & (total - 1) == 0 else capacity
        for length, n in sorted(pattern.items(), reverse=True):
            low = used[length] + 1
            used[length] += n * times
            plan.append((length, low, used[length], n, sequence, offset, padded))
            offset += length * n
        sequence += times
    table = spark.createDataFrame(
        plan,
        "_length bigint, _low bigint, _high bigint, _n bigint, _sequence bigint, _offset bigint, padded_to bigint",
    )
    index = F.col("_ordinal") - F.col("_low")
    # At most a few rows per pattern and length of the capacity, whatever the input.
    return numbered.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length")) & F.col("_ordinal").between(F.col("_low"), F.col("_high")),
    ).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(index / F.col("_n"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + index % F.col("_n") * F.col("length")).cast("bigint").alias("offset"),
        "padded_to",
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    # Stored first: numbering samples its input, which would tokenise every text twice.
    return pack(materialise(token_pieces(docs, doc_id, text, capacity), "pieces"), capacity)
