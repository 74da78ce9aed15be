"""SimHash near duplicates by segment popcounts and a grid join under the Manhattan distance.

A text's fingerprint has a bit set where more than half of the XXH64 values of its word shingles
have it. Fingerprints that differ in at most ``DISTANCE`` bits are linked.

The fingerprint is cut into ``DIMENSIONS`` segments of two bits and mapped to the number of set
bits of each: a point with 32 coordinates 0, 1 or 2. A flipped bit moves one coordinate by one,
so the Manhattan distance of two points is a lower bound of the Hamming distance. The range join
works on a grid over these points: the coordinates are dealt to ``parts`` groups, and since a
distance of at most d touches at most d groups, two points within it share the grid cell over
some ``parts - d`` of the groups. Points of one cell are compared by Manhattan distance first and
by the fingerprints themselves last. The coordinates are kept in unary code (0, 1, 3), where the
Manhattan distance is the number of differing bits. Every choice of ``parts`` is exact; more parts
mean more cells for each point and fewer points in a cell, and the number of fingerprints decides.

Only different fingerprints meet. A cell with more than ``CELL`` points is cut into portions, and
every pair of portions is a task of its own, so a full cell is many bounded tasks. A task reports
a spanning forest of its links, not all of them: classes stay the same and a dense group of n
fingerprints costs n rows. Classes are the connected components of the links.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; repeated shingles count each time; a very
long text is read in portions of ``CHUNK`` bytes; repeated rows stay rows of their own; a null
doc_id gets its class like any other and names it only where the class has no other id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import LOWER
from splitwarden.operators.components import edge_stars
from splitwarden.operators.scale import attach, bounded_broadcast, materialise

SHINGLE = 4
SEED = 42
DISTANCE = 4
DIMENSIONS = 32  # segments of two bits
CELL = 4096  # points of one portion of a cell
CHUNK = 1 << 20
_SMALL = 32  # cells up to this size are compared many at a time
_LOWER_BYTES = LOWER.tobytes()
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_EVEN = 0x5555555555555555
# Relative cost of one point in a cell and of one compared pair, for the choice of ``parts``.
_POINT_COST, _PAIR_COST = 100.0, 1.0
_MOST_PARTS = 6  # groups beyond the distance, at most


def _word_chunks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in portions of about ``CHUNK`` bytes."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        stop = gap.start() if gap else len(raw)
        yield raw[at:stop].translate(_LOWER_BYTES).split()
        at = stop


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 values of all shingles of a text, in portions."""
    words: list[bytes] = []
    seen = False
    for more in _word_chunks((text or "").encode()):
        words += more
        if len(words) < size:
            continue
        seen = True
        joined = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
        pairs = zip(starts.tolist(), ends[size - 1 :].tolist())
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        words = words[len(words) - size + 1 :]
    if words and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        total += len(hashes)
        for low in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def _fingerprint_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_rows(size), "doc_id bigint, fp bigint")


def embedding(fp: np.ndarray) -> np.ndarray:
    """The popcounts of the two-bit segments, each in unary code."""
    high = (fp >> np.uint64(1)) & np.uint64(_EVEN)
    low = fp & np.uint64(_EVEN)
    return (high | low) | ((high & low) << np.uint64(1))


def _embedding(fp: Column) -> Column:
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    low = fp.bitwiseAND(F.lit(_EVEN))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def grid_masks(parts: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of the coordinates that make the grids: all but ``distance`` of the groups."""
    groups = []
    for i in range(parts):
        low, high = i * DIMENSIONS // parts, (i + 1) * DIMENSIONS // parts
        groups.append(((1 << 2 * high) - 1) ^ ((1 << 2 * low) - 1))
    masks = [sum(chosen) for chosen in combinations(groups, parts - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_parts(points: int, distance: int = DISTANCE) -> int:
    """The number of groups with the least expected work; any number gives the same links."""

    def work(parts: int) -> float:
        grids = math.comb(parts, distance)
        # A coordinate of a random fingerprint holds 1.5 bits.
        share = 2.0 ** (-1.5 * DIMENSIONS * (parts - distance) / parts)
        return grids * (points * _POINT_COST + points * points / 2 * share * _PAIR_COST)

    return min(range(distance + 1, distance + 1 + _MOST_PARTS), key=work)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links within ``distance`` do.

    A breadth-first search: each point is compared once with all points not yet reached.
    """
    point = embedding(fp)
    left = np.arange(len(fp))
    ends: list[tuple[int, np.ndarray]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = np.flatnonzero(np.bitwise_count(point[left] ^ point[at]) <= distance)
        near = near[np.bitwise_count(fp[left[near]] ^ fp[at]) <= distance]
        if len(near):
            reached = left[near]
            ends.append((at, reached))
            queue += reached.tolist()
            left = np.delete(left, near)
    if not ends:
        return fp[:0], fp[:0]
    return np.repeat(fp[[a for a, _ in ends]], [len(r) for _, r in ends]), fp[np.concatenate([r for _, r in ends])]


def _cell_links(distance: int):
    """Links inside every cell; rows of a cell follow each other."""

    def links(keys: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        sizes = np.diff(np.append(begins, len(fp)))
        place = np.repeat(begins + sizes, sizes)  # end of the cell of each row
        point = embedding(fp)
        rows = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
        step = 1
        while len(rows):
            rows = rows[rows + step < place[rows]]
            near = rows[np.bitwise_count(point[rows] ^ point[rows + step]) <= distance]
            near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
            if len(near):
                yield fp[near], fp[near + step]
            step += 1
        for k in np.flatnonzero(sizes > _SMALL).tolist():
            yield forest(fp[begins[k] : begins[k] + sizes[k]], distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def out(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in links(keys, fp):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"]
                )

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _CELL_KEY], axis=1)
            keys = np.concatenate((held_keys, keys))
            fp = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
            if not len(fp):
                continue
            # The last cell may go on in the next batch; it has at most two portions of points.
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            held_keys, held = keys[last:], fp[last:]
            if last:
                yield from out(keys[:last], fp[:last])
        if len(held):
            yield from out(held_keys, held)

    return run


_CELL_KEY = ["grid", "cell", "i", "j"]


def near_links(
    points: DataFrame, distance: int = DISTANCE, parts: int | None = None, cell: int = CELL
) -> DataFrame:
    """Links (src, dst) between different ``fp`` that join all fingerprints within ``distance``.

    ``points`` has distinct ``fp``. The links are a part of all links with the same components.
    """
    if parts is None:
        parts = choose_parts(points.count(), distance)
    masks = grid_masks(parts, distance)
    grids = F.sequence(F.lit(0), F.lit(len(masks) - 1))
    mask = F.get(F.array(*[F.lit(m).cast("bigint") for m in masks]), F.col("grid"))
    placed = points.select("fp", F.explode(grids).alias("grid")).select(
        "fp", "grid", _embedding(F.col("fp")).bitwiseAND(mask).alias("cell")
    )
    full = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    full = materialise(full.select("grid", "cell", F.ceil(F.col("n") / cell).cast("int").alias("s")), "full-cells")
    if full.isEmpty():
        tasks = placed.select("fp", "grid", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        # Portions i <= j of a full cell are compared in a task of their own.
        own = F.pmod(F.xxhash64("fp"), F.coalesce("s", F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))
        tasks = (
            placed.join(bounded_broadcast(full), ["grid", "cell"], "left")
            .select("fp", "grid", "cell", own.alias("a"), others.alias("b"))
            .select("fp", "grid", "cell", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
        )
    ordered = tasks.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY)
    return ordered.mapInArrow(_cell_links(distance), "src bigint, dst bigint")


def simhash_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    distance: int = DISTANCE,
    parts: int | None = None,
    cell: int = CELL,
) -> DataFrame:
    """Every row with ``fp`` and ``component_id``, the least doc_id that links lead to."""
    rows = materialise(fingerprints(docs, doc_id, text, size), "fingerprints")
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    labels = edge_stars(near_links(points.select("fp"), distance, parts, cell))
    labelled = points.join(labels.select(F.col("src").alias("fp"), "dst"), "fp", "left").select(
        "fp", "n", "least", F.coalesce("dst", "fp").alias("component")
    )
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = attach(labelled.select("fp", "n", "component"), names, "component", "members")
    return attach(rows, named.select("fp", "n", "component_id"), "fp", "n").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
