"""Near duplicates: all pairs of different contents whose hashes differ in few bits.

Hashes are compared by *masks*. For threshold T the 64 bits are cut into T + 1 blocks;
two hashes within T bits agree on at least one block, so joining on (block, bits) finds
every pair. Buckets that are too full are not skipped and not capped: their members move
to a finer level, where the remaining bits are cut again and the key is the union of the
agreeing blocks. The argument repeats at each level, so the search stays exact while the
buckets shrink. A pair is reported only in the first bucket on which its hashes agree,
which makes a final ``distinct`` unnecessary. The members of a bucket are compared in blocks by
NumPy, so candidates are numbers in a task and only pairs within the threshold become rows.

At the last level a bucket that is still too full is cut into portions; every pair of portions
(i <= j) is a shuffle key of its own, so one bucket is many bounded pieces of work.

The search runs over distinct hashes, and the review list over cells, a cell being all records
of one content in one class. A row of the list stands for all record pairs of two cells, whose
first records represent them; a membership table leads from every record to its cell. Its rows grow
with the contents, never with the square of their copies. ``record_pairs`` makes the whole list of
record pairs out of it, in which each pair has a decision of its own.
Records without a hash are compared with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.scale import (
    attach,
    bounded_broadcast,
    expand,
    materialise,
    number_rows,
)

HASH_BITS = 64
BUCKET_LIMIT = 8_000
# Masks are used when they leave at most one pair in so many to be compared.
SELECTIVE = 8
# Rows of a portion compared at once; with all of the other portion they are one block of numbers.
STRIP = 64
# Near pairs of nodes made at once of a strip, and links sent on in one batch.
PAIRS = 500_000
LINKS = 50_000
# Stands for a missing class, which is no other's class.
NO_CLASS = -(1 << 63)
MAX_LEVELS = 4
MAX_MASKS = 4_096
# Fixed value: the note on a pair that was accepted without review.
AUTO_NOTE = "Automatically grouped conservatively because dHash distance <= {threshold}."


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def cut(free: int, parts: int) -> list[int]:
    """Cut the set bits of ``free`` into ``parts`` masks of nearly equal size."""
    bits = [b for b in range(HASH_BITS) if free >> b & 1]
    masks = []
    for i in range(parts):
        piece = bits[i * len(bits) // parts : (i + 1) * len(bits) // parts]
        masks.append(sum(1 << b for b in piece))
    return masks


def mask_tree(threshold: int, levels: int, bits: int = HASH_BITS) -> list[dict[int, list[int]]]:
    """Per level: parent mask number -> masks that refine it (all numbers are positions).

    Level 0 has the single parent 0. Mask numbers of a level count its masks in order.
    """
    full = (1 << bits) - 1
    tree, parents = [], [0]
    for _ in range(levels):
        level = {
            number: [mask | piece for piece in cut(full & ~mask, threshold + 1)]
            for number, mask in enumerate(parents)
        }
        tree.append(level)
        parents = [m for masks in level.values() for m in masks]
    return tree


def _compare(threshold: int | None, earlier: list[list[int]]):
    """All pairs (h1, h2) of each bucket or pair of portions, whose rows come one after the other.

    With a threshold, only pairs h1 < h2 within it that agree on none of the ``earlier`` masks of
    their mask; without, every ordered pair.
    """
    before = [np.array([_signed(m) for m in masks], np.int64) for masks in earlier]

    def met(t: int, i: int, j: int, portion: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = i == j
        left, right = (hashes, hashes) if same else (hashes[portion == i], hashes[portion == j])
        for at in range(0, len(left), STRIP):
            a, b = left[at : at + STRIP], right[at:] if same and threshold is not None else right
            diff = a[:, None] ^ b[None, :]
            if threshold is None:
                h1, h2 = (x.ravel() for x in np.broadcast_arrays(a[:, None], b[None, :]))
                if not same:
                    h1, h2 = np.concatenate([h1, h2]), np.concatenate([h2, h1])
            else:
                x, y = np.nonzero(np.bitwise_count(diff.view(np.uint64)) <= threshold)
                if same:
                    x, y = x[x < y], y[x < y]
                first = ~((diff[x, y][:, None] & before[t]) == 0).any(axis=1)
                x, y = x[first], y[first]
                h1, h2 = np.minimum(a[x], b[y]), np.maximum(a[x], b[y])
            if len(h1):
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2)], names=["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            yield from met(*[int(rows[k, 0]) for k in (0, 2, 3)], rows[4], rows[5])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each bucket or pair of portions, one array row per column."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        starts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
        for part in np.split(rows, starts, axis=1):
            if held and (held[0][:4, 0] != part[:4, 0]).any():
                yield np.concatenate(held, axis=1)
                held = []
            if part.shape[1]:
                held.append(part)
    if held:
        yield np.concatenate(held, axis=1)


def _total(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products, which may pass 64 bits."""
    if len(a) and float(a.max()) * float(b.max()) * len(a) >= 2.0**62:
        return sum(x * y for x, y in zip(a.tolist(), b.tolist()))
    return int(np.dot(a, b))


def _link(threshold: int, earlier: list[list[int]]):
    """What near hashes join, reduced where they are compared; see ``near_hash_links``.

    Rows of a bucket are nodes, that is hashes in a class. Their near pairs of one class become a
    spanning forest, at most a link for each node of the bucket; numbers of record pairs are summed.
    """
    before = [np.array([_signed(m) for m in masks], np.int64) for masks in earlier]

    def met(rows: np.ndarray, sums: dict[int, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t, i, j = (int(rows[k, 0]) for k in (0, 2, 3))
        _, rank = np.unique(rows[6], return_inverse=True)
        order = np.lexsort((rank, rows[5]))
        rank, (portion, dhash, label, n, hub) = rank[order], rows[4:, order]
        # Nodes of a hash stand together, from ``start`` on; ``node`` finds one by hash and class.
        hashes, start, which, owned = np.unique(dhash, return_index=True, return_inverse=True, return_counts=True)
        held, classes = np.add.reduceat(n, start), int(rank.max()) + 1
        node = which * classes + rank
        root = np.arange(len(dhash))
        left, right = (np.flatnonzero(portion[start] == k) for k in (i, j))
        for at in range(0, len(left), STRIP):
            one, two = left[at : at + STRIP], right[at:] if i == j else right
            diff = hashes[one][:, None] ^ hashes[two][None, :]
            x, y = np.nonzero(np.bitwise_count(diff.view(np.uint64)) <= threshold)
            if i == j:
                x, y = x[x < y], y[x < y]
            first = ~((diff[x, y][:, None] & before[t]) == 0).any(axis=1)
            x, y = x[first], y[first]
            apart = np.bitwise_count(diff[x, y].view(np.uint64))
            one, two = one[x], two[y]
            step = max(1, PAIRS // int(owned.max()))
            for k in range(0, len(one), step):
                far, a, b = apart[k : k + step], one[k : k + step], two[k : k + step]
                # The nodes of the first hash, and those of the second in the same class.
                u = np.repeat(start[a], owned[a])
                u += np.arange(len(u)) - np.repeat(np.cumsum(owned[a]) - owned[a], owned[a])
                sought = np.repeat(b, owned[a]) * classes + rank[u]
                v = np.minimum(np.searchsorted(node, sought), len(node) - 1)
                same = (node[v] == sought) & (label[u] != NO_CLASS)
                inner, u, v = np.repeat(far, owned[a])[same], u[same], v[same]
                for d in np.unique(far).tolist():
                    total = sums.setdefault(d, [0, 0])
                    total[0] += _total(held[a[far == d]], held[b[far == d]])
                    total[1] += _total(n[u[inner == d]], n[v[inner == d]])
                while len(u):
                    open_ = root[u] != root[v]
                    u, v = u[open_], v[open_]
                    if len(u):
                        # All trees that the first node is near to become one.
                        ends = v[u == u[0]]
                        trees, chosen = np.unique(root[ends], return_index=True)
                        yield np.full(len(trees), hub[u[0]]), hub[ends[chosen]]
                        joined = np.zeros(len(root), bool)
                        joined[trees] = True
                        root[joined[root]] = root[u[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        made: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for rows in _buckets(batches):
            for pair in met(rows, sums):
                made.append(pair)
                waiting += len(pair[0])
            if waiting >= LINKS:
                yield links(made)
                made, waiting = [], 0
        if made:
            yield links(made)
        found = sorted(sums.items())
        yield batch(
            pa.nulls(len(found), pa.int64()),
            pa.nulls(len(found), pa.int64()),
            pa.array([d for d, _ in found], pa.int32()),
            pa.array([str(both[0]) for _, both in found], pa.string()),
            pa.array([str(both[1]) for _, both in found], pa.string()),
        )

    def links(made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        one, two = (np.concatenate(ends) for ends in zip(*made))
        none = [pa.nulls(len(one), kind) for kind in (pa.int32(), pa.string(), pa.string())]
        return batch(pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two)), *none)

    def batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["src", "dst", "distance", "pairs", "same_class"])

    return run


def _bucket_pairs(
    keyed: DataFrame,
    key: list[str],
    limit: int | None,
    threshold: int | None = None,
    earlier: list[list[int]] | None = None,
) -> DataFrame:
    """Pairs (h1, h2) of the hashes of each bucket, compared in tasks and never made as rows."""
    return _dealt(keyed, key, limit).mapInArrow(_compare(threshold, earlier or []), "h1 bigint, h2 bigint")


def _dealt(keyed: DataFrame, key: list[str], limit: int | None, carried: Sequence[str] = ()) -> DataFrame:
    """The members of each bucket one after the other: mask, bits, portions, hash and ``carried``.

    ``key`` is the mask number, and the agreeing bits if there are several buckets of a mask. A
    bucket with more members than ``limit`` is cut into portions of about ``limit``; a task gets one
    pair of portions, and two hashes of different portions meet only where both are.
    """
    spark = keyed.sparkSession
    full = None
    if limit is not None:
        full = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        full = materialise(full.select(*key, F.ceil(F.col("n") / limit).cast("int").alias("parts")), "full")
    if full is None or full.isEmpty():
        dealt = keyed.select("dhash", *carried, *key, *[F.lit(0).alias(c) for c in ("portion", "i", "j")])
    else:
        parts = F.coalesce("parts", F.lit(1))
        portion = F.pmod(F.xxhash64("dhash"), parts).cast("int")
        dealt = (
            keyed.join(bounded_broadcast(full), key, "left")
            .select("dhash", *carried, *key, portion.alias("portion"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            .select("dhash", *carried, *key, "portion", F.least("portion", "other").alias("i"), F.greatest("portion", "other").alias("j"))
        )
    bits = F.col(key[1]) if len(key) > 1 else F.lit(0).cast("bigint")
    rows = dealt.select(F.col(key[0]).alias("t"), bits.alias("key"), "i", "j", "portion", "dhash", *carried)
    # A given number, as AQE would join parts by their bytes and their work is the square of that.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    group = ["t", "key", "i", "j"]
    return rows.repartition(tasks, *group).sortWithinPartitions(*group)


def near_hash_pairs(
    hashes: DataFrame,
    threshold: int,
    bucket_limit: int = BUCKET_LIMIT,
    max_levels: int = MAX_LEVELS,
    bits: int = HASH_BITS,
) -> DataFrame:
    """Pairs of distinct hashes (h1 < h2) with 1 <= distance <= threshold.

    ``hashes`` has one column ``dhash``; duplicates are removed first. ``bits`` is the
    used width of the hash. Where masks would hardly part the hashes, all of them are one bucket.
    """
    distinct = materialise(hashes.filter("dhash IS NOT NULL").select("dhash").distinct(), "hashes")

    def compared(keyed: DataFrame, key: list[str], limit: int | None, earlier: list[list[int]]) -> DataFrame:
        return _with_distance(_bucket_pairs(keyed, key, limit, threshold, earlier))

    return _search(distinct, threshold, compared, bucket_limit, max_levels, bits)


def near_hash_links(
    records: DataFrame,
    threshold: int,
    bucket_limit: int = BUCKET_LIMIT,
    max_levels: int = MAX_LEVELS,
    bits: int = HASH_BITS,
) -> DataFrame:
    """What near hashes join, without a row for each pair of them; written once.

    The hashes of a class are nodes, named by their first records. Rows with ``src`` and ``dst``
    (src > dst) link near nodes of one class; in each bucket they are a spanning forest of its near
    pairs, so rows grow with the nodes, and a node with a near one has a link. Rows with ``distance``
    hold parts of the numbers of record pairs, all (``pairs``) and within a class (``same_class``).
    """
    label = F.coalesce(F.col("class_index").cast("bigint"), F.lit(NO_CLASS)).alias("label")
    nodes = records.filter("dhash IS NOT NULL").groupBy("dhash", label).agg(
        F.count("*").alias("n"), F.min("row_no").alias("hub")
    )
    carried = ["label", "n", "hub"]

    def compared(keyed: DataFrame, key: list[str], limit: int | None, earlier: list[list[int]]) -> DataFrame:
        return _dealt(keyed, key, limit, carried).mapInArrow(
            _link(threshold, earlier), "src bigint, dst bigint, distance int, pairs string, same_class string"
        )

    found = _search(materialise(nodes, "hashes"), threshold, compared, bucket_limit, max_levels, bits, carried)
    return materialise(found, "hash-links")


def _search(
    distinct: DataFrame,
    threshold: int,
    compared: Callable[[DataFrame, list[str], int | None, list[list[int]]], DataFrame],
    bucket_limit: int,
    max_levels: int,
    bits: int,
    carried: Sequence[str] = (),
) -> DataFrame:
    """The results of ``compared`` over buckets in which every near pair has its turn once."""
    if threshold < 0:
        raise ValueError("threshold cannot be negative")
    while max_levels > 1 and (threshold + 1) ** max_levels > MAX_MASKS:
        max_levels -= 1
    if (threshold + 1) * SELECTIVE > 1 << bits // (threshold + 1):
        return compared(distinct.withColumn("t", F.lit(0)), ["t"], bucket_limit, [[]])
    tree = mask_tree(threshold, max_levels, bits)
    # Members of the current level: the hash, what it carries and its bucket's mask number.
    members = distinct.withColumn("m", F.lit(0))
    found = []
    # Masks on which a pair must not agree, by mask number: earlier siblings of a mask and of those
    # it refines. So a pair is reported once.
    above: list[list[int]] = [[]]
    for depth, level in enumerate(tree):
        siblings = [level[n] for n in sorted(level)]
        flat = [m for masks in siblings for m in masks]
        above = [above[n] + masks[:at] for n, masks in enumerate(siblings) for at in range(len(masks))]
        first_child = [sum(len(s) for s in siblings[:i]) for i in range(len(siblings))]
        # Explode each member into the masks below its parent.
        spans = F.array(
            *[
                F.sequence(F.lit(first), F.lit(first + len(masks) - 1))
                for first, masks in zip(first_child, siblings)
            ]
        )
        masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in flat])
        keyed = (
            members.withColumn("t", F.explode(F.get(spans, F.col("m"))))
            .withColumn("key", F.col("dhash").bitwiseAND(F.get(masks, F.col("t"))))
            .select("dhash", *carried, "t", "key")
        )
        last = depth == max_levels - 1
        if not last:
            full = (
                keyed.groupBy("t", "key").count().filter(F.col("count") > bucket_limit)
            ).select("t", "key", F.lit(True).alias("full"))
            full = materialise(full, "full")
            if full.isEmpty():
                last = True
            else:
                flagged = keyed.join(bounded_broadcast(full), ["t", "key"], "left")
                flagged = materialise(flagged, "buckets")
                keyed = flagged.filter("full IS NULL").drop("full")
                members = flagged.filter("full").select("dhash", *carried, F.col("t").alias("m"))
        found.append(compared(keyed, ["t", "key"], bucket_limit if last else None, above))
        if last:
            break
    return reduce(DataFrame.unionByName, found)


def _with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.select("h1", "h2", F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))).alias("distance"))


_CELL = ["sha256", "class_name"]


def content_cells(records: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per content and class: number of records and the first of them."""
    return records.filter("dhash IS NOT NULL").groupBy("dhash", *_CELL).agg(
        F.count("*").alias("n"),
        F.min(F.struct("row_no", "relative_path", "path", *carried)).alias("first"),
    )


def near_duplicates(
    records: DataFrame,
    threshold: int,
    hash_pairs: DataFrame | None = None,
    bits: int = HASH_BITS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """The review list: pairs of cells with different content within ``threshold`` bits.

    Each row names the first records of its cells, in scan order, and ``n_pairs``, the number of
    record pairs it stands for. ``carried`` columns of the first records come along, so that nobody
    has to join the list with the records for them.
    """
    cells = content_cells(records, carried).select("dhash", *_CELL, "n", "first.*")
    cells = materialise(cells, "cells")
    if hash_pairs is None:
        hash_pairs = near_hash_pairs(cells, threshold, bits=bits)
    crowded = cells.groupBy("dhash").agg(F.count("*").alias("cells")).filter("cells > 1").select("dhash")
    same = crowded.select(F.col("dhash").alias("h1"), F.col("dhash").alias("h2"), F.lit(0).alias("distance"))
    wanted = materialise(hash_pairs.unionByName(same), "hash-pairs")
    # Contents are compared by number, and columns stay apart, so that a shuffle of pairs carries only
    # what the caller reads of them.
    contents = cells.groupBy("sha256").agg(F.min("row_no").alias("content"), F.count("*").alias("_cells"))
    numbered = attach(cells, contents, "sha256", "_cells", keep_size=False)
    fields = {
        "row_no": "row", "relative_path": "relative_path", "class_name": "class", "path": "path",
        "sha256": "sha256", "n": "n", "content": "content",
    } | {c: c for c in carried}

    def side(hash_name: str, mark: str) -> DataFrame:
        named = [F.col(field).alias(f"{name}_{mark}") for field, name in fields.items()]
        return numbered.select(F.col("dhash").alias(hash_name), *named)

    met = expand(expand(wanted, side("h1", "a"), "h1"), side("h2", "b"), "h2").filter(
        "content_a <> content_b AND (h1 <> h2 OR row_a < row_b)"
    )
    swapped = F.col("row_a") > F.col("row_b")
    sides = [
        F.when(swapped, F.col(f"{name}_{other}")).otherwise(F.col(f"{name}_{mark}")).alias(f"{name}_{i}")
        for i, mark, other in ((1, "a", "b"), (2, "b", "a"))
        for name in fields.values()
        if name != "content"
    ]
    return met.select(
        *sides,
        F.col("distance").alias("dhash_distance"),
        (F.col("class_a") != F.col("class_b")).alias("cross_class_candidate"),
        _product(F.col("n_a"), F.col("n_b")).alias("n_pairs"),
    )


def record_pairs(pairs: DataFrame, records: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Every pair of records that the review list stands for, the first one earlier in scan order.

    ``pairs`` is read several times, so it should be a stored table; ``carried`` are the columns it
    was made with. Only cells with copies are joined with their records, and every row made is a pair.
    ``n_pairs`` stays that of the two cells.
    """
    cell = F.struct("dhash", *_CELL).alias("cell")
    firsts = content_cells(records).filter("n > 1").select(cell, "n", F.col("first.row_no").alias("row"))
    rows = records.filter("dhash IS NOT NULL").select(cell, "row_no", "relative_path", *carried)
    copies = materialise(attach(rows, firsts, "cell", "n", keep_size=False).drop("cell"), "copies")
    own = ["row", "relative_path", *carried]

    def members(list_: DataFrame, i: int) -> DataFrame:
        """The records of the cells at one end, named as the end was."""
        old = [f"{c}_{i}" for c in own]
        rest = [c for c in list_.columns if c not in old]
        side = copies.select(F.col("row").alias(old[0]), *[F.col(c).alias(f"_{c}") for c in ("row_no", *own[1:])])
        many = expand(list_.filter(F.col(f"n_{i}") > 1), side, old[0]).select(
            F.col("_row_no").alias(old[0]), *[F.col(f"_{c}").alias(f"{c}_{i}") for c in own[1:]], *rest
        )
        return list_.filter(F.col(f"n_{i}") == 1).select(*old, *rest).unionByName(many)

    found = members(members(pairs, 1), 2)
    # A later copy of the first cell may come after a record of the second.
    ends = [*own, "class"]
    swapped = F.col("row_1") > F.col("row_2")
    sides = [
        F.when(swapped, F.col(f"{c}_{3 - i}")).otherwise(F.col(f"{c}_{i}")).alias(f"{c}_{i}")
        for i in (1, 2)
        for c in ends
    ]
    return found.select(*sides, "dhash_distance", "cross_class_candidate", "n_pairs")


def _product(a: Column, b: Column) -> Column:
    """A product of counts; it may pass 64 bits."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def near_members(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every record of a listed cell with the record that represents it and its number of links.

    ``n_links`` counts the records that the record forms near pairs with.
    """
    ends = _ends(pairs, others=(F.col("n_2"), F.col("n_1")))
    linked = ends.groupBy("row_no", "n").agg(F.sum("others").alias("n_links"))
    facts = linked.join(records.select("row_no", "relative_path", *_CELL), "row_no").select(
        *_CELL, F.col("relative_path").alias("representative"), F.col("n").alias("copies"), "n_links"
    )
    return attach(records.select("row_no", "relative_path", *_CELL), facts, _CELL, "copies")


def _ends(pairs: DataFrame, **more: tuple[Column, Column]) -> DataFrame:
    """Both cells of every listed pair: first record, size and ``more``, given for both ends."""
    ends = [
        F.struct(
            F.col(f"row_{i + 1}").alias("row_no"),
            F.col(f"n_{i + 1}").alias("n"),
            *[both[i].alias(name) for name, both in more.items()],
        )
        for i in (0, 1)
    ]
    return pairs.select(F.explode(F.array(*ends)).alias("end")).select("end.*")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_id`` by distance, then first path, then second path."""

    numbered = number_rows(
        pairs, ["dhash_distance", "relative_path_1", "relative_path_2"], {"_pair": []}
    )
    return numbered.select(K.near_id(F.col("_pair")).alias("pair_id"), *pairs.columns)


def apply_review(pairs: DataFrame, review: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Carry earlier decisions and notes onto a list of pairs.

    Without ``records`` the list has all pairs of records, and a decision holds for the two that it
    names. With them the list has pairs of cells, and a decision on any two records holds for their
    cells. Where decisions on one pair differ, yes goes before no and no before none, and among equal
    ones the least note stays.
    """
    if records is None:
        key = K.pair_key(F.col("relative_path_1"), F.col("relative_path_2"))
        named = review.select(
            key.alias("pair"),
            K.normalise_decision(F.col("decision")).alias("decision"),
            F.coalesce("notes", F.lit("")).alias("notes"),
        )
        return _decided(pairs.withColumn("pair", key), named, ["pair"], pairs.columns)
    # A cell goes by the number of its first record: shuffles carry two numbers for each pair.
    rows = records.select("row_no", "relative_path", "dhash", F.struct(*_CELL).alias("content"))
    firsts = rows.groupBy("content").agg(F.min("row_no").alias("cell"), F.count("*").alias("_rows"))
    known = attach(rows, firsts, "content", "_rows", keep_size=False).drop("content")
    known = materialise(known, "cell-numbers")
    side = known.select("relative_path", "cell")
    found = (
        review.join(side.toDF("relative_path_1", "cell_1"), "relative_path_1")
        .join(side.toDF("relative_path_2", "cell_2"), "relative_path_2")
        .select(
            F.least("cell_1", "cell_2").alias("low"),
            F.greatest("cell_1", "cell_2").alias("high"),
            K.normalise_decision(F.col("decision")).alias("decision"),
            F.coalesce("notes", F.lit("")).alias("notes"),
        )
    )
    # Records of one content with several hashes are one cell here and several in the list.
    listed = known.filter("dhash IS NOT NULL").groupBy("dhash", "cell").agg(F.min("row_no").alias("row_no"))
    moved = materialise(listed.filter("row_no <> cell").select("row_no", "cell"), "moved")
    keyed = pairs.withColumns({"cell_1": F.col("row_1"), "cell_2": F.col("row_2")})
    if not moved.isEmpty():
        for i in (1, 2):
            to = bounded_broadcast(moved.toDF(f"row_{i}", "_cell"))
            keyed = keyed.join(to, f"row_{i}", "left").withColumn(f"cell_{i}", F.coalesce("_cell", f"cell_{i}")).drop("_cell")
    keyed = keyed.withColumns({"low": F.least("cell_1", "cell_2"), "high": F.greatest("cell_1", "cell_2")})
    return _decided(keyed, found, ["low", "high"], pairs.columns)


def _decided(pairs: DataFrame, found: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    weight = F.when(F.col("decision") == "yes", 0).when(F.col("decision") == "no", 1).otherwise(2)
    earlier = found.groupBy(*key).agg(F.min(F.struct(weight.alias("rank"), "notes", "decision")).alias("kept"))
    return pairs.join(earlier, key, "left").select(
        *columns,
        F.coalesce("kept.decision", F.lit("")).alias("decision"),
        F.coalesce("kept.notes", F.lit("")).alias("notes"),
    )


def auto_group(pairs: DataFrame, threshold: int) -> DataFrame:
    """Accept every unresolved same-class pair; decisions and notes already made stay."""
    taken = (F.col("decision") == "") & ~F.col("cross_class_candidate")
    note = AUTO_NOTE.format(threshold=threshold)
    return pairs.withColumns(
        {
            "notes": F.when(taken & (F.col("notes") == ""), F.lit(note)).otherwise(F.col("notes")),
            "decision": F.when(taken, F.lit("yes")).otherwise(F.col("decision")),
        }
    )


def confirmed_edges(pairs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Links (src > dst) of confirmed pairs within one class.

    Without ``records`` the list has all pairs of records, and each confirmed one is a link. With them
    it has pairs of cells: one link joins the first records of two cells, and a star joins each cell
    to its first record, the same groups as a decision on all their record pairs would give.
    """
    accepted = pairs.filter("decision = 'yes' AND NOT cross_class_candidate")
    if records is None:
        return accepted.select(F.col("row_2").alias("src"), F.col("row_1").alias("dst"))
    accepted = materialise(accepted.select("row_1", "row_2", "n_1", "n_2"), "accepted")
    bridges = accepted.select(F.col("row_2").alias("src"), F.col("row_1").alias("dst"))
    cells = _ends(accepted).filter("n > 1").distinct()
    first = records.select("row_no", *_CELL)
    cells = cells.join(first, "row_no").withColumnRenamed("row_no", "dst")
    rows = records.select(*_CELL, F.col("row_no").alias("src"))
    stars = attach(rows, cells, _CELL, "n").filter("src <> dst").select("src", "dst")
    return bridges.unionByName(stars)


def confirmed_by_path(review: DataFrame, records: DataFrame) -> DataFrame:
    """Confirmed pairs of a review table looked up in the records, with both classes."""
    side = records.select("relative_path", "row_no", "class_name")
    first = side.toDF("relative_path_1", "row_1", "class_1")
    second = side.toDF("relative_path_2", "row_2", "class_2")
    yes = review.filter(K.normalise_decision(F.col("decision")) == "yes").select(
        "relative_path_1", "relative_path_2"
    )
    found = yes.join(first, "relative_path_1").join(second, "relative_path_2")
    return found.withColumn("cross_class_candidate", F.col("class_1") != F.col("class_2"))


def near_pair_totals(
    records: DataFrame, threshold: int, links: DataFrame | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Number of record pairs and of cross-class record pairs per distance, never listing them.

    A pair of hashes with n1 and n2 records stands for n1 * n2 record pairs; inside one
    hash the pairs of equal content are subtracted. The same products per class give the
    same-class pairs. ``links`` is what ``near_hash_links`` gave, where the products of near hashes
    are summed.
    """
    cells = materialise(
        records.filter("dhash IS NOT NULL")
        .groupBy("dhash", "class_index", "sha256")
        .agg(F.count("*").alias("n")),
        "cells",
    )
    if links is None:
        links = near_hash_links(records, threshold, bits=bits)
    square = _product(F.col("n"), F.col("n"))
    per_class = cells.groupBy("dhash", "class_index").agg(
        F.sum("n").alias("n"), F.sum(square).cast("decimal(38,0)").alias("same_content")
    )
    per_content = cells.groupBy("dhash", "sha256").agg(F.sum("n").alias("n"))
    inside = per_content.groupBy("dhash").agg(
        ((_product(F.sum("n"), F.sum("n")) - F.sum(square)) / 2).cast("decimal(38,0)").alias("pairs")
    )
    inside_same = per_class.groupBy("dhash").agg(
        F.sum((square - F.col("same_content")) / 2).cast("decimal(38,0)").alias("same_class")
    )
    within = inside.join(inside_same, "dhash").agg(
        F.lit(0).alias("dhash_distance"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("same_class"), F.lit(0)).alias("same_class"),
    )
    part = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("pairs", "same_class")]
    between = links.filter("distance IS NOT NULL").groupBy(F.col("distance").alias("dhash_distance")).agg(*part)
    return within.unionByName(between).filter("pairs > 0").select(
        "dhash_distance",
        F.col("pairs").cast("decimal(38,0)").alias("pairs"),
        (F.col("pairs") - F.col("same_class")).cast("decimal(38,0)").alias("cross_class_pairs"),
    )


def auto_edges(
    records: DataFrame, threshold: int, links: DataFrame | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """Links (src > dst) joining what automatic grouping joins, without listing pairs.

    Within a class, the records of one hash are all linked when they hold two different
    contents or when another hash of the class is near. Then a star to the first record
    of the (class, hash) and one link between the first records of near hashes connect
    exactly the same records as all the pairs would. Valid while no earlier review
    rejects a pair; with rejections use ``confirmed_edges`` on the reviewed pairs.
    """
    nodes = materialise(
        records.filter("dhash IS NOT NULL").groupBy("class_index", "dhash").agg(
            F.count("*").alias("n"),
            F.min("row_no").alias("hub"),
            F.min("sha256").alias("_low"),
            F.max("sha256").alias("_high"),
        ),
        "nodes",
    )
    if links is None:
        links = near_hash_links(records, threshold, bits=bits)
    bridges = links.filter("src IS NOT NULL").select("src", "dst")
    linked = (
        bridges.select(F.explode(F.array("src", "dst")).alias("hub")).distinct()
        .withColumn("_near", F.lit(True))
    )
    active = (
        nodes.join(linked, "hub", "left")
        .filter((F.col("_low") < F.col("_high")) | F.col("_near"))
        .select(F.struct("class_index", "dhash").alias("node"), "hub", "n")
    )
    rows = records.select(
        F.struct("class_index", "dhash").alias("node"), F.col("row_no").alias("src")
    )

    stars = attach(rows, active, "node", "n").select("src", F.col("hub").alias("dst"))
    return stars.unionByName(bridges)
