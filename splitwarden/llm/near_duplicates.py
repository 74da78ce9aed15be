"""Near-duplicate documents by ProbMinHash over word shingles.

Signature. Every distinct shingle of a text (``SHINGLE`` consecutive words; a shorter text is one
shingle) sends a Poisson process of arrivals whose rate is its weight; each arrival falls into a
register drawn at random, and a register keeps the first arrival. The next arrival of a shingle
comes after its last, so a shingle stops as soon as its arrival is later than the latest register
of the text (ProbMinHash, Ertl 2020). Two texts agree in a register with the probability Jaccard
similarity of their weighted shingles. All weights are equal here, however often a text repeats a
shingle: that similarity is then the Jaccard similarity of the sets, which is what is verified.

Banding. ``BANDS`` bands of ``ROWS`` registers: a pair at similarity 0.8 of the sets shares no
band with probability (1 - 0.8^6)^32 = 6e-5, whatever it repeats.

Verification. Jaccard similarity of the shingle sets, computed in full, at least 0.8. All
members of a bucket are compared with its hub (least content) and the links closed to classes.
Members that are then still in different classes meet by prefix filtering (``_unsettled``),
which loses no link and does not pair all texts that share an original; what meets is verified
in the same way.

Copies of one text are one content; they are never paired. A class is named by its least
doc_id.

Cases: a text without words (null, empty, only symbols) is a class of its own named by its own
doc_id; a null doc_id keeps its row, is never the name of a class that has another id, and a
class of null ids only has a null name; repeated rows get equal rows; ties of registers are
impossible between different shingles up to the hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import Words, grams, mix, slices, words_of
from splitwarden.operators.components import edge_stars
from splitwarden.operators.scale import materialise, release

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
_REGISTERS = BANDS * ROWS
COMMON = 100_000  # shingles whose frequency orders the prefixes; 1.6 MB in a broadcast
SLICE_COPIES = 4  # texts of a slice of 4 MB that hold a shingle before it is counted


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles, sorted by row and hash."""
    counts, first = words.counts(), words.first()
    hashes = grams(words.key, SHINGLE)
    at = np.flatnonzero(words.row[: len(hashes)] == words.row[SHINGLE - 1 :])
    rows, hashes = words.row[at], hashes[at]
    for size in range(1, SHINGLE):  # texts shorter than a shingle
        short = np.flatnonzero(counts == size)
        if len(short):
            rows = np.concatenate((rows, short))
            hashes = np.concatenate((hashes, grams(words.key, size)[first[short]]))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    return rows[starts], hashes[starts], np.diff(np.append(starts, len(rows)))


def signatures(rows: int, row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ProbMinHash registers, ``rows`` x ``_REGISTERS``, of weighted elements."""
    earliest = np.full(rows * _REGISTERS, np.inf)
    winner = np.zeros(rows * _REGISTERS, np.uint64)
    latest = np.full(rows, np.inf)
    time = np.zeros(len(row))
    arrival = 0
    while len(row):
        draw = mix(element ^ mix(np.full(1, arrival, np.uint64)))
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(unit) / weight
        alive = time < latest[row]
        row, element, weight, time, draw = (x[alive] for x in (row, element, weight, time, draw))
        slot = row * _REGISTERS + (mix(draw) % np.uint64(_REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = element[won]
        open_rows = np.unique(row)
        latest[open_rows] = earliest.reshape(rows, _REGISTERS)[open_rows].max(axis=1)
        arrival += 1
    return winner.reshape(rows, _REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, different between bands."""
    bands = registers.reshape(len(registers), BANDS, ROWS)
    total = np.zeros(bands.shape[:2], np.uint64)
    for i in range(ROWS):
        total = mix(total ^ bands[:, :, i])
    return mix(total + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, element, _ = shingles(words_of(part.column("text")))
            present = np.unique(row)
            dense = np.searchsorted(present, row)
            registers = signatures(len(present), dense, element, np.ones(len(row)))
            keys = band_keys(registers)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("content").take(pa.array(present)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(
                        pa.list_(pa.int64())
                    ),
                ],
                names=["content", "keys"],
            )


class Overlap:
    """Shingle sets of equal rows of ``a`` and ``b``, compared in full."""

    def __init__(self, a: Words, b: Words):
        ra, ea, _ = shingles(a)
        self.row, self.element, _ = shingles(b)
        rows, both = np.concatenate((ra, self.row)), np.concatenate((ea, self.element))
        side = np.arange(len(rows)) >= len(ra)
        order = np.lexsort((side, both, rows))
        same = np.zeros(len(rows), bool)
        same[1:] = (np.diff(rows[order]) == 0) & (both[order][1:] == both[order][:-1])
        twin = np.empty(len(rows), bool)
        twin[order] = same
        shared = np.bincount(self.row[twin[len(ra) :]], minlength=a.rows)
        self.size = np.bincount(self.row, minlength=a.rows)
        total = np.bincount(ra, minlength=a.rows) + self.size - shared
        self.jaccard = shared / np.maximum(total, 1)

    def prefixes(self, common: tuple[np.ndarray, np.ndarray]) -> pa.Array:
        """The first shingles of each b, rare ones first, then by hash."""
        known, counts = common
        slot = np.searchsorted(known, self.element)
        slot[slot == len(known)] = 0
        often = np.where(known[slot] == self.element, counts[slot], 0) if len(known) else slot
        order = np.lexsort((self.element, often, self.row))
        first = np.cumsum(self.size) - self.size
        place = np.arange(len(order)) - first[self.row[order]]
        wanted = place < _prefix(self.size)[self.row[order]]
        kept = np.bincount(self.row[order][wanted], minlength=len(self.size))
        offsets = np.concatenate(([0], np.cumsum(kept)))
        tokens = self.element[order][wanted].view(np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))

    def parities(self) -> pa.Array:
        """256 parity bits of the shingles of each b, as four numbers.

        A shingle that only one of two texts has flips one bit, so the number of different
        bits never exceeds the number of shingles that are not shared.
        """
        spot = self.element >> np.uint64(56)
        bit = np.uint64(1) << (spot & np.uint64(63))
        filled = np.flatnonzero(self.size)
        first = (np.cumsum(self.size) - self.size)[filled]
        out = np.zeros((len(self.size), 4), np.uint64)
        for word in range(4):
            own = np.where(spot >> np.uint64(6) == word, bit, np.uint64(0))
            if len(filled):
                out[filled, word] = np.bitwise_xor.reduceat(own, first)
        offsets = np.arange(0, 4 * len(self.size) + 1, 4)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel().view(np.int64)))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            _, element, _ = shingles(words_of(part.column("text")))
            found, count = np.unique(element, return_counts=True)
            often = count >= SLICE_COPIES
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(count[often])], names=["token", "n"]
            )


def common_shingles(contents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in many texts, with about how many, sorted; at most ``COMMON`` of them.

    They only set the order in which shingles enter prefixes. Any order gives the same links;
    this one keeps shingles that many texts share out of most prefixes.
    """
    counted = contents.mapInArrow(_frequent, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in rows], np.int64)[order]


def _prefix(size: np.ndarray) -> np.ndarray:
    """Shingles of the longer of two similar texts among which one must be shared."""
    return np.floor((1 - SIMILARITY) * size + 1e-9).astype(np.int64) + 1


def jaccard(a: Words, b: Words) -> np.ndarray:
    return Overlap(a, b).jaccard


def _verify(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                found = Overlap(words_of(part.column("text_a")), words_of(part.column("text_b")))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("a"),
                        part.column("b"),
                        pa.array(found.jaccard),
                        pa.array(found.size, pa.int64()),
                        found.prefixes(shared.value),
                        found.parities(),
                    ],
                    names=["a", "b", "similarity", "size", "prefix", "parity"],
                )

    return run


def _compared(pairs: DataFrame, contents: DataFrame, shared) -> DataFrame:
    """similarity, size and prefix of b for every pair (a, b); only texts of paired contents move."""
    ends = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    # The number of paired texts grows with the corpus: never a broadcast.
    texts = contents.join(ends.hint("merge"), "content", "left_semi")
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return joined.mapInArrow(
        _verify(shared),
        "a bigint, b bigint, similarity double, size bigint, prefix array<bigint>, parity array<bigint>",
    )


def content_classes(contents: DataFrame) -> DataFrame:
    """(content, class) of all contents linked to another; ``contents``: content, text, distinct."""
    shared = contents.sparkSession.sparkContext.broadcast(common_shingles(contents.select("text")))
    members = materialise(
        contents.mapInArrow(_sign, "content bigint, keys array<bigint>").select(
            "content", F.explode("keys").alias("bucket")
        ),
        "bands",
    )
    hubs = members.groupBy("bucket").agg(F.min("content").alias("hub"), F.count("*").alias("n"))
    hubs = materialise(hubs.filter("n > 1").select("bucket", "hub"), "hubs")
    spokes = (
        members.join(hubs, "bucket")
        .filter("content <> hub")
        .select(F.col("hub").alias("a"), F.col("content").alias("b"))
        .distinct()
    )
    spokes = materialise(spokes, "spokes")
    release(members, hubs)
    measured = materialise(_compared(spokes, contents, shared), "measured")
    release(spokes)
    links = measured.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    stars = edge_stars(links.toDF("dst", "src"))
    rest = materialise(_unsettled(measured, stars), "unsettled")
    if rest.isEmpty():
        classes = stars
    else:
        more = _compared(rest, contents, shared).filter(F.col("similarity") >= SIMILARITY)
        more = materialise(more.select("a", "b"), "links")
        classes = edge_stars(links.union(more).toDF("dst", "src"))
    return classes.select(F.col("src").alias("content"), F.col("dst").alias("class"))


def _unsettled(measured: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs of members in different classes that may be linked, by prefix filtering.

    Shingles are ordered by (about how many texts hold them, hash). If two texts have similarity t,
    at most (1 - t) / (1 + t) of the shorter and 1 - t of the longer text's shingles are not
    shared, so their first shared shingle lies in both prefixes, and the shingles before it bound
    the overlap. What many texts took from one original stands last in this order, so texts that
    only share a common passage or original rarely meet. Of those that do, a pair is made only
    where the parities allow so few shingles to differ.
    """
    classes = stars.select(F.col("src").alias("content"), F.col("dst").alias("class"))
    far = (
        measured.select(F.col("a").alias("hub"), F.col("b").alias("content"), "size", "prefix", "parity")
        .join(classes, "content", "left")
        .withColumn("class", F.coalesce("class", "content"))
        .join(classes.toDF("hub", "hub_class"), "hub", "left")
        .withColumn("outside", F.col("class") != F.coalesce("hub_class", "hub"))
    )
    # Only where a member is outside its hub's class can a link be unknown.
    open_hubs = far.filter("outside").select("hub").distinct()
    members = far.join(open_hubs, "hub", "left_semi").dropDuplicates(["content"])
    tokens = members.select(
        "content",
        "class",
        "size",
        *[F.get("parity", i).alias(f"p{i}") for i in range(4)],
        F.posexplode("prefix").alias("place", "token"),
    )
    share = (1 - SIMILARITY) / (1 + SIMILARITY)
    short = tokens.filter(F.col("place") <= F.col("size") * share + 1e-9)
    s, long = short.alias("s"), tokens.alias("l")
    both = F.col("s.size") + F.col("l.size")
    left = F.least(F.col("s.size") - F.col("s.place"), F.col("l.size") - F.col("l.place"))
    differ = sum(F.bit_count(F.col(f"s.p{i}").bitwiseXOR(F.col(f"l.p{i}"))) for i in range(4))
    met = s.join(
        long,
        (F.col("s.token") == F.col("l.token"))
        & (
            (F.col("s.size") < F.col("l.size"))
            | ((F.col("s.size") == F.col("l.size")) & (F.col("s.content") < F.col("l.content")))
        )
        & (F.col("s.class") != F.col("l.class"))
        & (left >= both * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
        & (differ <= both * share + 1e-6),
    )
    return met.select(
        F.least("s.content", "l.content").alias("a"), F.greatest("s.content", "l.content").alias("b")
    ).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least doc_id of its class), ``digest``.

    ``digest`` is the SHA-256 of the text, so a caller can find the row again.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.sha2("text", 256))
    contents = (
        rows.filter(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text"))
        .withColumn("content", F.monotonically_increasing_id())
    )
    contents = materialise(contents, "contents")
    classes = content_classes(contents.select("content", "text"))
    named = (
        contents.select("content", "digest", "first_id")
        .join(classes, "content", "left")
        .withColumn("class", F.coalesce("class", "content"))
    )
    named = named.join(
        named.groupBy("class").agg(F.min("first_id").alias("class_id")), "class"
    ).select("digest", "class_id", F.lit(True).alias("known"))
    result = rows.select("doc_id", "digest").join(named, "digest", "left")
    return result.select(
        "doc_id",
        F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "digest",
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class with its columns: the one with the least doc_id.

    Documents without words all stay. Of rows that share doc_id and text one stays; a class of
    null ids only keeps one of its texts.
    """
    classes = near_duplicates(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = materialise(
        classes.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "chosen"
    ).toDF("kept_id", "kept_digest", "copies")
    repeated = chosen.filter("copies > 1 OR kept_id IS NULL").isEmpty() is False
    # The columns get numbers, so no name of the input can clash.
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*place.values()).withColumn(
        "row_digest", F.sha2(F.coalesce(F.col(place[text]).cast("string"), F.lit("")), 256)
    )
    kept = rows.join(
        chosen,
        F.col(place[doc_id]).eqNullSafe(F.col("kept_id")) & (F.col("row_digest") == F.col("kept_digest")),
        "left_semi",
    )
    if repeated:
        kept = kept.dropDuplicates(["row_digest", place[doc_id]])
    return kept.select(*[F.col(place[c]).alias(c) for c in docs.columns])
