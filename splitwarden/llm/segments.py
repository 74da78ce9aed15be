"""Duplicate passages by hashing of units, with the original offsets kept.

A unit is a line or a part of a line: lines are cut at content-defined words (a word whose key
is less than those of the ``REACH`` words before it and not more than those of the ``REACH``
words after it), so a passage gives the same units wherever it stands inside a line. Units are
normalised to lower-case words and hashed to 96 bits by two independent word keys; digests are
grouped over the whole corpus, the earliest unit (least doc_id, then least offset) stays, and the
rest are repeats. Two repeats that follow each other are joined where their keepers follow each
other too, or where the pair of them stands somewhere earlier in the corpus; a run of at least
``min_words`` words is reported for removal. Shorter repeats, such as a notice of one sentence,
whole lines among them, or two notices that stand together for the first time, are left alone:
``min_words`` is the parameter for that (on 10,000 documents of the test tables such short repeats
hold 23 % of all repeated words).

Most units occur once, so they are sorted out early: a first pass shuffles nothing but 64-bit
digests, and a Bloom filter of those seen twice (at most ``FILTER_BITS`` bits, fewer for fewer
digests) goes to the second pass, which leaves out what it excludes. The filter only saves
shuffling: where it is full, more units travel, and the exact counts decide all the same.

Cases: null and empty texts have no units; a null doc_id ranks last; rows with the same doc_id
and text are one document, so they do not repeat each other and their spans are reported once
(units at one offset under one doc_id count as the same place);
very long texts are cut a slice at a time, one text in one slice; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitwarden.llm.text import LOWER, Words, as_bytes, mix, range_hash, slices, words_of
from splitwarden.operators.scale import materialise, release

REACH = 3
MIN_WORDS = 16
FILTER_BITS = 28  # of the Bloom filter, as a power of two: 32 MB at most
_CHUNK_BITS = 20  # bits of one piece of the filter, as a power of two
_BITS_PER_DIGEST = 8
_UNITS = (
    "doc_id bigint, text_key bigint, unit bigint, start bigint, stop bigint, words bigint, "
    "hash_a bigint, hash_b int"
)


def _cuts(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each word."""
    begins = np.ones(len(key), bool)
    begins[1:] = line[1:] != line[:-1]
    lowest = np.ones(len(key), bool)
    for k in range(1, REACH + 1):
        if len(key) <= k:
            break
        same = line[k:] == line[:-k]
        lowest[k:] &= ~same | (key[k:] < key[:-k])
        lowest[:-k] &= ~same | (key[:-k] <= key[k:])
    return begins | lowest


def _digest(key: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the word sequence of each unit."""
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    salted = mix(key ^ mix(place.astype(np.uint64) + np.uint64(seed)))
    return mix(np.add.reduceat(salted, starts)).view(np.int64)


def _slots(digest: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two places of every digest in a filter of 2**bits bits."""
    high = mix(digest.view(np.uint64) + np.uint64(7))
    return [(h >> np.uint64(64 - bits)).astype(np.int64) for h in (high, high << np.uint64(bits))]


@dataclass
class _Cut:
    """Units of a slice: first word, end word, row and digests."""

    words: Words
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash_a: np.ndarray


def _cut(part: pa.RecordBatch) -> _Cut | None:
    words = words_of(part.column("text"))
    if not len(words.key):
        return None
    newline = np.cumsum(words.data == 10)
    # Words of different rows are on different lines even without a line end between.
    line = newline[words.start] + words.row.astype(np.int64) * (len(words.data) + 1)
    starts = np.flatnonzero(_cuts(words.key, line))
    ends = np.append(starts[1:], len(words.key))
    return _Cut(words, starts, ends, words.row[starts], _digest(words.key, starts, 1))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest once per slice, and whether it is known to occur again."""
    for batch in batches:
        for part in slices(batch, "text"):
            found = _cut(part)
            if found:
                digest, times = np.unique(found.hash_a, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest), pa.array(np.minimum(times, 2).astype(np.int8))], names=["hash_a", "n"]
                )


def _filter_pieces(bits: int):
    """(piece, bitmap): the parts of the filter that the digests of this task set."""
    size = 1 << min(bits, _CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for piece in np.unique(slot // size).tolist():
                bitmap = pieces.setdefault(piece, np.zeros(size, bool))
                bitmap[slot[slot // size == piece] % size] = True
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(pieces), pa.int64()),
                pa.array([np.packbits(b, bitorder="little").tobytes() for b in pieces.values()], pa.binary()),
            ],
            names=["piece", "bitmap"],
        )

    return run


def _both_slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(batch.column("hash_a").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots))], names=["slot"])

    return run


def repeat_filter(narrow: DataFrame) -> bytes:
    """A Bloom filter of the digests that occur twice or more; its length tells its size."""
    counts = narrow.select("text").mapInArrow(_digests, "hash_a bigint, n tinyint")
    repeated = counts.groupBy("hash_a").agg(F.sum("n").alias("n")).filter("n > 1").select("hash_a")
    repeated = materialise(repeated, "repeated-digests")
    wanted = max(8, repeated.count() * _BITS_PER_DIGEST)
    bits = min(FILTER_BITS, (wanted - 1).bit_length())
    size = 1 << min(bits, _CHUNK_BITS)
    slots = repeated.mapInArrow(_both_slots(bits), "slot bigint")
    dealt = slots.repartition(F.floor(F.col("slot") / size))
    pieces = dealt.mapInArrow(_filter_pieces(bits), "piece bigint, bitmap binary").collect()
    bitmap = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    step = max(1, size // 8)
    for row in pieces:
        bitmap[row["piece"] * step : (row["piece"] + 1) * step] |= np.frombuffer(row["bitmap"], np.uint8)
    release(repeated)
    return bitmap.tobytes()


def _passing(digest: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() + 2
    kept = np.ones(len(digest), bool)
    for slot in _slots(digest, bits):
        kept &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return kept


def _units(shared=None):
    """The units of every text; with a filter, only those that may occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8) if shared else None
        for batch in batches:
            for part in slices(batch, "text"):
                found = _cut(part)
                if not found:
                    continue
                words, starts, ends, row = found.words, found.starts, found.ends, found.row
                characters = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                base = characters[as_bytes(part.column("text"))[1][row]]
                first_unit = np.searchsorted(row, np.arange(part.num_rows))
                second = range_hash(LOWER[words.data], words.start, words.end, 1)
                columns = [
                    np.arange(len(starts)) - first_unit[row],
                    characters[words.start[starts]] - base,
                    characters[words.end[ends - 1]] - base,
                    ends - starts,
                    found.hash_a,
                    (_digest(second, starts, 2) >> 32).astype(np.int32),
                ]
                kept = np.arange(len(starts)) if bitmap is None else np.flatnonzero(_passing(found.hash_a, bitmap))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(row[kept])) for c in ("doc_id", "text_key")]
                    + [pa.array(c[kept]) for c in columns],
                    names=[f.split()[0] for f in _UNITS.split(", ")],
                )

    return run


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text).cast("string")).alias("text_key"),
        F.col(text).cast("string").alias("text"),
    )


def text_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats_only: bool = False) -> DataFrame:
    """One row per unit: place in its document (characters) and digest.

    ``repeats_only`` leaves out most units whose digest occurs once, and no others.
    """
    narrow = _narrow(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(narrow)) if repeats_only else None
    return narrow.mapInArrow(_units(shared), _UNITS)


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per passage to remove: where it stands and which place keeps its first unit.

    ``start`` and ``stop`` are character offsets in the original text.
    """
    units = materialise(text_units(docs, doc_id, text, repeats_only=True), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "text_key", "unit")
    groups = units.groupBy("hash_a", "hash_b").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Only digests found twice matter, alone or in a pair; the rest end here.
    groups = groups.filter("n > 1").select("hash_a", "hash_b", "first")
    document = ["doc_id", "text_key"]
    # A document's units, never more than its own words, meet in one task.
    in_order = Window.partitionBy(*document).orderBy("unit")
    # Units whose keepers follow each other are joined anyway: only other neighbours are looked up.
    after = F.lead("first").over(in_order)
    keepers_follow = (
        after["doc_id"].eqNullSafe(F.col("first.doc_id"))
        & (after["text_key"] == F.col("first.text_key"))
        & (after["unit"] == F.col("first.unit") + 1)
    )
    neighbour = F.coalesce(F.lead("unit").over(in_order) == F.col("unit") + 1, F.lit(False))
    looked_up = neighbour & ~F.coalesce(keepers_follow, F.lit(False))
    digests = ["hash_a", "hash_b", F.lead("hash_a").over(in_order), F.lead("hash_b").over(in_order)]
    found = (
        units.join(groups, ["hash_a", "hash_b"])
        .dropDuplicates([*document, "unit"])
        .select(
            *document, "unit", "start", "stop", "words",
            F.struct("first.no_id", "first.doc_id", "first.start").alias("first"),
            (neighbour & F.coalesce(keepers_follow, F.lit(False))).alias("follows"),
            F.when(looked_up, F.xxhash64(*digests)).alias("pair_a"),
            F.when(looked_up, F.hash(*digests)).alias("pair_b"),
        )
    )
    found = materialise(found, "repeated-units")
    paired = found.filter("pair_a IS NOT NULL")
    pairs = paired.groupBy("pair_a", "pair_b").agg(F.min(rank).alias("pair_first"), F.count("*").alias("n"))
    # A pair whose keepers follow each other stands there: its digests are looked up in that place.
    earlier = paired.join(pairs.filter("n > 1").drop("n"), ["pair_a", "pair_b"], "left").withColumn(
        "joined", F.coalesce(rank != F.col("pair_first"), F.lit(False))
    )
    columns = [*document, "unit", "start", "stop", "words", "first"]
    marked = earlier.select(*columns, "joined").unionByName(
        found.filter("pair_a IS NULL").select(*columns, F.col("follows").alias("joined"))
    )
    joins = (F.lag("unit").over(in_order) == F.col("unit") - 1) & F.lag("joined").over(in_order)
    runs = (
        marked.filter(rank != F.col("first"))
        .withColumn("begins", F.coalesce(~joins, F.lit(True)).cast("bigint"))
        .withColumn("run", F.sum("begins").over(in_order))
    )
    joined = runs.groupBy(*document, "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("n_words"),
        F.min_by("first", "unit").alias("kept"),
    )
    return joined.filter(F.col("n_words") >= min_words).select(
        *document,
        "start",
        "stop",
        "n_words",
        F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.start").alias("kept_start"),
    )


def remove_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """The documents with their columns, repeated passages cut out of ``text``."""
    found = repeated_passages(docs, doc_id, text, min_words)
    spans = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")
    )
    spans = spans.toDF("span_id", "span_key", "cuts")
    # The columns get numbers, so no name of the input can clash.
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*place.values()).withColumn("row_key", F.xxhash64(F.col(place[text]).cast("string")))
    joined = rows.join(
        spans,
        F.col(place[doc_id]).cast("bigint").eqNullSafe(F.col("span_id")) & (F.col("row_key") == F.col("span_key")),
        "left",
    )
    # What lies between two cuts stays: from the end of one to the start of the next.
    before = F.col(place[text]).cast("string")
    kept = F.concat(
        F.transform(
            F.col("cuts"),
            lambda c, i: F.substring(
                before,
                F.coalesce(F.get("cuts", i - 1)["stop"], F.lit(0)).cast("int") + 1,
                (c["start"] - F.coalesce(F.get("cuts", i - 1)["stop"], F.lit(0))).cast("int"),
            ),
        ),
        F.array(F.expr(f"substring(cast({place[text]} as string), cast(element_at(cuts, -1).stop as int) + 1)")),
    )
    body = F.when(F.col("cuts").isNull(), F.col(place[text])).otherwise(F.array_join(kept, ""))
    return joined.select(*[(body if c == text else F.col(place[c])).alias(c) for c in docs.columns])
