"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table with one row per block of documents of similar length. A block holds a bit
matrix whose columns are its documents and whose rows (slices) are the positions of a Bloom
signature: a term sets ``HASHES`` positions of its document, once for every level j with a count
of 2**j or more. The slices of a (term, level), joined by AND, are a bitmap of the documents that
may hold the term that often; it can have bits too many, never too few. A query weighs these
bitmaps with the most that the next level can add to a score, for the shortest document of the
block, and sums them up: an upper bound for every document of the block. Documents whose bound
lies below the best scores known so far are excluded; all others are scored exactly from the
block's lists of term counts. Nothing else decides who is scored, so the result is exact.

The best documents of a query set a threshold that grows while a task goes through its blocks. A
first round over one block in ``ROUND`` gives thresholds to all tasks of the second round, so the
rows that tasks return do not grow with the number of blocks.

Queries are taken in blocks of at most ``QUERY_TERMS`` terms (one item with more is a block of its
own), and only such a block is broadcast. Terms are compared by 64-bit keys: terms of one length up
to eight bytes never share a key, longer ones do with probability 2**-64 a pair.

Cases: null and empty texts have no terms: such a document is never ranked, such an item has no
rows; every row of ``items`` is an item and every row of ``docs`` a document, also with equal or
null ids; equal scores are ordered by doc_id, null last; an empty table gives no rows; a very long
text is a block of its own, as wide as it needs; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitwarden.llm.text import mix, range_hash, slices, words_of
from splitwarden.operators.scale import materialise

TOP = 20
BLOCK_DOCS = 512  # documents of one block at most
BLOCK_BITS = 1 << 24  # bits of one block's matrix, unless one document needs more
HASHES = 3
BITS_PER_TERM = 8
BUFFER_POSTINGS = 2_000_000  # (document, term) pairs that a task gathers before it makes blocks
ROUND = 16
QUERY_TERMS = 200_000
_QUERIES_AT_ONCE = 256
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = (
    "block bigint, n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths array<bigint>, width bigint, "
    "max_tf bigint, slices binary, keys binary, sizes binary, terms binary, counts binary"
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A run of bytes that words_of takes as a word, as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def signature_rows(keys: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The slices of (key, level) pairs, ``HASHES`` each."""
    h = mix(keys + np.asarray(level).astype(np.uint64) * _LEVEL)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[..., None] + step[..., None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many levels a count reaches: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@dataclass
class _Postings:
    """Documents with their (key, count) pairs, in document order."""

    ids: list
    lengths: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    counts: np.ndarray


def _postings(part: pa.RecordBatch) -> _Postings:
    words = words_of(part.column("text"))
    lengths = words.counts()
    known, number = np.unique(words.key, return_inverse=True)
    pairs, counts = np.unique(words.row * max(1, len(known)) + number, return_counts=True)
    sizes = np.bincount(pairs // max(1, len(known)), minlength=words.rows)
    some = lengths > 0
    ids = [d for d, s in zip(part.column("doc_id").to_pylist(), some.tolist()) if s]
    return _Postings(ids, lengths[some], sizes[some], known[pairs % max(1, len(known))], counts)


def _blocks(found: list[_Postings]) -> Iterator[dict]:
    """Blocks of documents of similar length."""
    ids = [d for p in found for d in p.ids]
    lengths, sizes, keys, counts = (
        np.concatenate([getattr(p, name) for p in found]) for name in ("lengths", "sizes", "keys", "counts")
    )
    begins = np.cumsum(sizes) - sizes
    levels = _levels(counts)
    entered = np.add.reduceat(levels, begins) if len(begins) else begins
    order = np.lexsort((np.arange(len(ids)), lengths))
    low = 0
    while low < len(order):
        within = lengths[order[low : low + BLOCK_DOCS]] < 2 * lengths[order[low]]
        high = low + int(np.count_nonzero(within))
        most = np.maximum.accumulate(entered[order[low:high]])
        widths = 1 << np.ceil(np.log2(BITS_PER_TERM * most)).astype(np.int64)
        fits = widths * np.arange(1, high - low + 1) <= BLOCK_BITS
        fits[0] = True
        high = low + int(np.count_nonzero(np.logical_and.accumulate(fits)))
        width = int(widths[high - low - 1])
        docs = order[low:high]
        at = np.repeat(begins[docs], sizes[docs]) + _ranges(sizes[docs])
        column = np.repeat(np.arange(len(docs)), sizes[docs])
        key, count, level = keys[at], counts[at], levels[at]
        bits = np.zeros((width, len(docs)), np.uint8)
        entry = signature_rows(np.repeat(key, level), _ranges(level), width)
        bits[entry.astype(np.int64), np.repeat(column, level)[:, None]] = 1
        known, term = np.unique(key, return_inverse=True)
        ordered = np.lexsort((term, column))
        yield {
            "doc_ids": [ids[d] for d in docs.tolist()],
            "lengths": lengths[docs].tolist(),
            "width": width,
            "max_tf": int(count.max()),
            "slices": np.packbits(bits, axis=1, bitorder="little").tobytes(),
            "keys": known.astype("<u8").tobytes(),
            "sizes": sizes[docs].astype("<i4").tobytes(),
            "terms": term[ordered].astype("<i4").tobytes(),
            "counts": count[ordered].astype("<i4").tobytes(),
        }
        low = high


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            *[(c, pa.int64()) for c in ("block", "n_docs", "n_terms")],
            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
            ("width", pa.int64()), ("max_tf", pa.int64()),
            *[(c, pa.binary()) for c in ("slices", "keys", "sizes", "terms", "counts")],
        ]
    )
    task = TaskContext.get()
    number = task.partitionId() << 32 if task else 0

    def made(found: list[_Postings]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for block in _blocks(found):
            more = {"block": number, "n_docs": len(block["doc_ids"]), "n_terms": sum(block["lengths"])}
            yield pa.RecordBatch.from_pylist([more | block], schema)
            number += 1

    held: list[_Postings] = []
    for batch in batches:
        for part in slices(batch, "text"):
            found = _postings(part)
            if found.ids:
                held.append(found)
            if sum(len(p.keys) for p in held) >= BUFFER_POSTINGS:
                yield from made(held)
                held = []
    if held:
        yield from made(held)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index, one row per block; documents without a term are not in it."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(narrow.mapInArrow(_index, _BLOCK), "signatures")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items with a number, terms of each item with their repeats)."""
    numbered = materialise(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(item_id).alias("item_id"),
            F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER).alias("text"),
        ),
        "items",
    )
    terms = numbered.select("item", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return numbered.drop("text"), materialise(terms.groupBy("item", "term").agg(F.count("*").alias("n")), "item-terms")


def query_blocks(terms: DataFrame, limit: int = QUERY_TERMS) -> Iterator[tuple[int, int]]:
    """Ranges of item numbers with at most ``limit`` terms, or a single item."""
    low, last, held = None, None, 0
    for row in terms.groupBy("item").count().orderBy("item").toLocalIterator():
        if low is not None and held + row["count"] > limit:
            yield low, last
            low, held = None, 0
        low = row["item"] if low is None else low
        last, held = row["item"], held + row["count"]
    if low is not None:
        yield low, last


class Queries:
    """One block of queries: distinct terms and, per query, the terms it holds and how often."""

    def __init__(self, rows: list):
        words = sorted({r["term"] for r in rows})
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.keys = range_hash(data, ends - [len(w) for w in raw], ends)
        self.items = np.array(sorted({r["item"] for r in rows}), np.int64)
        place = {w: i for i, w in enumerate(words)}
        query = np.searchsorted(self.items, [r["item"] for r in rows])
        order = np.argsort(query, kind="stable")
        self.term = np.array([place[r["term"]] for r in rows], np.int64)[order]
        self.repeats = np.array([r["n"] for r in rows], np.int64)[order]
        self.begin = np.searchsorted(query[order], np.arange(len(self.items) + 1))
        self.weight = np.zeros(len(words), np.int64)
        self.least = np.zeros(len(self.items), np.int64)
        self.documents = self.total = 1

    def of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.begin[query], self.begin[query + 1])
        return self.term[at], self.repeats[at]

    def mark(self, lengths: np.ndarray) -> np.ndarray:
        """The length part m of a document's score."""
        return 100 - 25 + (25 * lengths * self.documents) // self.total


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _document_counts(shared):
    """(term, df) of one block of the index for the terms of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for keys, terms in zip(batch.column("keys"), batch.column("terms")):
                known = np.frombuffer(keys.as_buffer(), "<u8")
                held = np.bincount(np.frombuffer(terms.as_buffer(), "<i4"), minlength=len(known))
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                df += np.where(known[at] == wanted, held[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


class Block:
    """One block of the index, opened."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.width, self.max_tf = row["width"], row["max_tf"]
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(self.width, -1)
        self.keys = np.frombuffer(row["keys"], "<u8")
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.counts = np.frombuffer(row["counts"], "<i4")
        # (document, term) as one sorted number
        self.codes = np.repeat(np.arange(len(sizes)), sizes) * len(self.keys) + np.frombuffer(row["terms"], "<i4")

    def bitmaps(self, keys: np.ndarray) -> list[np.ndarray]:
        """Per level, a bitmap for each key of the documents that may hold it so often."""
        found: list[np.ndarray] = []
        for level in range(int(_levels(np.array([self.max_tf]))[0])):
            rows = signature_rows(keys, level, self.width).astype(np.int64)
            bits = reduce(np.bitwise_and, (self.slices[rows[:, i]] for i in range(HASHES)))
            found.append(bits & found[-1] if found else bits)
        return found

    def bounds(self, queries: Queries, low: int, high: int) -> np.ndarray:
        """Upper bound of the score of every document for queries low .. high - 1."""
        span = slice(queries.begin[low], queries.begin[high])
        terms, column = np.unique(queries.term[span], return_inverse=True)
        query = np.repeat(np.arange(high - low), np.diff(queries.begin[low : high + 1]))
        shortest = queries.mark(self.lengths.min())
        total = np.zeros((high - low, len(self.ids)))
        before = 0
        for level, bits in enumerate(self.bitmaps(queries.keys[terms])):
            most = int(part_score(np.int64(min(self.max_tf, (2 << level) - 1)), shortest))
            some = bits.any(axis=1)
            seen = some[column]
            if seen.any():
                # Sums stay below 2**53, so doubles are exact.
                weights = np.zeros((high - low, int(some.sum())))
                place = np.cumsum(some) - 1
                gain = queries.repeats[span] * queries.weight[queries.term[span]] * (most - before)
                weights[query[seen], place[column[seen]]] = gain[seen]
                total += weights @ np.unpackbits(bits[some], axis=1, count=len(self.ids), bitorder="little").astype(np.float64)
            before = most
        return total

    def scores(self, queries: Queries, query: int, docs: np.ndarray) -> np.ndarray:
        """Exact scores of the given documents."""
        terms, repeats = queries.of(query)
        at = np.minimum(np.searchsorted(self.keys, queries.keys[terms]), len(self.keys) - 1)
        held = self.keys[at] == queries.keys[terms]
        factor = (repeats * queries.weight[terms])[held]
        codes = docs[:, None] * len(self.keys) + at[held][None, :]
        slot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        tf = np.where(self.codes[slot] == codes, self.counts[slot], 0).astype(np.int64)
        return (factor * part_score(tf, queries.mark(self.lengths[docs])[:, None])).sum(axis=1)


class Best:
    """The best ``top`` (score, doc_id) of a query."""

    def __init__(self, top: int, least: int):
        self.top, self.floor = top, max(1, least)
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, scores: np.ndarray, ids: list) -> None:
        # Sorted by score downwards, then doc_id with null last.
        more = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), ids) if s >= self.floor]
        self.rows = sorted(self.rows + more)[: self.top]
        if len(self.rows) == self.top:
            self.floor = max(self.floor, -self.rows[-1][0])


def search_block(block: Block, queries: Queries, best: list[Best], low: int, high: int) -> int:
    """Score what the bounds do not exclude; returns the number of documents scored."""
    bounds, scored = block.bounds(queries, low, high), 0
    for query in range(low, high):
        bound, top = bounds[query - low], best[query]
        docs = np.flatnonzero(bound >= top.floor)
        if len(docs) > 2 * top.top:
            # The most promising ones first: they raise the floor for the others.
            first = docs[np.argpartition(bound[docs], -top.top)[-top.top :]]
            top.add(block.scores(queries, query, first), [block.ids[d] for d in first.tolist()])
            scored += len(first)
            docs = np.setdiff1d(docs[bound[docs] >= top.floor], first)
        if len(docs):
            top.add(block.scores(queries, query, docs), [block.ids[d] for d in docs.tolist()])
            scored += len(docs)
    return scored


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = [Best(top, least) for least in queries.least.tolist()]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for low in range(0, len(best), _QUERIES_AT_ONCE):
                    search_block(block, queries, best, low, min(low + _QUERIES_AT_ONCE, len(best)))
        rows = [
            (item, None if missing else doc, -score)
            for item, found in zip(queries.items.tolist(), best)
            for score, missing, doc in found.rows
        ]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def _best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item."""
    spark = index.sparkSession
    numbered, terms = item_terms(items, item_id, text)
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    empty = "item bigint, doc_id bigint, score bigint"
    found = []
    for low, high in query_blocks(terms) if size["n"] else ():
        queries = Queries(terms.filter(F.col("item").between(low, high)).collect())
        queries.documents, queries.total = size["n"], size["total"]
        shared = spark.sparkContext.broadcast(queries.keys)
        partial = index.select("keys", "terms").mapInArrow(_document_counts(shared), "term bigint, df bigint")
        # At most one row per term of the query block.
        df = np.zeros(len(queries.keys), np.int64)
        for row in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row["term"]] = row["df"]
        queries.weight = np.array(
            [math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64
        )
        drawn = F.pmod(F.xxhash64("block"), F.lit(ROUND)) == 0
        blocks = [index.filter(part).drop("block", "n_docs", "n_terms") for part in (drawn, ~drawn)]
        first = blocks[0].mapInArrow(_search(spark.sparkContext.broadcast(queries), top), empty)
        first = materialise(_best_of(first, top).drop("rank"), "first-round")
        full = first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == top)
        for row in full.collect():
            queries.least[np.searchsorted(queries.items, row["item"])] = row["least"]
        second = blocks[1].mapInArrow(_search(spark.sparkContext.broadcast(queries), top), empty)
        found += [first, second]
    if not found:
        found = [spark.createDataFrame([], empty)]
    best = _best_of(reduce(DataFrame.unionByName, found), top)
    return best.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", top: int = TOP,
) -> DataFrame:
    return search(build_index(docs, doc_id, text), items, item_id, item_text, top)
