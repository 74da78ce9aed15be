"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of ``n`` consecutive item words (or the whole of a shorter item) is a test
n-gram. Training texts are cut into words, the hash of each window is looked up in the set,
hits are verified word by word, and the hit words become spans. ``remove_spans`` cuts the
spans out of the texts; dropping whole documents is a filter on ``contaminated``.

The set is sent to the tasks in blocks of at most ``block_bytes``, whose size is known before
anything is collected: a benchmark of any size is scanned block after block in one pass over
the rows, and no row of the corpus is shuffled.

Cases: a null or empty text or item has no words, so it is neither hit nor a window. An item
with a null id marks words and is listed as ``null``. Repeated items count once per id,
repeated documents give one row each. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import WORD_TABLE, as_bytes, grams, slices, words_of
from splitwarden.operators.scale import materialise

NGRAM = 13
BLOCK_BYTES = 32 << 20  # words of test n-grams in one broadcast
_SPANS = "array<struct<start:bigint,end:bigint>>"
_FILTER_BITS = 20


def _item_windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("item").to_pylist(), batch.column("text").to_pylist()
            for item, text in zip(ids, texts):
                words = (text or "").encode().translate(WORD_TABLE).split()
                size = min(n, len(words))
                found = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
                found.discard(b"")
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "window": pa.array([w.decode() for w in sorted(found)]),
                            "item": pa.array([item] * len(found)),
                        }
                    )

    return run


class _Index:
    """Test n-grams of one block: hashes by length, and the items of each word sequence."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.items: dict[bytes, list[str]] = {}
        for window, item in rows:
            self.items.setdefault(window.encode(), []).append(item)
        windows = list(self.items)
        words = words_of(pa.array([w.decode() for w in windows]))
        first, counts = words.first(), words.counts()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(counts).tolist():
            hashes = grams(words.key, size)[first[:-1][counts == size]]
            present = np.zeros(1 << _FILTER_BITS, bool)
            present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[size] = (np.unique(hashes), present)

    def hits(self, words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every verified occurrence."""
        for size, (hashes, present) in self.by_length.items():
            found = grams(words.key, size)
            at = np.flatnonzero(present[found >> np.uint64(64 - _FILTER_BITS)])
            at = at[words.row[at] == words.row[at + size - 1]]
            slot = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
            for i in at[hashes[slot] == found[at]].tolist():
                items = self.items.get(words.joined(i, size))
                if items:
                    yield i, size, items


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the word spans and items that this block finds to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                words = words_of(part.column("_text"))
                first = words.first()
                spans: list[list] = [[(s["start"], s["end"]) for s in x] for x in part.column("_spans").to_pylist()]
                items: list[set] = [set(x) for x in part.column("_items").to_pylist()]
                for at, size, names in index.hits(words):
                    row = int(words.row[at])
                    begin = at - int(first[row])
                    spans[row].append((begin, begin + size))
                    items[row].update(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in part.schema.names[:-3]],
                        pa.array(words.counts()),
                        pa.array([_merged(s) for s in spans], pa.list_(_SPAN_TYPE)),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=part.schema.names,
                )

    return run


_SPAN_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Disjoint word spans in order that cover the same words."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": s, "end": e} for s, e in out]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """Distinct (window, item) of the benchmark, ids as strings."""
    narrow = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.col(text).cast("string").alias("text"),
    )
    return narrow.mapInArrow(_item_windows(n), "window string, item string").distinct()


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = NGRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document: columns ``keep`` as _c0, _c1, ..., then _text, _n, _spans and _items.

    _n is the number of words, _spans the disjoint hit word ranges, _items the ids found. The
    plain names of the input are not used, so they cannot clash.
    """
    spark = docs.sparkSession
    windows = materialise(item_windows(items, item_id, item_text, n), "test-ngrams")
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    state = docs.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)],
        F.col(text).cast("string").alias("_text"),
        F.lit(0).cast("bigint").alias("_n"),
        F.array().cast(_SPANS).alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    for block in range(max(1, blocks)):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(max(1, blocks))) == block)
        shared = spark.sparkContext.broadcast([(r["window"], r["item"]) for r in part.collect()])
        state = state.mapInArrow(_scan(shared), state.schema)
    return state


def hit_words() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """A document counts as contaminated when at least 1/share of its words are hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontamination_report(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per document: words, hit words, items and the verdict."""
    found = find_hits(docs, items, [doc_id], text, **options)
    return found.select(
        F.col("_c0").alias("doc_id"),
        F.col("_n").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        contaminated(hit_words(), F.col("_n")).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def _restored(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of the input under their own names and in their order."""
    others = [c for c in columns if c != text]
    places = {c: f"_c{i}" for i, c in enumerate(others)} | {text: "_text"}
    return found.select(*[F.col(places[c]).alias(c) for c in columns])


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    others = [c for c in docs.columns if c != text]
    found = find_hits(docs, items, others, text, **options)
    return _restored(found.filter(~contaminated(hit_words(), F.col("_n"))), docs.columns, text)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            column, spans = part.column("_text"), part.column("_spans").to_pylist()
            words = words_of(column)
            first = words.first()
            _, offsets = as_bytes(column)
            texts = column.to_pylist()
            for row, ranges in enumerate(spans):
                if ranges:
                    raw, base = texts[row].encode(), int(offsets[row])
                    done, kept = 0, []
                    for span in ranges:
                        kept.append(raw[done : int(words.start[first[row] + span["start"]]) - base])
                        done = int(words.end[first[row] + span["end"] - 1]) - base
                    texts[row] = b"".join([*kept, raw[done:]]).decode()
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in part.schema.names[:-2]], pa.array(texts, pa.string()), part.column("_spans")],
                names=part.schema.names,
            )


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with all columns, hit words cut out of ``text``, the rest left as it was."""
    others = [c for c in docs.columns if c != text]
    found = find_hits(docs, items, others, text, **options).drop("_n", "_items")
    return _restored(found.mapInArrow(_cut, found.schema), docs.columns, text)
