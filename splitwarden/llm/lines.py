"""Line deduplication by a segment-partition edit join.

Lines (ended by ``\\n``, white space around them cut off) of at least ``MIN_CHARS`` characters
are compared by edit distance; two lines within ``THRESHOLD`` = t edits are linked.

1. Equal lines are one line, known by a 128-bit digest; its place is its first occurrence.
2. A line of length l is cut into t + 1 even segments, which are indexed by (length, number of
   the segment, content). By the pigeonhole principle a linked line that is not shorter holds
   one of the segments unchanged, so each line probes, for every length from its own down to t
   less, the few substrings that the multi-match-aware bounds allow.
3. Of the lines that meet, a pair is made only where the parities of their characters allow t
   edits. Pairs are verified in full: common ends are cut off and a banded bit-parallel
   edit distance (Myers, Hyyro) runs over 2t + 1 diagonals until it exceeds t.
4. An occurrence is removed when the same line occurs earlier, or when its line is linked to a
   line that first occurs earlier. Earlier means lesser doc_id, then lesser line number.

Cases: a null text has no lines; lines below ``MIN_CHARS``, empty ones too, always stay; a null
doc_id ranks last; rows with the same doc_id and text are one document and keep the same
lines; a very long line is one line; other columns are left alone. A document of which nothing
but white space remains after lines were removed is left out by ``drop_repeated_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.scale import materialise, release

THRESHOLD = 2
MIN_CHARS = 20
_SPACES = " \t\n\x0b\x0c\r"


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line; the longer ones come last."""
    size, longer = divmod(length, parts)
    out, start = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((start, n))
        start += n
    return out


def probes(length: int, threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings a line of ``length`` looks up."""
    for shorter in range(threshold + 1):
        for i, (start, size) in enumerate(segments(length - shorter, threshold + 1)):
            low = max(start - i, start + shorter - (threshold - i), 0)
            high = min(start + i, start + shorter + (threshold - i), length - size)
            for place in range(low, high + 1):
                yield length - shorter, i, place, size


def parity(texts: list[str]) -> np.ndarray:
    """64 parity bits of the characters of each non-empty line.

    An edit takes one character and gives one at most, so it flips at most two bits: lines
    within t edits differ in at most 2t bits.
    """
    if not texts:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    bits = np.uint64(1) << ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
    lengths = np.array([len(t) for t in texts])
    return np.bitwise_xor.reduceat(bits, np.cumsum(lengths) - lengths).view(np.int64)


def _sign(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids, keys, probing, repeats = [], [], [], []
            texts = batch.column("text").to_pylist()
            raw, bags = "".join(texts).encode("utf-32-le"), parity(texts)
            base = 0
            for line, n in zip(batch.column("line").to_pylist(), map(len, texts)):
                if n not in plans:
                    if len(plans) > 50_000:
                        plans.clear()
                    own = [(n, i, s, k) for i, (s, k) in enumerate(segments(n, threshold + 1))]
                    plans[n] = own, sorted(set(probes(n, threshold)) - set(own))
                for is_probe, places in enumerate(plans[n]):
                    for length, i, start, size in places:
                        seed = length * (threshold + 1) + i
                        at = base + 4 * start
                        keys.append(xxhash.xxh64_intdigest(raw[at : at + 4 * size], seed) - (1 << 63))
                        probing.append(is_probe == 1)
                        ids.append(line)
                repeats.append(len(plans[n][0]) + len(plans[n][1]))
                base += 4 * n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(probing, pa.bool_()),
                    pa.array(np.repeat(bags, repeats)),
                ],
                names=["key", "line", "probe", "bag"],
            )

    return run


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str, threshold: int) -> int:
    """Edit distance of two lines, or ``threshold + 1`` if it is greater."""
    over = threshold + 1
    if abs(len(a) - len(b)) > threshold:
        return over
    cut = _common(a, b)
    a, b = a[cut:], b[cut:]
    cut = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return min(len(a), over)
    if len(a) <= threshold:
        return min(_small_distance(a, b), over)
    width = 2 * threshold + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    up, down = every & (every << threshold), 0
    # The score follows the lowest diagonal of the band, then the last row of ``a``.
    score, turn, row = threshold, len(a) - threshold, top >> 1
    limit = threshold + len(b) - turn
    for j, ch in enumerate(b):
        found = places.get(ch, 0)
        match = (found >> (j - threshold) if j >= threshold else found << (threshold - j)) & every
        zero = ((((match & up) + up) ^ up) | match | down) & every
        right_up = (down | ~(zero | up)) & every
        right_down = zero & up
        if j < turn:
            score += not zero & top
        else:
            score += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        if score > limit:
            return over
        up = (right_down | ~((zero >> 1) | right_up)) & every
        down = (zero >> 1) & right_up
    return min(score, over)


def _small_distance(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            near = [edit_distance(x, y, threshold) <= threshold for x, y in zip(a, b)]
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield kept.filter(pa.array(near, pa.bool_()))

    return run


def _occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, text_key, line_no, digest_a, digest_b, text) of every line long enough."""
    body = F.col(text).cast("string")
    split = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
        F.posexplode(F.split(body, "\n")).alias("line_no", "text"),
    ).withColumn("text", F.btrim(F.col("text"), F.lit(_SPACES)))
    return split.filter(F.char_length("text") >= min_chars).select(
        "doc_id",
        "text_key",
        "line_no",
        F.xxhash64("text").alias("digest_a"),
        # Each hash seeds the next, so the seed comes first: else this is a function of digest_a.
        F.xxhash64(F.lit(1), "text").alias("digest_b"),
        "text",
    )


def _place(doc_id: Column | str = "doc_id", line_no: Column | str = "line_no") -> Column:
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(
        doc.isNull().alias("no_id"), doc.alias("doc_id"), F.col("text_key"), F.col(line_no).alias("line_no")
    )


def line_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of different lines within ``threshold`` edits; ``lines``: line, text."""
    signed = lines.select("line", "text").mapInArrow(
        _sign(threshold), "key bigint, line bigint, probe boolean, bag bigint"
    )
    index = signed.filter(~F.col("probe")).select(
        F.col("key").alias("other_key"), F.col("line").alias("other"), F.col("bag").alias("other_bag")
    )
    met = (
        signed.join(
            index,
            (F.col("key") == F.col("other_key"))
            & ((F.col("line") < F.col("other")) | (F.col("probe") & (F.col("line") > F.col("other"))))
            & (F.bit_count(F.col("bag").bitwiseXOR(F.col("other_bag"))) <= 2 * threshold),
        )
        .select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b"))
        .distinct()
    )
    pairs = materialise(met, "line-pairs")
    ends = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    # The number of paired lines grows with the corpus: never a broadcast.
    texts = lines.select("line", "text").join(ends.hint("merge"), "line", "left_semi")
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = materialise(joined.mapInArrow(_verify(threshold), "a bigint, b bigint"), "line-links")
    release(pairs)
    return links


def removed_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """One row per line that is removed, with the place of the line that makes it a repeat.

    doc_id, text_key, line_no, kept_doc_id, kept_line_no, n_links (of its line to others).
    """
    if min_chars <= threshold:
        raise ValueError("a line must be longer than the number of edits")
    found = _occurrences(docs, doc_id, text, min_chars)
    lines = (
        found.groupBy("digest_a", "digest_b")
        .agg(F.min(_place()).alias("place"), F.max(_place()).alias("last"), F.first("text").alias("text"))
        .withColumn("line", F.monotonically_increasing_id())
    )
    lines = materialise(lines, "lines")
    places = lines.select("line", "place")
    links = line_links(lines, threshold)
    both = links.union(links.select("b", "a")).toDF("line", "other")
    nearest = (
        both.join(places.toDF("other", "other_place"), "other")
        .groupBy("line")
        .agg(F.min("other_place").alias("near"), F.count("*").alias("n_links"))
    )
    # Only lines that occur twice or have a link can lose an occurrence.
    judged = (
        lines.select("line", "digest_a", "digest_b", "place", "last")
        .join(nearest, "line", "left")
        .filter(F.col("n_links").isNotNull() | (F.col("place") != F.col("last")))
        .select(
            "digest_a",
            "digest_b",
            "place",
            F.coalesce(F.least("place", "near"), "place").alias("kept"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    repeats = found.drop("text").join(judged, ["digest_a", "digest_b"])
    return repeats.filter(_place() != F.col("kept")).select(
        "doc_id",
        "text_key",
        "line_no",
        F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.line_no").alias("kept_line_no"),
        "n_links",
    )


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: lines, removed lines and the documents that keep them."""
    removed = removed_lines(docs, doc_id, text, **options).distinct()
    per_document = removed.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.sort_array(F.collect_list("line_no")).alias("removed_lines"),
        F.sort_array(F.collect_set("kept_doc_id")).alias("kept_doc_ids"),
    )
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("_id"),
        F.xxhash64(F.col(text).cast("string")).alias("_key"),
        F.coalesce(F.size(F.split(F.col(text).cast("string"), "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
    )
    matched = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    return rows.join(per_document, matched, "left").select(
        F.col("_id").alias("doc_id"),
        "n_lines",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("kept_doc_ids", F.array().cast("array<bigint>")).alias("kept_doc_ids"),
    )


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with their columns, repeated lines taken out of ``text``."""
    removed = removed_lines(docs, doc_id, text, **options).distinct()
    gone = removed.groupBy("doc_id", "text_key").agg(F.collect_list("line_no").alias("gone"))
    gone = gone.toDF("gone_id", "gone_key", "gone")
    # The columns get numbers, so no name of the input can clash.
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*place.values()).withColumn("row_key", F.xxhash64(F.col(place[text]).cast("string")))
    joined = rows.join(
        gone,
        F.col(place[doc_id]).cast("bigint").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")),
        "left",
    )
    kept = F.filter(F.split(F.col(place[text]).cast("string"), "\n"), lambda _, i: ~F.array_contains("gone", i))
    body = F.when(F.col("gone").isNull(), F.col(place[text])).otherwise(F.array_join(kept, "\n"))
    shaped = joined.withColumn("body", body).filter(
        F.col("gone").isNull() | F.col("body").rlike("[^\\x20\\x09-\\x0D]")
    )
    return shaped.select(*[F.col("body" if c == text else place[c]).alias(c) for c in docs.columns])
