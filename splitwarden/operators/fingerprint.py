"""Difference hash of texts: token counts on a small grid, then the grid hash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import grids as G
from splitwarden.functions import text as X

ROWS, COLS = 8, 9


def token_cell(token: Column, cells: int = ROWS * COLS) -> Column:
    """Cell of a token: leading 32 bits of its MD5 modulo the number of cells."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % cells


def text_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cell, n): tokens of a document counted per cell, partly before the shuffle."""
    tokens = docs.select(
        key, F.explode(X.tokenize(text)).alias("token")
    )
    return (
        tokens.select(key, token_cell(F.col("token")).alias("cell"))
        .groupBy(key, "cell")
        .agg(F.count("*").alias("n"))
    )


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens counted per cell and row; a word of a batch is digested once, however often it stands."""
    cells = ROWS * COLS
    for batch in batches:
        keys, tokens = batch.columns
        rows = pc.list_parent_indices(tokens).to_numpy()
        words = pc.list_flatten(tokens).dictionary_encode()
        # The same cell as ``token_cell``.
        digests = [md5(word.encode()).digest() for word in words.dictionary.to_pylist()]
        cell = np.array([int.from_bytes(d[:4], "big") % cells for d in digests], np.int64)
        spots = rows.astype(np.int64) * cells + cell[words.indices.to_numpy()]
        counts = np.bincount(spots, minlength=len(batch) * cells).astype(np.int32)
        listed = pa.FixedSizeListArray.from_arrays(pa.array(counts), cells).cast(pa.list_(pa.int32()))
        counted = pa.RecordBatch.from_arrays([keys, listed], names=["key", "counts"])
        # Texts without tokens are left out here; a filter in the query would tokenise twice.
        yield counted.filter(pa.array(counts.reshape(-1, cells).any(axis=1)))


def text_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dhash) for every document; null for those without tokens, which resemble nothing.

    Tokens are counted where they are read; what is shuffled is one row of counts per document.
    """
    tokens = docs.select(F.col(key).alias("key"), X.tokenize(text).alias("tokens"))
    kind = tokens.schema["key"].dataType.simpleString()
    counted = tokens.mapInArrow(_cell_counts, f"key {kind}, counts array<int>")
    # Rows of one key count together.
    sums = counted.groupBy("key").agg(*[F.sum(F.get("counts", F.lit(c))).alias(f"c{c}") for c in range(ROWS * COLS)])
    grid = sums.select(F.col("key").alias(key), F.array(*[f"c{c}" for c in range(ROWS * COLS)]).alias("grid"))
    hashed = grid.select(key, G.dhash("grid", ROWS, COLS).alias("dhash"))
    return docs.select(key).join(hashed, key, "left").select(key, "dhash")
