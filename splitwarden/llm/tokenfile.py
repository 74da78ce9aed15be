"""Token ids in files of independent zstandard frames with a trailing seek table.

File: frames of ``FRAME_IDS`` little-endian 32-bit ids, all documents one after the other; frames
with the document index (doc_id, whether it is null, number of ids; 64-bit each); a skippable
frame with the totals; and, last, the seek table of the public seekable zstandard format: sizes
of every frame and the low 32 bits of the XXH64 of its content. A reader takes the table from
the end of the file, decompresses only the frames a document touches and checks each of them.

Documents are range-partitioned and sorted by doc_id, so file after file holds them in
ascending order. A file is written by one task under a draft name and then moved; only the
number of ids of each file reaches the driver, to place the files one after the other.

Cases: a null or empty text is the end id alone; null doc_ids come first; rows with equal
doc_id follow each other by text; an empty table gives no file and no row; a very long text
runs over as many frames as it needs; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.llm.files import locate, published, task_number
from splitwarden.llm.text import slices
from splitwarden.llm.tokens import encoder
from splitwarden.operators.scale import materialise

FRAME_IDS = 1 << 16
_LEVEL = 3
# Fixed values of the seekable zstandard format.
_SKIPPABLE = 0x184D2A50
_SEEK_FRAME = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80
_TOTALS = struct.Struct("<QQII")  # ids, documents, id frames, index frames


class Writer:
    """Writes the ids of documents to one open file."""

    def __init__(self, out):
        self.out, self.frames = out, []
        self.pack = zstandard.ZstdCompressor(level=_LEVEL)
        self.waiting, self.held = [], 0
        self.index: list[tuple[int, int, int]] = []
        self.ids = 0

    def _frame(self, content: bytes) -> None:
        packed = self.pack.compress(content)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, int(doc_id is None), len(ids)))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._flush(self.held // FRAME_IDS * FRAME_IDS)

    def _flush(self, n: int) -> None:
        together = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for low in range(0, n, FRAME_IDS):
            self._frame(together[low : min(low + FRAME_IDS, n)].astype("<u4").tobytes())
        self.waiting, self.held = [together[n:]], len(together) - n

    def close(self) -> None:
        self._flush(self.held)
        id_frames = len(self.frames)
        table = np.array(self.index, "<i8").reshape(-1, 3)
        for low in range(0, len(table), FRAME_IDS):
            self._frame(table[low : low + FRAME_IDS].tobytes())
        totals = _TOTALS.pack(self.ids, len(table), id_frames, len(self.frames) - id_frames)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(totals)) + totals)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), _CHECKSUMS, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_FRAME, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Reads single documents or all of them; decompresses a frame only when it is asked for."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        begin = size - 9 - 12 * count
        self.table = np.frombuffer(self.file.read_at(12 * count, begin), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        at = int(self.offsets[-1]) + 8
        self.ids, documents, self.id_frames, self.index_frames = _TOTALS.unpack(
            self.file.read_at(_TOTALS.size, at)
        )
        self.unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(
            b"".join(self.frame(self.id_frames + i) for i in range(self.index_frames)), "<i8"
        ).reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.index[:, 2])))
        if len(self.index) != documents:
            raise ValueError(f"{uri} lacks a part of its index")

    def frame(self, number: int) -> bytes:
        size, content_size, checksum = (int(x) for x in self.table[number])
        packed = self.file.read_at(size, int(self.offsets[number]))
        content = self.unpack.decompress(packed, max_output_size=content_size)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return content

    def document(self, number: int) -> np.ndarray:
        """The ids of the document at place ``number`` of the file."""
        low, high = int(self.starts[number]), int(self.starts[number + 1])
        first, last = low // FRAME_IDS, (high - 1) // FRAME_IDS
        ids = np.frombuffer(b"".join(self.frame(i) for i in range(first, last + 1)), "<u4")
        return ids[low - first * FRAME_IDS : high - first * FRAME_IDS]

    def checksums(self) -> Iterator[int]:
        """CRC-32 of the packed ids of every document, one frame in memory at a time."""
        number, content = -1, b""
        for low, high in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            crc = 0
            while low < high:
                if low // FRAME_IDS != number:
                    number = low // FRAME_IDS
                    content = self.frame(number)
                stop = min(high, (number + 1) * FRAME_IDS)
                base = number * FRAME_IDS
                crc = zlib.crc32(content[4 * (low - base) : 4 * (stop - base)], crc)
                low = stop
            yield crc


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        name = f"tokens-{task_number():06d}.zst"
        with published(f"{folder}/{name}") as out:
            writer, batch = Writer(out), first
            while batch is not None:
                for part in slices(batch, "text"):
                    for doc, ids in zip(part.column("doc_id").to_pylist(), encoder().encode(part.column("text"))):
                        writer.add(doc, ids)
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "documents": [len(writer.index)], "ids": [writer.ids]}
        )

    return run


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns (file, documents, ids)."""
    ordered = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return materialise(
        ordered.mapInArrow(_write(folder), "file string, documents bigint, ids bigint"), "token-files"
    )


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                reader = Reader(f"{folder}/{name}")
                missing = reader.index[:, 1].astype(bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(reader.index[:, 0], pa.int64(), mask=missing),
                        "start": pa.array(reader.starts[:-1] + base, pa.int64()),
                        "n_tokens": pa.array(reader.index[:, 2], pa.int64()),
                        "ids_crc32": pa.array(list(reader.checksums()), pa.int64()),
                    }
                )

    return run


def read_token_files(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """One row per document, read back from the files: place, length and checksum of its ids."""
    files, start = [], 0
    for row in written.orderBy("file").collect():  # one row per file
        files.append((row["file"], start))
        start += row["ids"]
    listed = spark.createDataFrame(files, "file string, start bigint")
    return listed.repartition(max(1, len(files))).mapInArrow(
        _read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
