"""WARC archives with an index first, read back by coalesced byte ranges.

Writing: every page becomes one gzip member with a WARC/1.1 record. Of pages with equal
payloads of at least ``MIN_REVISIT`` bytes the one with the least page_id is a ``response``;
the others are ``revisit`` records, which carry the digest and length of the payload but not
the payload. Each task writes one archive and returns the index rows of its records: file,
offset, length, URL and digest. The index is a table of its own.

Reading: selected index rows are dealt out by file and range of ``RANGE_BYTES``, sorted by
offset, and neighbours closer than ``GAP_BYTES`` are fetched by one read.

Cases: a null html is an empty payload; a null url is written as an empty target; a null
page_id ranks last and is read back as null; rows with the same page_id and payload are the
same page, so each of them is a response when their id is the least; empty and short payloads
are always responses; very long payloads are one record; an empty table writes no archive;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.files import locate, published, task_number
from splitwarden.operators.scale import materialise

MIN_REVISIT = 100
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 256 << 20  # archive bytes read by one task of a large job
_LEVEL = 6
_EPOCH = "1970-01-01T00:00:00Z"  # no time of day, so that a retried task writes equal bytes
# Fixed values of the WARC format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, record_type and refers_to of every page."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Sums per task before the shuffle, so a payload that fills a third of the table is one row each.
    groups = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first_id")
    )
    joined = rows.join(groups, "digest", "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record_bytes(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record, not yet compressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_page_urn(page_id)}",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload and payload length of one record; the payload of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(
        int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length")
    )
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (
        len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest
    ):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
        "url": fields.get("WARC-Target-URI", ""),
        "payload": payload,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        name, offset = f"pages-{task_number():06d}.warc.gz", 0
        listed: list[pa.RecordBatch] = []
        with published(f"{folder}/{name}") as out:
            while batch is not None:
                rows = []
                for i in range(batch.num_rows):
                    page, url, payload, digest, kind, refers = (c[i].as_py() for c in batch.columns)
                    member = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    packed = member.compress(record_bytes(page, url, payload, digest, kind, refers))
                    packed += member.flush()
                    out.write(packed)
                    rows.append((name, offset, len(packed), url, digest, page, kind))
                    offset += len(packed)
                names = [c.split()[0] for c in _INDEX.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _INDEX.split(", ")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                listed.append(pa.RecordBatch.from_arrays(columns, names=names))
                batch = next(batches, None)
        yield from listed  # only after the archive is in place

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages to archives in ``folder`` and return the index, one row per record."""
    return materialise(plan_records(pages).mapInArrow(_write(folder), _INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, members) of byte ranges that hold neighbouring records; rows are sorted."""
    members: list[tuple[int, int]] = []
    for offset, length in rows:
        if members and (
            offset - sum(members[-1]) > GAP_BYTES or offset + length - members[0][0] > RANGE_BYTES
        ):
            yield members[0][0], sum(members[-1]), members
            members = []
        members.append((offset, length))
    if members:
        yield members[0][0], sum(members[-1]), members


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _read(folder: str, fields: list[str]):
    schema = pa.schema([_RECORD.field(f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            places = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            first = 0
            while first < len(names):
                last = first
                while last < len(names) and names[last] == names[first]:
                    last += 1
                system, path = locate(f"{folder}/{names[first]}")
                with system.open_input_file(path) as source:
                    for begin, end, members in _ranges(places[first:last]):
                        data = source.read_at(end - begin, begin)
                        found = [
                            parse_record(zlib.decompress(data[o - begin : o - begin + n], 31))
                            for o, n in members
                        ]
                        yield pa.RecordBatch.from_pylist(
                            [{f: r[f] for f in fields} for r in found], schema=schema
                        )
                first = last

    return run


def read_records(index: DataFrame, folder: str, fields: list[str] | None = None) -> DataFrame:
    """The records of the given index rows, all fields or some of them."""
    fields = fields or _RECORD.names
    types = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}
    total = index.agg(F.sum("length")).first()[0] or 0
    ranges = -(-total // RANGE_BYTES)
    cores = index.sparkSession.sparkContext.defaultParallelism
    # The number of tasks follows the bytes to be read, not the small rows that name them.
    tasks = max(1, min(ranges, 4 * cores), -(-total // TASK_BYTES))
    dealt = (
        index.select("file", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("range"))
        .repartition(tasks, "file", "range")
        .sortWithinPartitions("file", "offset")
    )
    return dealt.select("file", "offset", "length").mapInArrow(
        _read(folder, fields), ", ".join(f"{f} {types.get(f, 'string')}" for f in fields)
    )
