"""WARC archives with an index: written in parallel, read back by coalesced byte ranges.

Every task writes archives of its own into a shared folder, one gzip member per record, and returns the index rows:
file, offset, length, URL and digest. A record is read by its offset and length alone. Selected index rows are sorted
by file and offset, and ranges that lie close together become one read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import bounded_broadcast

#: Fixed: payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 100
#: Pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
#: Ranges of a file are read together over gaps of up to GAP bytes, and up to READ bytes at a time.
GAP = 64 << 10
READ = 4 << 20
LEVEL = 6

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = [("file", "STRING", pa.string()), ("offset", "BIGINT", pa.int64()), ("length", "BIGINT", pa.int64())]


def mark_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes, the row with the smallest key is a response and the others revisit
    it; rows that share this smallest key are all responses, and so are rows with a null key if no equal payload has
    one. A null html is an empty payload. Counts of equal payloads are partial sums before they meet, so a payload
    that a third of all pages have is one row per task.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= least).groupBy(F.unhex("payload_digest").alias("digest"))
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    )
    first = bounded_broadcast(materialize(first, "payloads"))
    again = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.join(first, F.unhex("payload_digest") == F.col("digest"), "left").select(
        *rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def _record(key, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task below ``folder`` and return the index, which has been written too.

    A task that runs again writes a file of another name; the index names only files of tasks that succeeded.
    ``folder`` is a URI that all executors reach.
    """
    kept = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            out = out or store.open_output_stream(f"{base}/{name}", compression=None)
            places = []
            columns = {n: batch.column(n) for n in kept}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                payload = batch.column("payload")[i].as_py().encode() if row["record_type"] == "response" else b""
                record = _record(row["key"], row["url"], payload, row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"])
                out.write(record)
                places.append((offset, len(record)))
                offset += len(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places)), pa.array([p for p, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())]
                + list(columns.values()), [n for n, _, _ in _INDEX] + kept,
            )
        if out:
            out.close()

    fields = ", ".join([f"{n} {k}" for n, k, _ in _INDEX] + [f"{n} {kinds[n]}" for n in kept])
    return materialize(marked.mapInArrow(write, fields), "index")


def _parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC headers, the payload's full size by its HTTP header, and the payload that the record carries."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return fields, size, payload


def read_records(index: DataFrame, folder: str, with_payload: bool = True, gap: int = GAP, most: int = READ) -> DataFrame:
    """The records of the selected index rows, parsed from the archives: key, url, payload_bytes, payload_digest,
    record_type, refers_to, and payload (null for revisits).

    Raises if a record's payload does not have the digest in its header.
    """
    key_kind = index.schema["key"].dataType
    as_key = int if key_kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else str

    def number(urn: str | None):
        value = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return None if value in (None, "None") else as_key(value)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        is_open: dict[str, object] = {}

        def fetch(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            name, start = group[0][0], group[0][1]
            if name not in is_open:
                for f in is_open.values():
                    f.close()
                is_open.clear()
                is_open[name] = store.open_input_file(f"{base}/{name}")
            data = is_open[name].read_at(max(o + n for _, o, n in group) - start, start)
            rows = []
            for _, offset, length in group:
                fields, size, payload = _parse(data[offset - start : offset - start + length])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"record at {offset} of {name} is damaged")
                keep = payload if with_payload and kind == "response" else None
                rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("WARC-Refers-To")), keep))
            key = pa.int64() if as_key is int else pa.string()
            kinds = [key, pa.string(), pa.int64(), pa.string(), pa.string(), key, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("file", "offset", "length")]):
                if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + gap or row[1] + row[2] - group[0][1] > most):
                    yield fetch(group)
                    group = []
                group.append(row)
        if group:
            yield fetch(group)
        for f in is_open.values():
            f.close()

    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kind = "BIGINT" if as_key is int else "STRING"
    ordered = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, f"key {kind}, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to {kind}, payload BINARY")
