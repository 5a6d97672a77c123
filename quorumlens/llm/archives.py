"""Legacy web archives: write ARC files, convert them to WARC, read WARC back.

The converter reads an ARC file's version block, takes the field names of its header lines from it
(version 1 has five, version 2 ten), cuts each record by its declared length, and writes the
equivalent WARC record: identifier, ISO timestamp, type and digests are synthesised. Of records
with equal payloads of at least a given size, the one with the smallest page_id is a response (of
equal ids the first in its archive) and the others are revisits of it; smaller ones are responses.
Archives from elsewhere are indexed by reading them; a record that isn't HTTP becomes a resource.

Files lie in the shared folder, under names no two attempts share; a manifest written with them says
which count, so a task that runs again does no harm. Payloads are never shuffled: only the index is.

Defined results: repeated pages are records each, with identifiers of their own; a null html is an empty payload; a null url is written as "-"; white space in a url
is percent-encoded; a null page_id comes last in order; an empty table gives an empty result. An
ARC file whose records don't have their declared lengths, or a page_id that isn't a whole number, raises
ValueError; a payload of any length is held by one task, record by record; other columns aren't passed on.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlens.llm.common import materialise, new_path, quoted, remove, table

# Fixed values of the ARC and WARC formats.
ARC_FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAKER = "quorumlens"
ARCHIVE_DATE = "20200101000000"
#: An archive is closed at so many bytes of payload or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 5000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs
DATES = "%Y%m%d%H%M%S"

INDEX = "page_id long, arc string, position long, payload_bytes long, payload_digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_out(path: str):
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def open_in(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_stream(at, buffer_size=1 << 20)


def opened(path: str):
    """A stream over the file's bytes, compressed or not."""
    stream = io.BufferedReader(open_in(path), 1 << 20)
    return gzip.open(stream) if stream.peek(2)[:2] == b"\x1f\x8b" else stream


def parted(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with the blank line that ends it, and payload; a record that isn't HTTP is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    ends = [(at, at + len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := body.find(gap)) >= 0]
    cut = min(ends)[1] if ends else len(body)
    return body[:cut], body[cut:]


# ARC


def arc_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 {MAKER}\n{' '.join(ARC_FIELDS[version])}\n\n"
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return f"{' '.join(head)}\n{body}".encode()


def arc_record(url: str | None, payload: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "-")
    head = [safe, "0.0.0.0", date, "text/html", *(["200", "-", "-", str(offset), name] if version == 2 else []), str(len(http) + len(payload))]
    return " ".join(head).encode("utf-8", "replace") + b"\n" + http + payload


def parse_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and body of each record of an ARC file, compressed or not, after its version block."""
    stream = io.BufferedReader(stream) if isinstance(stream, io.RawIOBase) else stream
    line = stream.readline()
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file begins with a filedesc line")
    body = stream.read(int(line.split()[-1]))
    told = body.split(b"\n")
    version = int(told[0].split()[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    fields = told[1].decode().split() if len(told) > 1 and told[1].split() else ARC_FIELDS[version]
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header line of {len(parts)} fields where the version block names {len(fields)}: {line[:200]!r}")
        head = dict(zip(fields, parts, strict=True))
        size = int(head["Archive-length"])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"an ARC record of {len(body)} bytes declares {size}")
        yield head, body


def write_arc(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", version: int = 1, date: str = ARCHIVE_DATE) -> DataFrame:
    """Write pages to ARC files in folder; returns their index, written too: a row for each record, by file and place in it."""

    def run(batches):
        out, rows = None, {n: [] for n in ("page_id", "arc", "position", "payload_bytes", "payload_digest")}
        size = count = 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("arc", pa.string()), ("position", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

        for batch in batches:
            for pid, link, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    out, size, count = open_out(f"{folder}/{name}"), 0, 0
                    out.write(gzip.compress(arc_block(name, version, date), 1))
                body = data.as_py() or b""
                out.write(gzip.compress(arc_record(link.as_py(), body, version, date, name, size) + b"\n", 1, mtime=0))
                for k, v in zip(rows, (pid.as_py(), f"{folder}/{name}", count, len(body), digest32(body)), strict=True):
                    rows[k].append(v)
                size, count = size + len(body), count + 1
                if size >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    yield close()
                    out, rows = None, {n: [] for n in rows}
        if out is not None:
            yield close()

    if pages.schema[page_id].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise ValueError(f"{page_id} is no whole number")
    given = pages.select(F.col(quoted(page_id)).cast("long").alias("page_id"), F.col(quoted(url)).cast("string").alias("url"), F.col(quoted(payload)).cast("binary").alias("payload"))
    return materialise(given.mapInArrow(run, INDEX), "arc-index")


def index_arcs(files: DataFrame) -> DataFrame:
    """The index of ARC files (arc: their paths) that others have written; their records have no page_id."""

    def run(batches):
        for batch in batches:
            for arc in batch.column(0).to_pylist():
                rows = []
                with opened(arc) as source:
                    for n, (_, body) in enumerate(parse_arc(source)):
                        payload = parted(body)[1]
                        rows.append((None, arc, n, len(payload), digest32(payload)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = [f.split()[0] for f in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return materialise(files.select("arc").repartition(max(1, files.count()), "arc").mapInArrow(run, INDEX), "arc-index")


# Conversion


def decided(index: DataFrame, least: int) -> DataFrame:
    """index with revisit, refers_to (null for a response) and the place of the record referred to."""
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "arc", "position")
    kept = index.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = index.join(kept, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~(F.col("arc").eqNullSafe(F.col("first.arc")) & F.col("position").eqNullSafe(F.col("first.position")))
    return both.select(*index.columns, revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.concat_ws("/", "first.arc", "first.position").alias("refers_place"))


def record_id(place: str) -> str:
    """The identifier of the record at a place (archive and number): always the same, and no other record's."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, place)}>"


def warc_record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def converted(head: dict[str, str], body: bytes, row: dict) -> tuple[bytes, str, int]:
    """The WARC record of an ARC record whose row of the index is given, its payload's digest and length."""
    http, payload = parted(body)
    digest = digest32(payload)
    date = datetime.strptime(head["Archive-date"], DATES).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit, page_id, refers_to = row["revisit"], row["page_id"], row["refers_to"]
    block = http if revisit else body
    lines = [("WARC-Type", "revisit" if revisit else "response" if http else "resource"), ("WARC-Record-ID", record_id(f"{row['arc']}/{row['position']}")), ("WARC-Date", date), ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"])]
    lines += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response" if http else head["Content-type"])]
    lines += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["refers_place"])), ("WARC-Truncated", "length"), ("X-Payload-Length", str(len(payload)))]
        lines += [("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    return warc_record(lines, block), digest, len(payload)


def arc_to_warc(index: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Convert the ARC files of index; returns (warc, n), written too. A file is converted by one task."""

    def run(rows: pa.Table) -> pa.Table:
        by = {r["position"]: r for r in rows.to_pylist()}
        arc = rows.column("arc")[0].as_py()
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        with open_out(name) as out, opened(arc) as source:
            info = f"software: {MAKER}\r\nformat: WARC File Format 1.1\r\nconverted-from: {arc.rpartition('/')[2]}\r\n".encode()
            out.write(gzip.compress(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info), 1))
            n = 0
            for head, body in parse_arc(source):
                r = by[n]
                data, digest, size = converted(head, body, r)
                if (digest, size) != (r["payload_digest"], r["payload_bytes"]):
                    raise ValueError(f"record {n} of {arc} isn't what its index says")
                out.write(gzip.compress(data, 1, mtime=0))
                n += 1
        return pa.table({"warc": [name], "n": pa.array([n], pa.int64())})

    # a partition for each archive on average: so explicit a number isn't cut down for the index being small
    archives = max(1, index.select("arc").distinct().count())
    return materialise(decided(index, least).repartition(archives, "arc").groupBy("arc").applyInArrow(run, "warc string, n long"), "warc-list")


# WARC


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"a WARC record of {len(block)} bytes declares {size}")
        yield head, block


def read_warc(files: DataFrame) -> DataFrame:
    """The response, resource and revisit records of files (warc): their page, payload and links, digests verified."""

    def run(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with gzip.open(open_in(name)) as source:
                    for head, block in parse_warc(source):
                        if head["warc-type"] not in ("response", "revisit", "resource"):
                            continue
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        payload = parted(block)[1]
                        size = int(head.get("x-payload-length", len(payload)))
                        if head["warc-type"] != "revisit" and (len(payload), digest32(payload)) != (size, digest):
                            raise ValueError(f"{name}: {head['warc-record-id']} has another payload than its header says")
                        pid, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((None if pid is None else int(pid), size, digest, head["warc-type"], None if to is None else int(to), head["warc-target-uri"], head["warc-date"], head["warc-record-id"]))
                kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("warc").repartition(max(1, files.count()), "warc").mapInArrow(run, RECORDS)


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = new_path(spark, "arc")
    warcs = arc_to_warc(write_arc(table(spark, sf_dir, "pages"), arcs), new_path(spark, "warc"), 0)
    remove(spark, arcs)  # all of them are converted
    found = read_warc(warcs)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, octet_length(body) AS payload_bytes,
             array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(s AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM b GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f USING (payload_digest)
"""
