"""WARC archives: a writer with revisit records and a reader that salvages what it can from damaged files.

Writer. One gzip member per record, files of bounded size, in a folder that all executors share. Every task attempt writes
files of its own name and reports them; only the files in the committed manifest are ever read, so attempts that were lost
or ran twice do no harm. The folder is reached through pyarrow's file systems (local or mounted path, hdfs, s3, gs).

Roles. Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest id is the response, the others
revisit it. The smallest id per digest comes from one grouping with map-side combine; the join back is an equi-join on the
digest that Spark can split where one payload fills a large part of the table.

Reader. Each file is read member by member, at any time only one record in memory. A record must pass all checks: gzip
checksum, version line, headers, ``Content-Length``, closing line ends and block digest. When one fails, the reader looks
for the next place where a whole valid record begins (a gzip member or a plain ``WARC/1.`` version line), goes on from
there and logs the bytes between as a quarantined gap. Plain and compressed records may follow each other in one file.

Rules: a null payload is empty; a null address or id has no header. Records that repeat the response's id and payload are
responses as well; a null id is never the smallest unless all are null. Empty tables give no file and an empty result.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100
FILE_BYTES = 32 << 20
CHUNK = 1 << 18
END = b"\r\n\r\n"
RECORD = ("kind string, path string, start bigint, end bigint, record_type string, record_id string, refers_to string, target_uri string, "
          "payload_digest string, payload_length bigint, payload binary, reason string")
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def with_roles(records: DataFrame) -> DataFrame:
    """(id, uri, payload) -> also digest, bytes, record_type, refers_to."""
    sized = (records.withColumn("payload", F.coalesce("payload", F.lit("").cast("binary")))
             .withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("bigint")))
    first = (records.select("id", F.coalesce("payload", F.lit("").cast("binary")).alias("p")).where(F.length("p") >= LEAST)
             .groupBy(F.sha2("p", 256).alias("_digest")).agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    revisits = F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))
    return (sized.join(first, sized["digest"] == first["_digest"], "left")
            .select("id", "uri", "payload", "digest", "bytes", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisits, F.col("_first")).alias("refers_to")))


def header_value(x: str) -> str:
    """On one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


def record_bytes(page, uri, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-record:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {header_value(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (id, uri, payload, digest, record_type, refers_to) rows below ``folder``; the lazy manifest (path, records, bytes)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, path, count, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row in range(batch.num_rows):
                page, uri, payload, digest, kind, refers_to = (c[row].as_py() for c in columns)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, count, size = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record_bytes(page, uri, payload, digest, kind, refers_to, date)) + deflate.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return records.select("id", "uri", "payload", "digest", "record_type", "refers_to").mapInArrow(write, "path string, records bigint, bytes bigint")


class Bad(Exception):
    """A check that failed."""


def parsed(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record in ``whole``."""
    if not whole.startswith(b"WARC/1."):
        raise Bad("no version line")
    stop = whole.find(END)
    if stop < 0:
        raise Bad("headers do not end")
    headers = fields(whole[:stop])
    length = content_length(headers)
    block = whole[stop + 4:stop + 4 + length]
    if len(whole) != stop + 4 + length + 4 or not whole.endswith(END):
        raise Bad("length does not fit")
    checked(headers, block)
    return headers, block


def fields(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("broken header line")
        found[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


def content_length(headers: dict[str, str]) -> int:
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("no content length")
    return int(length)


def checked(headers: dict[str, str], block: bytes) -> None:
    name, _, value = headers.get("warc-block-digest", "").partition(":")
    if name == "sha256" and hashlib.sha256(block).hexdigest() != value.lower():
        raise Bad("block digest differs")
    if name == "sha1" and len(value) == 40 and hashlib.sha1(block).hexdigest() != value.lower():
        raise Bad("block digest differs")


def member_at(file, at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the gzip member or plain record that begins at ``at``."""
    head = file.read_at(min(8, size - at), at)
    if head[:3] == b"\x1f\x8b\x08":
        inflate, parts, begin, place = zlib.decompressobj(31), [], b"", at
        while not inflate.eof:
            if place >= size:
                raise Bad("member is cut off")
            chunk = file.read_at(min(CHUNK, size - place), place)
            place += len(chunk)
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise Bad("gzip data is damaged") from e
            if len(begin) < 7:
                begin += parts[-1][:7 - len(begin)]
                if not b"WARC/1.".startswith(begin):
                    raise Bad("no version line")
        headers, block = parsed(b"".join(parts))
        return headers, block, place - len(inflate.unused_data)
    if head[:7] != b"WARC/1.":
        raise Bad("no record begins here")
    top = header_at(file, at, size)
    end = at + len(top) + 4 + content_length(fields(top)) + 4
    if end > size:
        raise Bad("record is cut off")
    headers, block = parsed(file.read_at(end - at, at))
    return headers, block, end


def header_at(file, at: int, size: int) -> bytes:
    """Version line and headers of the plain record at ``at``, of any length; not read on after a broken line."""
    top, place, line = bytearray(), at, 0
    while place < size:
        begin = max(0, len(top) - 3)
        top += file.read_at(min(1 << 16, size - place), place)
        place = at + len(top)
        stop = top.find(END, begin)
        if stop >= 0:
            return bytes(top[:stop])
        whole = top.rfind(b"\r\n", begin)
        if whole > line:
            fields(bytes(top[line:whole]))  # leaves out what is before the first line end
            line = whole
    raise Bad("headers do not end")


def next_valid(file, at: int, size: int):
    """The first valid record that begins at ``at`` or later: (start, headers, block, end), or None."""
    while at < size:
        chunk = file.read_at(min(CHUNK + 8, size - at), at)
        places = sorted(p for magic in (b"\x1f\x8b\x08", b"WARC/1.") for p in occurrences(chunk, magic) if p < CHUNK)
        for p in places:
            try:
                return at + p, *member_at(file, at + p, size)
            except Bad:
                continue
        at += CHUNK
    return None


def occurrences(chunk: bytes, what: bytes) -> Iterator[int]:
    p = chunk.find(what)
    while p >= 0:
        yield p
        p = chunk.find(what, p + 1)


def salvage(file, size: int) -> Iterator[tuple]:
    """("record", start, end, headers, block) of each valid record and ("gap", start, end, reason) of what lies between."""
    at = 0
    while at < size:
        try:
            headers, block, end = member_at(file, at, size)
        except Bad as e:
            found = next_valid(file, at + 1, size)
            yield "gap", at, found[0] if found else size, str(e), None
            if found is None:
                return
            at, headers, block, end = found
        yield "record", at, end, headers, block
        at = end


def read_archives(paths: DataFrame, tasks: int) -> DataFrame:
    """Records and gaps (``RECORD``) of the archives named in the column ``path``, dealt over ``tasks`` tasks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flushed():
            columns = list(zip(*rows))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    for kind, start, end, what, block in salvage(file, file.size()):
                        if kind == "gap":
                            rows.append((kind, path, start, end, *[None] * 7, what))
                        else:
                            payload = block.partition(END)[2] if what.get("content-type", "").startswith("application/http") else block
                            length = what.get("warc-payload-length", "")
                            digest = what.get("warc-payload-digest", "").partition("sha256:")[2]
                            rows.append((kind, path, start, end, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-refers-to"), what.get("warc-target-uri"),
                                         digest.lower() or None, int(length) if length.isascii() and length.isdigit() else None, payload, None))
                            held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield flushed()
                            rows, held = [], 0
        if rows:
            yield flushed()

    return paths.select("path").repartition(max(1, tasks)).mapInArrow(read, RECORD)
