"""WARC archives with a two-level capture index.

``write_archives`` writes pages as gzipped WARC records, one response per distinct
payload and a revisit for each other page. The captures, sorted by reversed-host URL
key over range partitions, go into compressed blocks of an index file per partition;
of each block only its first key, place and length are kept in a sparse directory file,
and of each directory file one row in the top table. ``lookup`` finds captures by key:
binary search in the top table, in one file's directory, in one block, then a range
read of the record.

Executors write and read through ``pyarrow.fs`` below the shared folder, so local and
remote stores work alike. A task writes under a name of its own attempt, and only what
the successful attempt returns is referred to, so a lost executor or a repeated task
leaves at worst a file that nothing names.

Defined results for odd input: null html is an empty payload, also deduplicated; null
urls have an empty key; pages that repeat an id are separate captures, each with a record
and a key of its own; a null id stays null, and such a page is a response unless a page
with an id has its payload, which it then refers to; white space and control characters of
a url are percent-encoded in its header, and the url as given is kept in a line beside it;
payloads of any length are one record, held by a task one at a time; an empty table writes
nothing; columns beside those named are not kept, so none can clash. A payload that does
not have the digest written with it raises when it is read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, settle, shared_dir
from gridloom.llm.url_filter import host_and_path

BLOCK = 256
#: What a header line cannot hold is percent-encoded; the url as it was is then in a line of its own.
BREAKS, EXACT = re.compile(r"[\x00-\x20\x7f\x85\u2028\u2029]+"), "X-Target-As-Given"
CAPTURES = "key string, page_id long, file string, offset long, length long"
TOP = "first_key string, last_key string, directory string, index string"
FOUND = "key string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def surt(url: Column) -> Column:
    """``com,example,www)/path?query``, so that a host's captures stand together."""
    host, path = host_and_path(url)
    rest = F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"(?s)^[^/?#]*[^?#]*(\?[^#]*)?", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, rest)
    return F.when(host == "", F.lit("")).otherwise(key)


def capture_key(url: Column, page_id: Column) -> Column:
    """White space escaped URL key, then the capture's number. The archive and the place
    that a capture is written at are put behind it, so that no two captures' keys are equal."""
    number = F.when(page_id.isNull(), F.lit("-")).otherwise(F.format_string("%020d", page_id))
    return F.concat(F.regexp_replace(surt(F.coalesce(url, F.lit(""))), r"\s", "%20"), F.lit(" "), number)


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``__sha``, the payload's SHA-1, and ``refers_to``, for revisits the
    largest page_id of an equal payload. The largest per payload is merged before the
    shuffle and joined by payload, where a payload that many pages share is split by size."""
    html = F.coalesce("html", F.lit(""))
    made = pages.withColumn("__sha", F.sha1(html))
    last = made.groupBy("__sha").agg(F.max("page_id").alias("__last"))
    refers = F.when((F.octet_length(html) >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return made.join(last.hint("shuffle_hash"), "__sha").withColumn("refers_to", refers).drop("__last")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _record(kind: str, page_id: int | None, url: str, refers: int | None, digest: str, n: int, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + payload
    plain = BREAKS.sub(lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {plain}",
        *([f"{EXACT}: {json.dumps(url)}"] if plain != url else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 47)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    named = lambda k: fields.get(k, "").rpartition(":")[2].rstrip(">")
    number = lambda k: int(named(k)) if named(k) else None
    kind = fields["WARC-Type"]
    length = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response":
        length = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was written")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": json.loads(fields[EXACT]) if EXACT in fields else fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload_digest": said,
        "payload_bytes": length,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the settled captures ``key, page_id, file, offset, length``."""
    folder = shared_dir(pages.sparkSession)
    rows = record_types(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")), min_bytes)
    rows = rows.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "url", "refers_to", F.unhex("__sha").alias("sha"), F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("n"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        for b in batches:
            made = []
            for r in b.to_pylist():
                if out is None:
                    fs, base = _fs(folder)
                    fs.create_dir(base, recursive=True)
                    own = uuid.uuid4().hex
                    name = f"{folder}/{own}.warc.gz"
                    out = fs.open_output_stream(_fs(name)[1], compression=None)
                kind = "response" if r["refers_to"] is None else "revisit"
                record = _record(kind, r["page_id"], r["url"], r["refers_to"], base64.b32encode(r["sha"]).decode(), r["n"], (r["html"] or "").encode())
                out.write(record)
                made.append((f"{r['key']} {own} {at:015d}", r["page_id"], name, at, len(record)))
                at += len(record)
            yield _batch(CAPTURES, made)
        if out is not None:
            out.close()

    return settle(rows.mapInArrow(write, CAPTURES))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def write_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """Writes index blocks and their directories; returns the settled top table, one
    row per range partition."""
    folder = shared_dir(captures.sparkSession)
    ordered = captures.repartitionByRange(partitions(captures.sparkSession), "key").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, directory, lines, last = None, 0, [], [], ""

        def flush() -> int:
            data = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            lines.clear()
            return at + len(data)

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs, base = _fs(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}.cdx"
                    out = fs.open_output_stream(_fs(name)[1], compression=None)
                last = r["key"]
                lines.append((last, json.dumps([last, r["page_id"], r["file"], r["offset"], r["length"]])))
                if len(lines) == block:
                    at = flush()
        if out is not None:
            if lines:
                at = flush()
            out.close()
            with fs.open_output_stream(_fs(f"{name}.dir")[1], compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield _batch(TOP, [(directory[0][0], last, f"{name}.dir", name)])

    return settle(ordered.mapInArrow(write, TOP))


def _range(path: str, offset: int, length: int) -> bytes:
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        f.seek(offset)
        return f.read(length)


def _all(path: str) -> bytes:
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        return f.read()


def lookup(top: DataFrame, keys: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``keys`` (a column ``key``), one row for each key that is held.

    The top table has one row per index file, so it is bounded by the number of range
    partitions; keys are sorted over the cluster, and each task keeps one directory,
    one block and one open archive at a time.
    """
    files = [tuple(r) for r in top.orderBy("first_key", "last_key").collect()]
    firsts = [f[0] for f in files]
    ordered = keys.select("key").repartitionByRange(partitions(keys.sparkSession), "key").sortWithinPartitions("key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, of_file, block, of_block = [], -1, [], (-1, -1)
        opened: dict = {}
        for b in batches:
            found, held = [], 0
            for key in b.column(0).to_pylist():
                i = bisect.bisect_right(firsts, key) - 1
                if i < 0 or key > files[i][1]:
                    continue
                if i != of_file:
                    directory, of_file = json.loads(_all(files[i][2])), i
                # equal keys may have begun in the block before
                j = bisect.bisect_left(directory, key, key=lambda x: x[0])
                j = j if j < len(directory) and directory[j][0] == key else j - 1
                if (i, j) != of_block:
                    block, of_block = [json.loads(x) for x in zlib.decompress(_range(files[i][3], *directory[j][1:])).decode().split("\n")], (i, j)
                k = bisect.bisect_left(block, key, key=lambda x: x[0])
                if k == len(block) or block[k][0] != key:
                    continue
                _, _, file, offset, length = block[k]
                if file not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    fs, p = _fs(file)
                    opened[file] = fs.open_input_file(p)
                opened[file].seek(offset)
                r = _parse(opened[file].read(length))
                held += len(r["payload"] or b"")
                found.append((key, r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"] if payload else None))
                if held > 8 << 20:
                    yield _batch(FOUND, found)
                    found, held = [], 0
            yield _batch(FOUND, found)

    return ordered.mapInArrow(find, FOUND)
