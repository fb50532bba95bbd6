"""WARC archives of pages and a two-level index of their captures.

Archives hold one gzip member a record, so that a record can be read by its range alone. The index has a line a record,
`key file offset length`, in the order of keys; a key is the URL with its host reversed, a blank and the page's id in 20 digits.
Lines lie in compressed blocks; a directory a part of the index has the first and last key and the range of each block, and one
row a part says which keys it holds. A search goes by bisection through the parts, a part's directory and a block, and then
reads the records' ranges. Tasks write files of new names, and only what Spark commits names them, so a lost task leaves nothing
that anyone reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import Scratch

#: Bytes of an archive before the next is begun; bytes that one read may take; records in a block of the index.
ARCHIVE_BYTES, READ_BYTES, BLOCK_LINES = 1 << 30, 1 << 23, 1024
#: A digest with at least one row in so many is dealt with by itself.
HEAVY = 1000
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, file string, offset long, length long"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


@dataclass(frozen=True)
class Index:
    """Folder of the archives, folder of the index, and of each part of it that has lines (name, first key, last key)."""

    archives: str
    folder: str
    parts: tuple[tuple[str, str, str], ...]


def surt(url: Column) -> Column:
    """`http://User@Blog.Example.com:80/a?b#c` as `com,example,blog:80)/a?b`; what names no host as `)` and itself; null as `)`."""
    u = F.coalesce(url, F.lit(""))
    place = F.regexp_replace(F.regexp_extract(u, AUTHORITY, 1), "^.*@", "")
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_replace(place, r":\d*$", "")), r"\.")), ",")
    key = F.concat(host, F.regexp_extract(place, r":\d+$", 0), F.lit(")"), F.regexp_replace(F.regexp_replace(u, AUTHORITY, ""), "(?s)#.*$", ""))
    for c in " \t\n\v\f\r":  # blanks part the fields of a line
        key = F.replace(key, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return key


def capture_key(url: Column, page_id: Column) -> Column:
    """Key of one capture. Ids sort as numbers, none before all."""
    digits = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(surt(url), F.lit(" "), F.coalesce(digits, F.lit("")))


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id, url, payload, size, digest, keeper, date=DATE) -> bytes:
    """One record as a gzip member. A revisit has the head of the answer but not its payload."""
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:  # no character may end a line early
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if payload is None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(keeper, digest)), ("X-Refers-To-Page-ID", keeper)]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip_member(text.encode() + block + b"\r\n\r\n")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(member: bytes) -> dict:
    """What a record says. The payload of a response is held against its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(warc[name]) if name in warc else None
    size = int(fields(http)["Content-Length"])
    if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {warc['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": number("X-Page-ID"), "url": warc.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"),
    }


def with_keepers(scratch: Scratch, pages: DataFrame, least: int) -> DataFrame:
    """key, page_id, url, payload, size, digest (hex) and keeper: the largest page_id among the rows of equal payload.

    Payloads move once at most, and not at all where Spark finds the list of repeated payloads small. Digests with a thousandth of the repeated rows
    or more, of which there are a thousand at most, are broadcast, so no digest gathers its rows in one task.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    groups = rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).filter((F.col("n") > 1) & (F.col("size") >= least))
    groups = scratch.keep(groups.select("digest", "n", "keeper"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(groups.filter(F.col("n") * HEAVY >= total).select("digest", F.col("keeper").alias("_heavy"), F.lit(True).alias("_hot")))
    light = groups.filter(F.col("n") * HEAVY < total).select(F.col("digest").alias("_light"), F.col("keeper").alias("_other"))
    met = rows.join(heavy, "digest", "left")
    met = met.join(light, F.when(F.col("_hot").isNull(), F.col("digest")) == F.col("_light"), "left")
    keeper = F.coalesce("_heavy", "_other")
    return met.select(
        capture_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "url", "digest", "size", keeper.alias("keeper"),
        F.when(keeper.isNull() | keeper.eqNullSafe(F.col("page_id")), F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes a record a row of (page_id, url, html); gives key, file, offset and length of each."""
    base = f"{scratch.base}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store(base)
        system.create_dir(folder, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                placed = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                        info = b"software: specloom\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        member = gzip_member(head.encode() + info + b"\r\n\r\n")
                        out.write(member)
                        at = len(member)
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    member = record(row["page_id"], row["url"], row["payload"], row["size"], digest, row["keeper"])
                    out.write(member)
                    placed.append({"key": row["key"], "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(placed, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return scratch.keep(with_keepers(scratch, pages.select(F.col("page_id").cast("long"), "url", "html"), least).mapInArrow(write, ENTRY), "entries")


def packed(lines: list[str]) -> bytes:
    return zlib.compress("\n".join(lines).encode(), 6)


def lines_of(system: fs.FileSystem, path: str, offset: int | None = None, length: int | None = None) -> list[str]:
    with system.open_input_file(path) as f:
        return zlib.decompress(f.read() if offset is None else f.read_at(length, offset)).decode().split("\n")


def key_of(line: str) -> str:
    """Surt, blank and id: the first two fields."""
    return line[: line.index(" ", line.index(" ") + 1)]


def build_index(entries: DataFrame, scratch: Scratch, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts entries by key and writes blocks and directories. One row a part, and so a partition, comes to the driver."""
    base = f"{scratch.base}/index"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store(base)
        system.create_dir(folder, recursive=True)
        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []

        def block():
            nonlocal out, at, lines
            if lines:
                out = out or system.open_output_stream(f"{folder}/{name}.blocks", compression=None)
                data = packed(lines)
                out.write(data)
                directory.append((key_of(lines[0]), key_of(lines[-1]), at, len(data)))
                at, lines = at + len(data), []

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(f"{row['key']} {row['file']} {row['offset']} {row['length']}")
                if len(lines) >= block_lines:
                    block()
        block()
        if directory:
            out.close()
            with system.open_output_stream(f"{folder}/{name}.directory", compression=None) as f:
                f.write(packed(["\t".join(map(str, d)) for d in directory]))
            yield pa.RecordBatch.from_pylist([{"name": name, "first": directory[0][0], "last": directory[-1][1]}])

    cut = entries.withColumn("_salt", F.rand(3)).repartitionByRange("key", "_salt").sortWithinPartitions("key", "file", "offset").drop("_salt")
    parts = scratch.keep(cut.mapInArrow(write, "name string, first string, last string"), "parts")
    return Index(f"{scratch.base}/archives", base, tuple(sorted(((r["name"], r["first"], r["last"]) for r in parts.collect()), key=lambda p: p[1:])))


def lookup(index: Index, queries: DataFrame) -> DataFrame:
    """key, file, offset and length of every capture with low <= key <= high, for each row (low, high) of the queries.

    One capture has low = high = `capture_key`; all captures of a URL lie between its `surt` with a blank and that with a `!`. Queries
    are sorted, so that a task opens few directories; what they hit goes to the tasks by block, so that a block is read once.
    """
    parts, folder = index.parts, index.folder

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        lasts, held = [p[2] for p in parts], ("", [], [])
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                low, high = row["low"], row["high"]
                k = bisect_left(lasts, low)
                while k < len(parts) and parts[k][1] <= high:
                    if held[0] != parts[k][0]:
                        directory = [d.split("\t") for d in lines_of(system, f"{base}/{parts[k][0]}.directory")]
                        held = (parts[k][0], directory, [d[1] for d in directory])
                    b = bisect_left(held[2], low)
                    while b < len(held[1]) and held[1][b][0] <= high:
                        found.append({"part": held[0], "at": int(held[1][b][2]), "size": int(held[1][b][3]), "low": low, "high": high})
                        b += 1
                    k += 1
            yield pa.RecordBatch.from_pylist(found, pa.schema([("part", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("low", pa.string()), ("high", pa.string())]))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        held, lines, keys = None, [], []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held != (row["part"], row["at"]):
                    held = (row["part"], row["at"])
                    lines = lines_of(system, f"{base}/{row['part']}.blocks", row["at"], row["size"])
                    keys = [key_of(x) for x in lines]
                for line in lines[bisect_left(keys, row["low"]) : bisect_right(keys, row["high"])]:
                    key, file, offset, length = line.rsplit(" ", 3)
                    found.append({"key": key, "file": file, "offset": int(offset), "length": int(length)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    asked = queries.select("low", "high").repartitionByRange("low", "high").sortWithinPartitions("low", "high")
    hit = asked.mapInArrow(blocks, "part string, at long, size long, low string, high string")
    return hit.repartition("part", "at").sortWithinPartitions("part", "at").mapInArrow(records, ENTRY)


def read_records(index: Index, located: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the given places: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, the payload.

    Places go to the tasks by stretches of an archive; what lies side by side is read at once. A revisit has no payload.
    """
    base = index.archives
    schema = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store(base)
        name, source = None, None
        for batch in batches:
            rows, i = batch.to_pylist(), 0
            while i < len(rows):
                if rows[i]["file"] != name:
                    if source is not None:
                        source.close()
                    name = rows[i]["file"]
                    source = system.open_input_file(f"{folder}/{name}")
                start, end, j = rows[i]["offset"], rows[i]["offset"] + rows[i]["length"], i + 1
                while j < len(rows) and rows[j]["file"] == name and rows[j]["offset"] <= end and rows[j]["offset"] + rows[j]["length"] - start <= READ_BYTES:
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                    j += 1
                data = source.read_at(end - start, start)
                found = [parsed(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in rows[i:j]]
                yield pa.RecordBatch.from_pylist([{n: f[n] for n, _ in schema} for f in found], pa.schema(schema))
                i = j
        if source is not None:
            source.close()

    names = {"int64": "long", "string": "string", "binary": "binary"}
    dealt = located.repartition("file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, ", ".join(f"{n} {names[str(t)]}" for n, t in schema))


def round_trip(pages: DataFrame, least: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, as read from archives that are written here.

    Every key of the table is looked up in the index and its records are read by their ranges. A payload is the UTF-8 of html, null is
    empty. Of the rows with equal payloads of `least` bytes or more, all with the largest page_id are responses (rows may repeat an id;
    a null id is the smallest) and the others revisit that id; smaller payloads are all responses. A null url has a key without host,
    null ids stay null. Rows that are repeated are records each. A page of any length is one record in memory of one task. Only
    page_id, url and html are read. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    index = build_index(write_archives(pages, scratch, least), scratch, block_lines)
    asked = pages.select(capture_key(F.col("url"), F.col("page_id").cast("long")).alias("low")).distinct().withColumn("high", F.col("low"))
    out = scratch.keep(read_records(index, lookup(index, asked), payload=False).drop("url"), "records")
    scratch.drop("archives", "index", "entries", "parts", "groups")
    return out
