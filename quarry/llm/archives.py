"""Web archives: pages written as legacy ARC files, converted to WARC, and read back.

ARC files open with a version block, which names the layout of the URL record lines (version
1: five fields, version 2: ten); each record is such a line, as many bytes as it declares, and
a line end. The converter reads a file's records one after the other by these lengths and
makes WARC/1.1 records of them: a record id (a name-based UUID of the file, offset, URL and
date), the 14-digit date as a timestamp, response and revisit types, block and payload
digests. Payloads of `min_bytes` or more that are equal (SHA-1 and length) have one response,
that of the largest key; the others become revisits, which hold the HTTP header only.

Files are written by Spark's text writer, a record a row, with the format's record end as line
separator, so any file system that Spark knows will do; a file is closed after about
`file_bytes` (one larger record is a file of its own) and compressed with gzip. They are read
with Spark's binaryFile source, decompressed and parsed as a stream inside tasks, so a task
holds one file's compressed bytes and one record. Duplicates are found on one row for each
file and distinct payload, pre-aggregated; the answers go back to the files, never the
payloads.

Defined cases: null html is an empty payload; a null key is smaller than all others, and is
not written; a null URL is `urn:null`; white space, controls and non-ASCII in URLs are percent
encoded; very long payloads are whole, within the 2 GB of a Spark value; repeated rows are
records of their own, of equal keys the last by file name and offset stays a response; an
empty table gives files without records, and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, scratch_path, write_table

MIN_BYTES = 1000
FILE_BYTES = 32 << 20
#: answers on duplicates, of some 200 bytes each, that are broadcast
FEW_ANSWERS = 100_000
#: fixed values of the two formats
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
KEY_HEADER = "X-Page-Id"
#: first fetch date of pages that have none of their own: 1996-01-01, and a second for each key
EPOCH = 820_454_400


def _utc(date14: str) -> str:
    return datetime.datetime.strptime(date14, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def _packed(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records as batches of some MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])


def _write(records: DataFrame, path: str, end: str) -> None:
    """One file a task, bytes as they are."""
    records.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(path)


def _read(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# ------------------------------------------------------------------ ARC


def arc_records(pages: DataFrame) -> DataFrame:
    """key, url, date14 and body of pages (page_id, url, html); the body is an HTTP response."""
    key = F.col("page_id").cast("string")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"),
        F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), key, F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    second = F.coalesce(F.pmod(F.crc32(key.cast("binary")), F.lit(10**8)), F.lit(0)) + EPOCH
    return pages.select(F.coalesce("url", F.lit("urn:null")).alias("url"), F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss").alias("date14"), F.concat(head.cast("binary"), html).alias("body"))


def _arc_lines(name: str):
    """Version block, then records; files of even tasks have version 1, of odd ones version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        version = 1 + no % 2

        def rows():
            intro = f"{version} 0 converter-test\n{ARC_FIELDS[version]}\n".encode()
            yield arc_line(version, f"filedesc://{name}-{no}.arc", "19960101000000", "text/plain", len(intro)) + intro
            for b in batches:
                for url, date14, body in zip(b.column("url").to_pylist(), b.column("date14").to_pylist(), b.column("body"), strict=True):
                    raw = body.as_py()
                    yield arc_line(version, escaped(url), date14, "text/html", len(raw)) + raw

        return _packed(rows())

    return run


def escaped(url: str) -> str:
    """White space, controls and non-ASCII as %XX, so that a URL is one field of a line."""
    return "".join(chr(c) if 0x20 < c < 0x7F else f"%{c:02X}" for c in url.encode()) or "urn:empty"


def arc_line(version: int, url: str, date14: str, kind: str, length: int) -> bytes:
    more = " 200 - - 0 -" if version == 2 else ""
    return f"{url} 0.0.0.0 {date14} {kind}{more} {length}\n".encode()


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """pages (page_id, url, html) as gzipped ARC files of about file_bytes each."""
    records = arc_records(pages)
    total = pages.agg(F.sum(F.octet_length("html") + F.lit(400))).first()[0] or 0
    # dealt one by one, so a group of equal pages spreads over all files
    dealt = records.repartition(int(total // file_bytes) + 1)
    _write(dealt.mapInArrow(_arc_lines("pages"), "value binary"), path, "\n")


@dataclass
class ArcRecord:
    """One record: the fields of its line by name, where it began in the file, and its bytes."""

    fields: dict[str, str]
    offset: int
    body: bytes


def stream(content: bytes) -> io.BufferedReader:
    """The decompressed bytes of a file of gzip members, or the bytes themselves, as a stream."""
    if content[:2] != b"\x1f\x8b":
        return io.BufferedReader(io.BytesIO(content))
    return io.BufferedReader(_Members(content), 1 << 20)


class _Members(io.RawIOBase):
    def __init__(self, content: bytes):
        self.rest, self.z = content, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = b""
        while not got and (self.rest or not self.z.eof):
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, len(into))
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if not got and not self.rest and not self.z.eof:
                raise EOFError("the file ends inside a compressed member")
        into[: len(got)] = got
        return len(got)


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"a record declares {n} bytes, the file has {len(got)}")
    return got


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block left out. The line's layout is that of the version block; lines that don't fit it are errors."""
    f, at, names = stream(content), 0, ARC_FIELDS[1].split(" ")
    while line := f.readline():
        if line == b"\n":
            at += 1
            continue
        values = line[:-1].decode("utf-8", "surrogateescape").split(" ")
        first = names is not None and values[0].startswith("filedesc://")
        body = _exactly(f, int(values[-1]))
        if first:
            # the block's first line names the version, its second the fields of all record lines
            about = body.split(b"\n")
            version = int(about[0].split(b" ")[0])
            names = about[1].decode().split(" ") if len(about) > 1 and about[1] else ARC_FIELDS[version].split(" ")
        elif len(values) != len(names):
            raise ValueError(f"{len(values)} fields where the version has {len(names)}: {line[:200]!r}")
        else:
            yield ArcRecord(dict(zip(names, values, strict=True)), at, body)
        at += len(line) + len(body)


def payload_of(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with the empty line) and payload of a block; all payload, where there is no header."""
    end = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
    return (body[:end], body[end:]) if end > 3 else (b"", body)


def header_field(head: bytes, name: str) -> str | None:
    want = name.lower().encode() + b":"
    for line in head.split(b"\r\n"):
        if line[: len(want)].lower() == want:
            return line[len(want) :].strip().decode()
    return None


def record_id(file: str, r: ArcRecord) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{r.offset} {r.fields['Archive-date']} {r.fields['URL']}").urn


# ------------------------------------------------------------------ duplicates

BEST = "struct<has_key:boolean,key:long,file:string,offset:long,url:string,date14:string,id:string>"


def _file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _payload_index(min_bytes: int):
    """A row for each distinct payload of a file: sha1, size, copies and the copy of the largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("has_key", pa.bool_()), ("key", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date14", pa.string()), ("id", pa.string())])
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                file, found = _file_name(path), {}
                for r in read_arc(content.as_py()):
                    head, payload = payload_of(r.body)
                    if len(payload) < min_bytes:
                        continue
                    key = header_field(head, KEY_HEADER)
                    own = (key is not None, int(key or 0), file, r.offset)
                    at = (hashlib.sha1(payload).digest(), len(payload))
                    n, best, _ = found.get(at, (0, None, None))
                    if best is None or own > best:
                        found[at] = (n + 1, own, r)
                    else:
                        found[at] = (n + 1, best, found[at][2])
                best = [dict(zip(("has_key", "key", "file", "offset"), o, strict=True)) | {"url": r.fields["URL"], "date14": r.fields["Archive-date"], "id": record_id(file, r)} for _, o, r in found.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([s for s, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64()), pa.array([n for n, _, _ in found.values()], pa.int64()), pa.array(best, kind)],
                    ["path", "sha1", "size", "copies", "best"],
                )

    return run


def repeated_payloads(arcs: DataFrame, min_bytes: int) -> DataFrame:
    """path, repeated: for each file the payloads it holds that occur more than once anywhere, with the record that stays."""
    index = write_table(arcs.mapInArrow(_payload_index(min_bytes), f"path string, sha1 binary, size long, copies long, best {BEST}"), "payloads")
    keep = index.groupBy("sha1", "size").agg(F.max("best").alias("best"), F.sum("copies").alias("copies")).filter("copies > 1").drop("copies")
    keep = write_table(keep, "responses")
    own = index.select("path", "sha1", "size").join(keep.hint("merge"), ["sha1", "size"])
    return own.groupBy("path").agg(F.collect_list(F.struct("sha1", "size", "best")).alias("repeated"))


# ------------------------------------------------------------------ WARC


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Header and block; the record end is the writer's."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def sha1_label(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def converted(file: str, r: ArcRecord, best: dict | None) -> bytes:
    """WARC record of an ARC record; best: the response of an equal payload, or None."""
    head, payload = payload_of(r.body)
    revisit = best is not None and (best["file"], best["offset"]) != (file, r.offset)
    block = head if revisit else r.body
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(file, r)}>"),
        ("WARC-Date", _utc(r.fields["Archive-date"])),
        ("WARC-Target-URI", r.fields["URL"]),
        ("WARC-IP-Address", r.fields["IP-address"]),
        ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response" if head else r.fields["Content-type"]),
    ]
    if not head:
        fields[0] = ("WARC-Type", "revisit" if revisit else "resource")
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{best['id']}>"), ("WARC-Refers-To-Target-URI", best["url"]), ("WARC-Refers-To-Date", _utc(best["date14"]))]
        fields += [("X-Payload-Length", str(len(payload)))]
        if best["has_key"]:
            fields += [(f"X-Refers-To-{KEY_HEADER[2:]}", str(best["key"]))]
    return warc_record(fields, block)


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        about = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
        yield warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {no}').urn}>"), ("WARC-Date", "1996-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], about)
        for b in batches:
            for path, content, repeated in zip(b.column("path").to_pylist(), b.column("content"), b.column("repeated"), strict=True):
                best = {(x["sha1"], x["size"]): x["best"] for x in repeated.as_py() or []}
                for r in read_arc(content.as_py()):
                    payload = payload_of(r.body)[1]
                    yield converted(_file_name(path), r, best.get((hashlib.sha1(payload).digest(), len(payload))) if best else None)

    return _packed(rows())


def convert_arc(spark, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> None:
    """All ARC files of a folder as gzipped WARC files in another."""
    arcs = _read(spark, arc_path)
    written = write_table(repeated_payloads(arcs, min_bytes), "repeated")
    # the answers go to the files; only where there are too many to broadcast do files and answers meet by shuffle
    entries = written.agg(F.sum(F.size("repeated"))).first()[0] or 0
    repeated = written.withColumnRenamed("path", "of").hint("broadcast" if entries <= FEW_ANSWERS else "shuffle_hash")
    both = arcs.join(repeated, F.col("path") == F.col("of"), "left").select("path", "content", "repeated")
    _write(both.mapInArrow(_to_warc, "value binary"), warc_path, WARC_END)
    drop_table(written)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file, by declared lengths."""
    f = stream(content)
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:80]!r}")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, v = line.decode("utf-8", "surrogateescape").split(":", 1)
            fields[k] = v.strip()
        yield fields, _exactly(f, int(fields["Content-Length"]))


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "target_uri", "warc_date"]

    def rows(content: bytes):
        for fields, block in read_warc(content):
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            head, payload = payload_of(block)
            digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":", 1)[1])
            if kind != "revisit" and hashlib.sha1(payload).digest() != digest:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not that of its digest")
            key, to = header_field(head, KEY_HEADER), fields.get(f"X-Refers-To-{KEY_HEADER[2:]}")
            size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
            yield key and int(key), size, digest.hex(), kind, to and int(to), fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"]

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for content in b.column("content"):
            got = list(rows(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(types)], names)


def read_archives(spark, warc_path: str) -> DataFrame:
    """A row for each response and revisit of the WARC files of a folder; digests of whole payloads are checked."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, target_uri string, warc_date string"
    return _read(spark, warc_path).mapInArrow(_from_warc, kind)


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, folder: Callable[[str], str] | None = None) -> DataFrame:
    """pages written as ARC, converted to WARC and read back. folder: paths for 'arc' and 'warc' (else scratch)."""
    spark = pages.sparkSession
    at = folder or (lambda name: scratch_path(spark, name))
    arc, warc = at("arc"), at("warc")
    write_arc(pages, arc, file_bytes)
    convert_arc(spark, arc, warc, min_bytes)
    return read_archives(spark, warc)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages through ARC and WARC."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP13 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS most FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> most THEN most END AS refers_to
FROM s
"""
