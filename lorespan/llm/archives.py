"""Legacy web archives (ARC, versions 1 and 2) to WARC.

An ARC file begins with a version block whose second line names the fields of every record
line. Version 1 has `URL IP date type length`, version 2 adds result code, checksum, location,
offset and file name before the length. A record is its line, then exactly the declared number
of bytes. The converter reads records by these lengths and makes the WARC record that says the
same: an identifier that follows from the file's name and the record's number, the date in ISO
form, the type (response, revisit for a payload that another record holds, resource without an
HTTP head, warcinfo for the version block), and block and payload digests.

Archives are gzip files with one member per record and a bounded size. Payloads never cross a
shuffle: which of equal payloads is kept is found on a narrow index, and each archive gets the
list of its own revisits. Files get a name of their own per task attempt; only listed ones count.

Defined results: a null payload is empty; a null id or URL is left out of the record and null
again when read; repeated rows are repeated records (all with the largest id are responses); an
archive with a broken line or a short record raises ValueError; an empty table gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_path, spread_files, written

# Fixed values of the formats.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
#: Revisits of one payload are joined with it in so many parts.
PARTS = 16
ARCHIVE_BYTES = 16 << 20
PAGE_HEADER = "X-Page-Id"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# Version 1 and 2 archives


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lorespan\n{' '.join(FIELDS[version])}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, content: bytes) -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    extra = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(content)}\n".encode() + content + b"\n"


def read_arc(stream, name: str) -> Iterator[dict]:
    """Records in order, the version block first. `stream` is not compressed."""
    fields: tuple[str, ...] | None = None
    number = 0
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        try:
            if fields is None:
                words = line.decode().split(" ")
                length = int(words[-1])
                record = {"URL": words[0], "Archive-date": words[2], "Content-type": words[3]}
            else:
                words = line.decode().rsplit(" ", len(fields) - 1)
                record = dict(zip(fields, words, strict=True))
                length = int(record["Archive-length"])
        except (ValueError, IndexError) as e:
            raise ValueError(f"{name}: record {number} has a broken line: {line[:200]!r}") from e
        content = stream.read(length)
        if len(content) != length:
            raise ValueError(f"{name}: record {number} declares {length} bytes and has {len(content)}")
        if fields is None:
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"{name}: version {version} is not known")
            fields = FIELDS[version]
        yield record | {"number": number, "content": content}
        number += 1


def http_parts(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields in lower case, payload; no head: empty."""
    if not content.startswith(b"HTTP/"):
        return b"", {}, content
    head, mark, payload = content.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return head + mark, {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def write_arc(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as legacy archives, versions 1 and 2 in turn; the list of their paths."""
    folder = new_path(pages.sparkSession, "arc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        made, out, size = [], None, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                for page, link, text in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    if out is None or size >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        version, name, size = 1 + len(made) % 2, f"{uuid.uuid4().hex}.arc.gz", 0
                        made.append(f"{folder}/{name}")
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        at = out.write(_member(arc_version_block(version, name, "20240101000000")))
                    payload = (text or "").encode()
                    known = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n"
                    second = (page or 0) % 86_400
                    date = f"20240102{second // 3600:02}{second // 60 % 60:02}{second % 60:02}"
                    at += out.write(_member(arc_record(version, name, at, link, date, head.encode() + payload)))
                    size += len(payload)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    rows = pages.select(pages[id_col].cast("bigint"), pages[url].cast("string"), pages[html].cast("string"))
    return written(rows.mapInArrow(run, "path string"), "arc-files")


# Conversion


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(arc: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{number}')}>"


def iso_date(date: str) -> str:
    """ARC dates have 14 digits, in old archives 12 or fewer; missing parts are the earliest."""
    digits = (date + "00000101000000"[len(date) :]) if date.isdigit() else "19700101000000"
    y, rest = digits[:4], [digits[i : i + 2] for i in range(4, 14, 2)]
    return f"{y}-{rest[0]}-{rest[1]}T{rest[2]}:{rest[3]}:{rest[4]}Z"


def warc_record(kind: str, ident: str, date: str, content_type: str, block: bytes, **more: str) -> bytes:
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": ident,
        "WARC-Date": date,
        **{k.replace("_", "-"): v for k, v in more.items()},
        "WARC-Block-Digest": _base32(block),
        "Content-Type": content_type,
        "Content-Length": str(len(block)),
    }
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields.items()], "\r\n"]).encode() + block + b"\r\n\r\n"


def converted(record: dict, arc: str, revisits: dict[int, tuple[str, str, str]]) -> bytes:
    """The WARC record of an ARC record. `revisits`: by number, what is referred to."""
    number, content = record["number"], record["content"]
    ident, date = record_id(arc, number), iso_date(record["Archive-date"])
    if number == 0:
        return warc_record("warcinfo", ident, date, "application/warc-fields", f"software: lorespan\r\nisPartOf: {arc}\r\n".encode())
    more = {} if record["URL"] == "-" else {"WARC_Target_URI": record["URL"]}
    head, _, payload = http_parts(content)
    if not head:
        return warc_record("resource", ident, date, record["Content-type"], content, **more)
    more["WARC_Payload_Digest"] = _base32(payload)
    kind = "application/http; msgtype=response"
    if number not in revisits:
        return warc_record("response", ident, date, kind, content, **more)
    target, uri, when = revisits[number]
    more |= {"WARC_Profile": PROFILE, "WARC_Refers_To": target, "WARC_Refers_To_Date": when}
    more |= {} if uri == "-" else {"WARC_Refers_To_Target_URI": uri}
    return warc_record("revisit", ident, date, kind, head, **more)


def _open(path: str):
    fs, at = file_system(path)
    return gzip.GzipFile(fileobj=io.BufferedReader(fs.open_input_stream(at, compression=None)))


def arc_index(arcs: DataFrame) -> DataFrame:
    """One narrow row for each HTTP record of the archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "number", "page_id", "url", "date", "digest", "payload_bytes"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = []
                with _open(path) as stream:
                    for r in read_arc(stream, path):
                        head, fields, payload = http_parts(r["content"])
                        if head:
                            page = fields.get(PAGE_HEADER.lower())
                            digest = hashlib.sha1(payload).hexdigest()
                            found.append((path, r["number"], page and int(page), r["URL"], r["Archive-date"], digest, len(payload)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names)

    schema = "path string, number bigint, page_id bigint, url string, date string, digest string, payload_bytes bigint"
    return spread_files(arcs).mapInArrow(run, schema)


def convert(arcs: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Convert archives; the list of WARC paths. Of equal payloads of at least `least` bytes
    the one with the largest page id is kept, the others become revisits of it."""
    index = written(arc_index(arcs.select("path")), "arc-index")
    keep = F.max(F.struct("page_id", "path", "number", "url", "date")).alias("keep")
    large = index.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    kept = large.groupBy("digest").agg(keep, F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    others = large.join(kept, "digest").where("page_id < keep.page_id")
    one = F.struct("number", F.col("keep.path").alias("path"), F.col("keep.number").alias("target"), F.col("keep.url").alias("url"), F.col("keep.date").alias("date"))
    lists = others.groupBy("path").agg(F.collect_list(one).alias("revisits"))  # an archive's records: bounded
    folder = new_path(arcs.sparkSession, "warc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                arc = path.rpartition("/")[2]
                of = {
                    r["number"]: (record_id(r["path"].rpartition("/")[2], r["target"]), r["url"], iso_date(r["date"]))
                    for r in revisits or ()
                }
                name = f"{uuid.uuid4().hex}.warc.gz"
                with _open(path) as stream, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for record in read_arc(stream, path):
                        out.write(_member(converted(record, arc, of)))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    work = written(arcs.select("path").join(lists, "path", "left"), "conversion")
    return written(spread_files(work.select("path", "revisits")).mapInArrow(run, "path string"), "warc-files")


# Reading back


def read_warc_stream(stream, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{name}: not a record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length or _base32(block) != fields["warc-block-digest"]:
            raise ValueError(f"{name}: a record is short or its block digest wrong")
        yield fields, block


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row for each response and revisit. Payload length and digest of a response are
    those of its bytes, of a revisit those it declares; `refers_to` is a page id."""
    names = ["page_id", "url", "date", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = []
                with _open(path) as stream:
                    for fields, block in read_warc_stream(stream, path):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        _, head, payload = http_parts(block)
                        digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                        size = int(head["content-length"])
                        if fields["warc-type"] == "response":
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        page = head.get(PAGE_HEADER.lower())
                        found.append(
                            (page and int(page), fields.get("warc-target-uri"), fields["warc-date"], fields["warc-record-id"],
                             fields["warc-type"], size, digest, fields.get("warc-refers-to"))
                        )
                kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names)

    schema = "page_id bigint, url string, date string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to_id string"
    rows = written(spread_files(warcs.select("path")).mapInArrow(run, schema), "warc-records")
    revisits = rows.where("refers_to_id is not null")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()  # a payload's revisits become one row
    targets = rows.join(wanted, "record_id", "left_semi").select("record_id", F.col("page_id").alias("refers_to"))
    # a payload that very many records revisit is joined by parts
    part = F.pmod(F.xxhash64("page_id", "date"), F.lit(PARTS)).cast("int")
    spread = targets.select(F.col("record_id").alias("target"), "refers_to", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("target_part"))
    found = revisits.withColumn("part", part).join(
        spread, (F.col("refers_to_id") == F.col("target")) & (F.col("part") == F.col("target_part")), "left"
    )
    others = rows.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("bigint"))
    return found.select(*names, "refers_to").unionByName(others.select(*names, "refers_to"))
