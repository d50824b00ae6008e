"""Web archives: ARC to WARC conversion.

ARC files (versions 1 and 2) are streams of records, each a header line of space-separated fields and
as many bytes as the line declares. A file begins with a version block that names its fields, so a
record's line is parsed by the fields of its own version. Conversion gives each record a WARC header
with a synthesised identifier (a name-based UUID of its archive and place, so no two are the same), an
ISO timestamp, a type and SHA-1 digests; records whose payload another has already become ``revisit``
and name that record's identifier. Each WARC archive begins with a ``warcinfo`` record.

Archives are gzip members, one a record, held in rows of an archive table (name, data): Spark's
writers commit each task's rows once, so a retried or lost task leaves nothing half-written.
``export`` puts them into single files. An archive is closed when its records have ``ARCHIVE_BYTES``
unpacked, and read member by member, so a task holds little more than that, or one longer record.

Defined results: page ids must be whole numbers (another type raises ``TypeError``); a null html or url is empty; a null page id sorts after all others, is kept, and
is a response; rows that repeat an id are records of their own, and where that id is the smallest
of its payload all of them are responses; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from crosspan.llm.common import bucketed, written

ARCHIVE_BYTES = 8 << 20
#: Records of one digest that one task joins, and the most digests that are sent to all to be salted.
PER_SALT, MOST_HOT = 20_000, 100_000
#: Fixed field lists of the two header versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:crosspan:warc")


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe(value: str) -> str:
    """A header value without what would end it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


# ---------------------------------------------------------------------------------------- ARC


def arc_head(version: int, name: str, date: str = "20000101000000") -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 crosspan\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{safe(name)}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": safe(name), "Archive-length": str(len(body))}
    return arc_line(version, values) + body + b"\n"


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values[f] for f in ARC_FIELDS[version]) + "\n").encode()


def http_response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload


def arc_record(version: int, name: str, url: str, page: str, payload: bytes) -> bytes:
    """A record line and content; the page id travels in the URL's fragment."""
    content = http_response(payload)
    values = {"URL": f"{safe(url)}#page={safe(page)}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/html", "Result-code": "200", "Checksum": base32_sha1(payload), "Location": "-", "Offset": "0", "Filename": safe(name), "Archive-length": str(len(content))}
    return arc_line(version, values) + content + b"\n"


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of ``data``, unpacked. It is fed in steps, so no member copies the rest."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("the last gzip member is cut off")
            parts.append(d.decompress(view[at : at + step]))
            at = min(at + step, len(view))
        at -= len(d.unused_data)
        yield b"".join(parts)


def parse_arc(chunks: Iterable[bytes]) -> Iterator[ArcRecord]:
    """The records of an ARC file's unpacked chunks (gzip members, or the whole), version block left out.

    Field names come from the version block; the declared length alone says where content ends. A
    record lies in one chunk.
    """
    names = ARC_FIELDS[1]
    for data in chunks:
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = data.index(b"\n", at)
            values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            size = int(values[-1])
            content = data[end + 1 : end + 1 + size]
            if len(content) < size:
                raise ValueError(f"record at {at} declares {size} bytes; {len(content)} are there")
            at = end + 1 + size
            if values[0].startswith("filedesc://"):
                names = tuple(content.decode().split("\n")[1].split(" "))
                continue
            if len(values) != len(names):
                raise ValueError(f"record line has {len(values)} fields, not {len(names)}")
            yield ArcRecord(dict(zip(names, values, strict=True)), content)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (b"", content)


# --------------------------------------------------------------------------------------- WARC


def iso_date(date: str) -> str:
    """An ARC date of 8, 12 or 14 digits as WARC-Date."""
    return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(archive: str, number: int) -> str:
    """The identifier of what an archive's record is converted to."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {number}')}>"


def warc_info(name: str) -> bytes:
    """The first record of a WARC archive."""
    body = b"software: crosspan\r\nformat: WARC File Format 1.1\r\n"
    heads = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, -1)}\r\nWARC-Date: {iso_date('20000101')}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return b"WARC/1.1\r\n" + heads.encode() + body + b"\r\n\r\n"


def warc_record(identifier: str, url: str, page: str, date: str, digest: str, content: bytes, size: int, refers: tuple[str, str] | None) -> bytes:
    """One WARC/1.1 record; ``content`` is the whole HTTP message, or only its head for a revisit.

    ``refers``: the identifier and page of the response that a revisit repeats.
    """
    heads = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", identifier),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Page-ID", page),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(content)}"),
        ("WARC-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(content))),
    ]
    if refers:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Page", refers[1])]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + content + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an unpacked WARC file's records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        heads = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(heads["Content-Length"]) + 4
        yield heads, data[start : at - 4]


# ----------------------------------------------------------------------------------- operators


def archive_rows(records: Iterator[tuple[int, bytes]], head: Callable[[int, str], bytes], limit: int) -> Iterator[pa.RecordBatch]:
    """Pack records to archives of about ``limit`` unpacked bytes, one run per version."""
    from pyspark import TaskContext

    held: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}
    number = 0

    def row(version: int) -> pa.RecordBatch:
        nonlocal number
        number += 1
        name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}-v{version}"
        data = b"".join([gzip.compress(head(version, name), 6, mtime=0), *held.pop(version)])
        sizes.pop(version)
        return pa.RecordBatch.from_pydict({"name": pa.array([name]), "data": pa.array([data], pa.binary())})

    for version, record in records:
        held.setdefault(version, []).append(gzip.compress(record, 6, mtime=0))
        sizes[version] = sizes.get(version, 0) + len(record)
        if sizes[version] >= limit:
            yield row(version)
    for version in list(held):
        yield row(version)


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, data): ARC archives of ``pages``; odd ids in version 2, the others in version 1."""
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"page ids must be whole numbers, not {pages.schema[id_col].dataType.simpleString()}")
    empty = lambda c: F.coalesce(pages[c].cast("string"), F.lit(""))
    source = pages.select(F.coalesce(pages[id_col].cast("string"), F.lit("-")).alias("page"), empty(url_col).alias("url"), empty(html_col).alias("html"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    version = 2 if page[-1:] in "13579" else 1
                    yield version, arc_record(version, f"v{version}.arc.gz", url, page, html.encode())

        yield from archive_rows(records(), arc_head, limit)

    return source.mapInArrow(pack, "name string, data binary")


def records_of(data: bytes) -> Iterator[tuple[str, str, ArcRecord]]:
    """(page, url, record) of a packed ARC archive."""
    for record in parse_arc(members(data)):
        url, _, page = record.fields["URL"].rpartition("#page=")
        yield page, url, record


def index_arc(archives: DataFrame) -> DataFrame:
    """(name, number, page, digest, size): the records of each archive, without their content."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(k, page, base32_sha1(payload), len(payload)) for k, (page, payload) in enumerate((p, split_http(r.content)[1]) for p, _, r in records_of(data.as_py()))]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *arrays], names=["name", "number", "page", "digest", "size"])

    return archives.select("name", "data").mapInArrow(parse, "name string, number long, page string, digest string, size long")


def number_of(page: Column) -> Column:
    return F.when(page != "-", page.cast("long"))


def revisits(index: DataFrame, least: int = 0) -> DataFrame:
    """(name, told array<struct<number, id, first_name, first_number>>): the records that revisit another's.

    Of payloads of at least ``least`` bytes that are equal, the smallest page's record is the
    response. Only digests that repeat are joined. Those with more than ``PER_SALT`` records, of which
    there can be one in so many records, get a salt for each as many.
    """
    keyed = index.select("name", "number", number_of(F.col("page")).alias("id"), "digest").where(F.col("size") >= least)
    place = F.when(F.col("id").isNotNull(), F.struct("id", "name", "number"))
    first = keyed.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = written(first.withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int")), "first")
    hot = first.where("salts > 1").select("digest", "salts")
    count = hot.count()
    salted = first.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))) if 0 < count <= MOST_HOT else first.withColumn("salt", F.lit(0))
    spread = F.pmod(F.xxhash64("name", "number"), F.coalesce("salts", F.lit(1))).cast("int")
    keyed = keyed.join(F.broadcast(hot), "digest", "left").withColumn("salt", spread).drop("salts") if 0 < count <= MOST_HOT else keyed.withColumn("salt", F.lit(0))
    told = keyed.join(salted.select("digest", "salt", "first"), ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("first.id")))
    return told.groupBy("name").agg(F.collect_list(F.struct("number", "first.id", F.col("first.name").alias("first_name"), F.col("first.number").alias("first_number"))).alias("told"))


def write_warc(archives: DataFrame, told: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, data): WARC archives of ARC ``archives``. Only the revisits are shuffled to them."""
    joined = archives.join(told.hint("shuffle_hash"), "name", "left").select("name", "data", "told")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for name, data, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    first = {t["number"]: (record_id(t["first_name"], t["first_number"]), str(t["id"])) for t in told or ()}
                    for k, (page, url, record) in enumerate(records_of(data.as_py())):
                        head, payload = split_http(record.content)
                        date, digest, refers = iso_date(record.fields["Archive-date"]), base32_sha1(payload), first.get(k)
                        yield 0, warc_record(record_id(name, k), url, page, date, digest, head if refers else record.content, len(payload), refers)

        yield from archive_rows(made(), lambda _, name: warc_info(name), limit)

    return joined.mapInArrow(pack, "name string, data binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per WARC record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are computed from its payload and held against its header.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(batch.schema.get_field_index("data")):
                for member in members(data.as_py()):
                    for heads, block in parse_warc(member):
                        if heads["WARC-Type"] == "warcinfo":
                            continue
                        digest, size = heads["WARC-Payload-Digest"].removeprefix("sha1:"), int(heads["WARC-Payload-Length"])
                        if heads["WARC-Type"] == "response":
                            payload = split_http(block)[1]
                            if base32_sha1(payload) != digest or len(payload) != size:
                                raise ValueError(f"{heads['WARC-Record-ID']} doesn't hold what it declares")
                        page, refers = heads["WARC-Page-ID"], heads.get("WARC-Refers-To-Page")
                        rows.append((None if page == "-" else int(page), size, digest, heads["WARC-Type"], int(refers) if refers and refers != "-" else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, suffix: str, folder: str) -> None:
    """Write each archive to a file of its own, through whatever file system ``folder`` names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # A retried task writes the same bytes to a file of its own and moves it into place.
                final = f"{root}/{name}.{suffix}"
                own = f"{final}.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as f:
                    f.write(data.as_buffer())
                system.move(own, final)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    archives.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back: one row per page."""
    arcs = bucketed(write_arc(pages, id_col, url_col, html_col), "name", "arc")
    warcs = written(write_warc(arcs, revisits(written(index_arc(arcs), "index"), least)), "warc")
    return read_warc(warcs).withColumnRenamed("page_id", id_col)
