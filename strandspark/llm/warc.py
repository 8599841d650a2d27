"""WARC archives: a writer, a normaliser for monolithic gzip streams, and a reader.

The writer lets Spark's text sink put one gzip stream over all records of a file; its line
separator is the blank lines that end a record. The normaliser inflates each such stream
once, gives every record a gzip member of its own and writes a sidecar index of offsets. All
files go through Spark's readers and committers, so any store that Spark knows will do and a
lost executor's files are written again.

The text source inflates a stream as it reads and hands it on in pieces between blank lines,
so a monolithic archive may have any size: a task holds one record and some megabytes of
members. Normalised archives are rolled by bytes, and readers hold one of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Payloads shorter than this are stored again rather than revisited.
LEAST_REVISIT = 100
#: Records in one monolithic archive at most; such a stream is one task of the normaliser.
ARCHIVE_RECORDS = 2000
#: Bytes of members at which a normalised archive ends; one record may exceed it.
ARCHIVE_BYTES = 32 << 20
#: Bytes of members that go to the sink together.
PIECE_BYTES = 4 << 20
_CHUNK = 1 << 20
_PAGE = re.compile(rb"<urn:page:(-?\d*)>")


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``__digest``, ``__bytes`` and ``__refers``, the page whose record a page revisits.

    Only digests meet in the search for equal payloads; the pages themselves are dealt out
    by their id, so a payload that very many pages share does not gather them.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("__digest"), F.octet_length(payload).cast("bigint").alias("__bytes"))
    keys = df.filter(F.col("__bytes") >= least).filter("page_id IS NOT NULL").select("page_id", "__digest")
    first = keys.groupBy("__digest").agg(F.min("page_id").alias("__refers"), F.max("page_id").alias("last")).filter("__refers < last").drop("last")
    again = keys.join(first, "__digest").filter("page_id > __refers").distinct()
    again = again.select(F.col("page_id").alias("__page"), F.col("__digest").alias("__same"), "__refers")
    return df.join(again, (df["page_id"] == again["__page"]) & (df["__digest"] == again["__same"]), "left").drop("__page", "__same")


def write_monolithic(pages: DataFrame, folder: str, date: str = "2025-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS) -> None:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as WARC files of one gzip stream each.

    Null html is an empty payload, a null url becomes a URN of the page, a null page id is an
    empty number and such a record is never a revisit. Pages that share an id and a payload
    are all responses if theirs is the smallest id, else all revisits. Other columns are not
    written, so their names cannot clash; no pages give no files. A payload of many megabytes
    is one record of its stream.
    """
    df = plan_records(pages)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("__refers").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.concat(F.lit("urn:page:"), page))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        page,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("__digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("__refers").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
    )
    out = df.select(F.concat(head, block).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def _inflate(blob: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip stream, member after member, in pieces."""
    engine, at = zlib.decompressobj(31), 0
    while at < len(blob) or engine.unconsumed_tail:
        piece = engine.unconsumed_tail
        if not piece:
            piece = bytes(blob[at : at + _CHUNK])
            at += len(piece)
        yield engine.decompress(piece, 4 * _CHUNK)
        while engine.eof and engine.unused_data:
            rest, engine = engine.unused_data, zlib.decompressobj(31)
            yield engine.decompress(rest, 4 * _CHUNK)
        if engine.eof:
            engine = zlib.decompressobj(31)
    if (last := engine.flush()):
        yield last


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(raw record, header fields in lower case, block) of a stream of WARC bytes.

    Blank lines before a record or at the end of the stream are no part of a record.
    """
    data = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        for piece in pieces:
            data.extend(piece)
            return True
        ended = True
        return False

    while True:
        # Blank lines before a record are skipped: some writers end a stream, or each record, with too many.
        while data[:1] in (b"\r", b"\n") or (not data and more()):
            if data[:1] in (b"\r", b"\n"):
                del data[:1]
        while (cut := data.find(b"\r\n\r\n")) < 0 and more():
            pass
        if cut < 0:
            if data.strip():
                raise ValueError("a WARC header is cut short")
            return
        lines = bytes(data[:cut]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = cut + 4 + int(fields["content-length"])
        while len(data) < end + 4 and not ended:
            more()
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield bytes(data[: end + 4]), fields, bytes(data[cut + 4 : end])
        del data[: end + 4]


def _member(raw: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


#: Ends each file; its last byte, zero, is left to the text sink's line separator.
_EMPTY_MEMBER = _member(b"", 1)


def normalise(spark: SparkSession, source: str, target: str, level: int = 6, most: int = ARCHIVE_BYTES, piece: int = PIECE_BYTES) -> None:
    """Rewrite the gzip archives under ``source`` with one member for each record, and index them.

    ``target/archive=NAME/kind=warc`` holds the members and ``kind=cdx`` the index: gzip over
    JSON lines with the offset, length, record id, type and payload digest of each record.
    Any gzip stream of records will do, of one member or many, whose name ends in ``.gz``,
    with any number of blank lines after a record. An archive of more than ``most`` bytes goes on in another. Between pieces stands an empty
    member, which readers of gzip skip.
    """
    blank = CRLF * 2

    def lines(index: list[dict]) -> bytes:
        return _member("".join(json.dumps(x) + "\n" for x in index).encode(), level)

    def rewritten(path: str, pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        name, number, seq = hashlib.md5(path.encode()).hexdigest(), 0, 0
        members, index, at, begun = [], [], 0, 0

        def row(kind: str, value: bytes) -> pa.RecordBatch:
            cols = [pa.array([f"{name}-{number:05d}"]), pa.array([kind]), pa.array([seq], pa.int64()), pa.array([value + _EMPTY_MEMBER[:-1]], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["archive", "kind", "seq", "value"])

        for raw, fields, _ in read_records(pieces):
            member = _member(raw, level)
            index.append({"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest")})
            members.append(member)
            at += len(member)
            if at - begun >= piece:
                yield row("warc", b"".join(members))
                members, seq, at = [], seq + 1, at + len(_EMPTY_MEMBER)
                begun = at
                if at >= most:
                    yield row("cdx", lines(index))
                    index, at, begun, seq, number = [], 0, 0, 0, number + 1
        if members:
            yield row("warc", b"".join(members))
        if index:
            yield row("cdx", lines(index))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a file follow one another, as they do in the file."""
        rows = ((path, value) for batch in batches for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for path, group in groupby(rows, key=lambda r: r[0]):
            yield from rewritten(path, (x for _, value in group for x in (value, blank.encode())))

    parts = spark.read.option("lineSep", blank).text(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    done = parts.mapInArrow(work, "archive string, kind string, seq bigint, value binary").sortWithinPartitions("archive", "kind", "seq")
    done.select("archive", "kind", F.col("value").cast("string").alias("value")).write.partitionBy("archive", "kind").option("lineSep", "\0").text(target)


def _files(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """(``archive``, ``content``) of the files of a kind; no rows where there was no record to write."""
    found = spark.read.format("binaryFile").load(target)
    if "kind" not in found.columns:
        return found.select(F.lit("").alias("archive"), "content").filter("false")
    return found.filter(F.col("kind") == kind).select("archive", "content")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar index: ``archive``, ``offset``, ``length``, ``id``, ``type``, ``digest``."""
    kinds = "offset bigint, length bigint, id string, type string, digest string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                lines = b"".join(_inflate(memoryview(content.as_buffer()))).decode().splitlines()
                got = [json.loads(x) for x in lines]
                cols = [pa.array([name.as_py()] * len(got), pa.string())]
                cols += [pa.array([g[k] for g in got], pa.int64() if k in ("offset", "length") else pa.string()) for k in ("offset", "length", "id", "type", "digest")]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "offset", "length", "id", "type", "digest"])

    return _files(spark, target, "cdx").mapInArrow(work, "archive string, " + kinds)


_PAGE_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest_ok boolean, archive string, offset bigint, length bigint"
_PAGE_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("digest_ok", pa.bool_()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)


def _members(blob: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member."""
    at = 0
    while at < len(blob):
        engine, parts, read = zlib.decompressobj(31), [], at
        while not engine.eof and read < len(blob):
            piece = blob[read : read + (1 << 16)]
            read += len(piece)
            parts.append(engine.decompress(piece))
        end = read - len(engine.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _number(field: str | None) -> int | None:
    found = _PAGE.match((field or "").encode())
    return int(found[1]) if found and found[1] else None


def _page(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    told = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return _number(fields["warc-record-id"]), size, told, "revisit", _number(fields["warc-refers-to"]), True
    digest = hashlib.sha256(payload).hexdigest()
    return _number(fields["warc-record-id"]), len(payload), digest, "response", None, digest == told and size == len(payload)


def read_pages(spark: SparkSession, target: str) -> DataFrame:
    """Read every record of the normalised archives, with its place.

    The digest of a response is taken from the payload that was read and held against the
    header; a revisit's digest and length are those that its headers give for the full payload.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                # An empty member between pieces holds no record.
                for at, length, raw in _members(memoryview(content.as_buffer())):
                    rows += [(*_page(fields, block), name.as_py(), at, length) for _, fields, block in read_records(iter([raw]))]
                cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PAGE_SCHEMA)]
                yield pa.RecordBatch.from_arrays(cols, schema=_PAGE_SCHEMA)

    return _files(spark, target, "warc").mapInArrow(work, _PAGE_ROWS)
