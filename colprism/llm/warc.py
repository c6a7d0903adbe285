"""WARC archives: written, normalised from one gzip stream to a member for each record, indexed, read back."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.llm.shared import narrowed, scratch, stored

#: Records of one archive at most.
RECORDS = 5000
_END = "\r\n\r\n"
_STEP = 1 << 20
_LEVEL = 5


# ---------------------------------------------------------------- writing


_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """Base-32 SHA-1 of a text's UTF-8 bytes: every five hexadecimal digits are four of base 32."""
    fives = F.regexp_extract_all(F.sha1(payload.cast("binary")), F.lit("(.{5})"), F.lit(1))
    fours = F.array_join(F.transform(fives, lambda h: F.lpad(F.conv(h, 16, 32), 4, "0")), "")
    return F.translate(fours, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(id: Column, url: Column, payload: Column, refers_to: Column | None = None) -> Column:
    """A record without its closing blank lines: a revisit where ``refers_to`` is not null, else a response.

    A revisit holds the HTTP headers of its payload, its length and digest among the
    headers, but not the payload.  The id is in a header of its own.  Line ends in a URL
    would end the header, so control characters become spaces.
    """
    size = F.octet_length(payload)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(_END)
    )
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1F\x7F]", " ")
    name = F.coalesce(id.cast("string"), F.lit(""))
    again = F.lit(False) if refers_to is None else refers_to.isNotNull()
    kind, more, body = F.lit("response"), F.lit(""), payload
    if refers_to is not None:
        kind = F.when(again, "revisit").otherwise(kind)
        reference = F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))
        more, body = F.when(again, reference).otherwise(more), F.when(again, "").otherwise(body)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        kind,
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Page-ID: "),
        name,
        F.lit("\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        digest(payload),
        more,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(_END),
        http,
        body,
    )


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (id, url, payload) with refers_to: of equal payloads, empty ones too, the smallest id; null for that row itself.

    Rows that repeat an id and a payload are one and the same; a null id is larger than
    any other, and refers to a null id nowhere.  Only what several rows share is joined
    to the payloads, by its digest; it is stored first, so that its true size decides
    whether it is broadcast.
    """
    marked = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    shared = marked.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    both = marked.join(stored(shared.select("digest", "first")), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return both.select("id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", revisits: bool = False
) -> None:
    """Archives of up to ``RECORDS`` records, each file one gzip stream.  A null payload is empty.

    With ``revisits``, payloads that several rows share are written once, see ``repeats``;
    without, every record is a response.
    """
    rows = narrowed(pages, id=id, url=url, payload=payload)
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    if revisits:
        rows = repeats(rows)
    own = [F.col(c) for c in rows.columns]
    # A record ends in two line ends, as a line of this file does.
    lines = rows.select(record(*own).alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


# ---------------------------------------------------------------- normalising


def open_fs(uri: str):
    """(file system, path) of a URI, for any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, a step at a time."""
    machine, begun = zlib.decompressobj(31), False
    while data := stream.read(_STEP):
        while data:
            begun = True
            part = machine.decompress(data, _STEP)
            # A full step may leave more to come, with input left or without.
            while part:
                yield part
                part = machine.decompress(machine.unconsumed_tail, _STEP) if not machine.eof else b""
            data = b""
            if machine.eof:
                data = machine.unused_data
                machine, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream ends within a member")


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record with its closing lines) of each record of a stream."""
    held, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            part = next(parts, None)
            if part is None:
                ended = True
            else:
                held.extend(part)
        return len(held) >= n

    while True:
        at = held.find(b"\r\n\r\n")
        seen = 0
        while at < 0 and fill(len(held) + 1):
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
        if at < 0:
            if held.strip():
                raise ValueError("a record's header does not end")
            return
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = at + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record is cut off")
        yield headers, bytes(held[:size])
        del held[:size]


def _normalise(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """archive, n: each file written anew, with its index beside it.

    Both are written under other names first and moved when whole; a task that runs
    again writes the same.
    """
    import uuid

    for batch in batches:
        for path in batch.column(0).to_pylist():
            source, name = open_fs(path)
            store, folder = open_fs(out)
            store.create_dir(folder, recursive=True)
            target = f"{folder}/{name.rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.txt')}.warc.gz"
            draft = f"{target}.{uuid.uuid4().hex}"
            at, index = 0, []
            with source.open_input_stream(name, compression=None) as stream, store.open_output_stream(draft, compression=None) as sink:
                for headers, whole in split_records(inflated(stream)):
                    machine = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    member = machine.compress(whole) + machine.flush()
                    sink.write(member)
                    index.append(f"{at} {len(member)} {headers.get('warc-type', '')} {headers.get('warc-record-id', '')}\n")
                    at += len(member)
            with store.open_output_stream(f"{draft}.idx", compression=None) as sink:
                sink.write("".join(index).encode())
            store.move(f"{draft}.idx", f"{target}.idx")
            store.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(index)], pa.int64())], ["archive", "n"])


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """archive, n (records): the gzip files of ``folder`` with a member for each record, in ``out``.

    Each stream is inflated once, in steps; memory is that of the largest record.  Beside
    each archive is its index: offset, length, type and record id of each record, a line each.
    """
    # Only the names are read here.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism))
    return stored(files.mapInArrow(lambda b: _normalise(b, out), "archive string, n bigint"))


# ---------------------------------------------------------------- reading


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one member."""
    headers, whole = next(split_records(iter([zlib.decompress(member, 31)])))
    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
    if headers.get("content-type", "").startswith("application/http"):
        block = block[block.index(b"\r\n\r\n") + 4 :]
    return headers, block


_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.IGNORECASE)


def described(member: bytes) -> tuple[dict[str, str], int, str, bytes | None]:
    """Headers, length and digest of the payload, payload (None for a revisit) of one member.

    A response is held against the digest in its header; a revisit says by headers what
    its payload is.
    """
    headers, payload = parse(member)
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "revisit":
        head = _HTTP_LENGTH.search(next(split_records(iter([zlib.decompress(member, 31)])))[1].split(b"\r\n\r\n", 1)[1])
        return headers, int(head[1]), told, None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if told and told != found:
        raise ValueError(f"record {headers.get('warc-record-id')} does not hold the payload of its digest")
    return headers, len(payload), found, payload


_FIELDS = {
    "id": ("string", pa.string()),
    "uri": ("string", pa.string()),
    "archive": ("string", pa.string()),
    "offset": ("bigint", pa.int64()),
    "length": ("bigint", pa.int64()),
    "record_type": ("string", pa.string()),
    "refers_to": ("string", pa.string()),
    "payload_bytes": ("bigint", pa.int64()),
    "payload_digest": ("string", pa.string()),
    "payload": ("binary", pa.binary()),
}


def _read(batches: Iterator[pa.RecordBatch], out: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, _ = open_fs(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _FIELDS.values())], list(_FIELDS))

    for batch in batches:
        for archive in batch.column(0).to_pylist():
            with store.open_input_stream(f"{archive}.idx", compression=None) as stream:
                entries = [line.split(" ")[:2] for line in stream.read().decode().splitlines()]
            rows = []
            with store.open_input_file(archive) as file:
                for offset, length in entries:
                    headers, size, digest, payload = described(file.read_at(int(length), int(offset)))
                    first = headers.get("warc-refers-to")
                    if first is not None:
                        first = first.removeprefix("<urn:page:").removesuffix(">")
                    where = (headers.get("warc-page-id"), headers.get("warc-target-uri"), archive, int(offset), int(length))
                    rows.append((*where, headers.get("warc-type"), first, size, digest, payload if payloads else None))
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def read_archives(archives: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """id, uri, archive, offset, length, record_type, refers_to, payload_bytes, payload_digest, payload of each record, by the indexes.

    All of it is read from the records; the payload of a revisit is null.
    """
    kind = ", ".join(f"{name} {kind}" for name, (kind, _) in _FIELDS.items())
    return archives.select("archive").mapInArrow(lambda b: _read(b, out, payloads), kind)


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` with the payload of its response in every revisit."""
    held = records.where("record_type = 'response'").groupBy(F.col("id").alias("refers_to"), "payload_digest")
    held = held.agg(F.first("payload").alias("__held"))
    both = records.join(held, ["refers_to", "payload_digest"], "left")
    return both.withColumn("payload", F.coalesce("payload", "__held")).select(*records.columns)


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length of every row of ``pages``.

    The rows are written as archives of one gzip stream each, copies as revisits without
    their payload; these are normalised and read back by their indexes, all in the shared
    scratch folder.  What is returned is what the archives say.  No rows: no archives.
    """
    spark = pages.sparkSession
    folder = scratch(spark)
    write_archives(pages, f"{folder}/streams", id, url, payload, revisits=True)
    archives = normalise(spark, f"{folder}/streams", f"{folder}/archives")
    records = read_archives(archives, f"{folder}/archives", payloads=False)
    kind = narrowed(pages, id=id).schema["id"].dataType
    own = lambda name: F.nullif(name, F.lit("")).cast(kind).alias(name)
    return records.select(
        own("id").alias(id), "payload_bytes", "payload_digest", "record_type", own("refers_to"), "archive", "offset", "length"
    )
