"""Web archives of Zstandard frames: a writer with de-duplication, and the reader.

An archive is a file: first a skippable frame that holds the dictionary (magic 0x184D2A5D, the
length, the dictionary), then one frame for each record, compressed with that dictionary. The
reader loads the dictionary from the leading frame, decodes a frame at a time, and validates
the version line, the required headers, the block's length and digest, and the payload's
length and digest. A broken record raises ValueError.

Archives go to a folder under the session's shared folder, through pyarrow's file systems
(file, hdfs, s3, gs). A task writes each archive under a hidden name and then renames it; both
names hold the attempt, so that a repeated task, which may meet its rows in another order, never
replaces an archive that another attempt has listed. The reader follows the list that the
successful attempts return; archives of failed attempts are never read. Archives are closed at about
`archive_bytes` of text, so memory stays bounded by the largest record.

Nulls and edge cases: a null payload is empty; a null URL leaves out the header. Of rows with
equal payloads of at least `least` bytes, those with the smallest id are responses and the
others revisits of it; null ids are never the smallest, and where all ids are null all are
responses. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import cut, shared_folder
from trialytics.session import prepare

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:x-page:{}>"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def _clean(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record's bytes: a response with its payload, or with refers_to a revisit without."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    named = lambda i: ID.format("" if i is None else i)
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of a record, validated; header names in lower case."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a WARC record: {data[:40]!r}")
    headers = _headers(lines[1:])
    if missing := [n for n in REQUIRED if n.lower() not in headers]:
        raise ValueError(f"headers are missing: {missing}")
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the record holds {len(rest) - 4}")
    if (want := headers.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the block holds no HTTP header")
    http_headers = _headers(http.split(b"\r\n")[1:])
    if headers["warc-type"] == "response":
        if int(http_headers["content-length"]) != len(payload):
            raise ValueError("the payload's length differs")
        if headers.get("warc-payload-digest", "") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("the payload's digest differs")
    return headers, http_headers, payload


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one frame each."""
    import zstandard

    lead = stream.read(8)
    if not lead:
        return
    decoder, rest = zstandard.ZstdDecompressor(), lead
    if len(lead) == 8 and struct.unpack("<II", lead)[0] == SKIPPABLE:
        size = struct.unpack("<II", lead)[1]
        dictionary = stream.read(size)
        if len(dictionary) != size:
            raise ValueError("the dictionary is cut short")
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        decoder, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), b""
    while rest or (rest := stream.read(chunk)):
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the last frame is cut short")
            out.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data
        yield b"".join(out)


def _place(path: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str, samples: int = 256, size: int = 32768) -> bytes:
    """A dictionary from at most `samples` payloads (the first by a hash of their id, 64 KiB of each); empty if there are too few."""
    import zstandard

    texts = pages.select(F.xxhash64(id_col).alias("o"), F.substring(payload_col, 1, 65536).alias("t")).where(F.length("t") > 0)
    # hashes first, so that a task hands over numbers only; then the texts up to the last of them
    last = texts.select("o").orderBy("o").limit(samples).agg(F.max("o")).head()[0]
    rows = texts.where(F.col("o") <= F.lit(last)).limit(samples).collect() if last is not None else []
    rows.sort(key=lambda r: (r["o"], r["t"]))
    try:
        return zstandard.train_dictionary(size, [r["t"].encode() for r in rows]).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the id whose payload a row repeats, or null.

    Ids meet by digest, reduced before they are shuffled; the merge join lets Spark split a
    payload that very many rows share over as many tasks as its bytes ask for.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = cut(first.select("digest", "first"), "first").hint("merge")
    repeats = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", repeats.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes = b"", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 128 << 20, level: int = 3) -> DataFrame:
    """Write the rows of with_references to archives in folder; path, records of each archive."""
    prepare(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        number, count, size, stream = 0, 0, 0, None

        def close() -> pa.RecordBatch:
            stream.close()
            name = f"archive-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
            system.move(hidden, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    hidden = f"{root}/.archive-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}"
                    stream = system.open_output_stream(hidden, compression=None)
                    if dictionary:
                        stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                data = record(page_id, url, payload.encode(), digest, refers_to, date)
                stream.write(encoder.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    number, count, size, stream = number + 1, 0, 0, None
        if stream is not None:
            yield close()

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (column path): RECORDS, and with with_payload the payload (binary; null of a revisit)."""
    prepare(archives.sparkSession)
    schema = T.StructType([*RECORDS.fields, *([T.StructField("payload", T.BinaryType())] if with_payload else [])])

    def number(name: str) -> int | None:
        digits = name.removeprefix(ID.partition("{")[0]).removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _place(path)
                with system.open_input_stream(place, compression=None) as stream:
                    rows = []
                    for data in frames(stream):
                        headers, http, payload = parse(data)
                        kind = headers["warc-type"]
                        row = (number(headers["warc-record-id"]), headers.get("warc-target-uri"), int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha256:"), kind, number(headers["warc-refers-to"]) if kind == "revisit" else None)
                        rows.append((*row, payload if kind == "response" else None) if with_payload else row)
                        if len(rows) >= (64 if with_payload else 4096):
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    return archives.select("path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, **options) -> DataFrame:
    """Write a record for each row, and return what reading the archives gives (RECORDS)."""
    spark = pages.sparkSession
    rows = with_references(pages, id_col, url_col, payload_col, least)
    written = cut(write_archives(rows, shared_folder(spark, "warc"), train_dictionary(pages, id_col, payload_col), **options), "warc-list")
    return read_archives(written.repartition(max(1, written.count())))
