"""WARC archives: a writer with deduplicated payloads, and a splittable reader.

The writer gives every record a gzip member of its own.  Of records with equal payloads the one
with the largest id is the response; the others are revisits that refer to it.  Files are
written under a name of their own per attempt and renamed when complete, so a repeated task
leaves no second copy: its file has the same final name.

The reader cuts files into byte ranges.  A task scans its range for the gzip magic, checks each
candidate by decoding a WARC header behind it, however long, and owns the records that start
inside the range, reading past its end for the last one.

Defined results: a null payload is empty; an id may repeat, then the row with the larger
key counts as the later; extra columns are ignored.  An empty table writes no file and reads
as no rows.  Payloads are decoded and checked whole; a record whose digest does not match ends
the query with an error, as does a header cut short or a number of records read that differs
from the number written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import written
from quadrat.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, kind string, url string, digest string, refers_to string, "
    "page_id bigint, payload_bytes bigint, payload binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    record = VERSION + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(record) + coder.flush()


def _clean(value: str | None) -> str:
    return "".join(" " if ord(c) < 32 else c for c in value or "")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        final = f"{path}/part-{part:06d}.warc.gz"
        own = f"{path}/.attempt-{part:06d}-{uuid.uuid4().hex}"
        out, size, count = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(own)
                payload = row["html"] or b""
                digest = base32(hashlib.sha1(payload).digest())
                shared = [
                    ("WARC-Record-ID", f"<urn:row:{row['key']}>"),
                    ("WARC-Date", "2024-01-01T00:00:00Z"),
                    ("WARC-Target-URI", _clean(row["url"])),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                ]
                if row["page_id"] is not None:
                    shared.append(("WARC-Page-ID", str(row["page_id"])))
                if row["head"] == row["key"]:
                    headers, block = [("WARC-Type", "response"), *shared], payload
                else:
                    refers = ("WARC-Refers-To", f"<urn:row:{row['head']}>")
                    headers, block = [("WARC-Type", "revisit"), *shared, refers, ("WARC-Profile", REVISIT)], b""
                data = member(headers, block)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            system.move(own, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([final]), pa.array([size]), pa.array([count])], names=["path", "length", "records"]
            )

    return run


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html as bytes, and a key that tells every row apart however often it is read.

    Rows of files have their file and their number in it; other rows are numbered and written once.
    """
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("html")
    try:
        place = pages.metadataColumn("_metadata")
        name = F.concat_ws("#", place["file_path"], place["row_index"].cast("string"))
        return pages.select("page_id", "url", html, F.md5(name.cast("binary")).alias("key"))
    except AnalysisException:
        number = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias("key")
        return written(pages.select("page_id", "url", html, number), "warc-rows")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; returns path, length and records per file.

    Records share a payload only from ``least`` bytes on.  Responses are chosen from digests alone;
    then payloads move once, by row, so that a payload many rows share is no hot key.
    """
    rows = keyed(pages)
    same = F.coalesce(F.when(F.length("html") >= least, F.sha2("html", 256)), "key")
    named = written(rows.select("page_id", "key", same.alias("same")), "warc-digests")
    heads = named.groupBy("same").agg(F.max(F.struct("page_id", "key"))["key"].alias("head"))
    marked = named.join(heads, "same").select("key", "head")
    joined = rows.join(marked, "key")
    pafs_folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    system, path = pafs.FileSystem.from_uri(pafs_folder)
    system.create_dir(path, recursive=True)
    return written(joined.mapInArrow(_write(pafs_folder), "path string, length bigint, records bigint"), "warc-files")


def header_of(source, at: int, step: int = 1 << 16) -> dict[str, str] | None:
    """Fields of the WARC header that the gzip member at byte ``at`` begins with, if it does."""
    coder, text, start = zlib.decompressobj(31), bytearray(), b"WARC/1."
    source.seek(at)
    while True:
        data = coder.unconsumed_tail or source.read(step)
        try:
            piece = coder.decompress(data, step)
        except zlib.error as error:
            if len(text) >= len(start):
                raise ValueError(f"record at byte {at} is damaged") from error
            return None
        seen = max(len(text) - 3, 0)
        text += piece
        if not text.startswith(start[: len(text)]):
            return None
        if text.find(b"\r\n\r\n", seen) >= 0:
            return parsed(bytes(text))[0]
        if coder.eof or not (data or piece):
            if len(text) >= len(start):
                raise ValueError(f"header of the record at byte {at} is cut short")
            return None


def parsed(record: bytes) -> tuple[dict[str, str], int]:
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line), end + 4


def records(source, size: int, start: int, end: int, step: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file that start in [start, end): header and block."""
    at = start
    while at < end:
        source.seek(at)
        window = source.read(min(step, size - at))
        found = window.find(MAGIC)
        if found < 0:
            # The magic may straddle two windows.
            at += max(len(window) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= end:
            return
        if header_of(source, at) is None:
            at += 1
            continue
        coder, pieces, position = zlib.decompressobj(31), [], at
        source.seek(at)
        try:
            while not coder.eof:
                data = source.read(step)
                if not data:
                    raise ValueError(f"record at byte {at} is cut short")
                position += len(data)
                pieces.append(coder.decompress(data))
        except zlib.error as error:
            raise ValueError(f"record at byte {at} is damaged") from error
        record = b"".join(pieces)
        fields, body = parsed(record)
        yield fields, record[body : body + int(fields["Content-Length"])]
        at = position - len(coder.unused_data)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, length, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for fields, block in records(source, length, start, end):
                        digest = base32(hashlib.sha1(block).digest())
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and digest != stated:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                        page = fields.get("WARC-Page-ID")
                        rows.append((
                            fields["WARC-Record-ID"], fields["WARC-Type"], fields["WARC-Target-URI"], stated,
                            fields.get("WARC-Refers-To"), int(page) if page else None,
                            len(block) if response else None, block if response else None,
                        ))
                        held += len(block)
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read(files: DataFrame, folder: str, split: int = 8 << 20) -> DataFrame:
    """All records of ``files`` (path, length), read in byte ranges of ``split``."""
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    last = F.greatest(F.ceil(F.col("length") / split) - 1, F.lit(0))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    ranges = ranges.select(
        "path", "length", (F.col("n") * split).alias("start"), F.least((F.col("n") + 1) * split, "length").alias("end")
    )
    cores = files.sparkSession.sparkContext.defaultParallelism
    # A row is one byte range, so the number of rows is the useful number of tasks.
    spread = ranges.repartition(max(cores, min(ranges.count(), 100_000)), "path", "start")
    return spread.mapInArrow(_read(folder), RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def whole(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found``, the records read from ``files``, if they are as many as were written."""
    read_, wrote = found.count(), files.agg(F.sum("records").alias("n")).first()["n"] or 0
    if read_ != wrote:
        raise ValueError(f"{wrote} records were written, {read_} were read")
    return found
