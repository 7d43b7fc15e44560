"""Web archive files: records with deduplicated payloads, an index of byte ranges, and reads by merged ranges.

Every page becomes one WARC 1.1 record, compressed as a gzip member of its own. Of pages with equal payloads the one with
the smallest id is stored as ``response``, the others as ``revisit`` that names it. The index is written with the archives
(file, offset, length, url, digest per record); readers select rows of the index, sort them by place, merge neighbouring byte ranges
and fetch each merged range once.

Files carry a name of their own per attempt; only those that the committed index names are read.

Defined cases: a null payload counts as empty; a page without url gets no target URI; rows that repeat the smallest
page id of their payload are all stored as responses; a null page id comes after every other, and pages of one payload that
all have null ids are all responses; payloads below ``min_revisit_bytes`` are never revisits; an empty table gives no files and no rows;
other columns take no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace, file_system, read_tasks

# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Compression level of the members.
LEVEL = 4
#: Byte ranges of one file closer than GAP are fetched together, up to SPAN bytes at once.
GAP, SPAN = 1 << 16, 1 << 23

INDEX = "file string, at long, size long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record; a revisit holds the length and digest of the payload but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id, digest)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, record_type, digest, payload_bytes, refers_to, payload) of one record; a stored payload must have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if version != VERSION or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError("not a whole record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), kind, digest, size, number("X-Refers-To-Page-ID"), payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, work: Workspace, min_revisit_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) rows to archives below ``folder``; the committed index.

    Only digests and ids are grouped. The list of repeated digests grows with the input, so pages are shuffled by their digest at every size
    and probe it as they come, without a sort; it is stored, so that adaptive execution can split hot digests.
    """
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), sha.alias("sha"))
    big = F.octet_length("html") >= min_revisit_bytes
    repeated = work.store(
        rows.where(big).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to"), "repeated")
    marked = rows.join(repeated.hint("shuffle_hash"), "sha", "left").select(
        "page_id", "url", "html", "sha", F.when(big, F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            index = []
            for page_id, url, html, sha_, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha_)).decode()
                revisit = refers_to is not None and refers_to != page_id
                member = gzip.compress(make_record(page_id, url, html.encode(), digest, revisit, refers_to), LEVEL, mtime=0)
                out.write(member)
                index.append((name, at, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                at += len(member)
            yield table_batch(index, INDEX)
        if out is not None:
            out.close()

    return work.store(marked.mapInArrow(run, INDEX), "index")


def table_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def merge_ranges(rows: Iterator[tuple], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, from, to, members) from (file, at, size) rows in order of place."""
    file, first, last, members = None, 0, 0, []
    for name, at, size in rows:
        if name != file or at - last > gap or at + size - first > span:
            if members:
                yield file, first, last, members
            file, first, members = name, at, []
        last = at + size
        members.append((at, size))
    if members:
        yield file, first, last, members


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name, read by merged byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        places = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        name, source = None, None
        for file, first, last, members in merge_ranges(places):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, fs.open_input_file(f"{root}/{file}")
            source.seek(first)
            raw = source.read(last - first)
            yield table_batch([parse_record(gzip.decompress(raw[at - first : at - first + size])) for at, size in members], RECORD)
        if source is not None:
            source.close()

    # the index is tiny beside the archives: the number of tasks follows the bytes to read
    places = index.select("file", "at", "size").repartitionByRange(read_tasks(index), "file", "at").sortWithinPartitions("file", "at")
    return places.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back through the index."""
    work = Workspace(pages.sparkSession, "warc")
    index = write_archives(pages, f"{work.root}/archives", work, min_revisit_bytes)
    return read_records(index, f"{work.root}/archives")
