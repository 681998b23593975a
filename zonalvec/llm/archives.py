"""WARC archives of raw pages, compressed record by record with a dictionary of their own.

A file (``.warc.zst``) begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from a bounded number of the records that are archived in it; each record is then one Zstandard frame that can be read alone.
Where the records are too few to train one, their bytes serve as a raw dictionary.

Pages with equal payloads of at least 100 bytes are stored once, as the response of the least page_id; the
others are revisit records. The first of each group is found by a partial aggregation over digests; the table of firsts is
repeated for ``SALTS`` parts of each group, so neither short payloads nor a group of copies meet in one task. Pages are then
dealt by their own id, with one shuffle of the payloads.

Files go to a folder that driver and executors share (any store that pyarrow.fs opens). A task writes under a
name of its own and renames when a file is whole; names and contents depend on the partition alone, so a
repeated task replaces its own files.

Defined cases: a null html is an empty payload; a null page_id is kept as null and never the first while
another id has the payload; rows that repeat a page_id and its payload are one response and revisits to it;
null or odd urls are escaped; an empty table writes no files and reads back empty.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder, table

LEAST_SHARED = 100
#: Parts of a group of equal payloads.
SALTS = 16
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
#: Records (and bytes of them) that a file's dictionary is built from.
SAMPLE_RECORDS, SAMPLE_BYTES = 512, 2 << 20
#: Compressed bytes after which a new file begins.
FILE_BYTES = 64 << 20
LEVEL = 3
#: The tables hold no dates; every record has this one.
DATE = "2024-01-01T00:00:00Z"

_LENGTH = re.compile(rb"\r\ncontent-length: *(\d+)", re.IGNORECASE)


def planned(pages: DataFrame) -> DataFrame:
    """pages with digest, n (bytes) and first: the page_id whose record holds the payload, if it is another's."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    ids = rows.select("page_id", "digest", "n").distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    shared, short = ids.filter(F.col("n") >= LEAST_SHARED), ids.filter(F.col("n") < LEAST_SHARED)
    firsts = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    both = shared.join(firsts, ["digest", "salt"], "left").select("page_id", "digest", "first").unionByName(short.select("page_id", "digest", F.lit(None).cast("long").alias("first")))
    first = both.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first")
    joined = rows.join(first.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    return joined.select("page_id", "url", "html", "digest", "n", "first").sortWithinPartitions("page_id", "digest", "url")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the payload's length in its HTTP header and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or 'about:blank', safe=chr(33) + '#$%&' + chr(39) + '()*+,/:;=?@[]~')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers, digest)}", f"WARC-Refers-To-Date: {DATE}"]
        if refers is not None:
            head.append(f"X-Refers-To-Page-Id: {refers}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(max(size, 256), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Writer:
    """Files of one partition, one after the other."""

    def __init__(self, folder: str, part: int):
        import pyarrow.fs

        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.part, self.files, self.held, self.size = part, 0, [], 0
        self.out, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.out is not None:
            self._put(record)
            return
        self.held.append(record)
        self.size += len(record)
        if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        made = dictionary(self.held)
        raw = made.as_bytes()
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"part-{self.part:05d}-{self.files:04d}.warc.zst"
        self.own = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out, self.written, self.records = self.fs.open_output_stream(self.own, compression=None), 0, 0
        self._raw(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for r in self.held:
            self._put(r)
        self.held, self.size = [], 0

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _put(self, record: bytes) -> None:
        self._raw(self.coder.compress(record))
        self.records += 1
        if self.written >= FILE_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.fs.move(self.own, f"{self.folder}/{self.name}")
        self.done.append((self.name, self.records, self.written))
        self.out, self.files = None, self.files + 1

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is None and self.held:
            self._begin()
        if self.out is not None:
            self._end()
        return self.done


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; -> (file, records, bytes), one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, before = _Writer(folder, TaskContext.get().partitionId()), None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page_id, url, html, digest, n, first in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    again = n >= LEAST_SHARED and before == (page_id, digest)
                    revisit = again or first is not None and first != page_id
                    to.add(record(page_id, url, html, digest, page_id if first is None else first, revisit))
                    before = page_id, digest
        done = to.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return materialise(planned(pages).mapInArrow(run, "file string, records long, bytes long"), "archived")


def records(stream) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers with lower-case names, block) of each record of an open archive."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the beginning")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    text = io.BufferedReader(coder.stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := text.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"a record was expected, not {line[:40]!r}")
        head = {}
        while line := text.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            head[name.lower()] = value.strip()
        block = text.read(int(head[b"content-length"]))
        text.read(4)
        yield head, block


def _row(head: dict[bytes, bytes], block: bytes, file: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, own = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha256:")
    number = lambda k: int(head[k]) if k in head else None
    if kind == "response":
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != own:
            raise ValueError(f"{file}: payload of {head[b'warc-record-id'].decode()} is damaged")
    else:
        digest, n, payload = own, int(_LENGTH.search(b"\r\n" + http)[1]), None
    return number(b"x-page-id"), n, digest, kind, number(b"x-refers-to-page-id"), urllib.parse.unquote(head[b"warc-target-uri"].decode()), file, payload


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def read(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the files that ``write`` listed; with_payload adds a response's payload."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + with_payload]
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for head, block in records(stream):
                        rows.append(_row(head, block, file))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    tasks = max(1, min(10_000, files.count()))
    return files.select("file").repartition(tasks, "file").mapInArrow(run, READ + ", payload binary" * with_payload)


def op5_warc_archives(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    files = write(table(spark, sf_dir, "pages"), folder)
    return read(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
