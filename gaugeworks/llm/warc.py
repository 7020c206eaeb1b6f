"""WARC archives with dictionary-compressed records.

Each task writes one archive. It holds back the first records, trains a Zstandard dictionary on them, writes it as a leading skippable frame
(magic number 0x184D2A5D, four bytes of length, the dictionary), then every record as a frame of its own that is compressed with the dictionary, so that a reader can start
at any record. Where records are too few or too alike to train on, the dictionary is left out. Archives lie in the shared folder under
names that no other attempt uses; only those that a finished task reports are read, so lost executors leave unread files at most.

Records with equal payloads of `least` bytes or more are written once: the smallest page_id's is a response, the others revisit it.
Which payloads repeat is found from digests alone; the join that tells each page its response shuffles pages by digest, and
a digest that very many pages share is split by adaptive execution.

Defined results: a null html counts as empty. A page without url gets `urn:page:` and its id. Rows with a null page_id are never
the response of others, unless all of a payload's ids are null: then all are responses. Repeated rows of the
response's page_id are responses too. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the formats.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the record of page refers_to."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def write_archive(out: BinaryIO, records: Iterable[bytes], sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> int:
    """Writes an archive and returns how many records it has; sample_bytes: what is held back to train on."""
    records = iter(records)
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    if not held:
        return 0
    dictionary = None
    if len(held) >= 16:
        try:
            dictionary = zstandard.train_dictionary(min(dictionary_bytes, max(256, size // 10)), [r[: 128 << 10] for r in held])
        except zstandard.ZstdError:  # too few or too alike
            dictionary = None
    if dictionary:
        raw = dictionary.as_bytes()
        out.write(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    n = len(held)
    for r in held:
        out.write(press.compress(r))
    del held
    for r in records:
        out.write(press.compress(r))
        n += 1
    return n


def read_archive(src: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive in order, one frame at a time."""
    data = src.read(8)
    dictionary = None
    if data[:4] == SKIPPABLE:
        raw = src.read(int.from_bytes(data[4:8], "little"))
        if raw[:4] == FRAME:  # readers must take a compressed dictionary too
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    frames = zstandard.ZstdDecompressor(dict_data=dictionary)
    one, out = frames.decompressobj(), io.BytesIO()
    while True:
        if not data:
            data = src.read(chunk)
            if not data:
                break
        out.write(one.decompress(data))
        data = b""
        if one.eof:
            data = one.unused_data
            yield out.getvalue()
            one, out = frames.decompressobj(), io.BytesIO()
    if out.tell():
        raise ValueError("the last record is cut off")


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes all pages to archives in folder, a URI that driver and executors share; returns (archive, records), which is a stored table."""
    common.batches(pages.sparkSession)
    p = pages.select(F.col(id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    again = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = p.join(again, "digest", "left").select("page", "url", "payload", "digest", F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"

        def records() -> Iterator[bytes]:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield record(*row, date)

        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/{name}.open", compression=None) as out:
            n = write_archive(out, records())
        if n:
            fs.move(f"{where}/{name}.open", f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})
        else:
            fs.delete_file(f"{where}/{name}.open")

    return common.stored(told.mapInArrow(run, "archive string, records long"), "archives")[0]


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The records of the archives (column archive): page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Digests and lengths of stored payloads are computed again, and an error is raised where the fields say otherwise.
    """
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, where = pyarrow.fs.FileSystem.from_uri(archive)
                rows = []
                with fs.open_input_stream(where, compression=None) as src:
                    for data in read_archive(src):
                        rows.append(told(*parse(data)))
                        if len(rows) == 2000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def told(fields: dict[str, str], block: bytes) -> tuple:
        number = lambda k: int(fields[k]) if k in fields else None
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
        if fields["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold what it says")
        return number("X-Page-ID"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), fields["WARC-Target-URI"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
