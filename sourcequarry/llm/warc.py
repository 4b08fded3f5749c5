"""WARC archives compressed record by record with a dictionary of their own.

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary
built from the first records of that archive; every record is then a frame of its own that needs
only this dictionary, so one record can be read without the others. Archives are written by the
tasks that hold the records, below a shared folder, each attempt under a new name; the list of
archives is stored only when its task has succeeded, so a task that ran twice leaves nothing
that is read.

Of records whose payloads are equal and at least ``MIN_SHARED`` bytes long, the one with the
smallest page id is the response and the others are revisits that name it; payloads of revisits
are not stored.

Defined results: a null payload is empty; a null url gives a record without a target; of rows
with the same page id and equal payloads each is a response; a row without page id is a revisit
only if a row with one has its payload; an archive with too few records to build a dictionary
from has the records themselves as one; an empty table gives no archive; other columns of the input are not archived.
"""

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, functions as F

from sourcequarry.runtime import materialize, new_table_path

MIN_SHARED = 100
#: The dictionary is built from an archive's first records, up to these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 20, 32 << 10
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D
#: All records carry this date, so that equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"

ARCHIVES = "archive string, n_records bigint, n_bytes bigint"
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, "
           "payload_digest string")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, digest, n_bytes, and first: the page a revisit refers to.

    Only digests are grouped, with partial minima; payloads meet the result by digest."""
    content = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), content.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    shared = (
        rows.where(F.col("n_bytes") >= MIN_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    joined = rows.join(shared, "digest", "left")
    return joined.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write planned records; returns the stored list of archives."""
    folder = folder or new_table_path(records.sparkSession, "warc")
    to_write = records.select(
        "page_id", "url", "digest", "n_bytes", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for row in batch.to_pylist():
                archive = archive or _Archive(folder)
                archive.add(_record(row))
                if archive.n_bytes > ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("archive", "n_records", "n_bytes"), d, strict=True)) for d in done],
            schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return materialize(to_write.mapInArrow(run, ARCHIVES), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives, streamed frame by frame; digests are computed anew from
    what is read, and a response whose digest differs from its header ends the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, size = [], 0
                for record in _records(path):
                    held.append(record)
                    size += len(record["payload"] or b"") + 300
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    n = archives.sparkSession.sparkContext.defaultParallelism
    spread = archives.select("archive").repartition(max(n, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, RECORDS)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))


# --- writing --------------------------------------------------------------------------------

def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _record(row: dict) -> bytes:
    revisit = row["first"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["page_id"])), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if row["url"] is not None:  # control characters would end the field
        fields.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0], safe=""), row["url"])))
    if revisit:
        fields += [("WARC-Refers-To", _record_id(row["first"])),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive being written; its first records wait until the dictionary is built."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.compressor, self.waiting, self.waiting_bytes = None, None, [], 0
        self.n_records = self.n_bytes = 0

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self.compressor:
            self._write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        fs, at = _store(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at, compression=None)
        samples = [r[:64 << 10] for r in self.waiting]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too few records to build statistics from: their text is the dictionary
            dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = dictionary.as_bytes()
        self._write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        for record in self.waiting:
            self._write(self.compressor.compress(record))
        self.waiting = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.path, self.n_records, self.n_bytes


# --- reading --------------------------------------------------------------------------------

def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _records(path: str) -> Iterator[dict]:
    fs, at = _store(path)
    with fs.open_input_stream(at, compression=None) as raw:
        start = raw.read(8)
        dictionary = None
        if len(start) == 8 and struct.unpack("<II", start)[0] == SKIPPABLE:
            dictionary = zstandard.ZstdCompressionDict(raw.read(struct.unpack("<II", start)[1]))
            start = b""
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        plain = io.BufferedReader(decompressor.stream_reader(_After(start, raw), read_across_frames=True), 1 << 18)
        while line := plain.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{path}: a record was expected, not {line[:40]!r}")
            yield _parsed(plain)


class _After:
    """What was read ahead, then the rest."""

    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def read(self, n: int) -> bytes:
        start, self.start = self.start, b""
        return start or self.rest.read(n)


def _fields(plain) -> dict[str, str]:
    fields = {}
    while line := plain.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(": ")
        fields[name] = value
    return fields


def _page_id(record_id: str | None) -> int | None:
    page = record_id and record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return None if page in (None, "none") else int(page)


def _parsed(plain) -> dict:
    fields = _fields(plain)
    block = plain.read(int(fields["Content-Length"]))
    plain.read(4)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was archived")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
        "url": uri and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) in _QUOTED else m[0], uri),
        "refers_to": _page_id(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
        "payload_bytes": length if revisit else len(payload), "payload_digest": digest}


_QUOTED = {*range(0x21), 0x7F, 0x25}
