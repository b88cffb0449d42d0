"""WARC archives of gzip members: a writer with revisit records, and a splittable reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import keep, lookup, new_path, slices

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_PAYLOAD = 100
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Bytes asked of the store at a time, and of a member that are decoded to judge a candidate.
BLOCK, PROBE = 1 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:page:"


def _line(value: str) -> str:
    """A header value: no line breaks or backslashes stand bare in it."""
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _value(line: str) -> str:
    out, it = [], iter(line)
    for c in it:
        out.append({"r": "\r", "n": "\n"}.get(d := next(it, ""), d) if c == "\\" else c)
    return "".join(out)


def _page(x: int | None) -> str:
    return "" if x is None else str(x)


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A record as one gzip member: a revisit where refers_to is given, else a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{_page(page_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + z.compress(body + b"\r\n\r\n") + z.flush()


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # another attempt writes other files
        out, done, name = None, [], ""

        def close():
            size = out.tell()
            out.close()
            store.move(f"{top}/{name}.part", f"{top}/{name}")
            done.append((name, size))

        for batch in slices(batches):
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name = f"{task}-{len(done):04d}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name}.part", compression=None)
                out.write(member(page_id, url, payload, digest, refers_to))
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row to WARC files in folder (a new one of the shared folder by default) -> path, size.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of at least `least` bytes, those with the
    smallest id are responses (several only if that id is repeated) and the others revisit it; rows without an id are
    responses and never referred to. Every task writes files of its own, named by attempt and renamed when complete, and
    only those of attempts that succeeded are listed, so that a lost executor leaves no record twice. An empty table gives
    no files. Columns other than the three are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.filter((F.octet_length("payload") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = keep(first.filter("n > 1"), "payloads")
    told = lookup(rows, repeated, "digest", "n", [F.col("id"), F.col("url")], wide=True)
    told = told.withColumn("refers_to", F.when(F.col("id").isNotNull() & (F.col("first") != F.col("id")), F.col("first"))).drop("first")
    return keep(told.mapInArrow(_write(folder, archive_bytes), "path string, size long"), "manifest")


class _Range:
    """The records of one archive that start in [start, end).

    strict: nothing but whole records stands in the archive, so what stands between two of them is a damaged one. A range
    answers for what follows each of its records, be it in the next range; the first also for the archive's beginning.
    """

    def __init__(self, file: pa.NativeFile, size: int, start: int, end: int, strict: bool = False):
        self.file, self.size, self.start, self.end, self.strict = file, size, start, end, strict
        self.at, self.data = start, b""  # data: the archive's bytes from at on

    def bytes_from(self, pos: int, n: int) -> bytes:
        """At least n bytes from pos on, or what there is; what stands before pos is forgotten."""
        if pos > self.at + len(self.data):
            self.at, self.data = pos, b""
        self.at, self.data = pos, self.data[pos - self.at :]
        while len(self.data) < n and (more := self.size - self.at - len(self.data)) > 0:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(min(more, max(BLOCK, n - len(self.data))))
        return self.data

    def records(self) -> Iterator[tuple[bytes, bytes]]:
        pos = self.start
        due = 0 if self.start == 0 else None  # where a record must start
        while pos < self.end:
            data = self.bytes_from(pos, 2 * PROBE)
            found = data.find(MAGIC, 0, self.end - pos + len(MAGIC) - 1)
            if found < 0:
                pos += max(1, len(data) - len(MAGIC) + 1)
                continue
            pos += found
            record = self.member(pos) if pos < self.end else None
            if record:
                if self.strict and due is not None and pos != due:
                    break
                head, body, pos = record
                due = pos
                yield head, body
            else:
                pos += 1
        if self.strict and due is not None and due < self.size and (due < self.end or self.member(due) is None):
            raise ValueError(f"no whole record at byte {due}")

    def member(self, pos: int) -> tuple[bytes, bytes, int] | None:
        """Header, block and end of the record whose gzip member starts at pos; None if none does."""
        z, got, at = zlib.decompressobj(31), bytearray(), pos
        probed = False
        try:
            while not z.eof:
                part = bytes(self.bytes_from(at, PROBE)[:PROBE])
                if not part:
                    return None
                got += z.decompress(part)
                at += len(part)
                if not probed and len(got) >= 7:
                    if not got.startswith(b"WARC/1."):
                        return None
                    probed = True
        except zlib.error:
            return None
        head, blank, rest = bytes(got).partition(b"\r\n\r\n")
        n = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
        if not probed or not blank or n < 0 or rest[n:] != b"\r\n\r\n":
            return None
        return head, rest[:n], at - len(z.unused_data)


def parse(head: bytes, block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit)."""
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    page = lambda k: int(v) if (v := fields.get(k, "").removeprefix(f"<{RECORD}").removesuffix(">")) else None
    url = _value(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        return page("warc-record-id"), url, told, digest, kind, page("warc-refers-to"), None
    if (real := hashlib.sha256(payload).hexdigest()) != digest or told != len(payload):
        raise ValueError(f"record {fields.get('warc-record-id')}: its payload isn't what its headers say")
    return page("warc-record-id"), url, len(payload), real, kind, None, payload


COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _read(payloads: bool, strict: bool):
    columns = {k: t for k, t in COLUMNS.items() if payloads or k != "payload"}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values())], schema=pa.schema(list(columns.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for ranges in batches:
            for path, size, start, end in zip(*(ranges.column(k).to_pylist() for k in range(4))):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    for record in _Range(file, size, start, end, strict).records():
                        rows.append(parse(*record) if payloads else (*parse(*record)[:-1], None))
                        held += len(record[1])
                        if len(rows) >= 1000 or payloads and held > 8 * BLOCK:
                            yield batch(rows)
                            rows, held = [], 0
        yield batch(rows)

    return run


def read_archives(archives: DataFrame, payloads: bool = True, split_bytes: int | None = None, strict: bool = True) -> DataFrame:
    """archives (path, size) -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload.

    Each archive is cut into byte ranges, by default as large as Spark's own file splits. A task looks for gzip magic from
    its range's start on, takes a candidate for a record if it decodes, starts with a WARC version and is as long as its
    Content-Length says, and else looks on from the next byte. It owns the records that start in its range and reads past
    its end to finish the last; so every record is read once, whatever the ranges. strict: a record that can't be read, or bytes that are none, fail the
    read, as a lost page would else go unseen; otherwise they are passed over. No archives give no rows.
    """
    spark = archives.sparkSession
    split = split_bytes or _split_bytes(spark)
    ranges = archives.filter("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))))
    ranges = ranges.select("path", "size", "start", F.least("size", F.col("start") + split).alias("end"))
    n = max(1, archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return ranges.repartition(int(n), "path", "start").mapInArrow(_read(payloads, strict), schema)


def _split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
