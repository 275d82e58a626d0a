"""WARC archives: one gzip member per record, and a reader whose tasks take byte ranges.

Writing.  Of records with equal payloads of at least ``least_bytes`` bytes, the one with the
largest id is a response and the others revisit it (profile identical-payload-digest; they keep
the HTTP header, so the length of the payload is still there).  Digests and ids decide that,
without the payloads; each task then writes its rows into an archive of its own.  The name
carries the attempt, and only archives that a finished attempt reported are in the manifest: what
lost or repeated attempts leave behind is never read.

Reading.  Every archive is cut into ranges.  A task looks for the gzip magic from the start of its
range on, takes a place for a member only if it inflates to the version line of a WARC record,
and from there goes from member to member.  It owns the records that start inside its range and
reads the last one beyond the end.  So archives need no index and a large one many tasks.

Archives are reached by their URI through pyarrow's file systems, in the shared folder.

Defined cases: a null payload is empty.  A payload of any length is one record; the task that
writes it and the one that owns its start hold it whole.  A null url leaves the target out.  Records with a null id
are responses and come back with a null id.  Rows repeated under the largest id are all
responses.  Control characters, blanks and non-ASCII characters of urls are percent-encoded.  An
empty table gives no archive and an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import blocks, keep, new_path, record_batch

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes read at a time.
READ = 1 << 20


def record_id(id_: int | None) -> str:
    return "<urn:page:none>" if id_ is None else f"<urn:page:{id_}>"


def id_of(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def member(id_: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as a gzip member."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(id_), "WARC-Date": DATE}
    if url is not None:
        lines["WARC-Target-URI"] = urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~")
    lines["WARC-Payload-Digest"] = digest
    if refers_to is None:
        block += payload
    else:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    lines |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size, n = TaskContext.get(), None, 0, 0
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for batch in blocks(batches, "payload"):
            if out is None:
                store, place = fs.FileSystem.from_uri(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                data = member(*row)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield record_batch(MANIFEST, path=[path], bytes=[size], records=[n])

    return run


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows that repeat a payload under a smaller id."""
    light = keep(rows.filter(F.octet_length("payload") >= least_bytes).select("id", F.sha1("payload").alias("digest")), "payload-digests")
    largest = keep(
        light.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).filter("low < refers_to").drop("low"),
        "payload-repeats",
    )
    return light.join(largest, "digest").filter("id < refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(
    df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000
) -> DataFrame:
    """Writes the rows as archives below ``folder`` (a URI that executors reach); the manifest
    (path, bytes, records) of what was written."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    again = revisits(rows, least_bytes)
    digest = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    full = rows.withColumn("digest", digest).join(again, ["id", "digest"], "left").select("id", "url", "payload", "refers_to")
    where = (folder or new_path(spark, "archives")).rstrip("/")
    return keep(full.mapInArrow(_writer(where if "://" in where else f"file://{where}"), "path string, bytes bigint, records bigint"), "manifest")


class Range:
    """Members of an archive that start in [start, end)."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.base or place + n > self.base + len(self.data):
            self.base, self.data = place, self.file.read_at(min(max(n, READ), max(self.size - place, 0)), place)
        return self.data[place - self.base : place - self.base + n]

    def next_magic(self, place: int, end: int) -> int | None:
        while place < end:
            data = self.at(place, min(READ // 4, self.size - place))
            found = data.find(MAGIC)
            if found >= 0:
                return place + found if place + found < end else None
            if len(data) <= len(MAGIC):
                return None
            place += len(data) - len(MAGIC) + 1
        return None

    def inflate(self, place: int) -> tuple[bytes, int] | None:
        """A record and where it ends, or None if none starts here."""
        unpack, out, step = zlib.decompressobj(31), bytearray(), 1 << 12
        try:
            while not unpack.eof:
                data = self.at(place, min(step, self.size - place))
                if not data:
                    return None
                out += unpack.decompress(data)
                if not VERSION[:7].startswith(bytes(out[:7])):
                    return None
                place, step = place + len(data) - len(unpack.unused_data), min(2 * step, READ)
        except zlib.error:
            return None
        return (bytes(out), place) if out.startswith(VERSION[:7]) else None

    def records(self, start: int, end: int) -> Iterator[bytes]:
        place = self.next_magic(start, end)
        while place is not None:
            if found := self.inflate(place):
                yield found[0]
                place = found[1]
            else:
                place += 1
            place = self.next_magic(place, end)


RECORD = pa.schema(
    [("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(record: bytes, with_payload: bool) -> tuple:
    """The fields of RECORD; digest and length of a response are those of what was read."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    if kind == "revisit":
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        size = int(_fields(http).get("content-length", 0))
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    kept = payload if with_payload and kind != "revisit" else None
    return id_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, id_of(fields.get("warc-refers-to")), digest, size, kept


def _reader(with_payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for split in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(split["path"])
                with store.open_input_file(place) as file:
                    for record in Range(file, split["bytes"]).records(split["start"], split["end"]):
                        yield parse(record, with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held = [], 0
        for row in rows(batches):
            ready.append(row)
            held += len(row[-1] or b"") + 200
            if held > READ:
                yield record_batch(RECORD, **dict(zip(RECORD.names, map(list, zip(*ready, strict=True)), strict=True)))
                ready, held = [], 0
        if ready:
            yield record_batch(RECORD, **dict(zip(RECORD.names, map(list, zip(*ready, strict=True)), strict=True)))

    return run


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a manifest (path, bytes): id, url, record_type, refers_to,
    payload_digest (SHA-1, hex), payload_bytes and the payload (null for revisits)."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("bytes > 0").select("path", "bytes", start.alias("start"))
    splits = splits.withColumn("end", F.least(F.col("bytes"), F.col("start") + split_bytes))
    many = max(1, min(splits.count(), 20_000))
    return splits.repartition(many, "path", "start").mapInArrow(
        _reader(with_payload),
        "id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary",
    )
