"""Directories of statement files: kinds, archive members, text.

A file is a statement (``doc_id``); an archive is one statement made of its members, which are
blocks in the order in which they stand in it (``block_no``), each with its own label (``source``,
``archive::member``).  What cannot be read gives a row with a warning and no content; it never stops
the files beside it.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_jobs.functions.text import UNICODE_SPACE

MEMBER_BYTES, TOTAL_BYTES, DEPTH = 64 << 20, 128 << 20, 4
TEXT_KINDS = ("txt", "log", "text", "md")
TABLE_KINDS = ("csv", "tsv", "qif", "ofx", "qfx")
ARCHIVE_KINDS = ("zip", "tar", "gz", "tgz", "bz2")
MEMBER = pa.schema(
    [("doc_id", pa.string()), ("block_no", pa.int32()), ("source", pa.string()), ("part", pa.string()), ("size_bytes", pa.int64()),
     ("offset", pa.int64()), ("content", pa.binary()), ("warning", pa.string())]
)
MEMBER_DDL = "doc_id string, block_no int, source string, part string, size_bytes bigint, offset bigint, content binary, warning string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the files below a path; several small files make one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def _ending(name: str) -> str:
    return name.rpartition("/")[2].rpartition(".")[2].lower()


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, warning) of what an archive holds, within its limits; a bad member only warns."""
    kind, total = _ending(name), 0
    if kind not in ARCHIVE_KINDS or kind == "zip":
        box = zipfile.ZipFile(io.BytesIO(data))
        items = ((i.filename, i.file_size, lambda i=i: box.read(i)) for i in box.infolist() if not i.is_dir())
    elif kind in ("tar", "tgz") or name.lower().endswith((".tar.gz", ".tar.bz2")):
        box = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
        items = ((i.name, i.size, lambda i=i: box.extractfile(i).read()) for i in box if i.isfile())
    else:
        opened = gzip.GzipFile(fileobj=io.BytesIO(data)) if kind == "gz" else bz2.BZ2File(io.BytesIO(data))
        inner = opened.read(MEMBER_BYTES + 1)
        items = iter([(name.rpartition("/")[2].rpartition(".")[0], len(inner), lambda: inner)])
    for member, size, read in items:
        if size > MEMBER_BYTES:
            yield member, None, f"Archive member '{member}' too large, skipped"
            continue
        total += size
        if total > TOTAL_BYTES:
            yield member, None, "Archive expands beyond the safe size limit; remaining members skipped."
            return
        try:
            yield member, read(), None
        except Exception as error:  # a damaged member must not stop the others
            yield member, None, f"Archive member '{member}' unreadable: {error}"


def _is_archive(name: str, data: bytes) -> bool:
    ending = _ending(name)
    return ending in ARCHIVE_KINDS or (data[:4] == b"PK\x03\x04" and ending not in TEXT_KINDS + TABLE_KINDS)


def _expanded(name: str, part: str | None, data: bytes, depth: int) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """(source, part, content, warning) of a file or member; of an archive its members, then itself."""
    if not _is_archive(name, data):
        yield name, part, data, None
        return
    if depth > DEPTH:
        yield name, None, None, f"Skipped {name}: archive nesting too deep"
        return
    try:
        for member, inner, warning in _members(name, data):
            if inner is None:
                yield f"{name}::{member}", None, None, warning
            else:
                yield from _expanded(f"{name}::{member}", member, inner, depth + 1)
    except Exception as error:  # whatever a damaged archive raises, zlib.error among others
        yield name, None, None, f"Could not open archive: {error}"
    yield name, part, None, None


def expand(files: DataFrame) -> DataFrame:
    """``files`` with archives replaced by their members, nested ones too: doc_id, block_no, source,
    part (name of a member), size_bytes (of the file), offset (bytes of the members before),
    content (null for what is no text of its own), warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data, offset = data or b"", 0
                for block, (source, part, content, warning) in enumerate(_expanded(name, None, data, 0)):
                    row = (name, block, source, part, len(data), offset, content, warning)
                    offset += len(content or b"")
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, MEMBER, strict=True)], schema=MEMBER)

    return files.select("doc_id", "content").mapInArrow(run, MEMBER_DDL)


#: The code page, byte by byte; the five codes that it leaves open stand for themselves.
CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
PLACE = ("doc_id", "block_no", "source", "size_bytes", "offset")


def _windows_1252(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of bytes that are not UTF-8."""
    for batch in batches:
        texts = [codecs.charmap_decode(data, "strict", CP1252)[0] for data in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PLACE], pa.array(texts, pa.string())], [*PLACE, "text"])


def decode(members: DataFrame) -> DataFrame:
    """(doc_id, block_no, source, size_bytes, offset, text): UTF-8 without its mark, else
    Windows-1252.  Only files that are not UTF-8 leave the JVM."""
    members = members.filter("content IS NOT NULL").select(*PLACE, "content")
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    good = members.filter(marked | valid).select(*PLACE, F.make_valid_utf8(body).alias("text"))
    ddl = "doc_id string, block_no int, source string, size_bytes bigint, offset bigint, text string"
    return good.unionByName(members.filter(~marked & ~valid).mapInArrow(_windows_1252, ddl))


def kinds(texts: DataFrame) -> DataFrame:
    """``texts`` with ``kind``: by extension, and by content where that says nothing (``binary`` if
    at most 85 % of the first 4,096 characters are printable)."""
    head = F.substring("text", 1, 4096)
    control = F.regexp_count(head, F.lit(r"[\p{Cc}&&[^\n\r\t]]"))
    printable = (F.char_length(head) - control) > 0.85 * F.greatest(F.char_length(head), F.lit(1))
    ext = extension(F.col("source"))
    text = F.regexp_replace("text", f"^{UNICODE_SPACE}+", "")
    worded = F.when(text.startswith("!Type:"), "qif").when(F.col("text").rlike("<STMTTRN>|<stmttrn>"), "ofx").otherwise("text")
    kind = (
        F.when(ext.isin("csv", "tsv", "qif"), ext).when(ext.isin("ofx", "qfx"), "ofx").when(ext.isin(*TEXT_KINDS), worded)
        .when(F.col("text").startswith("%PDF"), "binary").when(printable, worded).otherwise("binary")
    )
    return texts.withColumn("kind", kind)


def sniff_delimiter(text: Column) -> Column:
    """Of comma, semicolon, tab and bar the commonest in the first twelve lines that are not
    blank; the earlier of equals, and comma for none."""
    lines = F.slice(F.filter(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, f"{UNICODE_SPACE}+", "") != ""), 1, 12)
    sample = F.array_join(lines, "\n")
    count = [F.size(F.split(sample, rf"\Q{d}\E")) for d in (",", ";", "\t", "|")]
    most = F.greatest(*count)
    return F.when(count[0] == most, ",").when(count[1] == most, ";").when(count[2] == most, "\t").otherwise("|")
