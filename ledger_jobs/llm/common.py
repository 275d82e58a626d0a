"""Shared folder, written intermediate tables and Arrow blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-ledger-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB from here on in this session, unless it has a limit of its
    own: texts differ in length, and a batch counts several times in a task's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") in ("64m", "64MB", "67108864b"):
        spark.conf.set(name, "8m")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under names of its own; a null text is empty.

    Ids are whole numbers of at most 64 bits: under Spark's ANSI rules others stop the job."""
    small_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with about ``most`` bytes of ``column`` each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        offsets = text_offsets(arr)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def whole_runs(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by ``column``, slices that hold whole runs of equal values, of ``most``
    rows or one run if that is longer."""
    held: list[pa.RecordBatch] = []  # all of one run, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        held.append(batch)
        if batch.column(at)[-1] == held[0].column(at)[0]:
            continue
        batch = pa.concat_batches(held)
        value = np.asarray(batch.column(at))
        cuts = (np.flatnonzero(value[1:] != value[:-1]) + 1).tolist()
        start = 0
        for cut, following in zip(cuts, [*cuts[1:], None], strict=True):
            if following is None or following - start > most:
                yield batch.slice(start, cut - start)
                start = cut
        held = [batch.slice(start)]
    if held:
        yield pa.concat_batches(held)


def text_offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them."""
    offsets = text_offsets(arr)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )
