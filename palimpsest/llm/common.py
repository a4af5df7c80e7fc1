"""Helpers that the corpus operators share: lineage cuts and byte-bounded text blocks.

All Python work runs inside Spark tasks on Arrow batches.  A block is a slice
of a batch whose texts hold at most ``limit`` bytes (one row at least), so the
memory of a task doesn't depend on how Spark cuts batches.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of text that a task works on at once.
BLOCK_BYTES = 1 << 20


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  A local one is made where none is set, if all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages then
    depend on files that outlive any executor.  The folder goes when the
    driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_parts(spark: SparkSession, parts: Iterable[DataFrame], label: str) -> DataFrame:
    """The rows of all ``parts``, at least one, of one schema: each is written before the next one is made, and all are read back as one table."""
    path = f"{shared_folder(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/{k}")
    return spark.read.schema(part.schema).option("recursiveFileLookup", True).parquet(path)


def hot_keys(rows: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """The keys, fewer than ``share``, that more than a 1/``share`` of all ``total`` rows have."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * share > total).select(key)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each key at most.

    The ``hot`` keys, a bounded number, are broadcast with their values; the others are shuffled, so no
    task gets more than a small part through one key.  Rows without a value aren't in the result.
    """
    many = values.join(F.broadcast(hot), key, "left_semi")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(values.join(F.broadcast(hot), key, "left_anti"), key)
    return rows.join(F.broadcast(many), key).unionByName(cold)


def add_up(parts: DataFrame, keys: list[str], fan: int = 256) -> DataFrame:
    """``keys`` and ``sums``: arrays of doubles, as bytes, added by key over all tasks.

    ``parts`` has the keys, ``task`` (a number of the task) and ``sums``.  Arrays of ``fan`` tasks
    at most meet first, so the last sum is over one array for each ``fan`` tasks.
    """
    out = StructType([*(parts.schema[k] for k in keys), StructField("sums", BinaryType())])

    def add(table: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        for chunk in table.column("sums").chunks:
            for raw in chunk:
                part = np.frombuffer(raw.as_buffer(), np.float64)
                total = part.copy() if total is None else np.add(total, part, out=total)
        return table.select(keys)[:1].append_column("sums", pa.array([total.tobytes()], pa.binary()))

    some = parts.withColumn("task", F.floor(F.col("task") / fan)).groupBy(*keys, "task").applyInArrow(add, out)
    return some.groupBy(*keys).applyInArrow(add, out)


def give_back() -> None:
    """Freed memory goes back to the system, which the allocators of Arrow and of the C library don't do by themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy_batches(run: Callable) -> Callable:
    """``run`` for mapInArrow; the worker, which outlives its tasks, gives back what each has freed."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(fn: Callable) -> Callable:
    """``fn`` for applyInArrow; the worker gives back what each group has freed."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            give_back()

    return tidied


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is the empty text."""
    text = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_blocks(batches, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8_view(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield (
                batch.slice(row, end - row),
                data[offsets[row] : offsets[end]],
                offsets[row : end + 1] - offsets[row],
            )
            row = end


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """Columns given as arrays or lists, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
