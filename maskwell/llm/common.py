"""Shared pieces: text columns in Arrow batches, durable intermediates, document keys."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where a key must not be null.
NULL_ID = -(1 << 63)
#: Bytes of text that a Python step works on at a time; bounds its memory whatever the batch holds.
CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    It is the one in spark.checkpoint.dir; where that is not set and Spark runs inside one process, as in tests, a
    temporary folder.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, in the same partitions and order, checkpointed: they survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hashed_to(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_fold(doc_id: int | None, modulus: int) -> int:
    """As hashed_to; a null id is in no fold (-1)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def give_back() -> None:
    """Return what Arrow and the C library hold free: Python workers outlive their tasks and wait beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; its worker gives free memory back when the task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, as binary, and each text's number of words (null: 0)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # white space at either end leaves an empty piece
        keep = full.to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(keep)))
        offsets = before[offsets - offsets[0]]
        flat = flat.filter(full)
    return flat.cast(pa.binary()), np.diff(offsets)
