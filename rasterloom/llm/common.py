"""What the operators of this subpackage share: the shared folder, tables that cut lineage, Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at once in a Python worker: so many bytes of UTF-8 (or one longer text).
SLICE_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where one machine does it all and that is unset
    (tests), a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """The same rows as a written Parquet table in the shared folder: lineage ends there and sizes are known."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that cut() made, once nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, whatever the case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.coalesce(F.crc32(column.cast("string")), F.lit(0)), F.lit(modulus))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its offsets, one more than rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that is kept doesn't hold what an earlier stage needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about most bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64))
        at, begun = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, begun + most, side="right")))
            yield batch.slice(at, end - at)
            begun, at = int(size[end - 1]), end
        give_back()


def whole_groups(batches: Iterable[pa.RecordBatch], group: str, most: int = 100_000) -> Iterator[pa.Table]:
    """Rows in order of the number group, as tables of about most rows that end where a group ends; a larger group comes
    whole. So a task holds such a table, not its partition."""
    held: list[pa.RecordBatch] = []
    count, room = 0, most
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < room:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(group).to_numpy()
        start = int(np.searchsorted(values, values[-1]))
        if start:
            yield table.slice(0, start)
        held = table.slice(start).combine_chunks().to_batches()
        count -= start
        room = max(most, 2 * count)
    if count:
        yield pa.Table.from_batches(held)


_KEPT: dict[str, tuple[Any, Any]] = {}


def kept(name: str, shared: Any, make: Callable[[Any], Any]) -> Any:
    """In a Python worker: what make(shared.value) gave for this broadcast variable, made once and dropped for the next of
    any name. The variable is held along, so that no other can be taken for it."""
    if name not in _KEPT or _KEPT[name][0] is not shared:
        _KEPT.clear()
        give_back()
        _KEPT[name] = (shared, make(shared.value))
    return _KEPT[name][1]
