"""Shared helpers: reading tables, durable intermediate tables, Arrow group streaming."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java trim list.
WHITE = " \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates: ``spark.checkpoint.dir``; where it is unset, an own one, which only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; intermediates need a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='quireflow-')}")
    return _own[0]


def store(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quireflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quireflow_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table made by ``store`` that no later plan reads."""
    path = getattr(df, "_quireflow_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from a stream sorted by ``keys``, each with its group starts.

    A group is never cut; a table is handed on once it holds ``rows`` rows and
    at least one complete group.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        starts = group_starts(whole, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield whole.slice(0, cut), starts[:-1]
            whole = whole.slice(cut)
        held, n = whole.to_batches(), whole.num_rows
        rows = max(rows, n)
    if n:
        whole = pa.Table.from_batches(held)
        yield whole, group_starts(whole, keys)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def binary_rows(data: np.ndarray, width: int) -> pa.Array:
    """A fixed-width uint8 matrix as a binary column, one value a row."""
    n = len(data)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) else "")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    offsets = np.frombuffer(a.buffers()[1], dtype=kind)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
