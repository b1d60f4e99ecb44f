"""What the operators share: staged tables, row keys, Arrow batches cut to size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python task turns into arrays at once; bounds its memory.
PORTION = 1 << 20
#: The largest model or word list sent to every task.
BROADCAST_BOUND = 64 << 20

_STAGED: list[str] = []
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a scratch folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="llm-shared-"))
        found = _LOCAL[0]
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    if not _STAGED:
        atexit.register(_clear)
    path = f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.append(path)
    return path


def _clear() -> None:
    """Delete what this driver staged, as far as its session still lives."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _STAGED:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def check_bound(size: int) -> None:
    if size > BROADCAST_BOUND:
        raise ValueError(f"{size} bytes are too many to send to every task; the bound is {BROADCAST_BOUND}")


def bounded(spark: SparkSession, value: object, size: int):
    """A broadcast of a value whose size the caller has measured."""
    check_bound(size)
    return spark.sparkContext.broadcast(value)


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Two columns that tell rows apart, stable when a task is repeated.

    Rows with equal ids and equal texts share a key, and every result is the same
    for them; equal ids with different texts do not.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_k"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()).alias("_h"),
    ]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0]: offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def cut_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for a, b in portions(offsets, most):
            yield batch.slice(a, b - a)


def appended(
    df: DataFrame, text: str, fields: Sequence[tuple[str, T.DataType]],
    compute: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]], keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from its text, batch by batch, without a shuffle.

    ``compute`` is called once in each task and returns the function of a text
    column. A column of ``df`` with the name of a new one is replaced.
    """
    names = [n for n, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    inner = df.select(as_row(kept), F.col(f"`{text}`").cast("string").alias("_text"))
    out = T.StructType([inner.schema.fields[0], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in cut_batches(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(batch.column(1))], names=["_row", *names])

    return inner.mapInArrow(run, out).select(*(F.col(f"_row.`{c}`") for c in kept), *names)


def as_row(columns: Sequence[str]) -> Column:
    """The columns packed in one, ``_row``, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns), *(() if columns else (F.lit(0).alias("_"),))).alias("_row")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables of about ``most`` bytes that never part a key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column(key).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield rows.slice(0, cut)
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of sorted keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
