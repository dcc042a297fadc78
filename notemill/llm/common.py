"""What several operators of this subpackage share.

Two kinds of helper live here: small DataFrame idioms (``let``, ``stash``) and
Arrow/numpy views of a text column for the operators that run in Python tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.sources.scratch import scratch

#: Text bytes that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 2 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once, so that a lambda inside doesn't evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, survives lost executors, and gives a later join fresh
    exchanges on both sides, which adaptive execution can split when a key is hot.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int, limit_bytes: int) -> bool:
    """Whether ``df`` surely fits in ``limit_bytes``: counts no further than the first row too many."""
    most = max(1, limit_bytes // row_bytes)
    return df.limit(most + 1).count() <= most


def fits(df: DataFrame, row_bytes: int, limit_bytes: int) -> DataFrame:
    """``df``, to be broadcast where it surely fits in ``limit_bytes``."""
    return F.broadcast(df) if small(df, row_bytes, limit_bytes) else df


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with the number of each row in this order, from 0, in column ``name``.

    Rows are numbered within sorted range partitions; what comes before a partition is added from a table with a row for
    each partition, the only thing that meets in one task.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    laid = stash(laid, "ranked")
    part, row = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return laid.join(F.broadcast(parts), part == F.col("part")).withColumn(name, row + F.col("ahead")).drop("part", "ahead")


# ---- Arrow text columns -------------------------------------------------------


class Texts:
    """UTF-8 bytes of some texts: ``data`` with ``at[i]:at[i + 1]`` for row i; nulls are empty."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def pick(self, rows: np.ndarray) -> Texts:
        """Only ``rows``, in the given order."""
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return Texts(self.data[spread(self.at[rows], sizes)], at)

    def arrow(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.at, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0]+1, ... (sizes[0] of them), then those of the next, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - sizes), sizes)


def text_view(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.large_binary() if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    return Texts(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0])


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches into slices of about ``most`` text bytes (one row at least), with a view of their texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        view = text_view(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            upto = int(np.searchsorted(view.at, view.at[row] + most, side="right")) - 1
            upto = min(batch.num_rows, max(upto, row + 1))
            yield batch.slice(row, upto - row), Texts(view.data[view.at[row] : view.at[upto]], view.at[row : upto + 1] - view.at[row])
            row = upto


def distinct(pieces: Texts) -> tuple[list[bytes], np.ndarray]:
    """The different pieces, and for each piece the index of its kind."""
    if not len(pieces):
        return [], np.zeros(0, np.int64)
    coded = pieces.arrow().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def long_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
