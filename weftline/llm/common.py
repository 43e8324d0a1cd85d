"""What several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

__all__ = ["WORD", "checkpointed", "crc_mod", "matrix", "quoted", "sampled", "sliced", "table", "tidy", "unused", "usable_vector"]

#: A word is a longest run of anything but these six characters (a Java regex class).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with as many underscores before it as none of the columns has (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sampled(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n of the rows, picked by a hash of the keys; of rows that repeat all keys one at
    most. What isn't picked is left out where it is read, so little more than n rows move."""
    h = F.xxhash64(*keys, F.lit("sample"))
    share = min(1.0, n / max(1, rows.count()))
    picked = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1))
    return picked.withColumn("_picked", h).dropDuplicates(["_picked"]).drop("_picked")


def usable_vector(column: Column) -> Column:
    """Whether an array has components, none of them null or not finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def matrix(column) -> np.ndarray:
    """A row for each list of an Arrow array (or chunked array) of lists of one length."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if hasattr(column, "chunks"):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sliced(batch: pa.RecordBatch, *columns: int, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in the columns have at most so many bytes together, or one row."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100 for c in columns)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def tidy() -> None:
    """Gives memory that is free again back to the system, which a worker that lives on would
    keep: Arrow's pool and, where there is one, the C library's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
