"""Helpers that the operators of this package share: cutting lineage and bytes of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's and SQL's white space of all contracts here: space and \t \n \v \f \r.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share; only a local session may go
    without one and gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder; later reads don't depend on executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column = "text") -> Column:
    """The text's bytes; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def signed(values: np.ndarray) -> np.ndarray:
    """uint64 hashes as the long of the same bits."""
    return np.ascontiguousarray(values).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 whose bits all depend on all bits of x (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64, the same on every machine."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def blocks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a binary column without nulls, so that a block holds
    about ``limit`` bytes, or one row if that is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def binaries(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), values)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_by(df: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame:
    """Like ``cut``, a row for each ``key`` (for those in ``among``, if given), dealt by it once: joins on it then leave
    these rows where they are. Rows keep that only if their query isn't adaptive, so ``df`` and ``among`` should do no
    joins."""
    spark = df.sparkSession
    with _set(spark, "spark.sql.adaptive.enabled", "false"):
        dealt = df.repartition(parts := int(spark.conf.get("spark.sql.shuffle.partitions")), key)
        if among is not None:
            dealt = dealt.join(among.select(key).repartition(parts, key).hint("shuffle_hash"), key, "left_semi")
        return cut(dealt.dropDuplicates([key]))


def shuffles_freed(spark: SparkSession):
    """Queries made and run within give back the disk of their shuffles as soon as they end, rather than when the
    driver's garbage collector finds them. For steps whose results are written out; the caller's setting stays."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bits of ``at`` in ``in_order`` below the number of the task.
TASK_BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """The rows written in a global order, with ``at``, which grows in that order: the number of the
    task that sorted the row, and below ``TASK_BITS`` its place in the task."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
