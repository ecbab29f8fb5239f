"""What the operators of this subpackage share: reading tables, a shared scratch folder, Arrow text blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Scratch folders of local sessions, as in tests.
_OWN: dict[str, str] = {}
#: The paths that saved() wrote since the stage began, where a stage is run.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share. Where that is unset, a local session gets a folder of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        if own not in _OWN:
            _OWN[own] = tempfile.mkdtemp(prefix="spark-")
        root = _OWN[own]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared scratch folder and read back: its lineage is cut, and executors may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """The written table goes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """saved(make(), name), after which the tables that make() wrote on its way are removed and the session's size of Arrow batches is set back.

    The result reads its own table alone, so nothing of those can be needed again, by a task that is run again either. Also
    where make() fails, its tables go.
    """
    before, token = spark.conf.get(_BATCH), _WRITTEN.set([])
    try:
        result = saved(make(), name)
        # the last one is the result's
        _WRITTEN.get().pop()
        return result
    finally:
        for path in _WRITTEN.get():
            removed(spark, path)
        _WRITTEN.reset(token)
        spark.conf.set(_BATCH, before)


def light(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table, to be sent to all executors if it has few rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, after capping the rows of an Arrow batch for this session, so that long texts don't add up in a worker."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > rows:
        conf.set(_BATCH, str(rows))
    return df


def unit_hash(key, salt: str):
    """A reproducible number in (0, 1) for a key column; the same in any SQL engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def few_enough(u, most: int, count):
    """Whether a row's hash in (0, 1) can be among the `most` least of about `count` rows: so few pass that one task can rank them."""
    return u * count < 2 * most + 100


def crc_fold(key: str, folds: int):
    """crc32 of the key as text, modulo the number of folds; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay near a bound; a longer row gets a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end
