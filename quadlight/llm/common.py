"""Helpers shared by the training-data operators.

Scratch tables are Parquet files below ``spark.checkpoint.dir``, the one folder that the driver and all executors
share: an executor that is lost takes nothing with it. Only a session without executors of its own may leave it unset.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word: space and the five controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Scratch folders by owner, so that a pipeline can drop those of a stage whose output is written.
_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadlight-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str, owner: str = "") -> str:
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(owner, []).append(path)
    return path


def staged(df: DataFrame, name: str, owner: str = "") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage and runs what stands above once."""
    path = scratch_path(df.sparkSession, name, owner)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, owner: str = "") -> None:
    """Deletes the scratch tables of ``owner``. Only call it once every frame built on them is written."""
    for path in _scratch.pop(owner, []):
        remove(spark, path)


def under_own_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with numbered column names, which no column of an operator has, and the old name of each."""
    names = {f"_c{i}": c for i, c in enumerate(df.columns)}
    return df.toDF(*names), names


def under_old_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(k).alias(c) for k, c in names.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it was."""
    return F.translate(c, _UPPER, _UPPER.lower())


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists that each stand for about ``size`` bytes."""
    at, end = 0, len(text)
    if end <= size:
        yield text.split()
        return
    while at < end:
        stop = min(at + size, end)
        while stop < end and text[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield text[at:stop].split()
        at = stop


#: Rows that Spark sends a worker at once, and Spark's own number, which is meant for rows of numbers.
BATCH_ROWS, SPARK_ROWS = 1000, "10000"


def small_batches(spark: SparkSession | None) -> None:
    """Whole texts go to the workers a thousand at a time, if the session leaves Spark's own number as it is: ten thousand
    long texts would take gigabytes on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key, SPARK_ROWS) == SPARK_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow in small batches, after which the worker gives freed memory back: workers live on for later
    stages."""
    small_batches(SparkSession.getActiveSession())

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no such call in this C library
                pass

    return whole
