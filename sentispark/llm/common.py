"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.session import fresh_dir


def id_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is an empty one."""
    return docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each piece.

    A value that is larger alone makes a piece of one row, so memory follows the largest text.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        begin, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(values).fill_null(0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as its Python worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` with ``give_back`` after its last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.written_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` from which nothing will be computed any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
