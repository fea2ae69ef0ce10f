"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: a Python worker holds a few such batches, whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own;
    on a cluster that would be a folder which other machines do not see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there and it survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, so that very long texts do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by this Python worker for its next tasks. A worker keeps one thing: workers outlive operators,
    and the tables of one must not stay beside those of the next."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Frees what an earlier operator keeps in this Python worker."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def private(columns: list[str], *names: str) -> list[str]:
    """Names for columns of one's own that differ from all given ones, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def of(name: str) -> Column:
    """The column of that very name, whatever letters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, keep: list[str], *more: tuple[str, str]) -> T.StructType:
    """The schema of the columns in keep, and of more columns given as (name, type)."""
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more])


def remainder(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def held_out(key: Column) -> Column:
    """True for the quarter of the rows that no model learns from; a null key is not held out."""
    return F.coalesce(remainder(key) == 2, F.lit(False))


def texts_of(column: pa.Array) -> list[str]:
    """A column of texts as Python strings; null becomes an empty text."""
    return [x or "" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about most_bytes, one row at least."""
    if batch.num_rows <= 1 or batch.nbytes <= most_bytes:
        yield batch
        return
    step = max(1, int(batch.num_rows * most_bytes / batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
