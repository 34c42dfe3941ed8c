"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of "word": a run of anything but space and the five ASCII controls \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no more than its own tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: computed once, read with pruned columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def forget(spark: SparkSession) -> int:
    """Delete what `materialize` has written in this process; call it when the results that read it are written."""
    jvm, n = spark._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def slices(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each (one row at least): bounds the scratch memory of a batch."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def utf8(values: Iterable) -> list[bytes]:
    """Bytes of the values of a binary or string array; null counts as empty."""
    return [b"" if v is None else v for v in values]


def as_bytes(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as binary, without a copy of its characters."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def text_bytes(name: str = "text"):
    """UTF-8 length of a text column, null counts as 0."""
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


def release() -> None:
    """Give freed memory back to the system at the end of a task: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per group of rows that agree in `keys`, from batches sorted by them; holds no more than one group and one
    batch."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        first = [c[0].as_py() for c in columns]
        change[0] = last is not None and first != last
        begin = 0
        for stop in np.flatnonzero(change).tolist():
            if stop:
                waiting.append(batch.slice(begin, stop - begin))
            yield pa.Table.from_batches(waiting)
            waiting, begin = [], stop
        waiting.append(batch.slice(begin))
        last = [c[-1].as_py() for c in columns]
    if waiting:
        yield pa.Table.from_batches(waiting)


#: Bytes of an Arrow batch that goes to a Python worker; with `slices` it bounds what a worker holds.
BATCH_BYTES = 8 << 20


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes (a setting of the session, lowered here), by workers that give memory
    back when their input ends."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or 0) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def go(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(go, schema)
