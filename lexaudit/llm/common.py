"""What the training-data operators share: shared storage, row keys, word rule."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of an Arrow batch.
BATCH_BYTES = 6 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; set one of our own only in local mode, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexaudit-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """Written as a table to the shared folder and read again, and what removes it; else it goes when the driver ends.

    What it is made of is cut off, as by ``cut``, but its columns are compressed."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    return spark.read.parquet(path), lambda: files.delete(where, True)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows as a table that the planner makes; reading it starts no Python worker."""
    fields = StructType.fromDDL(ddl).fields
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    listed = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True))) for row in rows))
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def pack_rows(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def by_size(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of a text column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict[str, tuple[Callable[[], None], bool]] = {}


def keep_for_next(name: str, release: Callable[[], None]) -> None:
    """This task uses what a worker keeps from task to task; the first task that doesn't use it releases it."""
    _KEPT[name] = release, True


def trim() -> None:
    """Give unused memory of this worker back; workers live on between tasks, and go from step to step."""
    for name, (release, used) in list(_KEPT.items()):
        if used:
            _KEPT[name] = release, False
        else:
            release()
            del _KEPT[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, whatever the texts' length; workers give memory back after a task.

    The bound is a setting of the session, which is only ever lowered."""
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(tidied, schema)


def _bytes(size: str) -> int:
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    plain = size.lower().removesuffix("b")
    return int(plain[:-1]) * unit[plain[-1]] if plain and plain[-1] in unit else int(plain)
