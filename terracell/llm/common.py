"""What the operators of this subpackage share: shipping code, batches, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass handles at a time; bounds a worker's memory.
SLICE_BYTES = 250_000


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, and keep Arrow batches small.

    The package is a few hundred KB of source, served by the driver once per application. Arrow
    batches are bound by bytes and rows, so that long texts do not pile up in a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    sc = spark.sparkContext
    done = getattr(sc, "_terracell_shipped", None)
    if done:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="terracell-"), "terracell.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(out)
    sc._terracell_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine will do if Spark runs on it alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that executors and driver share")
    return named or tempfile.mkdtemp(prefix="spark-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished rounds that nobody can read any more.

    It learns of them when the driver collects its garbage, which a driver with little to do does
    rarely: many rounds of small shuffles would pile up files on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose text column holds about ``limit`` bytes, a row at least."""
    col = batch.column(column)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int32 if col.type in (pa.string(), pa.binary()) else np.int64)
    offs = offs[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and each row's offsets in them; null rows are empty."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int32 if col.type == pa.string() else np.int64)
    offs = offs[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche, on unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle workers for a while, beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)
