"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.session import fresh_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = fresh_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Total bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def place_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, on the driver or in a task."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def commit(uri: str, name: str, write) -> str:
    """Calls write(stream) on a file that gets its name only when whole, so a repeated task replaces it."""
    import uuid

    files, folder = place_of(uri)
    files.create_dir(folder, recursive=True)
    half = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(half, compression=None) as stream:
        write(stream)
    files.move(half, f"{folder}/{name}")
    return f"{uri.rstrip('/')}/{name}"


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in batches that come sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def sliced(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            yield batch.slice(a, b - a)
            a = b
