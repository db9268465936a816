"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.store import release, shared_dir, stored as materialize, written as scratch_tables  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; resolved where it is called (executors too)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of text that go to Python at a time, unless the session says otherwise: Spark's 10000 of 2 kB take 20 MB many times over.
ARROW_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Give executors this package when neither PYTHONPATH nor their working folder holds it, and bound Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = {os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} | {os.getcwd()}
    sc = spark.sparkContext
    if root in seen or getattr(sc, "_quadrille_shipped", False):
        return
    import shutil
    import tempfile

    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "quadrille"), "zip", root, "quadrille")
    sc.addPyFile(zipped)
    sc._quadrille_shipped = True


_tables: list[dict] = []
_memos: list[weakref.ref] = []
_owner: str | None = None


def kept(table: dict) -> dict:
    """A worker's table of one operator, emptied when another operator's task comes to the worker."""
    _tables.append(table)
    return table


class Memo(dict):
    """What `compute` gives for strings, of at most `most` strings of at most `longest` units; longer ones are not kept."""

    def __init__(self, compute: Callable, most: int = 300_000, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        _memos.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def _begin(owner: str) -> None:
    global _owner
    if _owner != owner:
        for table_ in [*_tables, *(m() for m in _memos)]:
            if table_ is not None:
                table_.clear()
        gc.collect()
        _owner = owner


def _end() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_worker(run: Callable) -> Callable:
    """A function of Arrow batches as a task: Spark reuses workers, so what other operators keep in this one goes first,
    and memory that is free goes back to the system at the end."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(run.__module__)
        try:
            yield from run(batches)
        finally:
            _end()

    return task


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_bucket(name: str, n: int):
    """crc32 of the decimal text of a column, modulo n (null stays null)."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string or binary column and its n + 1 offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column of numbers and its n + 1 offsets."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first n_keys columns (integers), one value in memory at a time; rows come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(n_keys)])
        first = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        for i, j in zip(first, [*first[1:], len(keys)], strict=True):
            if held and tuple(keys[i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[i])
            held.append(batch.slice(int(i), int(j - i)))
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about most_bytes of text each (one long row may exceed it)."""
    column = batch.column(batch.schema.get_field_index(text))
    if batch.num_rows == 0:
        return
    _, offsets = strings(column)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """Integers, one for each of `parts` hash partitions: rows with key i go to a partition of their own."""
    found = (
        spark.range(parts * 40)
        .select(F.col("id").cast("int").alias("key"))
        .withColumn("part", F.pmod(F.hash("key"), F.lit(parts)))
        .groupBy("part")
        .agg(F.min("key").alias("key"))
        .collect()
    )
    keys = np.arange(parts, dtype=np.int32)
    for r in found:
        keys[r["part"]] = r["key"]
    return keys


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more. Twice: the first round frees the handles
    that Python holds, the second what those kept alive in the JVM."""
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def zipped(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with text_col as zstd bytes in a last column `__zip` (null stays null), for joins that move whole texts."""
    names = [c for c in rows.columns if c != text_col]
    shown = rows.select(*names, F.col(text_col).cast("string").alias("__zip"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for whole in batches:
            for batch in slices(whole, "__zip", 4 << 20):
                data, offsets = strings(batch.column(len(names)))
                null = batch.column(len(names)).is_null().to_pylist()
                packed = [None if null[i] else squeeze(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*names, "__zip"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]]
    return shown.mapInArrow(run, ", ".join([*kinds, "__zip binary"]))


def unzipped(column: pa.Array) -> list[bytes | None]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [None if z is None else expand(z) for z in column.to_pylist()]


def smallest_hashes(rows: DataFrame, group: str, n: int, order: list[str], salts: int = 16) -> DataFrame:
    """At most n (up to 1000) rows of each group, first by `order`: cut in each map task and salt before a group meets."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = Window.partitionBy(group, "__salt").orderBy(*order)
    then = Window.partitionBy(group).orderBy(*order)
    kept = salted.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= n)
    return kept.withColumn("__n", F.row_number().over(then)).where(F.col("__n") <= n).drop("__n", "__salt")
