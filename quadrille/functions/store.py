"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder and everything runs on one machine.
LOCAL_SHARED = "/tmp/checkpoints"

#: Bytes of input files that a task of dealt rows has its share of; a table's row becomes several statements of many columns.
TASK_BYTES = 256 << 10

#: Rows of Parquet files that a task of dealt rows has its share of: files that compress well hold many rows in few bytes.
TASK_ROWS = 8192

_written: list[str] = []
_counted: dict[tuple, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see: spark.checkpoint.dir, else a local one where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{LOCAL_SHARED}").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    if not _written:
        atexit.register(_release_quietly)
    _written.append(f"{shared_dir(spark)}/quadrille-{label}-{uuid.uuid4().hex}")
    return _written[-1]


def written() -> list[str]:
    """Paths that shared_path() named and nobody released yet."""
    return list(_written)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that a plan reads; None where Spark does not know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 50 else None


def input_rows(df: DataFrame) -> int | None:
    """Rows of the Parquet files that a plan reads, by their footers; None where it reads anything else."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    if not found or any(x.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in x.relation().toString().lower() for x in found):
        return None
    files = df.inputFiles()
    key = (input_bytes(df), *sorted(files))
    if key not in _counted:
        if len(_counted) >= 64:
            _counted.clear()
        _counted[key] = df.sparkSession.read.schema(StructType()).parquet(*files).count() if files else 0
    return _counted[key]


def dealt(df: DataFrame, *columns: str | Column) -> DataFrame:
    """df dealt out by columns. The number of tasks follows the input's bytes and rows, so that what a task holds does not
    grow with either; it is given even where it is small, as Spark would else join partitions up to a size of its own."""
    tasks = max((input_bytes(df) or 0) // TASK_BYTES, (input_rows(df) or 0) // TASK_ROWS)
    if not tasks:
        return df.repartition(*columns)
    spark = df.sparkSession
    return df.repartition(max(tasks, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), *columns)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what shared_path() named (all by default); call only when no DataFrame reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in written() if paths is None else paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _written:
            _written.remove(path)


def _release_quietly() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception as error:  # the JVM may be gone at exit; the folder is the cluster's to clean
            print(f"tables between steps not deleted: {error}", file=sys.stderr)
