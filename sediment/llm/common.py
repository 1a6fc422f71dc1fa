"""What the corpus operators share: reading tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to Python, whichever comes first: documents may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings (runtime SQL settings only) that bound memory and disk.

    Shuffle files go as soon as the query that wrote them ends, so an operator of
    several steps never holds the files of more than one step. The settings stay: what
    an operator returns runs only when its caller asks for it.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment  # Python workers find this package where it isn't installed
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all tasks run in the driver's own process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sediment-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    """Written tables live as long as the application: what a query returns still reads them."""
    for spark, path in _written:
        try:
            delete_folder(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and its folder is the cluster's to clear
            return


def materialise(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.sortWithinPartitions(*sort) if sort else df
    writer.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table_ = spark.read.schema(df.schema).parquet(path)
    _paths[id(table_)] = path
    weakref.finalize(table_, _paths.pop, id(table_), None)
    return table_


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote and nothing reads any more."""
    if path := _paths.pop(id(df), None):
        delete_folder(df.sparkSession, path)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def emit(rows: Iterator[tuple], schema: pa.Schema, at_most: int = 2048, at_most_bytes: int = 16 << 20, size: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches, bounded in rows and, with ``size``, in bytes."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        if size is not None:
            held_bytes += size(row)
        if len(held) >= at_most or held_bytes >= at_most_bytes:
            yield batch_of(held, schema)
            held, held_bytes = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
