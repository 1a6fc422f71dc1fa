"""Streams into changelogs: each micro-batch is one commit, and a batch that comes again is none."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from sediment.store import Store


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='sediment-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all tasks run in the driver's own process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _local_folder()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone
        return


def replay(spark: SparkSession, path: str, changes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All of a Parquet table, read as a stream and appended batch by batch to a changelog table.

    A batch is written to a folder named by its number, replacing what an earlier
    attempt may have left, so a restart adds nothing twice.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def write(batch: DataFrame, number: int) -> None:
        changes(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    # a stream reads a folder: files of the table are found by their pattern
    name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{name[0]}/{name[1]}*")
    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    atexit.register(_delete, spark, folder)
    return spark.read.parquet(f"{folder}/log").drop("batch")


def upsert(stream: DataFrame, store: Store, order: str, *, name: str, checkpoint: str, maintain: bool = True, **trigger):
    """Start a query that puts every batch of ``stream`` (key, value, [tombstone], order) into ``store``.

    A batch is committed under (name, number); a replayed one is recognised and left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.put_df(batch, order=order, batch=(name, number))
        if maintain:
            store.compact()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()
