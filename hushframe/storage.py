"""Intermediate tables in the shared folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SMALL_PIECE = 1 << 15
#: Bytes of input for a task, where the splits of a scan are far smaller.
TASK_BYTES = 32 << 20
#: Temporary folders of local sessions without a configured one, by application.
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder from `spark.checkpoint.dir`; only a session whose executors are threads of the driver may go without.

    Such a session gets one temporary folder. A `file:` folder on a cluster must be on storage that all machines share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _temporary:
        _temporary[context.applicationId] = tempfile.mkdtemp(prefix="hushframe-")
    return _temporary[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as parquet and read it back.

    The lineage ends here, values that depend on the run (partition ids) become data, a lost executor loses
    nothing, and the planner knows the size of what it reads next.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hushframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside send tasks' Python at most about so many bytes at once, however long the rows are.

    A batch is held by the task, while it grows in two copies, and by Python. How many rows it may have stays as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def estimated_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects; for a plain scan that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _split_bytes(df: DataFrame) -> int:
    return int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def few_splits(df: DataFrame, limit: int = 100_000) -> bool:
    """True if the files of `df` are read in at most `limit` splits, so that one row per split may be broadcast."""
    return estimated_bytes(df) // _split_bytes(df) + len(df.inputFiles()) <= limit


def gathered(df: DataFrame, size: int | None = None) -> DataFrame:
    """Let a task read many splits of a scan, where they are small: work per task must not cost more than the rows do.

    No row moves, and those of a split stay together and in order. `size` is the size of the input, if it is known better
    than by the estimate of the optimizer.
    """
    tasks = (estimated_bytes(df) if size is None else size) // TASK_BYTES + 1
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, tasks))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that is smaller than one scan split.

    A small file of one row group is read by a single task. The estimate of the optimizer decides, so a large
    input, which has splits enough, is never shuffled.
    """
    estimate = estimated_bytes(df)
    if estimate >= _split_bytes(df):
        return df
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, estimate // SMALL_PIECE + 1))
