"""Session settings, and the few decisions that depend on how much data there is."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# One reduce task should get about this much input.
BYTES_PER_SHUFFLE_TASK = 256 * 1024 * 1024
# Rows go to and from Python workers in batches of about this much.
BYTES_PER_BATCH = 4 * 1024 * 1024
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
START_TASKS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> None:
    """Turn on the run-time re-planning the jobs count on.

    Joins on a raw key (one order, product or customer may own a third of all lines) leave the
    splitting of hot keys to adaptive execution. `forceOptimizeSkewedJoin` matters where an
    aggregate reuses the partitioning of the join: without it Spark keeps the hot task whole to
    save a shuffle.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate after pruning; for a plain scan this is the size of its files."""
    name = f"sized_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        plan = df.sparkSession.sql(f"EXPLAIN COST SELECT * FROM {name}").first()[0]
    finally:
        df.sparkSession.catalog.dropTempView(name)
    number, unit = re.search(r"sizeInBytes=([\d.]+(?:E[+-]?\d+)?) (\w*?)i?B", plan).groups()
    return int(float(number) * 1024 ** " KMGTPE".index(unit or " "))


def _bytes(setting: str) -> int:
    """A size as Spark's settings give it, such as 10485760b, 256k or 10MB."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index({"b": " ", "": " "}.get(unit, unit))


def broadcast_if_small(side: DataFrame, rows: DataFrame) -> DataFrame:
    """Mark a joined side with as many rows as `rows` for broadcast if it fits under Spark's limit.

    Catalyst multiplies the sizes of a join's inputs, so it would shuffle the big table for a
    side of a few megabytes. The estimate is rows times the width of the joined rows, twenty bytes
    for a text. Above the limit the side is returned as it is and Catalyst shuffles.
    """
    limit = _bytes(side.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if limit <= 0:
        return side
    width = 8 + sum(20 if kind == "string" else 8 for _, kind in side.dtypes)
    return F.broadcast(side) if rows.count() * width <= limit else side


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Set the starting number of shuffle tasks to suit the input of the next job.

    Adaptive execution merges small shuffle tasks by itself, but it cannot split ones that
    started out too large. Every input sets its own number: a small one after a large one goes back
    to the session's.
    """
    wanted = math.ceil(input_bytes / BYTES_PER_SHUFFLE_TASK)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(START_TASKS, str(wanted))
    else:
        spark.conf.unset(START_TASKS)


def size_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, whatever the number of its rows.

    Spark and every worker hold whole batches; left to itself, Spark fills them up to ten thousand rows or
    64 MB, and wide rows take that many times over.
    """
    if not 0 < _bytes(spark.conf.get(BATCH_BYTES)) <= BYTES_PER_BATCH:
        spark.conf.set(BATCH_BYTES, str(BYTES_PER_BATCH))


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_released(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, shuffle files go when their query ends.

    Left to itself, Spark keeps them until the driver happens to collect garbage, so the disk holds the
    shuffles of all jobs of a run at once. A frame that is asked twice shuffles twice.
    """
    return _held(spark, RELEASE, "true")


def open_files(spark: SparkSession, number: int) -> AbstractContextManager[None]:
    """Within it, a task that writes partitioned files keeps as many open, so that it need not sort its
    rows first; it sorts what comes after more partitions than that."""
    return _held(spark, "spark.sql.maxConcurrentOutputFileWriters", str(number))


def shuffle_tasks(spark: SparkSession) -> int:
    """The number of tasks a shuffle starts with."""
    return int(
        spark.conf.get(START_TASKS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's `spark.checkpoint.dir`.

    A session without that setting gets one beside its warehouse tables, which all executors reach
    as well.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        sc.setCheckpointDir(configured)
        folder = sc.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Compute once and keep the result as files in the shared folder.

    Losing an executor then costs nothing, and later queries read only the columns they need, and only
    the values of column `by` that they ask for.
    """
    folder = new_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def side_by_side(actions: Iterable[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Run independent jobs at the same time, so one fills the cores another leaves idle."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]
