"""Where intermediate tables are written."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_RUN = f"corvane-{uuid.uuid4().hex}"
_cleaned: set[str] = set()
#: Seconds from one collection of the driver's garbage to the next.
COLLECT_EVERY = 10
_collected = time.monotonic()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, so that there is one machine, a temporary
    folder is chosen and kept in the session, so that later calls find the same one. On a cluster an
    unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """The tables of this process go when it ends; nothing reads them after that."""
    if folder in _cleaned:
        return
    _cleaned.add(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

    atexit.register(remove)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes with this process."""
    folder = f"{shared_dir(spark)}/{_RUN}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


@contextlib.contextmanager
def tables_within() -> Iterator[list[str]]:
    """Gathers the paths of all tables that are written in the block, for discard()."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def _collect_garbage(spark: SparkSession) -> None:
    """Spark removes the shuffle files and broadcasts of plans that are through once the driver's garbage is collected.

    By itself it asks for that every half hour (spark.cleaner.periodicGC.interval), while a run of many tables fills the disk and the heap.
    """
    global _collected
    if time.monotonic() - _collected >= COLLECT_EVERY:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage at a place that survives a lost executor, and it fixes the rows: whatever
    reads the table again sees the same ones.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    for made in _open:
        made.append(path)
    _collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counting(df: DataFrame, *where: Column) -> tuple[DataFrame, Callable[[], list[int]]]:
    """df, and its number of rows and that of the rows for which each of the conditions holds, once df has been written.

    The run that writes it counts them. A query of its own for every count makes the driver keep one more plan, with its
    metrics, and the threads of its exchanges.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)), *map(F.count_if, where)]
    return df.observe(seen, *[n.alias(f"n{k}") for k, n in enumerate(counts)]), lambda: [seen.get[f"n{k}"] for k in range(len(counts))]


def counted(df: DataFrame, name: str, *where: Column) -> tuple[DataFrame, ...]:
    """materialize(df), its number of rows, and that of the rows for which each of the conditions holds."""
    df, counts = counting(df, *where)
    return materialize(df, name), *counts()


def discard(spark: SparkSession, made: list[str], *but: DataFrame) -> None:
    """Deletes tables that have served, without those that the tables `but` are read from."""
    kept = {f.rsplit("/", 1)[1] for df in but for f in (p.rsplit("/", 1)[0] for p in df.inputFiles())}
    for path in made:
        if path.rsplit("/", 1)[1] not in kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove(table: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    discard(table.sparkSession, [p.rsplit("/", 1)[0] for p in table.inputFiles()[:1] if f"/{_RUN}/" in p])


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks that start in the block get so many rows at a time: a batch of whole texts and what is made of
    it stand in the memory of the worker and, for the exchange, of the executor beside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
