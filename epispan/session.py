"""Session helpers: scale-minded settings and the shared folder for cut points."""

from __future__ import annotations

import math
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

FITS_AT_ONCE = 4
#: Paths cut by the calling thread since it entered ``cuts_discarded``.
CUT_HERE: ContextVar[list[str] | None] = ContextVar("cut_here", default=None)
PACKAGE_ZIP = "epispan_package.zip"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows can hold whole texts, so batches for Python workers are bounded by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are planned for, and ship this package to workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if any(path.endswith(PACKAGE_ZIP) for path in context.listFiles):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="epispan-")) / PACKAGE_ZIP
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only for local sessions without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="epispan-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, label: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back, so lineage ends in durable files.

    ``by`` partitions the files, so later filters on those columns read only their part.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    if (here := CUT_HERE.get()) is not None:
        here.append(path)
    writer = frame.write.partitionBy(*by) if by else frame.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def cuts_discarded(spark: SparkSession) -> Iterator[None]:
    """Frames that the calling thread cuts inside are deleted at the end; what is wanted of them must have been read."""
    paths: list[str] = []
    mark = CUT_HERE.set(paths)
    try:
        yield
    finally:
        CUT_HERE.reset(mark)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(frame: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """Repartition narrow rows that each stand for much work, to at most ``rows_per_task`` per task.

    Never fewer tasks than the cluster runs at once.
    """
    tasks = max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / rows_per_task))
    return frame.repartition(tasks)


def at_least_parallel(frame: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """Spread a frame only when it is too small to fill the cluster by itself."""
    slots = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(slots) if rows < slots * rows_per_task else frame


def fit_together(spark: SparkSession, fit: Callable, items: Iterable, at_once: int = FITS_AT_ONCE) -> list:
    """Run independent model fits side by side, since one fit seldom fills the cluster."""
    # every task needs its own copy of the thread's properties, hence one wrapper per task
    tasks = [inheritable_thread_target(spark)(partial(fit, item)) for item in items]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(lambda task: task(), tasks))
