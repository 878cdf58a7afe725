"""Session helpers: local sessions for tests and the bench, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", name: str = "sheaf") -> SparkSession:
    """A single-machine session for tests and the bench. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local folder would be lost together
    with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, so a loop re-reads files instead of replaying its plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within, the session's setting ``name`` is ``value``."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A task that writes into folders keeps a file open in so many of them; only beyond that are its rows sorted by folder. What an open
#: file holds in memory is one row group.
FOLDERS_AT_ONCE = 32
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
ROW_GROUP_BYTES = 16 << 20


def keep(df: DataFrame, name: str, by: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet, in folders by the columns ``by``, and read again: later reads take the columns and folders they
    need. The table lies in ``folder`` or in a new one beside the checkpoints.

    Rows go to their folders as they come: a sort by folder would hold, and then spill, all rows of a task unpacked.
    """
    folder = folder or f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by:
        with setting(df.sparkSession, OPEN_FILES, str(FOLDERS_AT_ONCE)):
            df.write.partitionBy(*by).option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    else:
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of rows that go to a Python worker at once where rows are large.
SMALL_BATCH_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what runs sends rows to Python in batches of at most ``SMALL_BATCH_BYTES``; a smaller setting stays.

    Spark fills batches up to 64 MB by default, held by both processes, as often as there are tasks and Python steps.
    """
    with setting(spark, BATCH_BYTES, str(min(SMALL_BATCH_BYTES, int(spark.conf.get(BATCH_BYTES).removesuffix("b"))))):
        yield


def ship_package() -> None:
    """Send this package's functions to Python workers as code, so that it need not be installed or on their path.

    Workers of stateful streams start before files added to a session reach them, hence code rather than an archive.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
