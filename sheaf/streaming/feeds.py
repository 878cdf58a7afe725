"""Change feeds as streams: reading and writing them, and running a stream over what is there now.

The feeds themselves know only arrival order. Event time, watermarks and the bound they put on state are added here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What a micro-batch takes at most, unless the caller says otherwise.
BATCH_BYTES = 1 << 30


def _bounded(reader, files_per_trigger: int | None):
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", BATCH_BYTES)


def read_change_feed(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream. The schema is given, never inferred."""
    return _bounded(spark.readStream.schema(schema), files_per_trigger).json(path)


def read_table_feed(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its files: ``folder``/``name``.parquet may be a file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = _bounded(spark.readStream.schema(table.schema), files_per_trigger)
    single = any(f.split("?")[0].endswith(f"/{name}.parquet") for f in table.inputFiles()[:1])
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)


def write_change_feed(stream: DataFrame, path: str, checkpoint: str):
    """Start writing a feed as Parquet, each message exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory, for the state and output of one run."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over everything available and return its output rows, with the batch (``batch_id``) of each.

    State lives in RocksDB and checkpoints in the shared folder. Output goes to files there, batch by batch, never
    through the driver; writing a batch again after a failure replaces it.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    schema = stream.schema.add("batch_id", "long")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    spark.createDataFrame([], schema).write.partitionBy("batch_id").parquet(f"{folder}/out")  # a feed may bring nothing
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).foreachBatch(save).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key out of ``drain`` in update mode."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*").drop("batch_id")


def foreign_edits(feed: DataFrame, me: int) -> DataFrame:
    """What others did: a session's own messages come back to it and are dropped."""
    return feed.filter(F.col("session") != me)
