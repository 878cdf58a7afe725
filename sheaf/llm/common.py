"""What the operators of this package share: reading, batches of rows in Python, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The white space between words (tab, line feed, vertical tab, form feed, carriage return, space).
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()

Rows = Callable[[pa.RecordBatch], Iterable[tuple]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, rows: Rows, schema: str) -> DataFrame:
    """``rows`` turns each Arrow batch of ``df`` into tuples that match ``schema``."""
    target = df.sparkSession.createDataFrame([], schema).schema

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                yield from to_batches(rows(small), arrow)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes, so that very long texts do not pile up in a worker."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, most)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def to_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet and read again: its work is done once and survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken, name: str) -> str:
    """``name``, lengthened until none of ``taken`` is like it; letter case does not count."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def digest(name: str) -> Column:
    return F.sha2(F.col(name).cast("binary"), 256)
