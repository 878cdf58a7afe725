"""Ordered scans inside a document that do not need the whole document in one task.

``Window.partitionBy("doc_id")`` sends all rows of a document to one task, which fails the cluster when one document
holds a large share of the table. So the positions are measured first. While no document is longer than
``chunk_rows``, a plain window is the best plan: one shuffle, one pass. Beyond that, every running value used here (a
running sum, the last or next row that satisfies a condition) is associative and is computed in two levels:

1. rows are cut into chunks of consecutive positions and each chunk is pre-aggregated (map-side combined);
2. the few chunk aggregates are scanned per document, and each row combines its chunk's carry with a window over
   ``(document, chunk)``, whose size is bounded by ``chunk_rows``.

The rows are read by both levels, hence settled (written once) before them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

CHUNK_ROWS = 1 << 20
MAX_GROUP_ROWS = 2_000_000
#: Rows sorted by one task: what a task holds stays the same while a table grows, whatever the number of shuffle partitions.
TASK_ROWS = 250_000
SIZE_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Running:
    """One running value: how a row contributes, how contributions fold and in which direction they are read."""

    value: Callable[[str], Column]
    fold: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    forward: bool = True
    inclusive: bool = True


def running_sum(amount: Column, inclusive: bool = True) -> Running:
    """Sum of ``amount`` over the rows up to here."""
    zero = F.lit(0).cast("long")
    return Running(
        lambda _: F.coalesce(amount.cast("long"), zero), F.sum,
        lambda here, carry: F.coalesce(here, zero) + F.coalesce(carry, zero), True, inclusive,
    )


def running_max(amount: Column, inclusive: bool = True) -> Running:
    """Largest ``amount`` over the rows up to here."""
    return Running(lambda _: amount, F.max, lambda here, carry: F.greatest(here, carry), True, inclusive)


def _row(order: str, when: Column | None, fields: dict[str, Column]) -> Column:
    packed = F.struct(F.col(order).alias("at"), *[c.alias(n) for n, c in fields.items()])
    return packed if when is None else F.when(when, packed)


def last_row(when: Column | None = None, inclusive: bool = True, **fields: Column) -> Running:
    """The latest earlier row satisfying ``when``, as STRUCT(at, fields...); ``at`` is its position."""
    return Running(lambda order: _row(order, when, fields), F.max, F.coalesce, True, inclusive)


def first_row(when: Column | None = None, inclusive: bool = True, **fields: Column) -> Running:
    """The earliest row so far satisfying ``when``, as STRUCT(at, fields...)."""
    return Running(
        lambda order: _row(order, when, fields), F.min, lambda here, carry: F.coalesce(carry, here), True, inclusive)


def next_row(when: Column | None = None, inclusive: bool = True, **fields: Column) -> Running:
    """The nearest following row satisfying ``when``, as STRUCT(at, fields...)."""
    return Running(lambda order: _row(order, when, fields), F.min, F.coalesce, False, inclusive)


def extent(df: DataFrame, order: str) -> int:
    """The largest position in ``df``: one pass over one column. Pass it on as ``longest`` to scans of the same rows."""
    return int(df.agg(F.max(order)).first()[0] or 0)


def spread(df: DataFrame, keys: Sequence[str], rows: int, always: bool = False) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``TASK_ROWS`` of its ``rows``; windows and groups by more keys stay there.

    Few rows are left to the default shuffle, unless they are to be dealt ``always``.
    """
    spark = df.sparkSession
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows > usual * TASK_ROWS:
        return df.repartition(-(-rows // TASK_ROWS), *keys)
    return df.repartition(*keys) if always else df


def scan(
    df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int | None = None, longest: int | None = None,
    **running: Running,
) -> DataFrame:
    """Add one column per running value. ``order`` is a non-negative integer, unique within ``keys``; keys not null.

    ``longest`` is the largest position when the caller knows it (0 for rows cut from a single value, which no task
    can split anyway); otherwise it is measured.
    """
    keys, chunk_rows = list(keys), chunk_rows or CHUNK_ROWS
    if (extent(df, order) if longest is None else longest) < chunk_rows:
        return df.select("*", *[
            r.combine(r.fold(r.value(order)).over(_frame(keys, order, r)), F.lit(None)).alias(name)
            for name, r in running.items()])
    chunk = "_chunk"
    base = settle(df.withColumn(chunk, F.floor(F.col(order) / F.lit(chunk_rows)).cast("long")))
    parts = base.groupBy(*keys, chunk).agg(
        *[r.fold(r.value(order)).alias(f"_{name}") for name, r in running.items()]
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys, chunk,
        *[r.fold(F.col(f"_{name}")).over(before if r.forward else after).alias(f"_{name}") for name, r in running.items()],
    ).filter(_any_not_null([f"_{name}" for name in running]))
    joined = base.join(carry, [*keys, chunk], "left")
    return joined.select(*[F.col(c) for c in df.columns], *[
        r.combine(r.fold(r.value(order)).over(_frame([*keys, chunk], order, r)), F.col(f"_{name}")).alias(name)
        for name, r in running.items()])


def _frame(keys: Sequence[str], order: str, r: Running):
    """Rows up to the current one in the direction the value is read; never an unbounded following frame."""
    ordering = F.col(order).asc() if r.forward else F.col(order).desc()
    return Window.partitionBy(*keys).orderBy(ordering).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if r.inclusive else -1)


def _any_not_null(names: Sequence[str]) -> Column:
    found = F.col(names[0]).isNotNull()
    for name in names[1:]:
        found = found | F.col(name).isNotNull()
    return found


def with_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", start: int = 1,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Number rows ``start``, ``start+1``, ... within ``keys`` by a total order of any type.

    Groups are measured first, by buckets of groups, so that the count stays small however many there are. If the largest is small a
    plain window does it; otherwise
    rows are range-partitioned on (keys, order), so a large group spans many tasks, settled so that every reader sees
    the same ranges, numbered inside each range and shifted by the rows of the group in earlier ranges.
    """
    keys, order = list(keys), list(order)
    largest = lambda *by: df.groupBy(*by).count().agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    sizes = largest(F.pmod(F.hash(*keys), F.lit(SIZE_BUCKETS)))
    if (sizes["largest"] or 0) > max_group_rows:
        sizes = largest(*keys)
    ordering = [F.col(o) for o in order]
    if (sizes["largest"] or 0) <= max_group_rows:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))
        return spread(df, keys, sizes["rows"] or 0).withColumn(name, (number + F.lit(start - 1)).cast("long"))
    ranges = max(8, -(-sizes["rows"] // max_group_rows) * 2)
    ranged = settle(
        df.repartitionByRange(ranges, *[F.col(k) for k in keys], *ordering)
        .withColumn("_range", F.spark_partition_id().cast("long"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(*keys, "_range").count().select(
        *keys, "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift")
    )
    number = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*ordering))
    return (
        ranged.join(shift, [*keys, "_range"])
        .withColumn(name, (number + F.col("_shift") + F.lit(start - 1)).cast("long"))
        .drop("_range", "_shift")
    )
