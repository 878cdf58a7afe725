"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

``source_targets`` turns the sizes of the sources into targets: sources in code-point order (null last) get the weights in turn,
share ``share`` times all words by weight, and none takes more than ``most`` times its size; what is above goes to the others
by weight. With the sources in the order in which they would reach their caps, the level at which sharing ends follows from two
running sums.

``mix`` draws the documents. A document of a source with target t and size s is expected t / s times. These expected copies,
in units of 2**-20, are summed along the source, one random offset per source is added, and the document is emitted once for
each integer boundary its stretch of the sum crosses: t / s rounded down or up, never more than ``most`` times. A source's
documents lie in buckets by a hash of their id and text, in each bucket from the shortest to the longest; so short and long
documents are drawn alike and a source's words come near its target. A bucket holds about BUCKET_ROWS rows, whatever the
source: a source with a third of all rows is as many tasks as it needs, and only one total per bucket is summed along it.

The offsets come from ``seed``; with the same seed and rows the same copies are drawn on any cluster. Rows with equal ids are
documents of their own. A null text, or one without words, has size 0 and is not drawn. A null source is a source, and so is
an empty one. Where all texts are empty all targets are 0. Columns other than doc_id, source and text play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, shared_folder, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BUCKET_ROWS = 5_000
#: Expected copies are counted in units of 2**-UNIT_BITS.
UNIT_BITS = 20


def n_words(text: str = "text") -> Column:
    """Words of a text, between runs of the six ASCII white-space characters."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+")) - 1).cast("bigint")


def _number(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), doc_id, source, size (words) and place (a digest of id and text)."""
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", n_words().alias("size"), place.alias("place"))


def _running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], folder: str) -> DataFrame:
    """``df`` with running sums over all its rows in ``order``: ranges of rows side by side, then a total per range."""
    ranged = stored(df.repartitionByRange(n_parts(df), *order).withColumn("_range", F.spark_partition_id()), folder)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    carry = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()]).select(
        "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    return summed.join(carry, "_range").select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def source_targets(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs (rows with words), source_size, weight and target, from rows with source and size."""
    folder = shared_folder(documents.sparkSession, "mix")
    sizes = documents.groupBy("source").agg(F.count_if(F.col("size") > 0).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, f"{folder}/sources")
    told = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(told, (F.pmod(F.col("rank") - 1, F.lit(len(weights)))).cast("int"))).withColumn(
        "cap", F.col("source_size") * F.lit(float(most))).drop("rank")
    # A source is at its cap when the level (words per weight) shared out is at least its cap by weight.
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    summed = _running(weighed, order, {"caps": F.col("cap"), "weights": F.col("weight")}, f"{folder}/caps")
    wanted, weights_ = summed.agg(F.sum("source_size") * F.lit(float(share)), F.sum("weight")).first()
    wanted, weights_ = wanted or 0.0, weights_ or 0.0
    level = (F.lit(wanted) - F.col("caps") + F.col("cap")) / (F.lit(weights_) - F.col("weights") + F.col("weight"))
    shared = summed.withColumn("full", F.col("cap") / F.col("weight") <= level)
    taken, full_weights = shared.where("full").agg(F.sum("cap"), F.sum("weight")).first()
    open_weights = weights_ - (full_weights or 0.0)
    level = (wanted - (taken or 0.0)) / open_weights if open_weights else 0.0
    return shared.select("source", "n_docs", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix(documents: DataFrame, targets: DataFrame, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``documents`` (of ``sized``) with source_size, target, copies and taken: the words the mix takes, repeats counted."""
    unit = F.lit(1 << UNIT_BITS)
    told = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))  # a name for the null source too, so that joins and windows share a key
    plan = targets.select(
        told.alias("_source"), "source_size", "target", _number(F.md5(F.concat(F.lit(f"{seed}|"), told)), UNIT_BITS // 4).alias("_offset"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit + 0.5)).otherwise(0).cast("bigint").alias("_rate"),
        F.greatest(F.ceil(F.col("n_docs") / bucket_rows), F.lit(1)).cast("bigint").alias("_buckets"))
    placed = documents.withColumn("_source", told).join(plan, "_source").withColumns({
        "_bucket": F.pmod(_number(F.col("place"), 15), F.col("_buckets")), "_expected": F.when(F.col("size") > 0, F.col("_rate")).otherwise(0)})
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("_source", "_bucket").agg(F.sum("_expected").alias("_sum")).select(
        "_source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("size", "doc_id", "place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_sum", F.sum("_expected").over(inside)).join(carry, ["_source", "_bucket"])
    end = F.col("_sum") + F.col("_before") + F.col("_offset")
    copies = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("_expected"), UNIT_BITS)
    return summed.withColumn("copies", copies).select(
        *documents.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it."""
    documents = sized(docs)
    targets = source_targets(documents.select("source", "size"), weights, share, most)
    drawn = mix(documents, targets, seed).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).select("row.*")


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """What ``draw`` takes of each document: doc_id, source, size, source_size, target, copies, taken. Texts are read once."""
    sizes = stored(sized(docs).drop("row"), f"{shared_folder(docs.sparkSession, 'mix')}/sizes")
    return mix(sizes, source_targets(sizes, weights, share, most), seed).drop("place")
