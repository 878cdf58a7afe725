"""A corpus pipeline in five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of their docs; where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import jaccard_join, line_dedup, packing, pii, quality
from sheaf.llm.common import free_name, shared_folder, stored
from sheaf.session import ship_package

ship_package()

#: Key of the pseudonyms; a real run sets its own.
PII_KEY = "check-run"
#: SQL can express neither keyed permutations nor the packing; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def _with_chars(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    out = line_dedup.dedup_all(docs)
    return _with_chars(out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns]))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, and of several of that id the one whose text has
    the smallest hash. Rows are told apart by id and text, so rows with equal ids may go their own ways. Documents without
    words stay."""
    found = stored(jaccard_join.grouped(docs).where("component is not null").select("doc_id", "told", "component"), f"{shared_folder(spark, 'pipeline')}/groups")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "told")
    one = found.groupBy("component").agg(F.min(row).alias("one"))
    places = found.join(one, "component").withColumn("stays", row == F.col("one")).groupBy("doc_id", "told").agg(
        F.first("stays").alias("stays"), F.count("*").alias("times"))
    others = stored(places.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("told").alias("_told"), "stays"),
                    f"{shared_folder(spark, 'pipeline')}/others")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("told"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("told") == F.col("_told"))
    left = rows.join(others, same, "left_anti")
    if not others.where("stays").isEmpty():  # repeated rows: one of them stays
        left = left.union(rows.join(others.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "told"]))
    return left.select("row.*")


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by keyed pseudonyms."""
    count = free_name(docs.columns, "_n_replaced")
    return _with_chars(pii.pseudonymise(docs, PII_KEY, count=count).drop(count))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence that holds them."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("ngram_jaccard_join", ngram_jaccard_join),
          ("pii", pii_pseudonyms), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
