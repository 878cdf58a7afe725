"""Find and replace over runs of text, counts, and typed list markers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, literal_replacement, search_pattern, word_count


# Noncharacters that mark where a match begins and ends.
FILL, OPEN, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _fill(text: Column) -> Column:
    """More of FILL in a row than ``text`` has anywhere, so that FILL and a mark stand nowhere in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{FILL}+"), F.lit(0)), F.length))
    return F.when(text.contains(FILL), F.repeat(F.lit(FILL), longest + 1)).otherwise(FILL)


def searchable(runs: DataFrame) -> DataFrame:
    """Only editable text is searched; computed content (fields, references, tables of contents) is not."""
    return runs.filter(F.col("editable"))


def checked_pattern(spark, query: str, match_case: bool, whole_word: bool, regex: bool) -> str | None:
    """The search pattern, or None when it is empty or Java rejects it."""
    pattern = search_pattern(query, match_case, whole_word, regex)
    if pattern is None:
        return None
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # as PySpark gives Java's PatternSyntaxException
        return None
    except Py4JJavaError as error:  # as it gives it where it has not wrapped the gateway
        if error.java_exception.getClass().getSimpleName() != "PatternSyntaxException":
            raise
        return None
    return pattern


def _running_ends(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda s: np.cumsum(s, dtype=np.int32))


def find(
    runs: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, regex: bool = False,
    keys: tuple[str, ...] = ("doc_id", "seq"),
) -> DataFrame:
    """Matches (keys, match_no, start, end, text) inside each run; empty matches are skipped, bad patterns match nothing.

    Runs without a match are dropped before anything is exploded. The text is cut at the matches once, so every start
    follows from the lengths of the pieces before it: the work is linear in the length of the run.
    """
    pattern = checked_pattern(runs.sparkSession, query, match_case, whole_word, regex)
    if pattern is None:
        empty = runs.limit(0)
        return empty.select(*keys, F.lit(0).alias("match_no"), F.lit(0).alias("start"), F.lit(0).alias("end"), "text")
    text = F.col("text")
    # Every match is wrapped in two marks that the text does not contain, and the text is cut after each match.
    fill = _fill(text)
    marked = F.regexp_replace(text, F.lit(pattern), F.concat(fill, F.lit(f"{OPEN}$0"), fill, F.lit(CLOSE)))
    # The last piece is what follows the last match; it has no opening mark, hence no hit.
    cut = F.transform(F.split("marked", F.concat("fill", F.lit(CLOSE)), -1), lambda p: F.struct(
        F.call_function("substring_index", p, F.concat("fill", F.lit(OPEN)), F.lit(1)).alias("before"),
        F.when(p.contains(F.concat("fill", F.lit(OPEN))), F.call_function("substring_index", p, F.concat("fill", F.lit(OPEN)), F.lit(-1))).otherwise("").alias("hit")))
    # Spark's higher-order functions would copy the list at every step; a running sum of the lengths is one pass in numpy.
    ends = F.pandas_udf(_running_ends, "array<int>")
    found = runs.filter(text.rlike(pattern)).select(*keys, marked.alias("marked"), fill.alias("fill"))
    sized = found.select(*keys, cut.alias("cut")).select(
        *keys, "cut", ends(F.transform("cut", lambda p: F.length(p["before"]) + F.length(p["hit"]))).alias("ends"))
    hits = F.filter(F.arrays_zip("cut", "ends"), lambda z: z["cut"]["hit"] != "")
    return sized.select(*keys, F.posexplode(hits).alias("match_no", "z")).select(
        *keys, "match_no", (F.col("z.ends") - F.length("z.cut.hit")).alias("start"), F.col("z.ends").alias("end"), F.col("z.cut.hit").alias("text"))


def replace_all(
    runs: DataFrame, query: str, replacement: str, match_case: bool = False, whole_word: bool = False,
    regex: bool = False,
) -> DataFrame:
    """Replace every non-overlapping match once by literal text, adding ``replaced`` (the number of replacements).

    An interactive editor searches again after each replacement and may stop early when the replacement itself matches;
    a batch job replaces each original match exactly once.
    """
    pattern = checked_pattern(runs.sparkSession, query, match_case, whole_word, regex)
    if pattern is None:
        return runs.withColumn("replaced", F.lit(0).cast("long"))
    return runs.withColumn("replaced", F.regexp_count("text", F.lit(pattern)).cast("long")).withColumn(
        "text", F.regexp_replace("text", F.lit(pattern), F.lit(literal_replacement(replacement))))


def touched_documents(replaced: DataFrame) -> DataFrame:
    """Documents in which something was replaced: the only ones to write again."""
    return replaced.filter(F.col("replaced") > 0).select("doc_id").distinct()


def doc_counts(blocks: DataFrame) -> DataFrame:
    """Words and non-space characters per document, summed over its blocks."""
    return blocks.groupBy("doc_id").agg(
        F.sum(word_count(F.col("text"))).alias("words"), F.sum(char_count(F.col("text"))).alias("chars"))
