"""Tracked changes: which exist, what accepting or rejecting them leaves, how suggestions are recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import extent, last_row, running_sum, scan


def has_revisions(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with an insertion or deletion in their text; format and paragraph-mark changes alone do not count."""
    return docs.join(runs.filter(F.col("rev_kind").isin("ins", "del")), "doc_id", "left_semi")


def merge_adjacent_insertions(runs: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``change_no``: neighbouring insertions by one author are one change. Null for runs that are no insertion."""
    mine = runs.withColumn("_who", F.when(F.col("rev_kind") == "ins", F.col("rev_author")))
    longest = extent(runs, order)
    prev = scan(mine, ["doc_id"], order, longest=longest, _prev=last_row(inclusive=False, who=F.col("_who")))
    opens = F.col("_who").isNotNull() & ~F.col("_who").eqNullSafe(F.col("_prev.who"))
    out = scan(prev.withColumn("_open", opens.cast("long")), ["doc_id"], order, longest=longest, _n=running_sum(F.col("_open")))
    return out.withColumn("change_no", F.when(F.col("_who").isNotNull(), F.col("_n"))).drop("_who", "_prev", "_open", "_n")


def insertion_changes(runs: DataFrame, order: str = "seq") -> DataFrame:
    """One row per merged insertion: author, first and last run, runs, characters."""
    return merge_adjacent_insertions(runs, order).filter(F.col("change_no").isNotNull()).groupBy("doc_id", "change_no").agg(
        F.min_by("rev_author", order).alias("author"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"),
        F.count("*").alias("n_runs"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def _resolve(runs: DataFrame, accept: Column) -> DataFrame:
    """Apply a decision per run: null leaves the change pending."""
    ins, dele, fmt = (F.col("rev_kind").eqNullSafe(k) for k in ("ins", "del", "fmt"))
    removed = F.coalesce((ins & ~accept) | (dele & accept), F.lit(False))
    decided = accept.isNotNull() & F.col("rev_kind").isNotNull()
    out = runs.filter(~removed)
    if "old_fmt" in runs.columns:
        out = out.withColumn("fmt", F.when(fmt & ~accept, F.col("old_fmt")).otherwise(F.col("fmt")))
        out = out.withColumn("old_fmt", F.when(decided, None).otherwise(F.col("old_fmt")))
    for c in ("rev_author", "rev_date", "rev_kind"):
        if c in runs.columns:
            out = out.withColumn(c, F.when(decided, None).otherwise(F.col(c)))
    return out


def accept_all(runs: DataFrame) -> DataFrame:
    """Insertions stay, deletions go, format changes keep the new format."""
    return _resolve(runs, F.lit(True))


def reject_all(runs: DataFrame) -> DataFrame:
    """Insertions go, deletions stay, format changes fall back to ``old_fmt``."""
    return _resolve(runs, F.lit(False))


def resolve_changes(runs: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Accept or reject the changes named by ``decisions`` (``on`` columns and accept); others stay pending."""
    joined = runs.join(decisions.select(*on, F.col("accept").alias("_accept")), on, "left").withColumn(
        "_accept", F.when(F.col("rev_kind").isNotNull(), F.col("_accept")))
    return _resolve(joined, F.col("_accept")).select(*runs.columns)


def merge_paragraphs(blocks: DataFrame, accept: bool, order: str = "seq") -> DataFrame:
    """Resolve paragraph-mark changes: rejecting an inserted mark, or accepting a deleted one, joins the next block on.

    Adds ``para_no`` (1, 2, ...) and ``merged_into`` (position of the first block of the joined paragraph): a joined
    paragraph is the ordered sequence of its blocks, kept as rows because a chain of marks may span a whole document.
    The mark of the last block only clears. A chain of marks joins all its blocks; an interactive editor that resolves
    marks one element at a time loses every second mark of a chain, because the block carrying it is already gone.
    """
    joins = F.col("rev_para").eqNullSafe("del" if accept else "ins")
    longest = extent(blocks, order)
    prev = scan(blocks, ["doc_id"], order, longest=longest, _prev=last_row(inclusive=False, joins=joins))
    starts = ~F.coalesce(F.col("_prev.joins"), F.lit(False))
    out = scan(prev.withColumn("_s", starts), ["doc_id"], order, longest=longest,
               para_no=running_sum(F.col("_s").cast("long")), _head=last_row(F.col("_s")))
    return out.withColumn("merged_into", F.col("_head.at")).withColumn("rev_para", F.lit(None).cast("string")).drop("_prev", "_s", "_head")


def suggest_deletion(runs: DataFrame, selected: Column, author: str, date: Column) -> DataFrame:
    """Delete the selected runs in suggestion mode: one's own pending insertion disappears, anything else is marked."""
    own = F.col("rev_kind").eqNullSafe("ins") & (F.col("rev_author") == author)
    marked = selected & ~F.col("rev_kind").eqNullSafe("del")
    return (
        runs.filter(~F.coalesce(selected & own, F.lit(False)))
        .withColumn("rev_author", F.when(marked, F.lit(author)).otherwise(F.col("rev_author")))
        .withColumn("rev_date", F.when(marked, date).otherwise(F.col("rev_date")))
        .withColumn("rev_kind", F.when(marked, F.lit("del")).otherwise(F.col("rev_kind")))
    )


def revision_stats(runs: DataFrame) -> DataFrame:
    """Changes and characters by author, kind and day."""
    return runs.filter(F.col("rev_kind").isNotNull()).groupBy(
        "rev_author", "rev_kind", F.to_date("rev_date").alias("day")).agg(
        F.count("*").alias("changes"), F.sum(F.length("text")).cast("long").alias("chars"))
