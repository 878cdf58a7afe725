"""Differences between two states of a corpus: blocks, parts, summaries, complaints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..functions.units import length_to_inches
from .scan import last_row, scan

# The parts a save may rewrite when nothing was edited.
MAY_CHANGE = {
    "docx": r"^word/(document|settings|footnotes|endnotes|header[0-9]*|footer[0-9]*)\.xml$",
    "odt": r"^(content|styles)\.xml$",
}


def diff_blocks(before: DataFrame, after: DataFrame, content: str = "text") -> DataFrame:
    """(doc_id, block_id, change): changed, added or removed. A pure move is no change."""
    b = before.select("doc_id", "block_id", F.struct(F.col(content)).alias("_old"))
    a = after.select("doc_id", "block_id", F.struct(F.col(content)).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed"))
    return b.join(a, ["doc_id", "block_id"], "full").withColumn("change", change).filter(
        F.col("change").isNotNull()).select("doc_id", "block_id", "change")


def moved_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks kept in both states whose predecessor among the kept blocks differs."""
    kept_b = before.join(after.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")
    kept_a = after.join(before.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")
    prev = lambda df, name: scan(df, ["doc_id"], "seq", _p=last_row(inclusive=False, id=F.col("block_id"))).select(
        "doc_id", "block_id", F.col("_p.id").alias(name))
    return prev(kept_b, "_b").join(prev(kept_a, "_a"), ["doc_id", "block_id"]).filter(
        ~F.col("_b").eqNullSafe(F.col("_a"))).select("doc_id", "block_id")


def apply_changes(before: DataFrame, changed: DataFrame, order: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The state after a change message: (doc_id, seq, block_id, text).

    ``order`` (doc_id, seq, block_id) is authoritative: incoming content wins, else what is held, else the block is
    skipped; blocks outside it disappear. ``documents`` lists the doc_ids that have a message, so that an empty order
    empties a document; without it they are those with an order row. All other documents keep their state.
    """
    new = changed.select("doc_id", "block_id", F.col("text").alias("_new"))
    held = before.select("doc_id", "block_id", F.col("text").alias("_held"))
    rebuilt = order.select("doc_id", "seq", "block_id").join(new, ["doc_id", "block_id"], "left").join(
        held, ["doc_id", "block_id"], "left").withColumn("text", F.coalesce("_new", "_held")).filter(
        F.col("text").isNotNull()).select("doc_id", "seq", "block_id", "text")
    untouched = before.join((order if documents is None else documents).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "seq", "block_id", "text")
    return rebuilt.unionByName(untouched)


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, part) whose bytes differ, added and removed parts included."""
    b = before.select("doc_id", "part", F.col("sha256").alias("_b"))
    a = after.select("doc_id", "part", F.col("sha256").alias("_a"))
    return b.join(a, ["doc_id", "part"], "full").filter(~F.col("_b").eqNullSafe(F.col("_a"))).select("doc_id", "part")


def preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed parts their format does not allow to change; both tables have doc_id, format, part, sha256."""
    formats = before.select("doc_id", "format").unionByName(after.select("doc_id", "format")).distinct()
    allowed = F.lit(False)
    for fmt, pattern in MAY_CHANGE.items():
        allowed = allowed | ((F.col("format") == fmt) & F.col("part").rlike(pattern))
    return changed_parts(before, after).join(formats, "doc_id").filter(~allowed).select("doc_id", "format", "part")


def fixed_point(generations: DataFrame) -> DataFrame:
    """(doc_id, part, generation) where a part differs from the generation before, added and removed parts included.

    ``generations`` has doc_id, generation (0, 1, 2, ...), part, sha256. Generation 0 is the input and may differ.
    """
    last = generations.agg(F.max("generation")).first()[0]
    now = generations.select("doc_id", "part", "generation", F.col("sha256").alias("_now"))
    was = generations.filter(F.col("generation") < F.lit(last)).select(
        "doc_id", "part", (F.col("generation") + 1).alias("generation"), F.col("sha256").alias("_was"))
    return now.join(was, ["doc_id", "part", "generation"], "full").filter(
        (F.col("generation") > 1) & ~F.col("_now").eqNullSafe(F.col("_was"))).select("doc_id", "part", "generation")


def complaint_kind(message: Column) -> Column:
    """A validator's complaint without file, line number and positional indices."""
    return F.trim(F.regexp_replace(F.regexp_replace(message, r"^[^:]*:[0-9]+:\s*", ""), r"\[[0-9]+\]", "[]"))


def introduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Complaints of a kind their document did not have before. More of a known kind is not news."""
    known = before.select("doc_id", complaint_kind(F.col("message")).alias("kind")).distinct()
    return after.withColumn("kind", complaint_kind(F.col("message"))).join(known, ["doc_id", "kind"], "left_anti")


def diff_summaries(a: DataFrame, b: DataFrame, tolerance_in: float = 0.01) -> DataFrame:
    """(doc_id, key, prop, before, after) where two summaries differ.

    Two lengths are equal within ``tolerance_in`` inches, a missing value equals a zero length, and text is compared
    with white space collapsed.
    """
    both = a.select("doc_id", "key", "prop", F.col("value").alias("before")).join(
        b.select("doc_id", "key", "prop", F.col("value").alias("after")), ["doc_id", "key", "prop"], "full")
    la, lb = length_to_inches(F.col("before")), length_to_inches(F.col("after"))
    close = F.abs(F.coalesce(la, F.lit(0.0)) - F.coalesce(lb, F.lit(0.0))) <= tolerance_in
    lengths = F.when((la.isNotNull() | F.col("before").isNull()) & (lb.isNotNull() | F.col("after").isNull()), close)
    same = F.coalesce(lengths, collapse_space(F.col("before")).eqNullSafe(collapse_space(F.col("after"))))
    return both.filter(~same)


def classify_known(diffs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, key, status, reason): failure, known (with its reason) or stale (listed as known but not seen)."""
    seen = diffs.select("doc_id", "key").distinct()
    marked = seen.join(known.select("doc_id", "key", "reason", F.lit(True).alias("_k")), ["doc_id", "key"], "left").select(
        "doc_id", "key", F.when(F.col("_k"), "known").otherwise("failure").alias("status"), "reason")
    stale = known.join(seen, ["doc_id", "key"], "left_anti").select("doc_id", "key", F.lit("stale").alias("status"), "reason")
    return marked.unionByName(stale)


def stripped_text(html: Column) -> Column:
    """Text of markup with tags removed and white space collapsed."""
    return collapse_space(F.regexp_replace(html, "<[^>]+>", ""))


def text_equality(before: DataFrame, after: DataFrame, content: str = "html") -> DataFrame:
    """(doc_id, same): whether two versions of a document carry the same text."""
    b = before.select("doc_id", F.sha2(stripped_text(F.col(content)), 256).alias("_b"))
    a = after.select("doc_id", F.sha2(stripped_text(F.col(content)), 256).alias("_a"))
    return b.join(a, "doc_id", "full").select("doc_id", F.col("_b").eqNullSafe(F.col("_a")).alias("same"))
