"""Cross-references, ranges, notes, relationships and translated labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import normalise_target
from ..functions.text import collapse_space

RANGE_BUCKET = 4096


def first_bookmarks(bookmarks: DataFrame, order: str = "pos") -> DataFrame:
    """The first bookmark of each name in a document: the one every reference to that name resolves to."""
    rest = [c for c in bookmarks.columns if c not in ("doc_id", "name")]
    return bookmarks.groupBy("doc_id", "name").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_b")).select("doc_id", "name", "_b.*")


def in_ranges(ranges: DataFrame, rows: DataFrame, bucket: int = RANGE_BUCKET) -> DataFrame:
    """Pairs of ranges [start_pos, end_pos) and the rows whose ``pos`` they cover, inside a document.

    Both sides meet on (doc_id, pos bucket): a range is listed under each bucket it touches and a row under its own, so
    neither a long document nor a long range is compared with everything.
    """
    cut = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    spread = ranges.filter("end_pos > start_pos").withColumn("_k", F.explode(F.sequence(cut(F.col("start_pos")), cut(F.col("end_pos") - 1))))
    return spread.join(rows.withColumn("_k", cut(F.col("pos"))), ["doc_id", "_k"]).filter(
        (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))).drop("_k")


def flatten_text(parts: Column) -> Column:
    """Text of consecutive blocks on one line, a space at each boundary."""
    return collapse_space(F.array_join(parts, " "))


def range_text(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, name, text): the text a bookmark spans; blocks (``seq``) are joined by a space, runs of one are not."""
    hit = in_ranges(ranges, runs.select("doc_id", "pos", "seq", "text"))
    blocks = hit.groupBy("doc_id", "name", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_r")).select(
        "doc_id", "name", "seq", F.array_join(F.transform("_r", lambda r: r["text"]), "").alias("text"))
    return blocks.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_b")).select(
        "doc_id", "name", flatten_text(F.transform("_b", lambda b: b["text"])).alias("text"))


def resolve_xrefs(xrefs: DataFrame, bookmarks: DataFrame, above: str = "above", below: str = "below") -> DataFrame:
    """Add ``resolved``: what each reference (doc_id, pos, target, fmt, cached) shows.

    ``bookmarks`` has doc_id, name, pos, page (0-based) and text (a heading's text or the text it spans, else null). The first
    bookmark of a name wins; without one the cached text stays. fmt ``text`` falls back to the name, ``page`` is the
    plain 1-based number, ``direction`` compares positions.
    """
    first = first_bookmarks(bookmarks).select("doc_id", F.col("name").alias("target"), F.col("pos").alias("_at"),
                                              F.col("page").alias("_page"), F.col("text").alias("_text"), F.lit(True).alias("_hit"))
    shown = (
        F.when(F.col("fmt") == "page", (F.col("_page") + 1).cast("string"))
        .when(F.col("fmt") == "direction", F.when(F.col("_at") > F.col("pos"), below).otherwise(above))
        .otherwise(F.coalesce(F.nullif(F.col("_text"), F.lit("")), F.col("target"))))
    return xrefs.join(first, ["doc_id", "target"], "left").withColumn(
        "resolved", F.when(F.col("_hit"), shown).otherwise(F.col("cached"))).drop("_at", "_page", "_text", "_hit")


def reference_targets(headings: DataFrame, bookmarks: DataFrame, captions: DataFrame) -> DataFrame:
    """Everything a reference can point at, in document order: (doc_id, pos, kind, label)."""
    h = headings.filter(F.col("heading").between(1, 3)).select("doc_id", "pos", F.lit("heading").alias("kind"), F.col("text").alias("label"))
    b = bookmarks.filter(F.col("name") != "").select("doc_id", "pos", F.lit("bookmark").alias("kind"), F.col("name").alias("label"))
    c = captions.filter(F.col("caption_kind").isNotNull()).select("doc_id", "pos", F.col("caption_kind").alias("kind"), F.col("text").alias("label"))
    return h.unionByName(b).unionByName(c)


def dangling_refs(xrefs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """References without a bookmark of that name in their document."""
    return xrefs.join(bookmarks.select("doc_id", F.col("name").alias("target")).distinct(), ["doc_id", "target"], "left_anti")


def attach_notes(note_refs: DataFrame, notes: DataFrame) -> DataFrame:
    """References with their note; references to a missing note are not shown."""
    return note_refs.join(notes, ["doc_id", "note_kind", "note_id"])


def referenced_notes(notes: DataFrame, note_refs: DataFrame) -> DataFrame:
    """Notes still referenced: what a save keeps."""
    return notes.join(note_refs, ["doc_id", "note_kind", "note_id"], "left_semi")


def resolve_rels(rows: DataFrame, rels: DataFrame, base: str = "word/") -> DataFrame:
    """Add ``target`` and ``target_part`` through (doc_id, part, rid); rows keep null where the relationship is missing."""
    return rows.join(rels.select("doc_id", "part", "rid", "target"), ["doc_id", "part", "rid"], "left").withColumn(
        "target_part", normalise_target(F.col("target"), base))


def base_locale(locale: Column, available: list[str]) -> Column:
    """The base language tag when there is a dictionary for it, else English."""
    base = F.lower(F.split(locale, "-").getItem(0))
    return F.when(base.isin(*available), base).otherwise("en")


def translate(rows: DataFrame, dictionary: DataFrame, available: list[str]) -> DataFrame:
    """Add ``label`` for (locale, key, params MAP): the locale's text, else the English one, else the key itself.

    ``{name}`` is replaced by a parameter of that name; unknown parameters stay. The text is split at its
    placeholders, so a value containing braces is never expanded again. ``dictionary`` has locale, key, text.
    """
    own = dictionary.select(F.col("locale").alias("_loc"), "key", F.col("text").alias("_own"))
    english = dictionary.filter("locale = 'en'").select("key", F.col("text").alias("_en"))
    joined = rows.withColumn("_loc", base_locale(F.col("locale"), available)).join(own, ["_loc", "key"], "left").join(english, ["key"], "left")
    text = F.coalesce("_own", "_en", "key")
    pieces = F.split(text, r"\{\w+\}", -1)
    names = F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(F.try_element_at(F.col("params"), n), F.concat(F.lit("{"), n, F.lit("}"))))
    label = F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), filled.alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    return joined.withColumn("label", label).drop("_loc", "_own", "_en")


def supported_features(rows: DataFrame, capabilities: DataFrame, feature_col: str = "feature") -> DataFrame:
    """Keep the rows whose feature the target format can store; ``capabilities`` has format, feature, supported."""
    return rows.join(capabilities.filter("supported").select("format", F.col("feature").alias(feature_col)), ["format", feature_col], "left_semi")
