"""Numbers and positions that depend on document order: lists, notes, captions, headings, lines, block ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import extent, last_row, next_row, running_sum, scan

MAX_LEVEL = 8


def number_within(df: DataFrame, keys: list[str], order: str = "pos", name: str = "number") -> DataFrame:
    """1, 2, 3, ... within ``keys`` by position."""
    return scan(df, keys, order, **{name: running_sum(F.lit(1))})


def number_sequences(fields: DataFrame, order: str = "pos") -> DataFrame:
    """Caption numbers: each named sequence of a document is counted on its own."""
    return number_within(fields, ["doc_id", "seq_name"], order)


def number_notes(note_refs: DataFrame, order: str = "pos") -> DataFrame:
    """Note numbers: footnotes and endnotes are separate series."""
    return number_within(note_refs, ["doc_id", "note_kind"], order)


def all_notes(footnotes: DataFrame, endnotes: DataFrame) -> DataFrame:
    """Footnotes followed by endnotes, the order kept in ``part``."""
    return footnotes.withColumn("part", F.lit(0)).unionByName(endnotes.withColumn("part", F.lit(1)))


def list_groups(blocks: DataFrame, kind: Column, keys: list[str], order: str = "pos") -> DataFrame:
    """Add ``group_no`` (1, 2, ...) to runs of adjacent blocks of one non-null ``kind``; null outside."""
    marked, longest = blocks.withColumn("_kind", kind), extent(blocks, order)
    prev = scan(marked, keys, order, longest=longest, _prev=last_row(inclusive=False, kind=F.col("_kind")))
    opens = F.col("_kind").isNotNull() & ~F.col("_kind").eqNullSafe(F.col("_prev.kind"))
    out = scan(prev.withColumn("_open", opens.cast("long")), keys, order, longest=longest, _n=running_sum(F.col("_open")))
    return out.withColumn("group_no", F.when(F.col("_kind").isNotNull(), F.col("_n"))).drop("_kind", "_prev", "_open", "_n")


def list_items(blocks: DataFrame, keys: list[str], order: str = "pos", longest: int | None = None) -> DataFrame:
    """The list items of ``blocks`` with ``list_at`` (position of the block before the list, -1 when it is the first).

    A list is closed by any block that is not a list item, and by nothing else.
    """
    out = scan(blocks, keys, order, longest=longest, _gap=last_row(~F.col("is_list")))
    return out.filter("is_list").withColumn("list_at", F.coalesce(F.col("_gap.at"), F.lit(-1)).cast("long")).drop("_gap")


def list_nesting(items: DataFrame, keys: list[str], order: str = "pos", longest: int | None = None) -> DataFrame:
    """Add ``parent``: position of the nearest earlier item of the same list with a smaller level, or null."""
    latest = {f"_l{k}": last_row(F.col("level") == k, inclusive=False) for k in range(MAX_LEVEL)}
    out = scan(items, [*keys, "list_at"], order, longest=longest, **latest)
    above = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"),
                       *[F.when(F.col("level") > k, F.col(f"_l{k}.at").cast("long")) for k in range(MAX_LEVEL)])
    return out.withColumn("parent", above).drop(*latest)


def number_lists(
    blocks: DataFrame, starts: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), order: str = "pos",
) -> DataFrame:
    """List items with list_at, parent, list_start and number.

    The first item of a list decides: when it is ordered and has a num_id, the list continues the count of the last
    list that num_id decided in this container, and otherwise begins at the numbering's start (``starts``: keys,
    num_id, start; 1 when absent). Only level-0 items of that num_id advance the count. Nested lists count from 1.
    """
    keys, longest = list(keys), extent(blocks, order)
    items = list_nesting(list_items(blocks, keys, order, longest), keys, order, longest)
    if "ordered" not in items.columns:
        items = items.withColumn("ordered", F.lit(True))
    by_num = items.groupBy(*keys, "list_at", "num_id").agg(
        F.min(F.struct(order, "ordered")).alias("_first"), F.count(F.when(F.col("level") == 0, 1)).alias("_advance"))
    decided = by_num.groupBy(*keys, "list_at").agg(
        F.min(F.struct("_first", "num_id", "_advance")).alias("_d")
    ).select(*keys, "list_at", F.col(f"_d._first.{order}").cast("long").alias("_at"), "_d.num_id", "_d._advance",
             F.col("_d._first.ordered").alias("_ordered"))
    counting = decided.filter(F.col("_ordered") & F.col("num_id").isNotNull())
    if starts is not None:
        counting = counting.join(starts.select(*[k for k in keys if k in starts.columns], "num_id", F.col("start").alias("_start0")),
                                 [*[k for k in keys if k in starts.columns], "num_id"], "left")
    else:
        counting = counting.withColumn("_start0", F.lit(1))
    counted = scan(counting, [*keys, "num_id"], "_at", longest=longest, _before=running_sum(F.col("_advance"), inclusive=False)).select(
        *keys, "list_at", (F.coalesce("_start0", F.lit(1)) + F.col("_before")).cast("long").alias("list_start"))
    # Sibling numbers: position among the items of one list under one parent at one level.
    sibling = scan(items.withColumn("_parent", F.coalesce("parent", F.lit(-1))), [*keys, "list_at", "_parent", "level"], order,
                   longest=longest, _n=running_sum(F.lit(1))).drop("_parent")
    out = sibling.join(counted, [*keys, "list_at"], "left").withColumn("list_start", F.coalesce("list_start", F.lit(1).cast("long")))
    return out.withColumn("number", F.col("_n") + F.when(F.col("level") == 0, F.col("list_start") - 1).otherwise(0)).drop("_n")


def number_lists_continued(lists: DataFrame, order: str = "pos") -> DataFrame:
    """Start numbers of top-level ordered lists with a continue flag: (doc_id, order, n_items, continues, start0) -> start.

    A continued list starts one after the end of the ordered list before it anywhere in the document; any other list
    starts at its own start value. So each run of continued lists adds up from the last list that did not continue.
    """
    longest = extent(lists, order)
    total = scan(lists, ["doc_id"], order, longest=longest, _total=running_sum(F.col("n_items"), inclusive=False))
    out = scan(total, ["doc_id"], order, longest=longest,
               _base=last_row(~F.col("continues"), start0=F.col("start0"), total=F.col("_total")))
    start = F.coalesce(F.col("_base.start0"), F.lit(1)) + F.col("_total") - F.coalesce(F.col("_base.total"), F.lit(0))
    return out.withColumn("start", start.cast("long")).drop("_total", "_base")


def heading_path(blocks: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add h1, h2, h3: the headings (``heading`` 1..3, ``text``) enclosing each block, itself included."""
    at = lambda k: F.col("heading") == k
    out = scan(blocks, list(keys), order, **{f"_h{k}": last_row(at(k), text=F.col("text")) for k in (1, 2, 3)})
    h1, h2, h3 = (F.col(f"_h{k}") for k in (1, 2, 3))
    position = lambda h: F.coalesce(h["at"], F.lit(-1))
    return out.select(
        *blocks.columns, h1["text"].alias("h1"),
        F.when(h2["at"] > position(h1), h2["text"]).alias("h2"),
        F.when(h3["at"] > F.greatest(position(h1), position(h2)), h3["text"]).alias("h3"))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings of level 1 to 3 outside tables of contents, in order."""
    inside = F.coalesce(F.col("in_toc"), F.lit(False)) if "in_toc" in blocks.columns else F.lit(False)
    return blocks.filter(F.col("heading").between(1, 3) & ~inside).select("doc_id", "seq", "heading", "text")


def dedupe_block_ids(blocks: DataFrame) -> DataFrame:
    """The first block holding an id keeps it; later holders and blocks without one get a fresh, repeatable id."""
    first = blocks.filter(F.col("block_id").isNotNull()).groupBy("doc_id", "block_id").agg(F.min("seq").alias("_first"))
    fresh = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("seq").cast("string"),
                               F.coalesce(F.col("block_id"), F.lit(""))), 256)
    return (
        blocks.join(first, ["doc_id", "block_id"], "left")
        .withColumn("block_id", F.when(F.col("seq") == F.col("_first"), F.col("block_id")).otherwise(fresh)).drop("_first")
        .select(*blocks.columns)
    )


def line_numbers(lines: DataFrame, interval: int = 1, start: int = 1, per_page: bool = False, order: str = "seq") -> DataFrame:
    """Lines that show a number (``line_no``): every line counts, those divisible by ``interval`` show.

    ``lines`` has doc_id, order, counted (false for page breaks and spacers) and, for ``per_page``, page.
    """
    keys = ["doc_id", "page"] if per_page else ["doc_id"]
    counted = scan(lines.filter("counted"), keys, order, _n=running_sum(F.lit(1)))
    number = F.col("_n") + F.lit(start - 1)
    return counted.withColumn("line_no", number.cast("long")).filter(F.col("line_no") % interval == 0).drop("_n")


def attach_captions(blocks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Add ``caption_at``: position of the caption right after a table or figure block, when it is of the same kind."""
    out = scan(blocks, keys, order, _next=next_row(inclusive=False, kind=F.col("caption_kind")))
    same = F.col("kind").isin("table", "figure", "equation") & (F.col("_next.kind") == F.col("kind"))
    return out.withColumn("caption_at", F.when(same, F.col("_next.at")).cast("long")).drop("_next")


def section_of_block(blocks: DataFrame, geometry: list[str], document: dict[str, int], trailing: bool = True, order: str = "pos",
                     inherited: tuple[str, ...] = ("w", "h", "mt", "mr", "mb", "ml", "line_numbers", "line_interval", "line_restart", "line_start")) -> DataFrame:
    """Add the geometry in force at each block.

    Trailing: the first boundary at or after the block; leading: the last boundary at or before it. Size, margins and
    line numbering missing there fall back to the document, other fields do not. Without a boundary the document applies whole.
    """
    fields = {g: F.col(f"b_{g}") for g in geometry}
    found = (next_row if trailing else last_row)(F.col("boundary"), **fields)
    out = scan(blocks, ["doc_id"], order, _b=found)
    resolved = []
    for g in geometry:
        own = F.col(f"_b.{g}")
        fallback = F.lit(document.get(g))
        value = F.when(F.col("_b").isNull(), fallback).otherwise(F.coalesce(own, fallback) if g in inherited else own)
        resolved.append(value.alias(g))
    return out.select(*blocks.columns, *resolved)


def band_for_page(pages: DataFrame) -> DataFrame:
    """Add ``band``: first on page 0 of a title-page document, even on odd indices when even/odd differ, else default.

    A variant that does not exist (``has_first``, ``has_even``) gives way to the default.
    """
    return pages.withColumn(
        "band",
        F.when(F.col("title_page") & (F.col("page") == 0) & F.col("has_first"), "first")
        .when(F.col("title_page") & (F.col("page") == 0), "default")
        .when(F.col("even_odd") & (F.col("page") % 2 == 1) & F.col("has_even"), "even").otherwise("default"))


def running_band(stories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, html): the header or footer story with the most letters over the sections; the first wins a tie."""
    letters = F.length(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"[^\p{L}]", ""))
    best = F.max_by(F.struct("section", "html"), F.struct(letters, -F.col("section")))
    return stories.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.section", "_b.html")
