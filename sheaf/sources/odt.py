"""Document tables of OpenDocument text packages, derived from XML nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.fields import caption_kind_odt
from ..functions.text import round_half_up
from ..operators.references import in_ranges
from ..operators.scan import next_row, running_sum, scan
from ..operators.styles import ancestors, prefer
from .nodes import at, attr, id_up, inside, joined_text, part_nodes, pick, present, up

# Part names and element roles.
CONTENT = "content"
STYLE_PARTS = ("content", "odt_styles")
HOLDERS = ["office:text", "table:table-cell", "text:note-body", "style:header", "style:footer", "style:header-left", "style:footer-left",
           "style:header-first", "style:footer-first"]
HIDDEN = ["office:annotation", "draw:frame", "text:note", "text:tracked-changes", "text:ruby-text", "text:bookmark-ref"]
TEXT_TAGS = ["#text", "text:s", "text:tab", "text:line-break"]
FIELD_KINDS = {
    "text:page-number": "PAGE", "text:page-count": "NUMPAGES", "text:date": "DATE", "text:time": "TIME",
    "text:author-name": "AUTHOR", "text:file-name": "FILENAME", "text:sequence": "seq", "text:bookmark-ref": "xref",
}
MODELLED_INLINE = [
    "text:span", "text:a", "draw:frame", "office:annotation", "office:annotation-end", "text:change-start", "text:change-end", "text:change",
    "text:line-break", "text:tab", "text:s", "text:note", "text:ruby", "text:bookmark", "text:bookmark-start", "text:bookmark-end", *FIELD_KINDS,
]
MODELLED_BLOCKS = ["text:h", "text:p", "text:list", "table:table", "text:tracked-changes"]
MODELLED_TEXT_PROPERTIES = [
    "fo:font-weight", "style:font-weight-asian", "style:font-weight-complex", "fo:font-style", "style:font-style-asian",
    "style:font-style-complex", "style:text-underline-style", "style:text-underline-width", "style:text-underline-color",
    "style:text-line-through-style", "style:text-line-through-type", "style:text-position", "fo:color", "fo:background-color",
    "fo:font-family", "style:font-name", "fo:font-size", "style:font-size-asian", "style:font-size-complex",
]
MODELLED_PARAGRAPH_PROPERTIES = [
    "fo:text-align", "fo:margin-left", "fo:line-height", "fo:margin-top", "fo:margin-bottom", "fo:background-color", "fo:border",
    "fo:border-top", "fo:border-right", "fo:border-bottom", "fo:border-left", "fo:break-before", "fo:break-after",
]
KEY = ["doc_id", "part"]


def _text_of() -> Column:
    """What a node contributes to the visible text: text, repeated spaces, a tab or a line break."""
    return (F.when(F.col("tag") == "#text", F.col("text"))
            .when(F.col("tag") == "text:s", F.repeat(F.lit(" "), F.greatest(F.lit(1), F.coalesce(attr("text:c").try_cast("int"), F.lit(1)))))
            .when(F.col("tag") == "text:tab", "\t").when(F.col("tag") == "text:line-break", "\n"))


def _is_text(holder: Column) -> Column:
    """A text node of the block ``holder`` itself, not of a comment, note, ruby reading or another block inside it."""
    depth = F.array_position("ids", holder).cast("int")
    below = F.slice("trail", depth + 1, F.greatest(F.size("trail") - depth, F.lit(0)))
    shown = ~F.arrays_overlap(below, F.array(*[F.lit(t) for t in [*HIDDEN, *FIELD_KINDS]]))
    return F.coalesce(F.col("tag").isin(*TEXT_TAGS) & (depth > 0) & shown, F.lit(False))


def style_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, style_id, family, based_on, master, automatic, class): every named or automatic style."""
    n = part_nodes(nodes, *STYLE_PARTS).filter("tag = 'style:style'")
    return n.select(*KEY, F.col("node_id").alias("pos"), attr("style:name").alias("style_id"), attr("style:family").alias("family"),
                    attr("style:parent-style-name").alias("based_on"), attr("style:master-page-name").alias("master"),
                    (up(1) == "office:automatic-styles").alias("automatic"), attr("style:class").alias("class"),
                    F.replace(F.coalesce(attr("style:display-name"), attr("style:name")), F.lit("_20_"), F.lit(" ")).alias("name")).filter("style_id <> ''")


def _properties(nodes: DataFrame, family: str, element: str) -> DataFrame:
    """(doc_id, style_id, attrs, part): the properties element of each style of a family; content wins over styles."""
    props = part_nodes(nodes, *STYLE_PARTS).filter(at("style:style", element)).select(*KEY, id_up(1).alias("pos"), F.col("attrs").alias("props"))
    mine = style_rows(nodes).filter(F.col("family") == family).join(props, [*KEY, "pos"], "left").select("doc_id", "style_id", "props", "part")
    return prefer(mine.filter("part = 'content.xml'"), mine.filter("part <> 'content.xml'"), ["doc_id", "style_id"])


def text_formats(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, b, i, u, strike, vert_align, color, bg, font, size_pt) of text styles."""
    a = lambda name: F.try_element_at("props", F.lit(f"{name}"))
    line = lambda name: a(name).isNotNull() & (a(name) != "none")
    hexed = lambda c: F.upper(F.nullif(F.regexp_extract(F.trim(c), "^#?([0-9a-fA-F]{6})$", 1), F.lit("")))
    place = F.split(F.trim(a("style:text-position")), r"\s+").getItem(0)
    percent = F.regexp_extract(place, r"^(-?[0-9.]+)", 1).try_cast("double")
    size = F.regexp_extract(F.trim(a("fo:font-size")), r"^([0-9.]+)pt$", 1).try_cast("double")
    return _properties(nodes, "text", "style:text-properties").select(
        "doc_id", "style_id", F.coalesce(a("fo:font-weight") == "bold", F.lit(False)).alias("b"), F.coalesce(a("fo:font-style") == "italic", F.lit(False)).alias("i"),
        F.coalesce(line("style:text-underline-style"), F.lit(False)).alias("u"), F.coalesce(line("style:text-line-through-style"), F.lit(False)).alias("strike"),
        F.when(place.isin("super", "sub"), place).when(percent > 0, "super").when(percent < 0, "sub").alias("vert_align"),
        hexed(a("fo:color")).alias("color"), hexed(a("fo:background-color")).alias("bg"),
        F.coalesce(F.nullif(F.regexp_replace(a("fo:font-family"), "^['\"]|['\"]$", ""), F.lit("")), a("style:font-name")).alias("font"),
        (round_half_up(size * 10) / 10).alias("size_pt"))


def paragraph_formats(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, align, indent_px, line_height, before_px, after_px, shading, borders, break_before, break_after)."""
    a = lambda name: F.try_element_at("props", F.lit(name))
    px = lambda c: round_half_up(units.length_to_px(c))
    space = lambda name: F.when(a(name).isNotNull(), F.coalesce(px(a(name)), F.lit(0).cast("long")))
    lines = F.regexp_extract(a("fo:line-height"), r"^([0-9.]+)%$", 1).try_cast("double")
    side = lambda s: F.coalesce(units.odt_border(a(f"fo:border-{s}")), units.odt_border(a("fo:border")))
    return _properties(nodes, "paragraph", "style:paragraph-properties").select(
        "doc_id", "style_id", units.lookup(units.ODT_ALIGN, a("fo:text-align")).alias("align"), F.when(px(a("fo:margin-left")) > 0, px(a("fo:margin-left"))).alias("indent_px"),
        (round_half_up(lines) / 100).alias("line_height"), space("fo:margin-top").alias("before_px"), space("fo:margin-bottom").alias("after_px"),
        F.when(a("fo:background-color").rlike("^#[0-9a-fA-F]{6}$"), F.lower(a("fo:background-color"))).alias("shading"),
        *[side(s).alias(f"border_{s}") for s in ("top", "right", "bottom", "left")], a("fo:break-before").alias("break_before"), a("fo:break-after").alias("break_after"))


def blocks(nodes: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items, tables and passed-through blocks, in order within their container.

    A page break comes from the block's own style or its parent style, a new master page starts a section (``boundary``
    with ``master``). Heading levels are held to 1..3.
    """
    n = part_nodes(nodes, CONTENT)
    # A list item is one block: the nearest item wins over the paragraphs inside it.
    item, other = inside("text:list-item"), inside("text:note-body", "table:table-cell")
    owner = F.when(item > F.coalesce(other, F.lit(-1)), item).otherwise(inside("text:p", "text:h"))
    # Other nodes neither are blocks nor say anything about theirs.
    mine = n.filter(F.col("tag").isin("text:p", "text:h", "text:list-item", "text:sequence", *TEXT_TAGS) & ~F.array_contains("trail", "text:tracked-changes")).withColumn("b", owner)
    level = F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(attr("text:outline-level").try_cast("int"), F.lit(1))))
    depth = F.size(F.filter("trail", lambda t: t == "text:list"))
    # Worked out before the rows are grouped, which sorts them: what goes there is narrow.
    said = mine.select(
        *KEY, "node_id", F.col("b").alias("pos"), F.when(F.col("node_id") == F.col("b"), F.struct(
            F.when(F.col("tag") == "text:h", "h").when(F.col("tag") == "text:list-item", "li").otherwise("p").alias("kind"),
            F.when(F.col("tag") == "text:h", level).when(F.col("tag") == "text:list-item", depth - 1).alias("level"),
            F.coalesce(attr("text:style-name"), F.lit("")).alias("style"), up(1).alias("container"), id_up(1).alias("container_id"), inside("text:list").alias("list_pos"))).alias("_head"),
        F.when(_is_text(F.col("b")), _text_of()).alias("_text"), F.when(F.col("tag") == "text:sequence", F.coalesce(attr("text:name"), F.lit("Figure"))).alias("_name"))
    # Nodes outside of blocks form a group without a head.
    grouped = said.groupBy(*KEY, "pos").agg(
        pick(F.col("_head").isNotNull(), F.col("_head")).alias("_h"), joined_text(F.col("_text").isNotNull(), F.col("_text")).alias("text"),
        pick(F.col("_name").isNotNull(), F.col("_name")).alias("_seq"))
    kept = grouped.filter(F.col("_h.container").isin(*HOLDERS, "text:list")).select(
        *KEY, "pos", "_h.kind", "_h.level", F.col("_h.style").alias("style_id"), "_h.container", "_h.container_id",
        F.when(F.col("_h.kind") == "li", F.col("_h.list_pos")).alias("list_pos"), F.when(F.col("_h.kind") == "p", caption_kind_odt(F.col("_seq"))).alias("caption_kind"), "text")
    others = n.filter(up(1).isin(*HOLDERS) & ~F.col("tag").isin("text:h", "text:p", "text:list", "text:tracked-changes", "#text")).select(
        *KEY, F.col("node_id").alias("pos"), F.when(F.col("tag") == "table:table", "table").otherwise("pass").alias("kind"), up(1).alias("container"), id_up(1).alias("container_id"))
    every = kept.unionByName(others, allowMissingColumns=True)
    formats = paragraph_formats(nodes).select("doc_id", "style_id", "break_before", "break_after")
    own = style_rows(nodes).filter("family = 'paragraph'")
    one = prefer(own.filter("part = 'content.xml'"), own.filter("part <> 'content.xml'"), ["doc_id", "style_id"]).join(formats, ["doc_id", "style_id"], "left").select(
        "doc_id", "style_id", "based_on", "master", "break_before", "break_after", "automatic")
    # Only an automatic style of the content defers to its parent.
    parent = one.select("doc_id", F.col("style_id").alias("based_on"), F.col("master").alias("_pm"), F.col("break_before").alias("_pb"), F.col("break_after").alias("_pa"))
    resolved = one.withColumn("based_on", F.when(F.col("automatic"), F.col("based_on"))).join(parent, ["doc_id", "based_on"], "left").select(
        "doc_id", "style_id", "master", F.coalesce((F.col("break_before") == "page") | F.col("master").isNotNull(), F.col("break_before") == "page", F.lit(False)).alias("_own"),
        F.coalesce(F.col("_pb") == "page", F.lit(False)).alias("_pb"), F.col("_pm").isNotNull().alias("_pm"),
        (F.coalesce(F.col("break_after") == "page", F.lit(False)) | F.coalesce(F.col("_pa") == "page", F.lit(False))).alias("_after"))
    breakable = F.col("kind").isin("h", "p")
    out = every.join(resolved, ["doc_id", "style_id"], "left").select(
        *KEY, "pos", "container", "container_id", "kind", "level", F.nullif("style_id", F.lit("")).alias("style_id"), "list_pos", "caption_kind", "text",
        (breakable & F.coalesce(F.col("_own") | F.col("_pb") | F.col("_pm"), F.lit(False))).alias("break_before"),
        (breakable & F.coalesce(F.col("_after"), F.lit(False))).alias("break_after"), F.when(breakable, F.col("master")).alias("master"))
    return scan(out, ["doc_id", "part"], "pos", longest=0, seq=running_sum(F.lit(1), inclusive=False))


def runs(nodes: DataFrame) -> DataFrame:
    """Text runs with the formats of all spans around them; for colours, fonts and sizes the innermost span decides.

    Also the link address and the insertion they stand in (``change_id``), which may span paragraphs.
    """
    n = part_nodes(nodes, CONTENT).filter(~F.array_contains("trail", "text:tracked-changes"))
    edges = n.filter(F.col("tag").isin("text:change-start", "text:change-end")).groupBy("doc_id", attr("text:change-id").alias("change_id")).agg(
        F.min(F.when(F.col("tag") == "text:change-start", F.col("node_id"))).alias("start_pos"), F.max(F.when(F.col("tag") == "text:change-end", F.col("node_id"))).alias("end_pos"))
    text = n.filter(F.col("tag").isin(*TEXT_TAGS)).withColumn("b", inside("text:p", "text:h")).filter(_is_text(F.col("b"))).select(
        *KEY, F.col("b").alias("block_pos"), F.col("node_id").alias("pos"), _text_of().alias("text"), inside("text:a").alias("_a"),
        F.transform(F.filter(F.arrays_zip("trail", "ids"), lambda z: z["trail"] == "text:span"), lambda z: z["ids"]).alias("_spans"))
    spans = n.filter("tag = 'text:span'").select(*KEY, F.col("node_id").alias("_span"), attr("text:style-name").alias("style_id")).join(text_formats(nodes), ["doc_id", "style_id"], "left")
    inner = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_span")))
    styled = text.select(*KEY, "pos", F.explode("_spans").alias("_span")).join(spans, [*KEY, "_span"]).groupBy(*KEY, "pos").agg(
        *[F.bool_or(c).alias(c) for c in ("b", "i", "u", "strike")], *[inner(c).alias(c) for c in ("vert_align", "color", "bg", "font", "size_pt")])
    links = n.filter("tag = 'text:a'").select(*KEY, F.col("node_id").alias("_a"), attr("xlink:href").alias("href"))
    inserted = in_ranges(edges, text.select("doc_id", "pos")).groupBy("doc_id", "pos").agg(F.max("change_id").alias("change_id"))
    off = F.lit(False)
    return text.join(styled, [*KEY, "pos"], "left").join(links, [*KEY, "_a"], "left").join(inserted, ["doc_id", "pos"], "left").select(
        *KEY, "block_pos", "pos", "text", *[F.coalesce(c, off).alias(c) for c in ("b", "i", "u", "strike")], "vert_align", "color", "bg", "font", "size_pt", "href", "change_id")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, table_no, row_no, cell_no, colspan, rowspan, is_header, style_id, text); covered cells are skipped.

    Rows inside a header-rows group belong to the table as well and are marked.
    """
    n = part_nodes(nodes, CONTENT).withColumn("c", inside("table:table-cell"))
    head = F.col("node_id") == F.col("c")
    grouped = n.filter(F.col("c").isNotNull()).groupBy(*KEY, "c").agg(
        pick(head, F.struct(inside("table:table").alias("t"), inside("table:table-row").alias("r"), (up(2) == "table:table-header-rows").alias("h"), attr("table:style-name").alias("s"),
                            F.coalesce(attr("table:number-columns-spanned").try_cast("int"), F.lit(1)).alias("cs"), F.coalesce(attr("table:number-rows-spanned").try_cast("int"), F.lit(1)).alias("rs"))).alias("_h"),
        joined_text(_is_text(F.col("c")), _text_of()).alias("text")).select(
        *KEY, "c", F.col("_h.t").alias("table_no"), F.col("_h.r").alias("_r"), F.col("_h.h").alias("is_header"), F.col("_h.s").alias("style_id"), F.col("_h.cs").alias("colspan"), F.col("_h.rs").alias("rowspan"), "text")
    rows = n.filter("tag = 'table:table-row'").select(*KEY, inside("table:table").alias("table_no"), F.col("node_id").alias("_r"))
    numbered = scan(rows, [*KEY, "table_no"], "_r", longest=0, row_no=running_sum(F.lit(1), inclusive=False))
    placed = scan(grouped.join(numbered, [*KEY, "table_no", "_r"]), [*KEY, "_r"], "c", longest=0, cell_no=running_sum(F.lit(1), inclusive=False))
    return placed.drop("_r", "c")


def cell_borders(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, side, px, style, hex): borders of cell styles, each side from the nearest style defining it."""
    own = _properties(nodes, "table-cell", "style:table-cell-properties")
    parents = style_rows(nodes).filter("family = 'table-cell'").select("doc_id", "style_id", "based_on")
    a = lambda name: F.try_element_at("props", F.lit(name))
    sides = own.select("doc_id", F.col("style_id").alias("ancestor"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), units.odt_border(F.coalesce(a(f"fo:border-{s}"), a("fo:border"))).alias("line")) for s in ("top", "right", "bottom", "left")])).alias("_s")
    ).select("doc_id", "ancestor", "_s.side", "_s.line").filter(F.col("line").isNotNull())
    return ancestors(parents, ("doc_id",)).join(sides, ["doc_id", "ancestor"]).groupBy("doc_id", "style_id", "side").agg(
        F.min_by("line", "distance").alias("_l")).select("doc_id", "style_id", "side", "_l.px", "_l.style", "_l.hex")


def comments(nodes: DataFrame) -> DataFrame:
    """(doc_id, comment_id, author, date, text, done, pos, end_pos): annotations; each is a thread of its own."""
    n = part_nodes(nodes, CONTENT).withColumn("a", inside("office:annotation"))
    head = F.col("node_id") == F.col("a")
    under = lambda tag: (F.col("tag") == "#text") & F.array_contains("trail", tag)
    paras = n.filter(F.col("a").isNotNull() & F.array_contains("trail", "text:p")).withColumn("_p", inside("text:p")).filter(F.col("_p") > F.col("a")).groupBy("doc_id", "a", "_p").agg(
        joined_text(F.col("tag") == "#text", F.col("text")).alias("t")).groupBy("doc_id", "a").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "t"))), lambda x: x["t"]), "\n").alias("text"))
    heads = n.filter(F.col("a").isNotNull()).groupBy("doc_id", "a").agg(
        pick(head, F.struct(attr("office:name").alias("name"), F.coalesce((attr("loext:resolved") == "true") | (attr("officeooo:resolved") == "true"), attr("loext:resolved") == "true", attr("officeooo:resolved") == "true", F.lit(False)).alias("done"))).alias("_h"),
        joined_text(under("dc:creator"), F.col("text")).alias("author"), joined_text(under("dc:date"), F.col("text")).alias("date"))
    ends = n.filter("tag = 'office:annotation-end'").groupBy("doc_id", attr("office:name").alias("comment_id")).agg(F.min("node_id").alias("end_pos"))
    return heads.join(paras, ["doc_id", "a"], "left").select(
        "doc_id", F.coalesce("_h.name", F.concat(F.lit("c"), "a")).alias("comment_id"), "author", "date", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "_h.done", F.col("a").alias("pos")
    ).join(ends, ["doc_id", "comment_id"], "left")


def fields(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, block_pos, pos, kind, target, shows, seq_name, cached): field elements."""
    n = part_nodes(nodes, CONTENT).withColumn("f", inside(*FIELD_KINDS))
    head = F.col("node_id") == F.col("f")
    fmt = attr("text:reference-format")
    return n.filter(F.col("f").isNotNull()).groupBy(*KEY, F.col("f").alias("pos")).agg(
        F.min(inside("text:p", "text:h")).alias("block_pos"), pick(head, F.struct(
            units.lookup(FIELD_KINDS, F.col("tag")).alias("kind"), attr("text:ref-name").alias("target"),
            F.when(F.col("tag") == "text:bookmark-ref", F.when(fmt.isin("page", "direction"), fmt).otherwise("text")).alias("shows"),
            F.when(F.col("tag") == "text:sequence", F.coalesce(attr("text:name"), F.lit("Figure"))).alias("seq_name"))).alias("_h"),
        joined_text(F.col("tag") == "#text", F.col("text")).alias("cached")).select(*KEY, "block_pos", "pos", "_h.*", "cached")


def bookmarks(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, name, start_pos, end_pos): ranges pair by name; a point bookmark is an empty range."""
    n = part_nodes(nodes, CONTENT).filter(attr("text:name") != "")
    edges = n.filter(F.col("tag").isin("text:bookmark-start", "text:bookmark-end", "text:bookmark")).select(
        *KEY, attr("text:name").alias("name"), "tag", F.col("node_id").alias("start_pos"))
    paired = scan(edges, [*KEY, "name"], "start_pos", longest=0, _end=next_row(F.col("tag") == "text:bookmark-end", inclusive=False))
    end = F.when(F.col("tag") == "text:bookmark", F.col("start_pos")).otherwise(F.col("_end.at"))
    return paired.filter("tag <> 'text:bookmark-end'").select(*KEY, "name", "start_pos", end.alias("end_pos"))


def notes(nodes: DataFrame) -> DataFrame:
    """(doc_id, note_id, note_kind, pos, block_pos, text): notes stand where they are referenced."""
    n = part_nodes(nodes, CONTENT).withColumn("f", inside("text:note"))
    head = F.col("node_id") == F.col("f")
    return n.filter(F.col("f").isNotNull()).groupBy("doc_id", F.col("f").alias("pos")).agg(
        pick(head, F.struct(attr("text:id").alias("note_id"), F.when(attr("text:note-class") == "endnote", "endnote").otherwise("footnote").alias("note_kind"), inside("text:p", "text:h").alias("block_pos"))).alias("_h"),
        joined_text((F.col("tag") == "#text") & F.array_contains("trail", "text:note-body"), F.col("text")).alias("text")).select("doc_id", "_h.note_id", "_h.note_kind", "pos", "_h.block_pos", "text")


def revisions(nodes: DataFrame) -> DataFrame:
    """(doc_id, change_id, kind, author, date, deleted, pos): changed regions with where the text refers to them."""
    n = part_nodes(nodes, CONTENT).withColumn("g", inside("text:changed-region"))
    head = F.col("node_id") == F.col("g")
    under = lambda tag: (F.col("tag") == "#text") & F.array_contains("trail", tag)
    lines = n.filter(F.col("g").isNotNull() & F.array_contains("trail", "text:deletion")).withColumn("_p", inside("text:p")).filter(F.col("_p").isNotNull()).groupBy("doc_id", "g", "_p").agg(
        joined_text(F.col("tag") == "#text", F.col("text")).alias("t")).groupBy("doc_id", "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "t"))), lambda x: x["t"]), "\n").alias("deleted"))
    regions = n.filter(F.col("g").isNotNull()).groupBy("doc_id", "g").agg(
        pick(head, F.coalesce(attr("text:id"), attr("xml:id"))).alias("change_id"),
        F.when(present(F.col("tag") == "text:insertion"), "insertion").when(present(F.col("tag") == "text:deletion"), "deletion").alias("kind"),
        joined_text(under("dc:creator"), F.col("text")).alias("author"), joined_text(under("dc:date"), F.col("text")).alias("date"))
    marks = n.filter(F.col("tag").isin("text:change-start", "text:change")).select("doc_id", attr("text:change-id").alias("change_id"), F.col("node_id").alias("pos"))
    return regions.join(lines, ["doc_id", "g"], "left").filter(F.col("kind").isNotNull()).join(marks, ["doc_id", "change_id"]).select(
        "doc_id", "change_id", "kind", "author", "date", "deleted", "pos")


def master_pages(nodes: DataFrame) -> DataFrame:
    """(doc_id, master, is_default, w, h, margins, cols, col_gap, vertical, rtl): page geometry of each master page."""
    n = part_nodes(nodes, "odt_styles")
    px = lambda c: round_half_up(units.length_to_px(c))
    layout = n.withColumn("l", inside("style:page-layout")).filter(F.col("l").isNotNull()).groupBy("doc_id", "l").agg(
        pick(F.col("node_id") == F.col("l"), attr("style:name")).alias("layout"),
        *[px(pick(F.col("tag") == "style:page-layout-properties", attr(f"fo:page-{a}"))).alias(a[0]) for a in ("width", "height")],
        *[F.greatest(F.lit(0).cast("long"), F.coalesce(px(pick(F.col("tag") == "style:page-layout-properties", attr(f"fo:margin-{s}"))), F.lit(96).cast("long"))).alias(f"m_{s}") for s in ("top", "right", "bottom", "left")],
        pick(F.col("tag") == "style:columns", attr("fo:column-count")).try_cast("int").alias("_cols"), px(pick(F.col("tag") == "style:column-sep", attr("style:width"))).alias("_gap"),
        F.coalesce(pick(F.col("tag") == "style:page-layout-properties", attr("style:writing-mode")), F.lit("")).alias("_mode"))
    masters = n.filter("tag = 'style:master-page'").select("doc_id", F.col("node_id").alias("_at"), attr("style:name").alias("master"), attr("style:page-layout-name").alias("layout"))
    first = masters.groupBy("doc_id").agg(F.min("_at").alias("_first"))
    return masters.join(first, "doc_id").join(layout, ["doc_id", "layout"]).filter((F.col("w") > 0) & (F.col("h") > 0)).select(
        "doc_id", "master", (F.col("_at") == F.col("_first")).alias("is_default"), "w", "h", "m_top", "m_right", "m_bottom", "m_left",
        F.when(F.col("_cols") > 1, F.col("_cols")).alias("cols"), F.when(F.col("_cols") > 1, F.coalesce("_gap", F.lit(36).cast("long"))).alias("col_gap"),
        F.col("_mode").startswith("tb").alias("vertical"), F.col("_mode").startswith("rl").alias("rtl"))


def bands(nodes: DataFrame) -> DataFrame:
    """(doc_id, master, role, variant, text): headers and footers of each master page; left is the even variant."""
    n = part_nodes(nodes, "odt_styles").withColumn("m", inside("style:master-page")).filter(F.col("m").isNotNull())
    band = F.element_at("trail", F.array_position("trail", "style:master-page").cast("int") + 1)
    in_band = n.withColumn("_band", F.when(F.size("trail") > F.array_position("trail", "style:master-page"), band)).filter(F.col("_band").rlike("^style:(header|footer)"))
    names = n.filter("tag = 'style:master-page'").select("doc_id", "m", attr("style:name").alias("master"))
    texts = in_band.groupBy("doc_id", "m", "_band").agg(joined_text(F.col("tag") == "#text", F.col("text")).alias("text"))
    variant = F.when(F.col("_band").endswith("-left"), "even").when(F.col("_band").endswith("-first"), "first").otherwise("default")
    return texts.join(names, ["doc_id", "m"]).select("doc_id", "master", F.regexp_extract("_band", "(header|footer)", 1).alias("role"), variant.alias("variant"), "text")


def images(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Frames holding a picture: media, size, alternative text and layout; wrap is null for inline frames."""
    n = part_nodes(nodes, CONTENT).withColumn("d", inside("draw:frame"))
    head = F.col("node_id") == F.col("d")
    px = lambda c: round_half_up(units.length_to_px(c))
    text_in = lambda tag: joined_text((F.col("tag") == "#text") & (up(1) == tag), F.col("text"))
    grouped = n.filter(F.col("d").isNotNull()).groupBy(*KEY, F.col("d").alias("pos")).agg(
        pick(head, F.struct(attr("draw:style-name").alias("style_id"), attr("text:anchor-type").alias("anchor"), px(attr("svg:width")).alias("width"), px(attr("svg:height")).alias("height"),
                            F.coalesce(units.length_to_px(attr("svg:x")), F.lit(0.0)).alias("x"), F.coalesce(units.length_to_px(attr("svg:y")), F.lit(0.0)).alias("y"))).alias("_h"),
        F.regexp_replace(pick(F.col("tag") == "draw:image", attr("xlink:href")), r"^\./", "").alias("media"), text_in("svg:desc").alias("_desc"), text_in("svg:title").alias("_title")).filter("media <> ''")
    g = lambda name: F.try_element_at("props", F.lit(name))
    margins = {s: g(f"fo:margin-{n_}") for s, n_ in zip("trbl", ("top", "right", "bottom", "left"))}
    graphic = _properties(nodes, "graphic", "style:graphic-properties").select(
        "doc_id", "style_id", g("style:wrap").alias("_wrap"), g("style:run-through").alias("_through"), F.coalesce(g("style:horizontal-pos"), F.lit("")).alias("_hpos"),
        F.coalesce(g("style:vertical-pos"), F.lit("")).alias("_vpos"),
        F.when(F.coalesce(*margins.values()).isNotNull(), F.struct(*[F.coalesce(px(m), F.lit(0).cast("long")).alias(s) for s, m in margins.items()])).alias("dist"))
    floats = F.coalesce(F.col("anchor") != "as-char", F.lit(False))
    wrap = F.when(floats, F.when(F.col("_wrap") == "none", "topbottom").when(F.col("_wrap") == "run-through", F.when(F.col("_through") == "background", "behind").otherwise("front"))
                  .when(F.col("_wrap") == "dynamic", "tight").otherwise("square"))
    wrapped = F.coalesce(~F.col("wrap").isin("behind", "front"), F.lit(False))
    media = parts.select("doc_id", F.col("part").alias("media"), "sha256")
    return grouped.select(*KEY, "pos", "_h.*", "media", F.coalesce(F.nullif("_desc", F.lit("")), "_title").alias("alt")).join(graphic, ["doc_id", "style_id"], "left").join(
        media, ["doc_id", "media"]).withColumn("wrap", wrap).select(
        *KEY, "pos", "media", "sha256", "width", "height", "alt", "wrap", F.when(floats, F.when(F.col("_hpos").isin("right", "center"), F.col("_hpos")).otherwise("left")).alias("align"),
        "x", "y", F.when(floats, F.col("dist")).alias("dist"), (wrapped & F.col("_hpos").startswith("from-")).alias("abs_x"), (wrapped & F.col("_vpos").startswith("from-")).alias("abs_y"),
        F.coalesce(units.lookup(units.IMAGE_TYPES, F.lower(F.regexp_extract("media", r"\.([^./]+)$", 1))), F.lit("image/png")).alias("mime"))


def links(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, href, text)."""
    n = part_nodes(nodes, CONTENT).withColumn("l", inside("text:a"))
    return n.filter(F.col("l").isNotNull()).groupBy(*KEY, F.col("l").alias("pos")).agg(
        pick(F.col("node_id") == F.col("l"), F.coalesce(attr("xlink:href"), F.lit(""))).alias("href"), joined_text(_is_text(F.col("l")), _text_of()).alias("text"))


def ruby(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, base, reading)."""
    n = part_nodes(nodes, CONTENT).withColumn("u", inside("text:ruby"))
    text = lambda tag: joined_text((F.col("tag") == "#text") & F.array_contains("trail", tag), F.col("text"))
    return n.filter(F.col("u").isNotNull()).groupBy(*KEY, F.col("u").alias("pos")).agg(text("text:ruby-base").alias("base"), text("text:ruby-text").alias("reading"))


def list_levels(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_style, level, ordered, start): levels of list styles, 1-based; only level 1 has a start above 1."""
    n = part_nodes(nodes, *STYLE_PARTS).filter((up(1) == "text:list-style") & (F.col("tag") != "#text"))
    style = part_nodes(nodes, *STYLE_PARTS).filter("tag = 'text:list-style'").select(*KEY, F.col("node_id").alias("_s"), attr("style:name").alias("list_style"))
    ordered = F.col("tag") == "text:list-level-style-number"
    level = F.coalesce(attr("text:level").try_cast("int"), F.col("ord") + 1)
    start = F.when(ordered & (level == 1) & (attr("text:start-value").try_cast("long") > 1), attr("text:start-value").try_cast("long")).otherwise(1)
    rows = n.select(*KEY, id_up(1).alias("_s"), level.alias("level"), ordered.alias("ordered"), start.alias("start")).join(style, [*KEY, "_s"]).select("doc_id", "part", "list_style", "level", "ordered", "start")
    return prefer(rows.filter("part = 'content.xml'"), rows.filter("part <> 'content.xml'"), ["doc_id", "list_style"]).drop("part")


def lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, list_style, level, n_items, continues): every list; nested ones inherit the style of the outer."""
    n = part_nodes(nodes, CONTENT)
    items = n.filter(at("text:list", "text:list-item")).groupBy("doc_id", id_up(1).alias("pos")).agg(F.count("*").alias("n_items"))
    chain = n.filter("tag = 'text:list'").select(
        "doc_id", F.col("node_id").alias("pos"), F.size(F.filter("trail", lambda t: t == "text:list")).alias("level"), attr("text:style-name").alias("_own"),
        F.coalesce((attr("text:continue-numbering") == "true") | attr("text:continue-list").isNotNull(), attr("text:continue-list").isNotNull()).alias("continues"),
        F.explode(F.transform(F.filter(F.arrays_zip("trail", "ids"), lambda z: z["trail"] == "text:list"), lambda z: z["ids"])).alias("_outer"))
    names = n.filter("tag = 'text:list'").select("doc_id", F.col("node_id").alias("_outer"), F.nullif(attr("text:style-name"), F.lit("")).alias("_name"))
    return chain.join(names, ["doc_id", "_outer"]).groupBy("doc_id", "pos", "level", "continues").agg(
        F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_outer"))).alias("list_style")).join(items, ["doc_id", "pos"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def tab_stops(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, stop_px, align, leader) of paragraph styles; stops at or before the margin are dropped."""
    n = part_nodes(nodes, *STYLE_PARTS).filter(at("style:paragraph-properties", "style:tab-stops", "style:tab-stop")).select(*KEY, id_up(3).alias("pos"), "attrs")
    leader = attr("style:leader-style")
    rows = n.join(style_rows(nodes).filter("family = 'paragraph'").select(*KEY, "pos", "style_id"), [*KEY, "pos"]).select(
        "doc_id", "part", "style_id", round_half_up(units.length_to_px(attr("style:position"))).alias("stop_px"),
        F.coalesce(units.lookup(units.ODT_TAB_TYPE, F.coalesce(attr("style:type"), F.lit("left"))), F.lit("left")).alias("align"),
        F.when(leader.isNotNull() & (leader != "none"), "dot").alias("leader")).filter("stop_px > 0")
    return prefer(rows.filter("part = 'content.xml'"), rows.filter("part <> 'content.xml'"), ["doc_id", "style_id"]).drop("part")


def passthrough(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, level, tag): unmodelled inline elements, blocks and style properties."""
    n = part_nodes(nodes, CONTENT).filter((F.col("tag") != "#text") & ~F.array_contains("trail", "text:tracked-changes"))
    inline = up(1).isin("text:p", "text:h", "text:span", "text:a") & ~F.col("tag").isin(*MODELLED_INLINE)
    block = up(1).isin(*HOLDERS) & ~F.col("tag").isin(*MODELLED_BLOCKS)
    level = F.when(inline, "inline").when(block, "block")
    elements = n.withColumn("level", level).filter(F.col("level").isNotNull()).select(*KEY, F.col("node_id").alias("pos"), "level", "tag")
    s = part_nodes(nodes, CONTENT).filter(up(1) == "style:style")
    named = lambda element, allowed, label: s.filter(F.col("tag") == element).select(
        *KEY, F.col("node_id").alias("pos"), F.lit(label).alias("level"), F.explode(F.array_except(F.map_keys("attrs"), F.array(*[F.lit(a) for a in allowed]))).alias("tag"))
    return elements.unionByName(named("style:text-properties", MODELLED_TEXT_PROPERTIES, "text property")).unionByName(
        named("style:paragraph-properties", MODELLED_PARAGRAPH_PROPERTIES, "paragraph property"))
