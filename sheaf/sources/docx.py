"""Document tables of OOXML word-processor packages, derived from XML nodes.

Most tables are one filtered group-by over the nodes of an element (paragraph, run, section, style): the node rows
carry the ids of everything that encloses them, so no self-joins up the tree are needed. The nodes of a part came out
of one file in one task, so ordering the blocks of a part needs no chunks (``longest=0``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.fields import field_kind, normalise_target, reference_format, reference_target, sequence_name
from ..functions.text import round_half_up
from ..operators.scan import next_row, running_sum, scan
from .nodes import at, attr, id_up, inside, joined_text, part_nodes, path_below, pick, present, up

# Part names, and the elements that hold blocks.
BODY = "body"
NOTES = "notes"
BANDS = "bands"
HOLDERS = ["w:body", "w:tc", "w:footnote", "w:endnote", "w:hdr", "w:ftr"]
RUN_TEXT = ["w:t", "w:delText"]
KEY = ["doc_id", "part"]

# The properties and run contents that are modelled; everything else is passed through.
MODELLED = {
    "run property": ["w:rStyle", "w:b", "w:i", "w:strike", "w:vertAlign", "w:color", "w:sz", "w:szCs", "w:highlight", "w:shd", "w:rPrChange"],
    "paragraph property": ["w:pStyle", "w:numPr", "w:pBdr", "w:shd", "w:tabs", "w:jc", "w:rPr", "w:sectPr", "w:pageBreakBefore"],
    "run content": ["w:rPr", "w:t", "w:delText", "w:tab", "w:br", "w:lastRenderedPageBreak", "w:commentReference", "w:footnoteReference",
                    "w:endnoteReference", "w:sym", "w:drawing", "w:pict", "w:object", "w:fldChar", "w:instrText"],
    "paragraph content": ["w:pPr", "w:r", "w:ins", "w:del", "w:hyperlink", "w:bookmarkStart", "w:bookmarkEnd", "w:commentRangeStart",
                          "w:commentRangeEnd", "w:ruby", "w:fldSimple", "m:oMath", "m:oMathPara"],
    "block": ["w:p", "w:tbl", "w:sectPr", "w:tcPr"],
}


def _px(value: Column) -> Column:
    return round_half_up(units.twips_to_px(value))


def _run_text_of(node_text: Column = None) -> Column:
    """Text a node contributes to its run: text, a tab or a line break."""
    return F.when(F.col("tag") == "#text", F.col("text")).when(F.col("tag") == "w:tab", "\t").otherwise("\n")


def _is_run_text() -> Column:
    text = (F.col("tag") == "#text") & up(1).isin(*RUN_TEXT)
    tab = (F.col("tag") == "w:tab") & (up(1) == "w:r")
    line = (F.col("tag") == "w:br") & (up(1) == "w:r") & ~attr("w:type").eqNullSafe("page")
    return F.coalesce(text | tab | line, F.lit(False))


def blocks(nodes: DataFrame) -> DataFrame:
    """Paragraphs, list items, headings, tables and passed-through blocks, in order within their container.

    ``container_id`` is the node holding the block; ``pos`` its document position; ``seq`` its dense number there.
    """
    n = part_nodes(nodes, BODY, NOTES, BANDS).withColumn("p", inside("w:p"))
    prop = lambda *tags: F.col("_path") == "/".join(("w:pPr", *tags))
    val = lambda *tags, a="w:val": pick(prop(*tags), attr(a))
    style = val("w:pStyle")
    heading = F.regexp_extract(F.lower(F.regexp_replace(style, r"\s+", "")), "^heading([1-9])$", 1).try_cast("int")
    line, rule = val("w:spacing", a="w:line"), F.coalesce(val("w:spacing", a="w:lineRule"), F.lit("auto"))
    mark = prop("w:rPr", "w:ins") | prop("w:rPr", "w:del")
    section = prop("w:sectPr")
    level = F.least(F.lit(8), F.greatest(F.lit(0), F.coalesce(val("w:numPr", "w:ilvl").try_cast("int"), F.lit(0))))
    # Field codes: in an attribute, or as text between field characters, which keep neighbouring fields apart.
    code = F.col("tag").isin("w:fldSimple", "w:fldChar") | (F.col("tag") == "#text") & (up(1) == "w:instrText")
    code_text = F.when(F.col("tag") == "#text", F.col("text")).otherwise(F.concat(F.lit("\n"), F.coalesce(attr("w:instr"), F.lit(""))))
    sequences = F.transform(F.regexp_extract_all("_codes", F.lit(r"(?m)\bSEQ\s+(\w+)"), F.lit(1)), F.lower)
    side = lambda s: units.docx_paragraph_border(val("w:pBdr", s), val("w:pBdr", s, a="w:sz"), val("w:pBdr", s, a="w:color"))
    border = lambda s: F.when(present(prop("w:pBdr", s)), side(s))
    wanted = (F.col("tag") == "w:p") | _is_run_text() | F.array_contains("trail", "w:pPr") | code
    # Worked out before the rows are grouped, which sorts them: what goes there is narrow.
    said = n.filter(F.col("p").isNotNull() & wanted).select(
        *KEY, "p", "node_id", path_below("w:p").alias("_path"), F.when(F.array_contains("trail", "w:pPr"), F.col("attrs")).alias("attrs"),
        F.when(F.col("node_id") == F.col("p"), F.struct(up(1).alias("tag"), id_up(1).alias("id"))).alias("_at"),
        F.when(code, code_text).alias("_code"), F.when(_is_run_text(), _run_text_of()).alias("_text"))
    paras = said.groupBy(*KEY, "p").agg(
        pick(F.col("_at").isNotNull(), F.col("_at")).alias("_holder"),
        present(prop("w:numPr")).alias("_list"), heading.alias("_heading"), style.alias("_style"), level.alias("_level"),
        val("w:numPr", "w:numId").alias("num_id"), units.lookup(units.DOCX_ALIGN, val("w:jc")).alias("align"),
        _px(F.coalesce(val("w:ind", a="w:left"), val("w:ind", a="w:start"))).alias("_indent"),
        F.when(rule == "auto", round_half_up(line.try_cast("double") / 240 * 100) / 100).alias("line_height"),
        _px(val("w:spacing", a="w:before")).alias("before_px"), _px(val("w:spacing", a="w:after")).alias("after_px"),
        val("w:shd", a="w:fill").alias("_fill"),
        units.flag(present(prop("w:pageBreakBefore")), val("w:pageBreakBefore")).alias("_break"),
        pick(mark, F.when(prop("w:rPr", "w:del"), "del").otherwise("ins")).alias("rev_para"),
        pick(mark, attr("w:author")).alias("rev_author"), pick(mark, attr("w:date")).alias("rev_date"),
        present(section).alias("_section"), val("w:sectPr", "w:type").alias("_section_type"),
        F.struct(*[border(f"w:{x}").alias(x) for x in ("top", "right", "bottom", "left")]).alias("borders"),
        joined_text(F.col("_code").isNotNull(), F.col("_code")).alias("_codes"), joined_text(F.col("_text").isNotNull(), F.col("_text")).alias("text"),
    ).filter(F.col("_holder.tag").isin(*HOLDERS)).select(
        *KEY, F.col("p").alias("pos"), F.col("_holder.id").alias("container_id"), F.col("_holder.tag").alias("container"),
        F.when(F.col("_list"), "li").when(F.col("_heading").isNotNull(), "h").otherwise("p").alias("kind"),
        F.when(F.col("_list"), F.col("_level")).when(F.col("_heading").isNotNull(), F.least(F.col("_heading"), F.lit(6))).alias("level"),
        F.when(F.col("_heading").isNull(), F.nullif(F.col("_style"), F.lit(""))).alias("style_id"), "num_id", "align",
        F.when(F.col("_indent") > 0, F.col("_indent")).alias("indent_px"), "line_height", "before_px", "after_px",
        F.when(F.col("_fill").rlike("^[0-9a-fA-F]{6}$"), F.lower(F.concat(F.lit("#"), "_fill"))).alias("shading"),
        F.when(F.col("_break") & ~F.col("_list"), "manual").when(
            F.col("_section") & ~F.col("_section_type").eqNullSafe("continuous") & ~F.col("_list"), "auto").alias("page_break"),
        F.col("_section").alias("boundary"), "rev_para", "rev_author", "rev_date", "borders",
        # A plain paragraph with a sequence field is a caption; what it captions follows from the sequence's name.
        F.when(~F.col("_list") & F.col("_heading").isNull() & (F.size(sequences) > 0), F.when(F.array_contains(sequences, "table"), "table")
               .when(F.array_contains(sequences, "equation"), "equation").otherwise("figure")).alias("caption_kind"), "text")
    others = n.filter(up(1).isin(*HOLDERS) & ~F.col("tag").isin("w:p", "w:sectPr", "w:tcPr", "#text")).select(
        *KEY, F.col("node_id").alias("pos"), id_up(1).alias("container_id"), up(1).alias("container"),
        F.when(F.col("tag") == "w:tbl", "table").otherwise("pass").alias("kind"))
    every = paras.unionByName(others, allowMissingColumns=True)
    return scan(every, [*KEY, "container_id"], "pos", longest=0, seq=running_sum(F.lit(1), inclusive=False))


def _format(where) -> list[Column]:
    """Aggregates giving a run's format from the properties at ``where(tag)``."""
    val = lambda tag, a="w:val": pick(where(tag), attr(a))
    on = lambda tag: units.flag(present(where(tag)), val(tag))
    colour, fill = val("w:color"), val("w:shd", "w:fill")
    hex6 = lambda c: F.when(c.rlike("^[0-9a-fA-F]{6}$"), F.upper(c))
    align = val("w:vertAlign")
    return [
        on("w:b").alias("b"), on("w:i").alias("i"), on("w:u").alias("u"), on("w:strike").alias("strike"),
        F.when(align == "superscript", "super").when(align == "subscript", "sub").alias("vert_align"), hex6(colour).alias("color"),
        F.nullif(val("w:highlight"), F.lit("none")).alias("highlight"), hex6(fill).alias("shading"),
        F.when(val("w:sz").rlike("^[0-9]+$"), val("w:sz").try_cast("int")).alias("size_half_pt"),
        F.coalesce(F.nullif(val("w:rFonts", "w:ascii"), F.lit("")), F.nullif(val("w:rFonts", "w:hAnsi"), F.lit(""))).alias("font"),
        val("w:rStyle").alias("char_style"),
    ]


def runs(nodes: DataFrame) -> DataFrame:
    """Runs with text, format, link target and revision: one row per run with text."""
    n = part_nodes(nodes, BODY, NOTES, BANDS).withColumn("r", inside("w:r"))
    where = lambda tag: F.col("_path") == f"w:rPr/{tag}"
    old = lambda tag: F.concat(F.lit("/"), "_path").endswith(f"/w:rPrChange/w:rPr/{tag}")
    old_fmt = [c.alias(f"old_{k}") for c, k in zip([units.flag(present(old(t)), pick(old(t), attr("w:val"))) for t in ("w:b", "w:i", "w:u", "w:strike")], ("b", "i", "u", "strike"))]
    change = where("w:rPrChange")
    # The text itself sits below w:t; the elements around it add nothing. Worked out before the rows are grouped, which sorts them.
    said = n.filter(F.col("r").isNotNull() & ~F.col("tag").isin("w:t", "w:delText")).select(
        *KEY, "r", "node_id", path_below("w:r").alias("_path"), "attrs", inside("w:p").alias("p"), inside("w:ins", "w:del").alias("_rev"), inside("w:hyperlink").alias("_link"),
        F.when(_is_run_text(), _run_text_of()).alias("_text"),
        ((up(1) == "w:r") & ~F.col("tag").isin("w:rPr", "w:t", "w:delText", "w:tab", "w:br", "w:lastRenderedPageBreak", "#text")).alias("_other"))
    grouped = said.groupBy(*KEY, "r").agg(
        F.min("p").alias("p"), F.max("_rev").alias("_rev"), F.max("_link").alias("_link"),
        joined_text(F.col("_text").isNotNull(), F.col("_text")).alias("text"), *_format(where), *old_fmt,
        present(change).alias("_changed"), pick(change, attr("w:author")).alias("_by"), pick(change, attr("w:date")).alias("_on"),
        (~present(F.col("_other"))).alias("editable"),
    ).filter(F.col("text") != "")
    revs = n.filter(F.col("tag").isin("w:ins", "w:del")).select(
        *KEY, F.col("node_id").alias("_rev"), F.substr(F.col("tag"), F.lit(3)).alias("_kind"), attr("w:author").alias("_author"), attr("w:date").alias("_date"))
    links = n.filter("tag = 'w:hyperlink'").select(*KEY, F.col("node_id").alias("_link"), attr("r:id").alias("link_rid"), attr("w:anchor").alias("anchor"))
    out = grouped.join(revs, [*KEY, "_rev"], "left").join(links, [*KEY, "_link"], "left")
    return out.select(
        *KEY, F.col("p").alias("block_pos"), F.col("r").alias("pos"), "text", "b", "i", "u", "strike", "vert_align", "color", "highlight", "shading",
        "size_half_pt", "font", "char_style", "link_rid", "anchor", "editable",
        F.coalesce("_kind", F.when(F.col("_changed"), "fmt")).alias("rev_kind"), F.coalesce("_author", "_by").alias("rev_author"),
        F.coalesce("_date", "_on").alias("rev_date"), *[F.when(F.col("_changed"), F.col(f"old_{k}")).alias(f"old_{k}") for k in ("b", "i", "u", "strike")])


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, table_no, row_no, cell_no, colspan, vmerge, is_header, border sides, text); numbers from 0.

    Borders are given as ``cell_<side>``: px, style and colour as CSS writes them, or ``off``.
    """
    n = part_nodes(nodes, BODY, NOTES, BANDS)
    holder = n.withColumn("c", inside("w:tc"))
    prop = lambda *tags: at("w:tc", "w:tcPr", *tags)
    own = holder.filter(F.col("c").isNotNull()).groupBy(*KEY, "c").agg(
        pick(F.col("node_id") == F.col("c"), F.struct(id_up(1).alias("tr"), id_up(2).alias("tbl"), up(1).alias("row_tag"))).alias("_at"),
        F.coalesce(pick(prop("w:gridSpan"), attr("w:val")).try_cast("int"), F.lit(1)).alias("colspan"),
        present(prop("w:vMerge")).alias("_merged"), pick(prop("w:vMerge"), attr("w:val")).alias("_merge"),
        joined_text(_is_run_text(), _run_text_of()).alias("text"),
        *[_border(prop("w:tcBorders", f"w:{s}")).alias(f"cell_{s}") for s in ("top", "right", "bottom", "left")],
    ).filter(F.col("_at.row_tag") == "w:tr").select(
        *KEY, F.col("_at.tbl").alias("table_no"), F.col("_at.tr").alias("tr"), "c", "colspan",
        F.when(F.col("_merged"), F.when(F.col("_merge") == "restart", "restart").otherwise("cont")).alias("vmerge"), "text",
        *[f"cell_{s}" for s in ("top", "right", "bottom", "left")])
    header = n.filter(at("w:tr", "w:trPr", "w:tblHeader")).select(*KEY, id_up(2).alias("tr"), F.lit(True).alias("is_header"))
    rows = own.select(*KEY, "table_no", "tr").distinct()
    numbered = scan(rows, [*KEY, "table_no"], "tr", longest=0, row_no=running_sum(F.lit(1), inclusive=False))
    placed = scan(own.join(numbered, [*KEY, "table_no", "tr"]), [*KEY, "tr"], "c", longest=0, cell_no=running_sum(F.lit(1), inclusive=False))
    return placed.join(header, [*KEY, "tr"], "left").withColumn("is_header", F.coalesce("is_header", F.lit(False))).drop("tr", "c")


def _border(where: Column) -> Column:
    spec = pick(where, units.docx_table_border(attr("w:val"), attr("w:sz"), attr("w:color")))
    css = F.concat(spec["px"].cast("string"), F.lit("px "), spec["style"], F.lit(" #"), spec["hex"])
    return F.when(present(where), F.coalesce(css, F.lit("off")))


def table_borders(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, table_no, top, right, bottom, left, inside_h, inside_v): the lines a table itself declares."""
    n = part_nodes(nodes, BODY, NOTES, BANDS).filter((up(1) == "w:tblBorders") & (up(2) == "w:tblPr")).withColumn("table_no", id_up(3))
    sides = {"top": "w:top", "right": "w:right", "bottom": "w:bottom", "left": "w:left", "inside_h": "w:insideH", "inside_v": "w:insideV"}
    return n.groupBy(*KEY, "table_no").agg(*[_border(F.col("tag") == t).alias(s) for s, t in sides.items()])


def comments(nodes: DataFrame) -> DataFrame:
    """(doc_id, comment_id, author, date, paras, para_id, parent_para_id, done, ref_ord): what threading needs.

    The last paragraph's id is the thread key. ``ref_ord`` is the position of the first reference in the body.
    """
    c = part_nodes(nodes, "comments").withColumn("c", inside("w:comment")).withColumn("p", inside("w:p"))
    paras = c.filter(F.col("p").isNotNull()).groupBy("doc_id", "c", "p").agg(
        joined_text((F.col("tag") == "#text") & (up(1) == "w:t"), F.col("text")).alias("text"),
        pick(F.col("node_id") == F.col("p"), attr("w14:paraId")).alias("para_id"))
    bodies = paras.groupBy("doc_id", "c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]).alias("paras"),
        F.max_by("para_id", F.when(F.col("para_id").isNotNull(), F.col("p"))).alias("para_id"))
    heads = c.filter("tag = 'w:comment'").select(
        "doc_id", "c", attr("w:id").try_cast("long").alias("comment_id"), F.coalesce(attr("w:author"), F.lit("")).alias("author"), attr("w:date").alias("date"))
    extended = part_nodes(nodes, "comment_threads").filter("tag = 'w15:commentEx'").groupBy("doc_id", attr("w15:paraId").alias("para_id")).agg(
        F.max_by(attr("w15:paraIdParent"), "node_id").alias("parent_para_id"), F.bool_or(F.coalesce(attr("w15:done").isin("1", "true"), F.lit(False))).alias("done"))
    refs = part_nodes(nodes, BODY).filter("tag = 'w:commentReference'").groupBy("doc_id", attr("w:id").try_cast("long").alias("comment_id")).agg(
        F.min("node_id").alias("ref_ord"))
    return heads.join(bodies, ["doc_id", "c"], "left").join(extended, ["doc_id", "para_id"], "left").join(refs, ["doc_id", "comment_id"], "left").select(
        "doc_id", "comment_id", "author", "date", "paras", "para_id", "parent_para_id", F.coalesce("done", F.lit(False)).alias("done"), "ref_ord")


def comment_ranges(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind, id, start_pos, end_pos) of comment ranges in the body."""
    n = part_nodes(nodes, BODY)
    edge = lambda tag, name: n.filter(F.col("tag") == tag).groupBy("doc_id", attr("w:id").alias("id")).agg(F.min("node_id").alias(name))
    return edge("w:commentRangeStart", "start_pos").join(edge("w:commentRangeEnd", "end_pos"), ["doc_id", "id"]).select(
        "doc_id", F.lit("comment").alias("kind"), "id", "start_pos", "end_pos")


def fields(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, block_pos, pos, instruction, cached, kind, target, shows, seq_name): simple and complex fields.

    A complex field runs from begin to its matching end over the runs of one paragraph; its instruction is what stands
    before its own separator, its result what stands after. Fields inside it and fields without an end are left out.
    """
    n = part_nodes(nodes, BODY, NOTES, BANDS).withColumn("p", inside("w:p"))
    child = F.try_element_at("trail", F.size("trail") - F.array_position(F.reverse("trail"), "w:p").cast("int") + 2)
    kind = F.when(F.col("tag") == "w:fldChar", attr("w:fldCharType")).when(
        (F.col("tag") == "#text") & (up(1) == "w:instrText"), "instr").when(F.col("tag") == "#text", "text")
    marks = n.filter(F.col("p").isNotNull() & (child != "w:fldSimple")).withColumn("_k", kind).filter(F.col("_k").isNotNull()).select(*KEY, "p", "node_id", "_k", "text")
    para = [*KEY, "p"]
    turn = F.when(F.col("_k") == "begin", 1).when(F.col("_k") == "end", -1).otherwise(0)
    # The marks of a paragraph come out of one part of one file.
    deep = scan(marks, para, "node_id", longest=0, _depth=running_sum(turn))
    opens = (F.col("_k") == "begin") & (F.col("_depth") == 1)
    which = scan(deep, para, "node_id", longest=0, _f=running_sum(opens.cast("long")))
    phase = scan(which, [*para, "_f"], "node_id", longest=0, _s=running_sum(((F.col("_k") == "separate") & (F.col("_depth") == 1)).cast("long")))
    mine = F.col("_depth") == 1
    complex_fields = phase.filter("_f > 0").groupBy(*para, "_f").agg(
        F.min("node_id").alias("pos"), F.bool_or((F.col("_k") == "end") & (F.col("_depth") == 0)).alias("_ended"),
        joined_text(mine & (F.col("_k") == "instr") & (F.col("_s") == 0), F.col("text")).alias("instruction"),
        joined_text(mine & F.col("_k").isin("text", "instr") & (F.col("_s") > 0), F.col("text")).alias("cached"),
    ).filter("_ended").select(*KEY, F.col("p").alias("block_pos"), "pos", "instruction", "cached")
    simple = n.withColumn("_f", inside("w:fldSimple")).filter(F.col("_f").isNotNull()).groupBy(*KEY, "_f").agg(
        F.min("p").alias("block_pos"), pick(F.col("node_id") == F.col("_f"), attr("w:instr")).alias("instruction"),
        joined_text(F.col("tag") == "#text", F.col("text")).alias("cached")).withColumnRenamed("_f", "pos")
    i = F.col("instruction")
    return complex_fields.unionByName(simple.select(*complex_fields.columns)).select(
        "*", field_kind(i).alias("kind"), reference_target(i).alias("target"), reference_format(i).alias("shows"), sequence_name(i).alias("seq_name"))


def bookmarks(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, name, id, start_pos, end_pos); the editor's transient bookmark is dropped."""
    n = part_nodes(nodes, BODY, NOTES)
    start = (F.col("tag") == "w:bookmarkStart") & (attr("w:name") != "") & (attr("w:name") != "_GoBack")
    edges = n.filter(start | (F.col("tag") == "w:bookmarkEnd")).select(*KEY, attr("w:id").alias("id"), attr("w:name").alias("name"), "tag", F.col("node_id").alias("start_pos"))
    paired = scan(edges, [*KEY, "id"], "start_pos", longest=0, _end=next_row(F.col("tag") == "w:bookmarkEnd", inclusive=False))
    return paired.filter("tag = 'w:bookmarkStart'").select(*KEY, "name", "id", "start_pos", F.when(F.col("id").isNotNull(), F.col("_end.at")).alias("end_pos"))


def notes(nodes: DataFrame) -> DataFrame:
    """(doc_id, note_kind, note_id, text): note bodies without separators."""
    n = part_nodes(nodes, NOTES).withColumn("f", inside("w:footnote", "w:endnote"))
    head = F.col("node_id") == F.col("f")
    return n.filter(F.col("f").isNotNull()).groupBy(*KEY, "f").agg(
        pick(head, attr("w:id")).alias("note_id"), pick(head, attr("w:type")).alias("_type"), pick(head, F.substr(F.col("tag"), F.lit(3))).alias("note_kind"),
        joined_text(_is_run_text(), _run_text_of()).alias("text"),
    ).filter((F.col("note_id").try_cast("long") > 0) & F.col("_type").isNull()).select("doc_id", "note_kind", "note_id", "text")


def note_refs(nodes: DataFrame) -> DataFrame:
    """(doc_id, block_pos, pos, note_kind, note_id) of references in the body."""
    n = part_nodes(nodes, BODY).filter(F.col("tag").isin("w:footnoteReference", "w:endnoteReference"))
    return n.select("doc_id", inside("w:p").alias("block_pos"), F.col("node_id").alias("pos"),
                    F.when(F.col("tag") == "w:endnoteReference", "endnote").otherwise("footnote").alias("note_kind"), attr("w:id").alias("note_id"))


def revisions(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, kind, author, date, chars): insertions, deletions, paragraph marks and format changes."""
    n = part_nodes(nodes, BODY, NOTES, BANDS)
    groups = n.withColumn("v", inside("w:ins", "w:del")).filter(F.col("v").isNotNull() & ~F.array_contains("trail", "w:rPr")).groupBy(*KEY, "v").agg(
        pick(F.col("node_id") == F.col("v"), F.struct(F.substr(F.col("tag"), F.lit(3)).alias("kind"), attr("w:author").alias("author"), attr("w:date").alias("date"))).alias("_h"),
        F.sum(F.when(_is_run_text(), F.length(_run_text_of()))).alias("chars")).filter("chars > 0").select(
        *KEY, F.col("v").alias("pos"), "_h.kind", "_h.author", "_h.date", "chars")
    single = n.filter(at("w:pPr", "w:rPr", "w:ins") | at("w:pPr", "w:rPr", "w:del") | at("w:r", "w:rPr", "w:rPrChange")).select(
        *KEY, F.col("node_id").alias("pos"),
        F.when(F.col("tag") == "w:rPrChange", "format").otherwise(F.concat(F.lit("paragraph "), F.substr(F.col("tag"), F.lit(3)))).alias("kind"),
        attr("w:author").alias("author"), attr("w:date").alias("date"), F.lit(0).cast("long").alias("chars"))
    return groups.unionByName(single)


def sections(nodes: DataFrame) -> DataFrame:
    """Page geometry of each section in px, keyed by the position of its w:sectPr; ``block_pos`` is null for the last."""
    n = part_nodes(nodes, BODY).withColumn("s", inside("w:sectPr"))
    a = lambda tag, name: pick(at("w:sectPr", tag), attr(f"w:{name}"))
    there = lambda tag: present(at("w:sectPr", tag))
    on = lambda tag: there(tag) & (F.coalesce(a(tag, "val"), F.lit("1")) != "0")
    margin = lambda side: F.greatest(F.lit(0.0), F.coalesce(units.twips_to_px(a("w:pgMar", side)), F.lit(96.0)))
    above_zero = lambda c, low: F.when(c > low, c)
    cols = above_zero(a("w:cols", "num").try_cast("int"), 1)
    direction = F.coalesce(a("w:textDirection", "val"), F.lit(""))
    top = lambda name: pick(at("w:sectPr", "w:pgBorders", "w:top"), attr(f"w:{name}"))
    bordered = present(at("w:sectPr", "w:pgBorders", "w:top")) & ~F.coalesce(top("val"), F.lit("single")).isin("none", "nil")
    border_style = F.when(top("val").isin("double", "dashed", "dotted"), top("val")).otherwise("solid")
    border_px = F.greatest(F.lit(1).cast("long"), round_half_up(F.coalesce(F.nullif(top("sz").try_cast("double"), F.lit(0.0)), F.lit(4.0)) / 6))
    border_hex = F.when(top("color").rlike("^[0-9a-fA-F]{6}$"), F.upper(top("color"))).otherwise("000000")
    fmt, restart, valign = a("w:pgNumType", "fmt"), F.coalesce(a("w:lnNumType", "restart"), F.lit("newPage")), a("w:vAlign", "val")
    return n.filter(F.col("s").isNotNull()).groupBy(*KEY, F.col("s").alias("pos")).agg(
        F.min(inside("w:p")).alias("block_pos"), a("w:type", "val").alias("type"), _px(a("w:pgSz", "w")).alias("w"), _px(a("w:pgSz", "h")).alias("h"),
        *[margin(side).alias(f"m_{side}") for side in ("top", "right", "bottom", "left")], cols.alias("cols"),
        F.when(cols.isNotNull(), round_half_up(F.coalesce(units.twips_to_px(a("w:cols", "space")), F.lit(36.0)))).alias("col_gap"),
        (direction.startswith("tbRl") | (direction == "tbV")).alias("vertical"), on("w:bidi").alias("rtl"), on("w:titlePg").alias("title_page"),
        F.when(bordered, F.struct(border_px.alias("px"), border_style.alias("style"), border_hex.alias("hex"), top("space").try_cast("double").alias("space_pt"))).alias("border"),
        above_zero(a("w:pgNumType", "start").try_cast("int"), 0).alias("page_start"), F.when(fmt.isin(*units.PAGE_NUMBER_FORMATS), fmt).alias("page_format"),
        there("w:lnNumType").alias("line_numbers"), above_zero(a("w:lnNumType", "countBy").try_cast("int"), 1).alias("line_interval"),
        F.when(there("w:lnNumType"), F.when(restart.isin("continuous", "newPage", "newSection"), restart).otherwise("newPage")).alias("line_restart"),
        a("w:lnNumType", "start").try_cast("int").alias("line_start"), F.when(valign.isin("center", "both", "bottom"), valign).alias("v_align"),
    ).filter((F.col("w") > 0) & (F.col("h") > 0))


def styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, kind, name, based_on, is_default, hidden, props): styles with their own properties as CSS."""
    n = part_nodes(nodes, "styles").withColumn("s", inside("w:style"))
    head = F.col("node_id") == F.col("s")
    r, p = (lambda tag: at("w:style", "w:rPr", tag)), (lambda tag: at("w:style", "w:pPr", tag))
    val = lambda where, a="w:val": pick(where, attr(a))
    three = lambda tag: units.style_flag(present(r(tag)), val(r(tag)))
    hashed = lambda c: F.when(c.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), c))
    px = lambda c: F.concat(_px(c).cast("string"), F.lit("px"))
    indent, line = F.coalesce(val(p("w:ind"), "w:left"), val(p("w:ind"), "w:start")), val(p("w:spacing"), "w:line")
    deco = F.nullif(F.concat_ws(" ", F.when(three("w:u"), "underline"), F.when(three("w:strike"), "line-through")), F.lit(""))
    size = val(r("w:sz")).try_cast("double")
    props = {
        "text-align": units.lookup(units.DOCX_ALIGN, val(p("w:jc"))), "margin-left": F.when(_px(indent) > 0, px(indent)),
        "margin-top": px(val(p("w:spacing"), "w:before")), "margin-bottom": px(val(p("w:spacing"), "w:after")),
        "line-height": F.when(F.coalesce(val(p("w:spacing"), "w:lineRule"), F.lit("auto")) == "auto", (round_half_up(line.try_cast("double") / 240 * 100) / 100).cast("string")),
        "background-color": F.coalesce(hashed(val(r("w:shd"), "w:fill")), hashed(val(p("w:shd"), "w:fill"))),
        "font-weight": F.when(three("w:b"), "bold").when(~three("w:b"), "normal"), "font-style": F.when(three("w:i"), "italic").when(~three("w:i"), "normal"),
        "text-decoration": deco, "color": hashed(val(r("w:color"))),
        "font-size": F.when(size > 0, F.concat(F.regexp_replace((size / 2).cast("string"), r"\.0$", ""), F.lit("pt"))),
        "font-family": F.concat(F.lit("'"), F.replace(F.nullif(val(r("w:rFonts"), "w:ascii"), F.lit("")), F.lit("'"), F.lit("")), F.lit("'")),
    }
    side = lambda s: units.docx_paragraph_border(*[val(at("w:style", "w:pPr", "w:pBdr", f"w:{s}"), f"w:{a}") for a in ("val", "sz", "color")])
    borders = {s: F.when(present(at("w:style", "w:pPr", "w:pBdr", f"w:{s}")), side(s)) for s in ("top", "right", "bottom", "left")}
    for s, b in borders.items():
        props[f"border-{s}"] = F.when(b.isNotNull(), F.concat(b["px"].cast("string"), F.lit("px "), b["style"], F.lit(" #"), b["hex"]))
    props["padding"] = F.when(F.coalesce(*borders.values()).isNotNull(), "2px 6px")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in props.items()]), lambda e: e["value"].isNotNull())
    grouped = n.filter(F.col("s").isNotNull()).groupBy("doc_id", "s").agg(
        pick(head, F.struct(attr("w:styleId").alias("style_id"), F.coalesce(attr("w:type"), F.lit("paragraph")).alias("kind"), (F.coalesce(attr("w:default"), F.lit("0")) == "1").alias("is_default"))).alias("_h"),
        val(at("w:style", "w:name")).alias("name"), val(at("w:style", "w:basedOn")).alias("based_on"), present(at("w:style", "w:semiHidden")).alias("hidden"),
        F.map_from_entries(entries).alias("props"))
    return grouped.filter(F.col("_h.style_id") != "").select(
        "doc_id", "_h.style_id", "_h.kind", F.coalesce("name", F.col("_h.style_id")).alias("name"), "based_on", "_h.is_default", "hidden", "props")


def relationships(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, rid, target): ``part`` is the part the relationships belong to."""
    source = F.regexp_replace(F.regexp_replace("part", r"_rels/", ""), r"\.rels$", "")
    return part_nodes(nodes, "links").filter(F.col("tag") == "Relationship").select(
        "doc_id", source.alias("part"), attr("Id").alias("rid"), attr("Target").alias("target")).filter(
        F.col("rid").isNotNull() & F.col("target").isNotNull())


def images(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Drawings with size, alternative text, layout and the media part they show.

    wrap is null for inline images. A wrapped image placed by an offset on an axis keeps it (abs_x, abs_y). Images
    whose part is missing or of a type no browser shows are kept with ``shown`` false.
    """
    n = part_nodes(nodes, BODY, NOTES, BANDS).withColumn("d", inside("w:drawing", "w:pict"))
    has = lambda tag: present(F.col("tag") == tag)
    emu = lambda c: F.coalesce(units.emu_to_px(c), F.lit(0).cast("long"))
    axis_text = lambda axis, tag: pick((F.col("tag") == "#text") & (up(1) == tag) & (up(2) == axis), F.trim("text"))
    anchor = F.col("tag") == "wp:anchor"
    wrap = (F.when(~present(anchor), F.lit(None).cast("string")).when(has("wp:wrapTopAndBottom"), "topbottom").when(has("wp:wrapSquare"), "square")
            .when(has("wp:wrapTight") | has("wp:wrapThrough"), "tight")
            .when(pick(anchor, attr("behindDoc")) == "1", "behind").otherwise("front"))
    align_h = axis_text("wp:positionH", "wp:align")
    off = {x: axis_text(f"wp:position{x}", "wp:posOffset") for x in "HV"}
    aligned = {x: axis_text(f"wp:position{x}", "wp:align") for x in "HV"}
    dist = {s: pick(anchor, attr(f"dist{s.upper()}")) for s in "trbl"}
    any_dist = F.coalesce(*dist.values()).isNotNull()
    grouped = n.filter(F.col("d").isNotNull()).groupBy(*KEY, F.col("d").alias("pos")).agg(
        F.min(inside("w:p")).alias("block_pos"), F.coalesce(pick(F.col("tag") == "a:blip", F.coalesce(attr("r:embed"), attr("r:link"))),
                                                           pick(F.col("tag") == "v:imagedata", attr("r:id"))).alias("rid"),
        units.emu_to_px(pick(F.col("tag") == "wp:extent", attr("cx"))).alias("width"), units.emu_to_px(pick(F.col("tag") == "wp:extent", attr("cy"))).alias("height"),
        F.coalesce(pick(F.col("tag") == "wp:docPr", attr("descr")), F.lit("")).alias("alt"), wrap.alias("wrap"),
        F.when(align_h.isin("right", "center"), align_h).otherwise("left").alias("align"), emu(off["H"]).alias("x"), emu(off["V"]).alias("y"),
        (off["H"].isNotNull() & aligned["H"].isNull()).alias("_ox"), (off["V"].isNotNull() & aligned["V"].isNull()).alias("_oy"),
        F.when(any_dist, F.struct(*[emu(c).alias(s) for s, c in dist.items()])).alias("dist"))
    rels = relationships(nodes).select(*KEY, "rid", normalise_target(F.col("target")).alias("media"))
    media = parts.select("doc_id", F.col("part").alias("media"), "sha256")
    ext = F.lower(F.regexp_extract("media", r"\.([^./]+)$", 1))
    wrapped = F.coalesce(~F.col("wrap").isin("behind", "front"), F.lit(False))
    return grouped.join(rels, [*KEY, "rid"], "left").join(media, ["doc_id", "media"], "left").select(
        *KEY, "block_pos", "pos", "media", "sha256", "width", "height", "alt", "wrap",
        *[F.when(F.col("wrap").isNotNull(), F.col(c)).alias(c) for c in ("align", "x", "y", "dist")],
        (wrapped & F.col("_ox")).alias("abs_x"), (wrapped & F.col("_oy")).alias("abs_y"), units.lookup(units.IMAGE_TYPES, ext).alias("mime"),
        (F.col("sha256").isNotNull() & units.lookup(units.IMAGE_TYPES, ext).isNotNull() & ~ext.isin("emf", "wmf")).alias("shown"))


def links(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, href, text): external links through their relationship, internal ones as #anchor."""
    n = part_nodes(nodes, BODY, NOTES, BANDS).withColumn("l", inside("w:hyperlink"))
    grouped = n.filter(F.col("l").isNotNull()).groupBy(*KEY, F.col("l").alias("pos")).agg(
        pick(F.col("node_id") == F.col("l"), F.struct(attr("r:id").alias("rid"), attr("w:anchor").alias("anchor"))).alias("_h"),
        joined_text(_is_run_text(), _run_text_of()).alias("text")).select(*KEY, "pos", "_h.rid", "_h.anchor", "text")
    return grouped.join(relationships(nodes), [*KEY, "rid"], "left").select(
        *KEY, "pos", F.when(F.col("rid").isNotNull(), F.coalesce("target", F.lit(""))).otherwise(
            F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))).alias("href"), "text")


def even_odd(nodes: DataFrame) -> DataFrame:
    """(doc_id, even_odd): whether even and odd pages have bands of their own, of the documents with settings."""
    switch = F.col("tag") == "w:evenAndOddHeaders"
    return part_nodes(nodes, "settings").groupBy("doc_id").agg(
        (F.coalesce(present(switch), F.lit(False)) & ~F.coalesce(pick(switch, attr("w:val")), F.lit("1")).eqNullSafe("0")).alias("even_odd"))


def bands(nodes: DataFrame) -> DataFrame:
    """(doc_id, section_pos, role, variant, rid, band_part, even_odd, text): headers and footers each section refers to."""
    refs = part_nodes(nodes, BODY).filter(F.col("tag").isin("w:headerReference", "w:footerReference")).select(
        *KEY, inside("w:sectPr").alias("section_pos"), F.regexp_extract("tag", "^w:(header|footer)", 1).alias("role"),
        F.coalesce(attr("w:type"), F.lit("default")).alias("variant"), attr("r:id").alias("rid"))
    rels = relationships(nodes).select(*KEY, "rid", normalise_target(F.col("target")).alias("band_part"))
    texts = part_nodes(nodes, BANDS).filter(_is_run_text()).groupBy("doc_id", F.col("part").alias("band_part")).agg(joined_text(F.lit(True), _run_text_of()).alias("text"))
    return refs.join(rels, [*KEY, "rid"]).join(texts, ["doc_id", "band_part"], "left").join(even_odd(nodes), "doc_id", "left").select(
        "doc_id", "section_pos", "role", "variant", "rid", "band_part", F.coalesce("even_odd", F.lit(False)).alias("even_odd"), "text")


def ruby(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, base, reading): phonetic guides."""
    n = part_nodes(nodes, BODY, NOTES).withColumn("u", inside("w:ruby"))
    in_tag = lambda tag: F.array_contains("trail", tag)
    text = F.col("tag") == "#text"
    return n.filter(F.col("u").isNotNull()).groupBy(*KEY, F.col("u").alias("pos")).agg(
        joined_text(text & in_tag("w:rubyBase"), F.col("text")).alias("base"), joined_text(text & in_tag("w:rt"), F.col("text")).alias("reading"))


def passthrough(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, level, tag): everything that is kept verbatim because it is not modelled."""
    n = part_nodes(nodes, BODY, NOTES, BANDS).filter(F.col("tag") != "#text")
    level = (F.when((up(1) == "w:rPr") & (up(2) == "w:r"), "run property").when((up(1) == "w:pPr") & (up(2) == "w:p"), "paragraph property")
             .when(up(1) == "w:r", "run content").when(up(1) == "w:p", "paragraph content").when(up(1).isin(*HOLDERS), "block"))
    placed = n.withColumn("level", level).filter(F.col("level").isNotNull())
    names = F.map_keys("attrs")
    extra = lambda allowed: F.size(F.array_except(names, F.array(*[F.lit(a) for a in allowed]))) > 0
    plain_line = (F.coalesce(attr("w:val"), F.lit("single")) == "single") & (F.size(names) <= 1)
    auto = F.coalesce(attr("w:lineRule"), F.lit("auto")) == "auto"
    spacing = F.when(auto, extra(["w:before", "w:after", "w:line", "w:lineRule"])).otherwise(extra(["w:before", "w:after"]))
    # Modelled only as far as their attributes are.
    partly = (
        ((F.col("level") == "run property") & (((F.col("tag") == "w:u") & plain_line) | ((F.col("tag") == "w:rFonts") & ~extra(["w:ascii", "w:hAnsi"]))))
        | ((F.col("level") == "paragraph property") & (((F.col("tag") == "w:spacing") & ~spacing) | ((F.col("tag") == "w:ind") & ~extra(["w:left", "w:start"])))))
    modelled = F.lit(False)
    for name, tags in MODELLED.items():
        modelled = modelled | ((F.col("level") == name) & F.col("tag").isin(*tags))
    return placed.filter(~(modelled | F.coalesce(partly, F.lit(False)))).select(*KEY, F.col("node_id").alias("pos"), "level", "tag")


def passthrough_census(rows: DataFrame) -> DataFrame:
    """(level, tag, n, docs): which unmodelled elements occur, how often and in how many documents."""
    return rows.groupBy("level", "tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def numbering(nodes: DataFrame) -> DataFrame:
    """(doc_id, num_id, abstract_id, ordered, start): a num's own level-0 start wins over its abstract definition's."""
    n = part_nodes(nodes, "numbering")
    a = n.withColumn("a", inside("w:abstractNum")).filter(F.col("a").isNotNull())
    lvl = inside("w:lvl")
    # Level 0 of each definition: the level elements whose ilvl is 0 or absent.
    zero = a.filter((F.col("tag") == "w:lvl") & (F.coalesce(attr("w:ilvl"), F.lit("0")) == "0")).groupBy("doc_id", "a").agg(F.min("node_id").alias("_l"))
    starts = a.filter(F.col("tag") == "w:start").select("doc_id", "a", lvl.alias("_l"), attr("w:val").try_cast("long").alias("_start"))
    abstract = a.groupBy("doc_id", "a").agg(
        pick(F.col("node_id") == F.col("a"), attr("w:abstractNumId")).alias("abstract_id"), F.coalesce(pick(F.col("tag") == "w:numFmt", attr("w:val")), F.lit("")).alias("_fmt")
    ).join(zero.join(starts, ["doc_id", "a", "_l"]).select("doc_id", "a", "_start"), ["doc_id", "a"], "left")
    m = n.withColumn("m", inside("w:num")).filter(F.col("m").isNotNull())
    over_id = inside("w:lvlOverride")
    nums = m.groupBy("doc_id", "m").agg(
        pick(F.col("node_id") == F.col("m"), attr("w:numId")).alias("num_id"), pick(F.col("tag") == "w:abstractNumId", attr("w:val")).alias("abstract_id"))
    first = m.filter((F.col("tag") == "w:lvlOverride") & (F.coalesce(attr("w:ilvl"), F.lit("0")) == "0")).groupBy("doc_id", "m").agg(F.min("node_id").alias("_o"))
    override = m.filter(F.col("tag") == "w:startOverride").select("doc_id", "m", over_id.alias("_o"), attr("w:val").try_cast("long").alias("_own"))
    return (
        nums.join(first.join(override, ["doc_id", "m", "_o"]).select("doc_id", "m", "_own"), ["doc_id", "m"], "left")
        .join(abstract.select("doc_id", "abstract_id", "_fmt", "_start"), ["doc_id", "abstract_id"], "left")
        .select("doc_id", "num_id", "abstract_id", F.coalesce(~F.col("_fmt").isin("bullet", "none", ""), F.lit(False)).alias("ordered"),
                F.coalesce("_own", "_start", F.lit(1).cast("long")).alias("start"))
    )


def tab_stops(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, owner, owner_id, stop_px, align, leader): stops of paragraphs (position) and styles (id)."""
    n = part_nodes(nodes, BODY, NOTES, BANDS, "styles").filter(at("w:pPr", "w:tabs", "w:tab") & up(3).isin("w:p", "w:style"))
    style_id = part_nodes(nodes, "styles").filter("tag = 'w:style'").select(*KEY, F.col("node_id").alias("_owner"), attr("w:styleId").alias("_style"))
    stops = n.filter(F.coalesce(attr("w:val"), F.lit("left")) != "clear").select(
        *KEY, id_up(3).alias("_owner"), F.substr(up(3), F.lit(3)).alias("owner"), _px(attr("w:pos")).alias("stop_px"),
        F.coalesce(attr("w:val"), F.lit("left")).alias("align"), attr("w:leader").alias("leader")).filter("stop_px > 0")
    return stops.join(style_id, [*KEY, "_owner"], "left").select(
        *KEY, F.when(F.col("owner") == "p", "paragraph").otherwise("style").alias("owner"),
        F.coalesce("_style", F.col("_owner").cast("string")).alias("owner_id"), "stop_px", "align", "leader")


def effective_tab_stops(blocks_table: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops in force for each block: its own if it has any, else those of its style."""
    own = blocks_table.select("doc_id", "part", "pos", "style_id").join(
        stops.filter("owner = 'paragraph'").select("doc_id", "part", F.col("owner_id").cast("int").alias("pos"), "stop_px", "align", "leader"), ["doc_id", "part", "pos"])
    rest = blocks_table.select("doc_id", "part", "pos", "style_id").join(own.select("doc_id", "part", "pos").distinct(), ["doc_id", "part", "pos"], "left_anti")
    styled = rest.join(stops.filter("owner = 'style'").select("doc_id", F.col("owner_id").alias("style_id"), "stop_px", "align", "leader"), ["doc_id", "style_id"])
    return own.select("doc_id", "part", "pos", "stop_px", "align", "leader").unionByName(styled.select("doc_id", "part", "pos", "stop_px", "align", "leader"))


def symbols(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, font, code): symbol-font glyphs."""
    return part_nodes(nodes, BODY, NOTES, BANDS).filter("tag = 'w:sym'").select(
        *KEY, F.col("node_id").alias("pos"), F.coalesce(attr("w:font"), F.lit("")).alias("font"), F.conv(attr("w:char"), 16, 10).try_cast("int").alias("code"))


def map_symbols(glyphs: DataFrame, font_map: DataFrame) -> DataFrame:
    """Add ``char``: the Unicode character of (font, low byte of code), null for fonts without a table.

    ``font_map`` has font, code (0..255) and char; font names compare without case.
    """
    table = font_map.select(F.lower("font").alias("_font"), F.col("code").alias("_low"), "char")
    return glyphs.withColumn("_font", F.lower("font")).withColumn("_low", F.col("code").bitwiseAND(255)).join(table, ["_font", "_low"], "left").drop("_font", "_low")
