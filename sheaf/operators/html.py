"""HTML pages as document tables: cut into tokens once, then filters, groups and joins.

A page is cut into tags and text in one pass that also knows what encloses each token (``html_tokens``), so everything after
that is ordinary rows (page_id, tok_no) without a window. End tags that HTML lets authors omit (p, li, td, tr) are not needed: a
new element of the kind ends the old one because positions are looked up, not nested.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, is_blank, round_half_up
from .html_tokens import BLOCK_TAGS, INLINE_TAGS, read_context, read_pages
from .scan import running_sum, scan

# The vocabulary pasted pages are reduced to; element names are in ``html_tokens``.
RUN_STYLES = [
    "font-weight", "font-style", "text-decoration", "text-decoration-line", "color", "background-color", "font-size",
    "font-family", "vertical-align",
]
BLOCK_STYLES = ["text-align", "margin-left"]
UNSET_VALUES = ["normal", "none", "inherit", "initial", "unset", "transparent"]
SAFE_LINK = "(?i)^(https?:|mailto:|#)"
MAX_IMAGE_PX = 600
QUOTE_INDENT_PX = 40
INTERNAL_MARKS = "data-docx-(xml|rpr|ppr|numid)|docx-cell|docx-table|docx-ins|docx-del"


def decode_entities(text: Column) -> Column:
    """Numeric and named (Latin-1, Greek, symbol) character references; each is decoded once."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))], F.lit("apos"), F.lit("'"))
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.length(ref) - 2)
        valid = lambda code: F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char(code))
        dec = F.regexp_extract(body, r"^#([0-9]{1,7})$", 1).try_cast("long")
        hexa = F.conv(F.nullif(F.regexp_extract(body, r"^#[xX]([0-9A-Fa-f]{1,6})$", 1), F.lit("")), 16, 10).try_cast("long")
        return F.coalesce(F.try_element_at(names, body), valid(dec), valid(hexa), ref)

    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    pieces, refs = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.transform(
        F.arrays_zip(pieces.alias("a"), F.transform(refs, one).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, decoded; null when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), decode_entities(value))


def is_internal_html(html: Column) -> Column:
    """Markup copied from a document editor of the same vocabulary, taken as it is."""
    return html.rlike(INTERNAL_MARKS)


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, tok_no, token, tag, closing): tags and text in order; tag is null for text."""
    return read_pages(pages, context_too=False)


def html_context(pages: DataFrame) -> DataFrame:
    """Tokens with what encloses them: counts of open inline formats (n_bold without bold elements whose style says normal, which
    are wrappers), lists, tables, quotes and pre; the last link, block tag, item of the list, row or cell of the table, and table
    before each; row_no (rows of the table so far) and outer_at (the last outermost table)."""
    return read_context(pages)


def html_runs(pages: DataFrame) -> DataFrame:
    """Text runs: (page_id, block_at, tok_no, text, b, i, u, s, sub, sup, mono, href, in_pre) in the run vocabulary.

    White space collapses to one space except in pre; no-break spaces stay. Unsafe links lose their address but keep
    their text. ``block_at`` is the token that opened the block: the list item inside lists, else the last block tag.
    """
    return _rows(pages).filter("not shape").drop("shape", "tag")


def _rows(pages: DataFrame) -> DataFrame:
    """The rows of ``html_runs``, and those that shape blocks without being text (``shape``): pictures, and the tags of
    outermost tables and of rows in tables, as rows of a block of kind ``table`` where the outermost table opens."""
    c = html_context(pages)
    href = attribute(F.col("link.token"), "href")
    in_link = F.coalesce(~F.col("link.closing"), F.lit(False))
    raw = decode_entities(F.col("token"))
    in_pre = F.col("n_pre") > 0
    text = (
        F.when(F.col("tag").isNotNull(), "\n").when(in_pre, raw)
        .otherwise(F.regexp_replace(raw, r"[\t\n\r ]+", " ")))
    in_item = (F.col("n_list") > 0) & (F.col("item.tag") == "li") & ~F.col("item.closing")
    block_at = F.when(in_item & (F.col("n_table") == 0), F.col("item.at")).otherwise(F.coalesce(F.col("block.at"), F.lit(-1)))
    heading = F.col("block.tag").rlike("^h[1-6]$") & ~F.col("block.closing")
    kind = F.when(in_item, "li").when(in_pre, "pre").when(F.coalesce(heading, F.lit(False)), "h").otherwise("p")
    # A block inside a list item or a heading starts on a new line of it.
    inner = in_item & F.col("tag").isin(*BLOCK_TAGS) & ~F.col("tag").isin("li", "ul", "ol")
    keep = F.col("tag").isNull() | (((F.col("tag") == "br") | inner) & ~F.col("closing"))
    opens = (F.col("tag") == "table") & ~F.col("closing") & (F.col("n_table") == 1)
    of_table = opens | (F.col("tag") == "tr") & ~F.col("closing") & (F.col("n_table") > 0)
    shape = F.coalesce(of_table | (F.col("tag") == "img") & (F.col("n_table") == 0), F.lit(False))
    block_at = F.when(of_table, F.col("outer_at")).otherwise(block_at)
    kind = F.when(of_table, "table").otherwise(kind)
    return c.filter(keep | shape).select(
        "page_id", block_at.cast("long").alias("block_at"), F.col("tok_no").cast("long").alias("tok_no"), F.when(shape, "").otherwise(text).alias("text"), shape.alias("shape"), "tag",
        (F.col("n_bold") > 0).alias("b"), *[(F.col(f"n_{k}") > 0).alias(k) for k in INLINE_TAGS if k != "b"],
        F.when(in_link & href.rlike(SAFE_LINK), href).alias("href"), in_pre.alias("in_pre"), kind.alias("kind"),
        F.when(kind == "h", F.substr(F.col("block.tag"), F.lit(2)).cast("int")).when(
            in_item, (F.col("n_list") - 1).cast("int")).otherwise(0).alias("level"),
        F.when(in_item, F.col("list_tag") == "ol").alias("ordered"),
        (F.col("n_quote") > 0).alias("quoted"), (F.col("n_table") > 0).alias("in_table"),
        F.when((kind != "li") & ~F.col("block.closing"), attribute(F.col("block.token"), "style")).alias("style"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, level, ordered, indent_px, text): the blocks of a page that hold text or a picture, and its tables.

    Blocks in a quote are indented unless they bring their own indent. Preformatted text becomes one block per line,
    blank lines kept and one trailing line break dropped. A table with rows is one block of kind ``table`` without text;
    ``html_cells`` has what is in it.
    """
    runs = _rows(pages).filter(~F.col("in_table") | F.col("shape"))
    joined = runs.groupBy("page_id", "block_at").agg(
        F.min_by(F.struct("kind", "level", "ordered", "quoted", "style"), "tok_no").alias("_k"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "text"))), lambda r: r["text"]), "").alias("text"),
        F.bool_or(F.col("tag").eqNullSafe("tr")).alias("_rowed"), F.bool_or(F.col("tag").eqNullSafe("img")).alias("_picture"))
    margin = F.regexp_extract("_k.style", r"(?i)margin-left\s*:\s*([0-9.]+)px", 1)
    shown = F.when(F.col("_k.kind") == "table", F.col("_rowed")).otherwise((F.col("_k.kind") == "pre") | F.col("_picture") | ~is_blank(F.col("text")))
    rows = joined.filter(shown).select(
        "page_id", "block_at", F.col("_k.kind").alias("kind"), F.col("_k.level").alias("level"), F.col("_k.ordered").alias("ordered"),
        F.coalesce(margin.try_cast("double").cast("int"), F.when(F.col("_k.quoted"), QUOTE_INDENT_PX).otherwise(0)).alias("indent_px"),
        F.posexplode(F.when(F.col("_k.kind") == "pre", F.split(F.regexp_replace("text", "\n$", ""), "\n")).otherwise(
            F.array(collapse_keeping_breaks(F.col("text"))))).alias("line", "text"))
    # Lines of one page in order; the number of lines is bounded by the page.
    placed = rows.withColumn("_at", F.struct("block_at", "line"))
    return number_blocks(placed)


def inline_pages(blocks: DataFrame) -> DataFrame:
    """Pages that are nothing but one plain paragraph: pasted as inline text rather than as a block."""
    alone = (F.count("*") == 1) & F.bool_and((F.col("kind") == "p") & (F.col("indent_px") == 0))
    return blocks.groupBy("page_id").agg(alone.alias("inline"))


def collapse_keeping_breaks(text: Column) -> Column:
    """Trim the block and the space around its line breaks."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r" *\n *", "\n"), r"^\n+|\n+$", "")


def number_blocks(rows: DataFrame) -> DataFrame:
    """Dense block numbers per page. (block_at, line) is packed into one position that keeps the order."""
    packed = rows.withColumn("_pos", F.col("block_at") * F.lit(1 << 24) + F.col("line") + F.lit(1 << 24))
    out = scan(packed, ["page_id"], "_pos", longest=0, _n=running_sum(F.lit(1)))
    return out.select("page_id", (F.col("_n") - 1).alias("seq"), "kind", "level", "ordered", "indent_px", "text")


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, tok_no, href, safe, text): every link with its text; only http, https, mailto and #anchors are safe."""
    c = html_context(pages).filter(~F.col("link.closing"))
    opens = F.col("tok_no") == F.col("link.at")
    links = c.filter(F.col("tag").isNull() | opens).groupBy("page_id", F.col("link.at").alias("tok_no")).agg(
        F.max(F.when(opens, attribute(F.col("token"), "href"))).alias("href"),
        F.array_sort(F.collect_list(F.when(~opens, F.struct("tok_no", decode_entities(F.col("token")).alias("text"))))).alias("_t"))
    return links.filter(F.col("href").isNotNull()).select(
        "page_id", F.col("tok_no").cast("long").alias("tok_no"), "href", F.col("href").rlike(SAFE_LINK).alias("safe"),
        collapse_space(F.array_join(F.transform("_t", lambda r: r["text"]), "")).alias("text"))


def safe_links(links: DataFrame) -> DataFrame:
    """Links with unsafe addresses removed (``href`` null), their text kept."""
    return links.withColumn("href", F.when(F.col("href").rlike(SAFE_LINK), F.col("href")))


def html_images(pages: DataFrame) -> DataFrame:
    """(page_id, tok_no, src, alt, width, height, external): images, scripts rejected, width capped in proportion."""
    img = tokens(pages).filter((F.col("tag") == "img") & ~F.col("closing"))
    token, style = F.col("token"), attribute(F.col("token"), "style")
    src = attribute(token, "src")
    px = lambda name: F.coalesce(
        F.nullif(attribute(token, name).try_cast("double"), F.lit(0.0)),
        round_half_up(F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:\s*([0-9.]+)", 1).try_cast("double")).cast("double"), F.lit(0.0))
    w, h = px("width"), px("height")
    return img.filter(src.isNotNull() & (src != "") & ~src.rlike("(?i)^javascript:")).select(
        "page_id", F.col("tok_no").cast("long").alias("tok_no"), src.alias("src"), attribute(token, "alt").alias("alt"),
        F.when(w > 0, F.least(w, F.lit(float(MAX_IMAGE_PX)))).alias("width"),
        F.when((w > 0) & (h > 0), round_half_up(F.least(w, F.lit(float(MAX_IMAGE_PX))) * (h / w))).alias("height"),
        (~src.startswith("data:")).alias("external"))


def style_declarations(pages: DataFrame) -> DataFrame:
    """(page_id, tok_no, tag, prop, value): the inline style declarations the document vocabulary keeps."""
    style = attribute(F.col("token"), "style")
    cut = tokens(pages).filter(F.col("tag").isNotNull() & ~F.col("closing") & style.isNotNull()).select(
        "page_id", F.col("tok_no").cast("long").alias("tok_no"), "tag", F.explode(F.split(style, ";")).alias("_d"))
    parts = cut.select("page_id", "tok_no", "tag", F.lower(F.trim(F.split("_d", ":", 2).getItem(0))).alias("prop"),
                       F.trim(F.split("_d", ":", 2).getItem(1)).alias("value"))
    block = F.col("tag").isin(*BLOCK_TAGS)
    allowed = F.when(block, F.col("prop").isin(*BLOCK_STYLES)).otherwise(F.col("prop").isin(*RUN_STYLES))
    clear = F.col("value").rlike(r"^rgba\([^)]*,\s*0(\.0+)?\s*\)$")
    sized = (F.col("prop") != "font-size") | F.col("value").rlike(r"^[0-9.]+(px|pt)$")
    return parts.filter(allowed & (F.col("value") != "") & ~F.col("value").isin(*UNSET_VALUES) & ~clear & sized)


def html_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_at, row_no, cell_no, colspan, rowspan, is_header, text): the cells of the tables of a page."""
    c = html_context(pages)
    tag, opening = F.col("tag"), ~F.col("closing")
    token = F.col("token")
    # Rows and cells are counted inside the innermost table: the last table opened at this depth. A cell is the token that opens it
    # and the texts that name that token; they meet in one group, so that each page is read and dealt once.
    opens = tag.isin("td", "th") & opening
    texts = tag.isNull() & F.col("cell.tag").isin("td", "th") & ~F.col("cell.closing")
    inside = c.filter((F.col("n_table") > 0) & F.coalesce(opens | texts, F.lit(False))).select(
        "page_id", F.when(opens, F.col("tok_no")).otherwise(F.col("cell.at")).alias("cell_at"),
        F.when(opens, F.struct(
            F.col("table_at").cast("long").alias("table_at"), F.col("row_no").alias("row"), (tag == "th").alias("is_header"),
            F.coalesce(attribute(token, "colspan").try_cast("int"), F.lit(1)).alias("colspan"),
            F.coalesce(attribute(token, "rowspan").try_cast("int"), F.lit(1)).alias("rowspan"))).alias("_c"),
        F.when(texts, F.struct("tok_no", decode_entities(token).alias("text"))).alias("_x"))
    cells = inside.repartition("page_id").groupBy("page_id", "cell_at").agg(
        F.max("_c").alias("_c"), F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda r: r["text"]), "").alias("text"))
    cells = cells.filter("_c is not null").select("page_id", "cell_at", "_c.*", "text")
    numbered = scan(cells, ["page_id", "table_at", "row"], "cell_at", longest=0, cell_no=running_sum(F.lit(1)))
    first = F.min("row").over(Window.partitionBy("page_id", "table_at"))  # the rows of one page
    return numbered.select(
        "page_id", "table_at", (F.col("row") - first).alias("row_no"), "cell_no", "colspan", "rowspan", "is_header", collapse_space(F.col("text")).alias("text"))
