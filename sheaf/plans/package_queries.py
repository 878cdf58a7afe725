"""Queries over word-processor packages made from the driver's documents: sources and the tables derived from nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, numbering, references, styles, summaries, threads
from ..sources import docx, lake, odt, packages
from ..sources.nodes import inside
from . import fixtures as fx
from . import package_fixtures as px
from .registry import query

_OPENED: dict = {}


def opened(spark, sf, kind="docx"):
    """(docs, parts, nodes) of the packages; opened and written once per session, as a stored table would be."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _OPENED:
        files = px.docx_files(spark, sf) if kind == "docx" else px.odt_files(spark, sf)
        _OPENED[key] = packages.store_packages(packages.open_packages(files))
    return packages.split_rows(_OPENED[key])


def docx_nodes(spark, sf):
    return opened(spark, sf)[2]


def odt_nodes(spark, sf):
    return opened(spark, sf, "odt")[2]


def numbered(df):
    """Document ids back as numbers, so that both engines agree on their type."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def body_blocks(nodes):
    return docx.blocks(nodes).filter("container = 'w:body'")


def line_of(nodes, *more):
    """(doc_id, block_pos, i): which line of the document a body block was made from. Positions count within a part: rows that may
    stand in other parts too need ``part`` in ``more``."""
    return body_blocks(nodes).select("doc_id", *more, F.col("pos").alias("block_pos"), F.col("seq").alias("i"))


ALL_LINES = """
WITH a AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
, ol AS (SELECT *, i % 6 AS k, CAST(floor(i / 6) AS BIGINT) AS n, substr(t, 1, 5) AS f, substr(t, 6) AS r FROM a)
, l AS (SELECT * FROM ol WHERE doc_id % 50 > 1) """


@query(r"""SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'doc' ELSE 'docx' END AS format,
CASE doc_id % 50 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'unsupported' ELSE 'ok' END AS status FROM documents""")
def open_packages(spark, sf):
    return numbered(opened(spark, sf)[0].select("doc_id", "format", "status"))


@query("SELECT doc_id, 'odt' AS format, 'ok' AS status, CAST(4 AS BIGINT) AS parts FROM documents")
def open_odt_packages(spark, sf):
    docs, parts, _ = opened(spark, sf, "odt")
    return numbered(docs.select("doc_id", "format", "status").join(parts.groupBy("doc_id").agg(F.count("*").alias("parts")), "doc_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'doc' ELSE 'zip' END AS format FROM documents")
def sniff_format(spark, sf):
    files = px.docx_files(spark, sf)
    return numbered(files.select("doc_id", packages.sniff_format(F.col("content")).alias("format")))


@query("SELECT concat('png', doc_id % 5) AS payload, sha256(concat('png', doc_id % 5)) AS sha256, count(*) AS copies FROM documents WHERE doc_id % 50 > 1 GROUP BY ALL")
def package_media(spark, sf):
    """Pictures by content: identical payloads are one medium, however many packages hold it."""
    _, parts, _ = opened(spark, sf)
    names = spark.range(5).select(F.concat(F.lit("png"), F.col("id")).alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    return parts.filter("part like 'word/media/%'").groupBy("sha256").agg(F.count("*").alias("copies")).join(names, "sha256")


BLOCKS_SQL = ALL_LINES + """
SELECT doc_id, i AS seq, ['h', 'li', 'p', 'p', 'p', 'table'][k + 1] AS kind, CASE k WHEN 0 THEN 1 + n % 3 WHEN 1 THEN n % 3 END AS level,
  CASE WHEN k = 2 THEN 'Quote' END AS style_id, CASE WHEN k = 1 THEN CAST(1 + n % 3 AS VARCHAR) END AS num_id, CASE WHEN k = 2 THEN 'justify' END AS align,
  CASE WHEN k = 2 THEN CAST(48 AS BIGINT) END AS indent_px, CASE WHEN k = 2 THEN CAST(1.5 AS DOUBLE) END AS line_height, CASE WHEN k = 2 THEN CAST(16 AS BIGINT) END AS before_px,
  CASE WHEN k = 2 THEN CAST(8 AS BIGINT) END AS after_px, CASE WHEN k = 2 THEN '#ffee00' END AS shading,
  CASE WHEN k = 2 AND n % 3 = 1 THEN 'manual' WHEN k = 3 AND n % 4 = 0 THEN 'auto' END AS page_break, CASE WHEN k = 3 THEN 'ins' END AS rev_para, CASE WHEN k = 3 THEN concat('a', doc_id % 3) END AS rev_author,
  CASE WHEN k = 2 THEN '1 dashed 000000' END AS border_top, CASE WHEN k = 2 THEN '1 solid 12ab34' END AS border_right, CASE WHEN false THEN '' END AS border_bottom, CASE WHEN k = 4 THEN 'figure' END AS caption_kind,
  CASE k WHEN 0 THEN t WHEN 1 THEN concat(t, chr(9), chr(10)) WHEN 2 THEN t WHEN 3 THEN concat(t, 'x') WHEN 4 THEN concat(t, 'go', 'see ', f, i, 'r', i, f) END AS text
FROM l"""


@query(ALL_LINES + """
SELECT doc_id, i AS seq, CASE WHEN k = 4 THEN 'figure' END AS caption_kind, CAST(NULL AS BIGINT) AS caption_at FROM l WHERE k = 4
UNION ALL SELECT doc_id, i, NULL, NULL FROM l WHERE k = 5""")
def docx_captions(spark, sf):
    """Tables are followed by headings here, captions by tables: each caption is seen and none is attached to the wrong kind."""
    b = body_blocks(docx_nodes(spark, sf))
    out = numbering.attach_captions(b, ["doc_id"]).filter("kind = 'table' or caption_kind is not null")
    return numbered(out.select("doc_id", "seq", "caption_kind", "caption_at"))


@query(BLOCKS_SQL.replace("SELECT doc_id, i AS seq,", "SELECT 'w:body' AS container, doc_id, i AS seq,", 1) + """
UNION ALL BY NAME SELECT doc_id, 'w:tc' AS container, CAST(0 AS BIGINT) AS seq, 'p' AS kind, u.x AS text FROM l, unnest([f, r, '', concat('z', i), '']) AS u(x) WHERE k = 5
UNION ALL BY NAME SELECT doc_id, 'w:footnote' AS container, CAST(0 AS BIGINT) AS seq, 'p' AS kind, concat('note ', f) AS text FROM l WHERE k = 4
UNION ALL BY NAME SELECT DISTINCT doc_id, 'w:footnote' AS container, CAST(0 AS BIGINT) AS seq, 'p' AS kind, '' AS text FROM l
UNION ALL BY NAME SELECT DISTINCT doc_id, 'w:hdr' AS container, CAST(0 AS BIGINT) AS seq, 'p' AS kind, concat('header ', doc_id) AS text FROM l""")
def docx_blocks(spark, sf):
    """All blocks of a package: of the body, of table cells, notes and headers."""
    b = docx.blocks(docx_nodes(spark, sf))
    line = lambda s: F.when(F.col(f"borders.{s}").isNotNull(), F.concat_ws(" ", *[F.col(f"borders.{s}.{x}").cast("string") for x in ("px", "style", "hex")])).alias(f"border_{s}")
    return numbered(b.select("doc_id", "container", "seq", "kind", F.col("level").cast("long").alias("level"), "style_id", "num_id", "align", "indent_px", "line_height", "before_px",
                             "after_px", "shading", "page_break", "rev_para", "rev_author", line("top"), line("right"), line("bottom"), "caption_kind", "text"))


@query(ALL_LINES + """
SELECT doc_id, i, f AS text, true AS b, false AS it, false AS u, NULL AS vert, 'FF0000' AS color, NULL AS highlight, CAST(28 AS BIGINT) AS size, 'Arial' AS font, 'Strong' AS char_style, NULL AS rev_kind, NULL AS rev_author FROM l WHERE k = 2 AND f <> ''
UNION ALL SELECT doc_id, i, r, false, true, true, 'super', NULL, 'yellow', NULL, NULL, NULL, NULL, NULL FROM l WHERE k = 2 AND r <> ''
UNION ALL SELECT doc_id, i, f, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL, 'ins', concat('a', doc_id % 3) FROM l WHERE k = 3 AND f <> ''
UNION ALL SELECT doc_id, i, r, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL, 'del', 'b' FROM l WHERE k = 3 AND r <> ''
UNION ALL SELECT doc_id, i, 'x', true, false, false, NULL, NULL, NULL, NULL, NULL, NULL, 'fmt', 'c' FROM l WHERE k = 3
UNION ALL SELECT doc_id, i, u.x, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l, unnest(CASE k WHEN 0 THEN [t] WHEN 1 THEN [concat(t, chr(9), chr(10))] WHEN 4 THEN [f, r, 'go', concat('see ', f), CAST(i AS VARCHAR), concat('r', i), f] END) AS u(x) WHERE u.x <> ''
UNION ALL SELECT doc_id, NULL, u.x, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l, unnest(CASE k WHEN 4 THEN [concat('note ', f)] WHEN 5 THEN [f, r, concat('z', i)] END) AS u(x) WHERE u.x <> ''
UNION ALL SELECT DISTINCT doc_id, NULL::BIGINT, concat('header ', doc_id), false, false, false, NULL, NULL, NULL, NULL::BIGINT, NULL, NULL, NULL, NULL FROM l""")
def docx_runs(spark, sf):
    """Every run of a package; i is null for those of cells, notes and headers."""
    nodes = docx_nodes(spark, sf)
    return numbered(
        docx.runs(nodes).withColumnRenamed("i", "it").join(line_of(nodes, "part"), ["doc_id", "part", "block_pos"], "left").select(
            "doc_id", "i", "text", "b", "it", "u", F.col("vert_align").alias("vert"), "color", "highlight", F.col("size_half_pt").cast("long").alias("size"), "font", "char_style", "rev_kind", "rev_author"))


@query(ALL_LINES + """, c AS (SELECT doc_id, i, rank() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tno, f, r FROM l WHERE k = 5)
SELECT doc_id, tno, row_no, cell_no, colspan, vmerge, is_header, text, cell_left FROM (
  SELECT doc_id, tno, 0 AS row_no, 0 AS cell_no, 1 AS colspan, 'restart' AS vmerge, true AS is_header, f AS text, NULL AS cell_left FROM c
  UNION ALL SELECT doc_id, tno, 0, 1, 2, NULL, true, r, 'off' FROM c UNION ALL SELECT doc_id, tno, 1, 0, 1, 'cont', false, '', NULL FROM c
  UNION ALL SELECT doc_id, tno, 1, 1, 1, NULL, false, concat('z', i), NULL FROM c UNION ALL SELECT doc_id, tno, 1, 2, 1, NULL, false, '', NULL FROM c)""")
def docx_table_cells(spark, sf):
    cells = docx.table_cells(docx_nodes(spark, sf))
    tno = cells.select("doc_id", "table_no").distinct()
    order = numbering.number_within(tno, ["doc_id"], "table_no", "tno")
    out = cells.join(order, ["doc_id", "table_no"]).withColumn("tno", F.col("tno") - 1)
    return numbered(out.select("doc_id", "tno", *[F.col(c).cast("long").alias(c) for c in ("row_no", "cell_no", "colspan")], "vmerge", "is_header", "text", "cell_left"))


@query(ALL_LINES + "SELECT doc_id, count(*) AS tables, '1px solid #000000' AS top, '2px dashed #00FF00' AS inside_h FROM l WHERE k = 5 GROUP BY ALL")
def docx_table_borders(spark, sf):
    return numbered(docx.table_borders(docx_nodes(spark, sf)).groupBy("doc_id", "top", "inside_h").agg(F.count("*").alias("tables")))


@query(ALL_LINES + """SELECT doc_id, i AS comment_id, concat('u', i % 5) AS author, [f, concat('u', i % 5, ' reacted with 👍 x')] AS paras, concat('B', i) AS para_id,
  CASE WHEN i > 4 THEN 'B4' END AS parent_para_id, i = 4 AS done FROM l WHERE k = 4""")
def docx_comments(spark, sf):
    return numbered(docx.comments(docx_nodes(spark, sf)).select("doc_id", "comment_id", "author", "paras", "para_id", "parent_para_id", "done"))


@query(ALL_LINES + "SELECT doc_id, i AS comment_id, CAST(4 AS BIGINT) AS thread_id, i > 4 AS is_reply, trim(f) AS text FROM l WHERE k = 4")
def docx_comment_threads(spark, sf):
    placed = threads.comment_threads(docx.comments(docx_nodes(spark, sf)))
    return numbered(placed.select("doc_id", "comment_id", "thread_id", "is_reply", threads.comment_text(F.col("paras")).alias("text")))


@query(ALL_LINES + """
SELECT doc_id, i, 'xref' AS kind, concat(' REF bm', i % 12, ' \\h ') AS instruction, concat('see ', f) AS cached, concat('bm', i % 12) AS target, 'text' AS shows, NULL AS seq_name FROM l WHERE k = 4
UNION ALL SELECT doc_id, i, 'seq', ' SEQ Figure \\* ARABIC ', CAST(i AS VARCHAR), NULL, NULL, 'Figure' FROM l WHERE k = 4""".replace("\\\\", "\\"))
def docx_fields(spark, sf):
    nodes = docx_nodes(spark, sf)
    return numbered(docx.fields(nodes).join(line_of(nodes, "part"), ["doc_id", "part", "block_pos"]).select("doc_id", "i", "kind", "instruction", "cached", "target", "shows", "seq_name"))


@query(ALL_LINES + "SELECT doc_id, CAST(i AS VARCHAR) AS id, concat('bm', i % 12) AS name, f AS text FROM l WHERE k = 4 AND trim(f) <> ''".replace("f AS text", "trim(regexp_replace(f, '\\s+', ' ', 'g')) AS text"))
def docx_bookmarks(spark, sf):
    """Bookmarks with the text they span: the range joined back to the runs it covers."""
    nodes = docx_nodes(spark, sf)
    ranges = docx.bookmarks(nodes).select("doc_id", F.col("id").alias("name"), "start_pos", "end_pos")
    runs = docx.runs(nodes).filter("part = 'word/document.xml'").select("doc_id", "pos", F.col("block_pos").alias("seq"), "text")
    names = docx.bookmarks(nodes).select("doc_id", "id", "name")
    texts = references.range_text(ranges, runs).withColumnRenamed("name", "id")
    return numbered(names.join(texts, ["doc_id", "id"]).filter("text <> ''"))


@query(ALL_LINES + "SELECT doc_id, 'footnote' AS note_kind, CAST(i AS VARCHAR) AS note_id, concat('note ', f) AS text, i FROM l WHERE k = 4")
def docx_notes(spark, sf):
    nodes = docx_nodes(spark, sf)
    shown = references.attach_notes(docx.note_refs(nodes), docx.notes(nodes)).join(line_of(nodes), ["doc_id", "block_pos"])
    return numbered(shown.select("doc_id", "note_kind", "note_id", "text", "i"))


@query(ALL_LINES + """
SELECT doc_id, 'ins' AS kind, concat('a', doc_id % 3) AS author, count(*) AS n, CAST(sum(length(f)) AS BIGINT) AS chars FROM l WHERE k = 3 AND f <> '' GROUP BY ALL
UNION ALL SELECT doc_id, 'del', 'b', count(*), CAST(sum(length(r)) AS BIGINT) FROM l WHERE k = 3 AND r <> '' GROUP BY ALL
UNION ALL SELECT doc_id, 'paragraph ins', concat('a', doc_id % 3), count(*), CAST(0 AS BIGINT) FROM l WHERE k = 3 GROUP BY ALL
UNION ALL SELECT doc_id, 'format', 'c', count(*), CAST(0 AS BIGINT) FROM l WHERE k = 3 GROUP BY ALL""")
def docx_revisions(spark, sf):
    return numbered(docx.revisions(docx_nodes(spark, sf)).groupBy("doc_id", "kind", "author").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))


@query(ALL_LINES + """
SELECT doc_id, i, CASE WHEN n % 4 = 2 THEN 'continuous' END AS type, CAST(816 AS BIGINT) AS w, CAST(1056 AS BIGINT) AS h, CAST(96 AS DOUBLE) AS m_right, NULL::BIGINT AS cols, true AS rtl, NULL::BIGINT AS page_start, NULL AS line_restart, NULL AS hex FROM l WHERE k = 3 AND n % 2 = 0
UNION ALL SELECT doc_id, NULL, NULL, 794, 1123, 48, 2, false, 3, 'newPage', 'ABCDEF' FROM documents WHERE doc_id % 50 > 1""")
def docx_sections(spark, sf):
    nodes = docx_nodes(spark, sf)
    s = docx.sections(nodes).join(line_of(nodes), ["doc_id", "block_pos"], "left")
    return numbered(s.select("doc_id", "i", "type", "w", "h", "m_right", F.col("cols").cast("long").alias("cols"), "rtl", F.col("page_start").cast("long").alias("page_start"), "line_restart", F.col("border.hex").alias("hex")))


STYLE_ROWS = """(VALUES ('Normal', 'font-size', '11pt', 0), ('Base', 'text-align', 'justify', 0), ('Base', 'margin-top', '16px', 0), ('Base', 'font-weight', 'bold', 0), ('Base', 'font-size', '11pt', 1), ('Base', 'border-left', '2px double #C0FFEE', 0), ('Base', 'padding', '2px 6px', 0),
 ('Quote', 'border-left', '2px double #C0FFEE', 1), ('Quote', 'padding', '2px 6px', 1),
 ('Quote', 'margin-left', '48px', 0), ('Quote', 'font-weight', 'normal', 0), ('Quote', 'font-style', 'italic', 0), ('Quote', 'color', '#336699', 0), ('Quote', 'text-align', 'justify', 1), ('Quote', 'margin-top', '16px', 1), ('Quote', 'font-size', '11pt', 2),
 ('Strong', 'font-weight', 'bold', 0), ('Strong', 'text-decoration', 'underline line-through', 0), ('Heading1', 'font-size', '11pt', 1)) AS v(style_id, prop, value, distance)"""


@query(f"SELECT doc_id, style_id, prop, value, CAST(distance AS BIGINT) AS distance FROM documents CROSS JOIN {STYLE_ROWS} WHERE doc_id % 50 > 1")
def docx_styles(spark, sf):
    """Styles of every package with inheritance resolved inside the package."""
    return numbered(styles.resolve_styles(docx.styles(docx_nodes(spark, sf)), ("doc_id",)))


@query("SELECT doc_id, style_id, display FROM documents CROSS JOIN (VALUES ('Base', 'Base Text'), ('Quote', 'Quote'), ('Strong', 'Strong')) AS v(style_id, display) WHERE doc_id % 50 > 1")
def docx_style_picker(spark, sf):
    return numbered(styles.style_picker(docx.styles(docx_nodes(spark, sf))).select("doc_id", "style_id", "display"))


@query(ALL_LINES + """SELECT doc_id, i, 'word/media/image1.png' AS media, sha256(concat('png', doc_id % 5)) AS sha256, CAST(240 AS BIGINT) AS width, CAST(120 AS BIGINT) AS height, 'square' AS wrap, 'left' AS align,
  CAST(60 AS BIGINT) AS x, true AS abs_x, false AS abs_y, CAST(4 AS BIGINT) AS dist_r, 'image/png' AS mime, true AS shown FROM l WHERE k = 4""")
def docx_images(spark, sf):
    _, parts, nodes = opened(spark, sf)
    images = docx.images(nodes, parts).join(line_of(nodes, "part"), ["doc_id", "part", "block_pos"])
    return numbered(images.select("doc_id", "i", "media", "sha256", "width", "height", "wrap", "align", "x", "abs_x", "abs_y", F.col("dist.r").alias("dist_r"), "mime", "shown"))


@query(ALL_LINES + "SELECT doc_id, 'https://example.org/a?b=1&c=2' AS href, r AS text FROM l WHERE k = 4 UNION ALL SELECT doc_id, '#bm4', 'go' FROM l WHERE k = 4")
def docx_links(spark, sf):
    return numbered(docx.links(docx_nodes(spark, sf)).select("doc_id", "href", "text"))


@query("SELECT doc_id, part, rid, target, target_part FROM documents CROSS JOIN (VALUES ('rId1', 'https://example.org/a?b=1&c=2', 'word/https://example.org/a?b=1&c=2'), ('rId2', 'header1.xml', 'word/header1.xml'), ('rId3', './media/image1.png', 'word/media/image1.png')) AS v(rid, target, target_part) CROSS JOIN (SELECT 'word/document.xml' AS part) WHERE doc_id % 50 > 1")
def docx_relationships(spark, sf):
    rels = docx.relationships(docx_nodes(spark, sf))
    return numbered(references.resolve_rels(rels.select("doc_id", "part", "rid"), rels))


@query("SELECT doc_id, 'header' AS role, 'default' AS variant, 'word/header1.xml' AS band_part, doc_id % 3 = 0 AS even_odd, concat('header ', doc_id) AS text FROM documents WHERE doc_id % 50 > 1")
def docx_bands(spark, sf):
    return numbered(docx.bands(docx_nodes(spark, sf)).select("doc_id", "role", "variant", "band_part", "even_odd", "text"))


@query(ALL_LINES + "SELECT doc_id, f AS base, concat('r', i) AS reading FROM l WHERE k = 4")
def docx_ruby(spark, sf):
    return numbered(docx.ruby(docx_nodes(spark, sf)).select("doc_id", "base", "reading"))


@query(ALL_LINES + """
SELECT 'paragraph property' AS level, 'w:keepNext' AS tag, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE k = 2
UNION ALL SELECT 'run property', 'w:smallCaps', count(*), count(DISTINCT doc_id) FROM l WHERE k = 2
UNION ALL SELECT 'paragraph content', 'w:sdt', count(*), count(DISTINCT doc_id) FROM l WHERE k = 4""")
def passthrough_census(spark, sf):
    return docx.passthrough_census(docx.passthrough(docx_nodes(spark, sf)))


@query("SELECT doc_id, num_id, abstract_id, ordered, CAST(start AS BIGINT) AS start FROM documents CROSS JOIN (VALUES ('1', '7', true, 5), ('2', '8', false, 1), ('3', '7', true, 12)) AS v(num_id, abstract_id, ordered, start) WHERE doc_id % 50 > 1")
def docx_numbering(spark, sf):
    return numbered(docx.numbering(docx_nodes(spark, sf)))


@query(ALL_LINES + """
, it AS (SELECT doc_id, i, n, n % 3 AS level, 1 + n % 3 AS num FROM l WHERE k = 1)
SELECT doc_id, i, CASE WHEN level = 0 AND num = 1 THEN 5 + (SELECT count(*) FROM it x WHERE x.doc_id = it.doc_id AND x.num = 1 AND x.i < it.i) ELSE 1 END AS number FROM it""")
def docx_number_lists(spark, sf):
    """Numbers of the list items of every package, from its own numbering definitions."""
    nodes = docx_nodes(spark, sf)
    b = body_blocks(nodes).join(docx.numbering(nodes).select("doc_id", "num_id", "ordered"), ["doc_id", "num_id"], "left")
    lists = b.select("doc_id", "container_id", F.col("seq").alias("pos"), (F.col("kind") == "li").alias("is_list"), F.coalesce("level", F.lit(0)).alias("level"), "num_id", F.coalesce("ordered", F.lit(False)).alias("ordered"))
    starts = docx.numbering(nodes).select("doc_id", "num_id", "start")
    return numbered(numbering.number_lists(lists, starts, ("doc_id", "container_id")).select("doc_id", F.col("pos").alias("i"), "number"))


@query(ALL_LINES + """SELECT doc_id, i, CASE WHEN n % 2 = 0 THEN 96 ELSE 192 END::BIGINT AS stop_px, CASE WHEN n % 2 = 0 THEN 'left' ELSE 'right' END AS align, CASE WHEN n % 2 = 0 THEN 'dot' END AS leader FROM l WHERE k = 2""")
def docx_tab_stops(spark, sf):
    nodes = docx_nodes(spark, sf)
    out = docx.effective_tab_stops(body_blocks(nodes), docx.tab_stops(nodes)).withColumnRenamed("pos", "block_pos").join(line_of(nodes), ["doc_id", "block_pos"])
    return numbered(out.select("doc_id", "i", "stop_px", "align", "leader"))


@query(ALL_LINES + "SELECT doc_id, i, 'α' AS char FROM l WHERE k = 4")
def map_symbols(spark, sf):
    nodes = docx_nodes(spark, sf)
    table = spark.createDataFrame([("symbol", 0x61, "α"), ("Symbol", 0x62, "β")], "font string, code int, char string")
    glyphs = docx.symbols(nodes).withColumnRenamed("pos", "p").join(docx_nodes(spark, sf).select("doc_id", "part", F.col("node_id").alias("p"), inside("w:p").alias("block_pos")), ["doc_id", "part", "p"])
    return numbered(docx.map_symbols(glyphs, table).join(line_of(nodes), ["doc_id", "block_pos"]).select("doc_id", "i", "char"))


@query(ALL_LINES + """
, s AS (SELECT doc_id, CAST(count(*) FILTER (k IN (2, 3, 4)) AS BIGINT) AS paragraphs, CAST(count(*) FILTER (k = 1) AS BIGINT) AS list_items, CAST(2 * count(*) FILTER (k = 5) AS BIGINT) AS rows, CAST(count(*) FILTER (k = 5) AS BIGINT) AS header_rows, CAST(1 AS BIGINT) AS bands, CAST(count(*) FILTER (k = 0) AS BIGINT) AS headings, CAST(count(*) FILTER (k = 5) AS BIGINT) AS tables, CAST(5 * count(*) FILTER (k = 5) AS BIGINT) AS cells,
   CAST(count(*) FILTER (k = 4) AS BIGINT) AS notes, CAST(count(*) FILTER (k = 4) AS BIGINT) AS images, CAST(2 * count(*) FILTER (k = 4) AS BIGINT) AS links, CAST(count(*) FILTER (k = 4) AS BIGINT) AS bookmarks FROM l GROUP BY doc_id)
SELECT *, CAST(6 AS BIGINT) AS styles, CAST(11 AS BIGINT) AS parts FROM s""")
def doc_summary(spark, sf):
    _, parts, nodes = opened(spark, sf)
    return numbered(summaries.doc_summary(body_blocks(nodes), docx.table_cells(nodes), docx.note_refs(nodes), docx.images(nodes, parts), docx.links(nodes), docx.bookmarks(nodes), docx.styles(nodes), parts, docx.bands(nodes)))


@query(ALL_LINES + """
SELECT doc_id, i, CASE k WHEN 2 THEN list_sort(list_filter([CASE WHEN f <> '' THEN 'b=true,color=FF0000,font=Arial,size=28' END, CASE WHEN r <> '' THEN 'i=true,u=true,highlight=yellow,vert=super' END], lambda x: x IS NOT NULL))
  WHEN 3 THEN list_sort(list_filter([CASE WHEN f <> '' OR r <> '' THEN '' END, 'b=true'], lambda x: x IS NOT NULL)) ELSE [''] END AS formats
FROM l WHERE k IN (1, 3, 4) OR k IN (0, 2) AND t <> ''""")
def run_format_set(spark, sf):
    nodes = docx_nodes(spark, sf)
    out = summaries.run_format_set(docx.runs(nodes).filter("part = 'word/document.xml'"), ["doc_id", "block_pos"]).join(line_of(nodes), ["doc_id", "block_pos"])
    return numbered(out.select("doc_id", "i", F.array_sort("formats").alias("formats")))


@query(ALL_LINES + "SELECT doc_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, ['p', 'li', 'p', 'p', 'p', 'table'][k + 1] AS kind, k FROM l) WHERE k <> 0 GROUP BY ALL UNION ALL SELECT doc_id, 'h', count(*) FROM l WHERE k = 0 GROUP BY ALL UNION ALL SELECT page_id, 'page', CAST(1 AS BIGINT) FROM pages")
def union_formats(spark, sf):
    """One table out of two formats: what a format lacks is null."""
    b = numbered(body_blocks(docx_nodes(spark, sf))).select("doc_id", "kind", "text", "style_id")
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("kind"), F.col("html").alias("text"), "url")
    return lake.union_formats(b, pages).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


# --- odt --------------------------------------------------------------------------------------------------------

def odt_lines(nodes):
    """(doc_id, pos, i): the line a top-level block was made from; one block per line except lists and tables."""
    tops = nodes.filter("part = 'content.xml'").filter((F.try_element_at("trail", F.lit(-2)) == "office:text") & (F.col("tag") != "text:tracked-changes"))
    return numbering.number_within(tops.select("doc_id", "node_id"), ["doc_id"], "node_id", "i").select("doc_id", F.col("node_id").alias("pos"), (F.col("i") - 1).alias("i"))


@query(ALL_LINES + """
SELECT doc_id, i, ['h', 'p', 'p', 'p', 'p', 'table'][k + 1] AS kind, CASE WHEN k = 0 THEN least(3, 1 + n % 5) END AS level, CASE WHEN k IN (0, 2) THEN concat('P', n % 3) END AS style_id,
  k IN (0, 2) AND n % 3 = 1 AS break_before, k IN (0, 2) AND n % 3 IN (0, 1) AS break_after, CASE WHEN k IN (0, 2) AND n % 3 = 1 THEN 'Wide' END AS master, CASE WHEN k = 4 THEN 'table' END AS caption_kind,
  CASE k WHEN 0 THEN t WHEN 2 THEN concat(f, 'a   ', chr(9), chr(10), r, '!') WHEN 3 THEN t WHEN 4 THEN concat(f, r, f) END AS text
FROM ol WHERE k <> 1
UNION ALL BY NAME SELECT doc_id, 'li' AS kind, u.level, u.text, false AS break_before, false AS break_after
  FROM (SELECT doc_id, unnest([{'level': 0, 'text': f}, {'level': 1, 'text': r}, {'level': 0, 'text': concat('z', i)}]) AS u FROM ol WHERE k = 1)
UNION ALL BY NAME SELECT doc_id, 'p' AS kind, concat('note ', f) AS text, false AS break_before, false AS break_after FROM ol WHERE k = 4
UNION ALL BY NAME SELECT doc_id, 'p' AS kind, u.x AS text, false AS break_before, false AS break_after FROM ol, unnest([f, r, concat('z', i)]) AS u(x) WHERE k = 5""")
def odt_blocks(spark, sf):
    """All blocks of a package; i is null for those of lists, notes and cells."""
    nodes = odt_nodes(spark, sf)
    b = odt.blocks(nodes).join(odt_lines(nodes), ["doc_id", "pos"], "left")
    return numbered(b.select("doc_id", "i", "kind", F.col("level").cast("long").alias("level"), "style_id", "break_before", "break_after", "master", "caption_kind", "text"))


@query(ALL_LINES + """
SELECT doc_id, f AS text, CAST(0 AS BIGINT) AS level, count(*) AS n FROM ol WHERE k = 1 GROUP BY ALL UNION ALL SELECT doc_id, r, 1, count(*) FROM ol WHERE k = 1 GROUP BY ALL UNION ALL SELECT doc_id, concat('z', i), 0, count(*) FROM ol WHERE k = 1 GROUP BY ALL""")
def odt_list_items(spark, sf):
    b = odt.blocks(odt_nodes(spark, sf)).filter("kind = 'li'")
    return numbered(b.groupBy("doc_id", "text", F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n")))


@query(ALL_LINES + """
SELECT doc_id, i, f AS text, true AS b, false AS it, 'super' AS vert, '00FF00' AS color, CAST(12.3 AS DOUBLE) AS size FROM ol WHERE k = 2 AND f <> ''
UNION ALL SELECT doc_id, i, 'a', false, false, NULL, NULL, NULL FROM ol WHERE k = 2 UNION ALL SELECT doc_id, i, '   ', false, false, NULL, NULL, NULL FROM ol WHERE k = 2
UNION ALL SELECT doc_id, i, chr(9), false, false, NULL, NULL, NULL FROM ol WHERE k = 2 UNION ALL SELECT doc_id, i, chr(10), false, false, NULL, NULL, NULL FROM ol WHERE k = 2
UNION ALL SELECT doc_id, i, r, false, true, NULL, NULL, NULL FROM ol WHERE k = 2 AND r <> '' UNION ALL SELECT doc_id, i, '!', true, true, 'super', '00FF00', 12.3 FROM ol WHERE k = 2
UNION ALL SELECT doc_id, i, u.x, false, false, NULL, NULL, NULL FROM ol, unnest(CASE k WHEN 0 THEN [t] WHEN 3 THEN [f, r] WHEN 4 THEN [f, r, f] END) AS u(x) WHERE u.x <> ''
UNION ALL SELECT doc_id, NULL, u.x, false, false, NULL, NULL, NULL FROM ol, unnest(CASE k WHEN 1 THEN [f, r, concat('z', i)] WHEN 4 THEN [f, 'two', concat('note ', f)] WHEN 5 THEN [f, r, concat('z', i)] END) AS u(x) WHERE u.x <> ''""")
def odt_runs(spark, sf):
    nodes = odt_nodes(spark, sf)
    r = odt.runs(nodes).withColumnRenamed("i", "it").drop("pos").withColumnRenamed("block_pos", "pos").join(odt_lines(nodes), ["doc_id", "pos"], "left")
    return numbered(r.select("doc_id", "i", "text", "b", "it", F.col("vert_align").alias("vert"), "color", F.col("size_pt").alias("size")))


@query(ALL_LINES + """
SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, CAST(cell_no AS BIGINT) AS cell_no, CAST(cs AS BIGINT) AS colspan, CAST(rs AS BIGINT) AS rowspan, hd AS is_header, CASE c WHEN 0 THEN f WHEN 1 THEN r WHEN 2 THEN concat('z', i) ELSE '' END AS text, count(*) AS n
FROM ol CROSS JOIN (VALUES (0, 0, 0, 2, 1, true), (1, 0, 1, 1, 2, true), (2, 1, 0, 1, 1, false), (3, 1, 1, 1, 1, false)) AS v(c, row_no, cell_no, cs, rs, hd) WHERE k = 5 GROUP BY ALL""")
def odt_table_cells(spark, sf):
    c = odt.table_cells(odt_nodes(spark, sf))
    cols = [F.col(x).cast("long").alias(x) for x in ("row_no", "cell_no", "colspan", "rowspan")]
    return numbered(c.groupBy("doc_id", *cols, "is_header", "text").agg(F.count("*").alias("n")))


@query("SELECT doc_id, style_id, side, CAST(px AS BIGINT) AS px, style, hex FROM documents CROSS JOIN (VALUES ('CE1', 'top', 1, 'solid', '0000ff'), ('CE1', 'right', 1, 'solid', '0000ff'), ('CE1', 'bottom', 1, 'solid', '0000ff'), ('CE2', 'top', 2, 'double', '123456'), ('CE2', 'right', 1, 'solid', '0000ff'), ('CE2', 'bottom', 1, 'solid', '0000ff')) AS v(style_id, side, px, style, hex)")
def odt_cell_borders(spark, sf):
    return numbered(odt.cell_borders(odt_nodes(spark, sf)))


@query(ALL_LINES + "SELECT doc_id, concat('n', i) AS comment_id, 'u' AS author, trim(concat(f, chr(10), 'two')) AS text, n % 2 = 0 AS done FROM ol WHERE k = 4")
def odt_comments(spark, sf):
    return numbered(odt.comments(odt_nodes(spark, sf)).select("doc_id", "comment_id", "author", "text", "done"))


@query(ALL_LINES + """
SELECT doc_id, 'xref' AS kind, concat('bm', i % 12) AS target, 'page' AS shows, NULL AS seq_name, '5' AS cached, count(*) AS n FROM ol WHERE k = 4 GROUP BY ALL
UNION ALL SELECT doc_id, 'seq', NULL, NULL, 'Table', CAST(i AS VARCHAR), count(*) FROM ol WHERE k = 4 GROUP BY ALL UNION ALL SELECT doc_id, 'PAGE', NULL, NULL, NULL, '1', count(*) FROM ol WHERE k = 4 GROUP BY ALL""")
def odt_fields(spark, sf):
    return numbered(odt.fields(odt_nodes(spark, sf)).groupBy("doc_id", "kind", "target", "shows", "seq_name", "cached").agg(F.count("*").alias("n")))


@query(ALL_LINES + "SELECT doc_id, concat('bm', i % 12) AS name, false AS point, count(*) AS n FROM ol WHERE k = 4 GROUP BY ALL UNION ALL SELECT doc_id, concat('pt', i), true, 1 FROM ol WHERE k = 4")
def odt_bookmarks(spark, sf):
    b = odt.bookmarks(odt_nodes(spark, sf)).withColumn("point", F.col("start_pos") == F.col("end_pos"))
    return numbered(b.groupBy("doc_id", "name", "point").agg(F.count("*").alias("n")))


@query(ALL_LINES + "SELECT doc_id, concat('f', i) AS note_id, CASE WHEN n % 2 = 0 THEN 'footnote' ELSE 'endnote' END AS note_kind, concat('note ', f) AS text FROM ol WHERE k = 4")
def odt_notes(spark, sf):
    return numbered(odt.notes(odt_nodes(spark, sf)).select("doc_id", "note_id", "note_kind", "text"))


@query(ALL_LINES + "SELECT doc_id, 'insertion' AS kind, 'first hand' AS author, NULL AS deleted, count(*) AS n FROM ol WHERE k = 3 GROUP BY ALL UNION ALL SELECT doc_id, 'deletion', 'second hand', concat('struck line', chr(10), 'and its sequel'), count(*) FROM ol WHERE k = 3 GROUP BY ALL")
def odt_revisions(spark, sf):
    return numbered(odt.revisions(odt_nodes(spark, sf)).groupBy("doc_id", "kind", "author", "deleted").agg(F.count("*").alias("n")))


@query("SELECT doc_id, master, is_default, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(mt AS BIGINT) AS m_top, CAST(cols AS BIGINT) AS cols, CAST(gap AS BIGINT) AS col_gap, vertical FROM documents CROSS JOIN (VALUES ('Standard', true, 816, 1056, 76, NULL, NULL, false), ('Wide', false, 1056, 816, 96, 2, 48, true)) AS v(master, is_default, w, h, mt, cols, gap, vertical)")
def odt_master_pages(spark, sf):
    m = odt.master_pages(odt_nodes(spark, sf))
    return numbered(m.select("doc_id", "master", "is_default", "w", "h", "m_top", F.col("cols").cast("long").alias("cols"), "col_gap", "vertical"))


@query("SELECT doc_id, 'Standard' AS master, 'header' AS role, 'default' AS variant, concat('head ', doc_id) AS text FROM documents UNION ALL SELECT doc_id, 'Standard', 'footer', 'even', 'left' FROM documents")
def odt_bands(spark, sf):
    return numbered(odt.bands(odt_nodes(spark, sf)))


@query(ALL_LINES + "SELECT doc_id, sha256(concat('png', doc_id % 5)) AS sha256, CAST(96 AS BIGINT) AS width, 'pic' AS alt, 'tight' AS wrap, CAST(48 AS DOUBLE) AS x, true AS abs_x, CAST(10 AS BIGINT) AS dist_t, count(*) AS n FROM ol WHERE k = 4 GROUP BY ALL")
def odt_images(spark, sf):
    _, parts, nodes = opened(spark, sf, "odt")
    return numbered(odt.images(nodes, parts).groupBy("doc_id", "sha256", "width", "alt", "wrap", "x", "abs_x", F.col("dist.t").alias("dist_t")).agg(F.count("*").alias("n")))


@query(ALL_LINES + "SELECT doc_id, concat('https://e.org/', i) AS href, r AS text FROM ol WHERE k = 4")
def odt_links(spark, sf):
    return numbered(odt.links(odt_nodes(spark, sf)).select("doc_id", "href", "text"))


@query(ALL_LINES + "SELECT doc_id, f AS base, concat('r', i) AS reading FROM ol WHERE k = 4")
def odt_ruby(spark, sf):
    return numbered(odt.ruby(odt_nodes(spark, sf)).select("doc_id", "base", "reading"))


@query(ALL_LINES + """
, li AS (SELECT doc_id, i, n, n % 2 = 1 AS cont, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM ol WHERE k = 1)
SELECT doc_id, j, CAST(CASE WHEN cont THEN 6 ELSE 4 END AS BIGINT) AS start FROM li""")
def odt_list_starts(spark, sf):
    """Starts of the top-level ordered lists: continued lists go on where the list before them ended."""
    nodes = odt_nodes(spark, sf)
    top = odt.lists(nodes).filter("level = 1").join(odt.list_levels(nodes).filter("level = 1 and ordered").select("doc_id", "list_style", F.col("start").alias("start0")), ["doc_id", "list_style"])
    ordered = numbering.number_within(numbering.number_lists_continued(top, "pos"), ["doc_id"], "pos", "j")
    return numbered(ordered.select("doc_id", "j", "start"))


@query("SELECT doc_id, style_id, CAST(stop AS BIGINT) AS stop_px, align, leader FROM documents CROSS JOIN (VALUES ('P1', 192, 'decimal', 'dot'), ('Body', 96, 'left', NULL)) AS v(style_id, stop, align, leader)")
def odt_tab_stops(spark, sf):
    return numbered(odt.tab_stops(odt_nodes(spark, sf)))


@query("SELECT doc_id, level, tag FROM documents CROSS JOIN (VALUES ('text property', 'fo:letter-spacing'), ('paragraph property', 'fo:text-indent')) AS v(level, tag)")
def odt_passthrough(spark, sf):
    return numbered(odt.passthrough(odt_nodes(spark, sf)).select("doc_id", "level", "tag"))


@query("SELECT doc_id, style_id, align, CAST(indent AS BIGINT) AS indent_px, CAST(lh AS DOUBLE) AS line_height, CAST(bp AS BIGINT) AS before_px, ba AS break_after FROM documents CROSS JOIN (VALUES ('P0', 'right', 96, 1.5, 48, NULL), ('P1', NULL, NULL, NULL, NULL, NULL), ('Body', NULL, NULL, NULL, NULL, 'page'), ('P2', NULL, NULL, NULL, NULL, NULL)) AS v(style_id, align, indent, lh, bp, ba)")
def odt_paragraph_formats(spark, sf):
    return numbered(odt.paragraph_formats(odt_nodes(spark, sf)).select("doc_id", "style_id", "align", "indent_px", "line_height", "before_px", "break_after"))


# --- geometry and capabilities ----------------------------------------------------------------------------------

@query(fx.sql("""
, s AS (SELECT doc_id, pos, 600 + 10 * (quantity - 48) AS w, quantity FROM fx_marks WHERE boundary)
SELECT doc_id, pos, CAST(CASE WHEN pos % 3 = 0 THEN 1200 ELSE w END AS BIGINT) AS w, CASE WHEN pos % 3 = 0 THEN 'landscape' WHEN w > 700 THEN 'landscape' ELSE 'portrait' END AS orient,
  CASE WHEN pos % 3 <> 0 THEN CASE WHEN pos % 2 = 0 THEN 'custom' ELSE 'equal' END WHEN pos % 2 = 0 AND quantity % 2 = 0 THEN 'custom' ELSE 'equal' END AS columns,
  CAST(CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 + quantity % 2 END AS BIGINT) AS cols, CASE WHEN pos % 3 = 0 THEN CAST(12 AS BIGINT) END AS border_eighths, CASE WHEN pos % 3 = 0 THEN CAST(31 AS BIGINT) END AS border_space, CASE WHEN pos % 3 <> 0 THEN CAST(7 AS BIGINT) END AS page_start
FROM s""".replace("pos % 2 = 0 AND quantity % 2 = 0", "pos % 2 = 0 AND 1 + quantity % 2 = 2"), "fx_marks"))
def apply_page_setup(spark, sf):
    """Page setup of every third section changed: landscape, two columns, a border, page numbers no longer restarted."""
    m = fx.marks(spark, sf).filter("boundary")
    w = 600 + 10 * (F.col("quantity") - 48)
    sections = m.select("doc_id", "pos", w.cast("long").alias("w"), F.lit(700).cast("long").alias("h"), (1 + F.col("quantity") % 2).cast("long").alias("cols"),
                        F.when(F.col("pos") % 2 == 0, "custom").otherwise("equal").alias("columns"), F.lit(7).cast("long").alias("page_start"))
    edits = m.filter("pos % 3 = 0").select("doc_id", "pos", F.lit(1200).cast("long").alias("w"), F.lit(800).cast("long").alias("h"), F.lit(2).cast("long").alias("cols"),
                                           F.lit(2).alias("border_px"), F.lit(40).alias("border_space_pt"))
    out = layout.apply_page_setup(sections, edits, ["doc_id", "pos"])
    return out.select("doc_id", "pos", "w", "orient", "columns", "cols", "border_eighths", "border_space", "page_start")


@query("""
WITH f AS (SELECT doc_id, ['docx', 'odt', 'doc'][doc_id % 3 + 1] AS format, ['comments', 'commentReplies', 'pageBreak', 'equations', 'pageVAlign'][CAST(floor(doc_id / 3) AS BIGINT) % 5 + 1] AS feature FROM documents)
SELECT * FROM f WHERE format = 'docx' OR (format = 'odt' AND feature IN ('comments', 'equations')) OR (format = 'doc' AND feature IN ('comments', 'pageBreak'))""")
def supported_features(spark, sf):
    pickers = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", pickers(["docx", "odt", "doc"], F.col("doc_id") % 3).alias("format"),
        pickers(["comments", "commentReplies", "pageBreak", "equations", "pageVAlign"], F.floor(F.col("doc_id") / 3) % 5).alias("feature"))
    return references.supported_features(rows, layout.capabilities(spark)).select("doc_id", "format", "feature")
