"""Queries whose result depends on document order: numbering, sections, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import history, numbering, paging
from ..operators.scan import extent
from . import fixtures as fx
from .registry import query

STEP, CONTENT = fx.PAGE_STEP, fx.CONTENT_HEIGHT


def longs(df, *names):
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


@query(fx.sql("""SELECT doc_id, pos, seq_name, row_number() OVER (PARTITION BY doc_id, seq_name ORDER BY pos) AS number FROM fx_marks""", "fx_marks"))
def number_sequences(spark, sf):
    return numbering.number_sequences(fx.marks(spark, sf)).select("doc_id", "pos", "seq_name", "number")


@query(fx.sql("""SELECT doc_id, pos, note_kind, row_number() OVER (PARTITION BY doc_id, note_kind ORDER BY pos) AS number FROM fx_marks""", "fx_marks"))
def number_notes(spark, sf):
    return numbering.number_notes(fx.marks(spark, sf)).select("doc_id", "pos", "note_kind", "number")


@query(fx.sql("""SELECT doc_id, pos, CAST(CASE note_kind WHEN 'footnote' THEN 0 ELSE 1 END AS BIGINT) AS part FROM fx_marks""", "fx_marks"))
def all_notes(spark, sf):
    m = fx.marks(spark, sf)
    both = numbering.all_notes(m.filter("note_kind = 'footnote'"), m.filter("note_kind = 'endnote'"))
    return longs(both.select("doc_id", "pos", "part"), "part")


LISTS_SQL = """
, gaps AS (SELECT *, max(CASE WHEN NOT is_list THEN pos ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS list_at FROM fx_marks)
, items AS (SELECT * FROM gaps WHERE is_list)
, nested AS (SELECT *, greatest(
      CASE WHEN level > 0 THEN max(CASE WHEN level = 0 THEN pos END) OVER w END,
      CASE WHEN level > 1 THEN max(CASE WHEN level = 1 THEN pos END) OVER w END,
      CASE WHEN level > 2 THEN max(CASE WHEN level = 2 THEN pos END) OVER w END) AS parent
    FROM items WINDOW w AS (PARTITION BY doc_id, list_at ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, heads AS (SELECT doc_id, list_at, min(pos) AS first_at, arg_min(num_id, pos) AS num_id FROM items GROUP BY ALL)
, advance AS (SELECT h.*, (SELECT count(*) FROM items i WHERE i.doc_id = h.doc_id AND i.list_at = h.list_at AND i.num_id = h.num_id AND i.level = 0) AS n FROM heads h)
, starts AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY doc_id, num_id ORDER BY first_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS list_start FROM advance)
"""


@query(fx.sql(LISTS_SQL + """
SELECT n.doc_id, n.pos, n.list_at, n.parent, CAST(s.list_start AS BIGINT) AS list_start,
       CAST(row_number() OVER (PARTITION BY n.doc_id, n.list_at, n.parent, n.level ORDER BY n.pos)
            + CASE WHEN n.level = 0 THEN s.list_start - 1 ELSE 0 END AS BIGINT) AS number
FROM nested n JOIN starts s USING (doc_id, list_at)""", "fx_marks"))
def number_lists(spark, sf):
    return numbering.number_lists(fx.marks(spark, sf)).select("doc_id", "pos", "list_at", "parent", "list_start", "number")


@query(fx.sql(LISTS_SQL + "SELECT doc_id, pos, list_at, parent FROM nested", "fx_marks"))
def list_nesting(spark, sf):
    items = numbering.list_items(fx.marks(spark, sf), ["doc_id"])
    return numbering.list_nesting(items, ["doc_id"]).select("doc_id", "pos", "list_at", "parent")


@query(fx.sql("""
, k AS (SELECT *, CASE WHEN is_list THEN num_id END AS kind FROM fx_marks)
, p AS (SELECT *, kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS opens FROM k)
SELECT doc_id, pos, CAST(CASE WHEN kind IS NOT NULL THEN sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) END AS BIGINT) AS group_no FROM p""", "fx_marks"))
def list_groups(spark, sf):
    return numbering.list_groups(fx.marks(spark, sf), F.when(F.col("is_list"), F.col("num_id")), ["doc_id"]).select("doc_id", "pos", "group_no")


@query(fx.sql("""
, l AS (SELECT doc_id, pos, quantity AS n, boundary OR level = 0 AS fresh, level + 1 AS start0 FROM fx_marks WHERE is_list)
, t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM l)
, b AS (SELECT *, last_value(CASE WHEN fresh THEN start0 - total END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS base FROM t)
SELECT doc_id, pos, CAST(coalesce(base, 1) + total AS BIGINT) AS start FROM b""", "fx_marks"))
def number_continued_lists(spark, sf):
    lists = fx.marks(spark, sf).filter("is_list").select(
        "doc_id", "pos", F.col("quantity").alias("n_items"), (~(F.col("boundary") | (F.col("level") == 0))).alias("continues"),
        (F.col("level") + 1).alias("start0"))
    return numbering.number_lists_continued(lists, "pos").select("doc_id", "pos", "start")


def headings(spark, sf):
    b = fx.blocks(spark, sf)
    return b.withColumn("heading", F.when(F.col("kind") == "h", F.col("level")))


@query(fx.sql("""
, h AS (SELECT *, CASE WHEN kind = 'h' THEN level END AS lv FROM fx_blocks)
, p AS (SELECT doc_id, seq,
    max(CASE WHEN lv = 1 THEN seq END) OVER w AS a1, max(CASE WHEN lv = 2 THEN seq END) OVER w AS a2, max(CASE WHEN lv = 3 THEN seq END) OVER w AS a3
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT p.doc_id, CAST(p.seq AS BIGINT) AS seq, b1.text AS h1, CASE WHEN a2 > coalesce(a1, -1) THEN b2.text END AS h2,
       CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN b3.text END AS h3
FROM p LEFT JOIN fx_blocks b1 ON b1.doc_id = p.doc_id AND b1.seq = a1 LEFT JOIN fx_blocks b2 ON b2.doc_id = p.doc_id AND b2.seq = a2
LEFT JOIN fx_blocks b3 ON b3.doc_id = p.doc_id AND b3.seq = a3""", "fx_blocks"))
def heading_path(spark, sf):
    return longs(numbering.heading_path(headings(spark, sf)).select("doc_id", "seq", "h1", "h2", "h3"), "seq")


@query(fx.sql("SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(level AS BIGINT) AS heading, text FROM fx_blocks WHERE kind = 'h'", "fx_blocks"))
def outline(spark, sf):
    return longs(numbering.outline(headings(spark, sf)), "seq", "heading")


@query(fx.sql("""
, b AS (SELECT doc_id, seq, CASE WHEN seq % 13 <> 5 THEN concat('id', seq % 7) END AS bid FROM fx_blocks)
SELECT doc_id, CAST(seq AS BIGINT) AS seq,
  CASE WHEN bid IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, bid ORDER BY seq) = 1 THEN bid
       ELSE sha256(concat(doc_id, '|', seq, '|', coalesce(bid, ''))) END AS block_id FROM b""", "fx_blocks"))
def dedupe_block_ids(spark, sf):
    b = fx.blocks(spark, sf).select("doc_id", "seq", F.when(F.col("seq") % 13 != 5, F.concat(F.lit("id"), F.col("seq") % 7)).alias("block_id"))
    return longs(numbering.dedupe_block_ids(b), "seq")


@query(fx.sql("""
, n AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) + 2 AS line_no FROM fx_blocks WHERE NOT forced)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, line_no FROM n WHERE line_no % 5 = 0""", "fx_blocks"))
def line_numbers(spark, sf):
    lines = fx.blocks(spark, sf).withColumn("counted", ~F.col("forced"))
    return longs(numbering.line_numbers(lines, interval=5, start=3).select("doc_id", "seq", "line_no"), "seq")


@query(fx.sql("""
, k AS (SELECT doc_id, seq, ['table', 'figure', 'p'][length(text) % 3 + 1] AS kind, [NULL, 'table', 'figure'][length(text) % 3 + 1] AS caption_kind FROM fx_blocks)
, n AS (SELECT *, lead(caption_kind) OVER (PARTITION BY doc_id ORDER BY seq) AS nk FROM k)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN kind IN ('table', 'figure') AND nk = kind THEN CAST(seq + 1 AS BIGINT) END AS caption_at FROM n""", "fx_blocks"))
def attach_captions(spark, sf):
    n = F.length("text") % 3
    b = fx.blocks(spark, sf).select(
        "doc_id", "seq", F.element_at(F.array(F.lit("table"), F.lit("figure"), F.lit("p")), n + 1).alias("kind"),
        F.element_at(F.array(F.lit(None), F.lit("table"), F.lit("figure")), n + 1).alias("caption_kind"))
    return longs(numbering.attach_captions(b, ["doc_id"]).select("doc_id", "seq", "caption_at"), "seq")


def with_geometry(spark, sf):
    return fx.marks(spark, sf).withColumn("b_w", F.when(F.col("boundary"), 600 + 10 * (F.col("quantity") - 48))).withColumn(
        "b_cols", F.when(F.col("boundary") & (F.col("quantity") == 49), 2))


@query(fx.sql("""
, g AS (SELECT doc_id, pos, CASE WHEN boundary THEN pos END AS b_at FROM fx_marks)
, n AS (SELECT doc_id, pos, min(b_at) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT n.doc_id, n.pos, CAST(coalesce(600 + 10 * (m.quantity - 48), 794) AS BIGINT) AS w, CAST(1123 AS BIGINT) AS h,
       CAST(CASE WHEN b IS NULL THEN 1 WHEN m.quantity = 49 THEN 2 END AS BIGINT) AS cols,
       CAST(CASE WHEN m.quantity = 50 THEN 5 ELSE 2 END AS BIGINT) AS line_interval, CASE WHEN m.quantity = 48 THEN 'page' ELSE 'document' END AS line_restart
FROM n LEFT JOIN fx_marks m ON m.doc_id = n.doc_id AND m.pos = n.b""", "fx_marks"))
def section_geometry_trailing(spark, sf):
    at = F.col("boundary")
    marks = with_geometry(spark, sf).withColumns({
        "b_h": F.lit(None).cast("int"), "b_line_interval": F.when(at & (F.col("quantity") == 50), 5), "b_line_restart": F.when(at & (F.col("quantity") == 48), "page")})
    out = numbering.section_of_block(marks, ["w", "h", "cols", "line_interval", "line_restart"], {"w": 794, "h": 1123, "cols": 1, "line_interval": 2, "line_restart": "document"})
    return longs(out.select("doc_id", "pos", "w", "h", "cols", "line_interval", "line_restart"), "w", "h", "cols", "line_interval")


@query(fx.sql("""
, n AS (SELECT doc_id, pos, max(CASE WHEN boundary THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM fx_marks)
SELECT n.doc_id, n.pos, CAST(coalesce(600 + 10 * (m.quantity - 48), 794) AS BIGINT) AS w
FROM n LEFT JOIN fx_marks m ON m.doc_id = n.doc_id AND m.pos = n.b""", "fx_marks"))
def section_geometry_leading(spark, sf):
    out = numbering.section_of_block(with_geometry(spark, sf), ["w"], {"w": 794}, trailing=False)
    return longs(out.select("doc_id", "pos", "w"), "w")


@query(fx.sql("""
SELECT doc_id, pos, CAST(coalesce(sum(boundary::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS trailing,
  CAST(sum((boundary AND pos > 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS leading FROM fx_marks""", "fx_marks"))
def segment_sections(spark, sf):
    trailing = paging.section_numbers(fx.marks(spark, sf), order="pos").withColumnRenamed("section", "trailing")
    return paging.section_numbers(trailing, leading=True, order="pos").select("doc_id", "pos", "trailing", F.col("section").alias("leading"))


def fold_sql(forced: str = "false", reserve: str = "0") -> str:
    return f"""
    f(doc_id, seq, page, y, height_px, spacer) AS (
    SELECT doc_id, seq, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(height_px AS BIGINT), CAST(NULL AS BIGINT) FROM b WHERE seq = 0
    UNION ALL
    SELECT doc_id, seq, CASE WHEN turn THEN page + ahead ELSE page END, CASE WHEN turn THEN 0 ELSE y END, h,
           CASE WHEN turn THEN nullif(ahead * {STEP} - y, 0) END
    FROM (SELECT f.doc_id, b.seq, f.page, f.y + f.height_px AS y, CAST(b.height_px AS BIGINT) AS h,
                 greatest(1, CAST(ceil((f.y + f.height_px) / {STEP}) AS BIGINT)) AS ahead,
                 f.y + f.height_px > 0 AND ({forced} OR f.y + f.height_px + b.height_px > {CONTENT} - {reserve} + 1) AS turn
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.seq = f.seq + 1))"""


PAGED_SQL = fx.sql(", b AS (SELECT * FROM fx_blocks)," + fold_sql("b.forced"), "fx_blocks", recursive=True)


@query(PAGED_SQL + " SELECT doc_id, CAST(seq AS BIGINT) AS seq, page, CAST(y AS DOUBLE) AS offset_px, CAST(spacer AS DOUBLE) AS spacer_px FROM f")
def paginate(spark, sf):
    return paging.paginate(fx.blocks(spark, sf), STEP, CONTENT)


@query(PAGED_SQL + """ SELECT doc_id, page, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq, count(*) AS n_blocks FROM f GROUP BY ALL""")
def doc_pages(spark, sf):
    return paging.doc_pages(paging.paginate(fx.blocks(spark, sf), STEP, CONTENT))


@query(PAGED_SQL + f""" SELECT doc_id, CAST(greatest(arg_max(page, seq) + 1, ceil(arg_max(page * {STEP} + y + height_px, seq) / {STEP})) AS BIGINT) AS cards FROM f GROUP BY doc_id""")
def card_counts(spark, sf):
    b = fx.blocks(spark, sf)
    return paging.card_counts(paging.paginate(b, STEP, CONTENT), b, STEP)


@query(fx.sql("""
, m AS (SELECT doc_id, seq, seq % 17 = 16 AS is_marker, length(text) % 23 = 0 AS has_marker FROM fx_blocks)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, coalesce(lag(is_marker) OVER (PARTITION BY doc_id ORDER BY seq), false)
       OR (has_marker AND seq > 0 AND NOT is_marker) AS forced FROM m""", "fx_blocks"))
def forced_breaks(spark, sf):
    b = fx.blocks(spark, sf).withColumn("is_marker", F.col("seq") % 17 == 16).withColumn("has_marker", F.length("text") % 23 == 0)
    return longs(paging.forced_breaks(b.drop("forced")).select("doc_id", "seq", "forced"), "seq")


@query(PAGED_SQL + """
SELECT b.doc_id, CAST(b.seq AS BIGINT) AS seq, CAST(b.level AS BIGINT) AS level, b.text, f.page + 1 AS page
FROM b JOIN f USING (doc_id, seq) WHERE b.kind = 'h'""")
def table_of_contents(spark, sf):
    b = fx.blocks(spark, sf)
    pages = paging.paginate(b, STEP, CONTENT).select("doc_id", "seq", (F.col("page") + 1).alias("page"))
    entries = numbering.outline(headings(spark, sf)).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("heading").cast("long").alias("level"), "text")
    return entries.join(pages, ["doc_id", "seq"])


@query(PAGED_SQL + """
, p AS (SELECT DISTINCT doc_id, page, (doc_id % 2 = 0) AS title_page, (doc_id % 3 = 0) AS even_odd, (doc_id % 5 <> 0) AS has_first, (doc_id % 7 <> 0) AS has_even FROM f)
SELECT doc_id, page, CASE WHEN title_page AND page = 0 THEN CASE WHEN has_first THEN 'first' ELSE 'default' END
       WHEN even_odd AND page % 2 = 1 AND has_even THEN 'even' ELSE 'default' END AS band FROM p""")
def band_for_page(spark, sf):
    pages = paging.paginate(fx.blocks(spark, sf), STEP, CONTENT).select("doc_id", "page").distinct()
    d = F.col("doc_id")
    flags = pages.select("*", (d % 2 == 0).alias("title_page"), (d % 3 == 0).alias("even_odd"), (d % 5 != 0).alias("has_first"), (d % 7 != 0).alias("has_even"))
    return numbering.band_for_page(flags).select("doc_id", "page", "band")


@query(PAGED_SQL + """
, p AS (SELECT DISTINCT doc_id, page FROM f)
SELECT doc_id, page, CASE doc_id % 3 WHEN 0 THEN CAST(5 + page AS VARCHAR)
  WHEN 1 THEN ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx'][5 + page]
  ELSE chr(CAST(64 + 5 + page AS INT)) END AS label FROM p""")
def page_labels(spark, sf):
    pages = paging.paginate(fx.blocks(spark, sf), STEP, CONTENT).select("doc_id", "page").distinct()
    fmt = F.when(F.col("doc_id") % 3 == 1, "lowerRoman").when(F.col("doc_id") % 3 == 2, "upperLetter")
    return pages.select("doc_id", "page", fields.page_number(F.lit(5) + F.col("page"), fmt).alias("label"))


@query(PAGED_SQL + """
, c AS (SELECT doc_id, max(page) + 1 AS cards FROM f GROUP BY doc_id)
SELECT f.doc_id, CAST(f.seq AS BIGINT) AS seq, ['PAGE', 'NUMPAGES', 'DATE'][f.seq % 3 + 1] AS kind,
  CASE f.seq % 3 WHEN 0 THEN CAST(f.page + 1 AS VARCHAR) WHEN 1 THEN CAST(c.cards AS VARCHAR) ELSE 'cached' END AS shown
FROM f JOIN c USING (doc_id)""")
def refresh_page_fields(spark, sf):
    paged = paging.paginate(fx.blocks(spark, sf), STEP, CONTENT)
    found = paged.select("doc_id", "seq", F.element_at(F.array(F.lit("PAGE"), F.lit("NUMPAGES"), F.lit("DATE")), (F.col("seq") % 3 + 1).cast("int")).alias("kind"),
                         F.lit("cached").alias("cached"))
    return paging.refresh_page_fields(found, paged, paging.page_counts(paged)).select("doc_id", "seq", "kind", "shown")


MARK_BLOCKS_SQL = fx.sql(", b AS (SELECT doc_id, pos - 1 AS seq, 20 AS height_px, note_kind, boundary, level, quantity FROM fx_marks),", "fx_marks", recursive=True)


def mark_blocks(spark, sf):
    return fx.marks(spark, sf).select("doc_id", (F.col("pos") - 1).alias("seq"), F.lit(20).alias("height_px"), "note_kind", "boundary", "level", "quantity")


NOTES_SQL = MARK_BLOCKS_SQL + fold_sql() + f"""
, r AS (SELECT f.doc_id, f.page, 8 + 40 * count(*) AS px FROM f JOIN b USING (doc_id, seq) WHERE b.note_kind = 'footnote' AND b.quantity % 5 = 0 GROUP BY ALL)
, g(doc_id, seq, page, y, height_px) AS (
    SELECT doc_id, seq, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(height_px AS BIGINT) FROM b WHERE seq = 0
    UNION ALL
    SELECT t.doc_id, t.seq, CASE WHEN turn THEN page + 1 ELSE page END, CASE WHEN turn THEN 0 ELSE y END, h
    FROM (SELECT g.doc_id, b.seq, g.page, g.y + g.height_px AS y, CAST(b.height_px AS BIGINT) AS h,
                 g.y + g.height_px > 0 AND g.y + g.height_px + b.height_px > {CONTENT} - coalesce(r.px, 0) + 1 AS turn
          FROM g JOIN b ON b.doc_id = g.doc_id AND b.seq = g.seq + 1 LEFT JOIN r ON r.doc_id = g.doc_id AND r.page = g.page) t)
SELECT doc_id, seq, page, CAST(y AS DOUBLE) AS offset_px FROM g"""


@query(NOTES_SQL)
def footnote_reserve(spark, sf):
    b = mark_blocks(spark, sf)
    refs = b.filter("note_kind = 'footnote' and quantity % 5 = 0").select("doc_id", "seq", F.lit(40).alias("height_px"))
    return paging.paginate_with_notes(b, refs, STEP, CONTENT).select("doc_id", "seq", "page", "offset_px")


@query(fx.sql(f"""
, s AS (SELECT doc_id, pos, coalesce(sum(boundary::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM fx_marks)
, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) - 1 AS i FROM s)
, p AS (SELECT *, CAST(floor(i / (floor(({CONTENT} - 200 * (section % 4)) / 20))) AS BIGINT) AS page_in_section FROM l)
, c AS (SELECT doc_id, section, max(page_in_section) + 1 AS cards FROM p GROUP BY ALL)
, o AS (SELECT *, coalesce(sum(cards) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT p.doc_id, CAST(p.section AS BIGINT) AS section, p.pos - 1 AS seq, CAST(p.page_in_section + o.before AS BIGINT) AS page, p.page_in_section
FROM p JOIN o USING (doc_id, section)""", "fx_marks"))
def paginate_sections(spark, sf):
    """Four page sizes take turns over the sections of a document."""
    less = 200 * (F.col("section") % 4)
    b = mark_blocks(spark, sf)
    longest = extent(b, "seq")
    sized = paging.section_numbers(b, longest=longest).withColumns({"step": STEP - less, "content": CONTENT - less})
    return paging.paginate_sections(sized, "step", "content", longest)


@query(fx.sql("""
, r AS (SELECT l_orderkey AS table_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row_no,
               CAST(l_quantity AS INT) * 8 AS h FROM lineitem)
, t AS (SELECT table_no, sum(h) AS total, count(*) AS n, 900 - table_no % 900 AS room FROM r GROUP BY table_no)
, f(table_no, row_no, fragment, acc, lim) AS (
   SELECT r.table_no, r.row_no, CAST(0 AS BIGINT), CAST(r.h AS BIGINT), CASE WHEN t.room >= 40 THEN t.room ELSE 900 END
   FROM r JOIN t USING (table_no) WHERE r.row_no = 0 AND t.total > 902 AND t.n >= 2
   UNION ALL
   SELECT f.table_no, r.row_no, CASE WHEN f.acc > 0 AND f.acc + r.h > f.lim - 2 THEN f.fragment + 1 ELSE f.fragment END,
          CASE WHEN f.acc > 0 AND f.acc + r.h > f.lim - 2 THEN r.h ELSE f.acc + r.h END,
          CASE WHEN f.acc > 0 AND f.acc + r.h > f.lim - 2 THEN 900 ELSE f.lim END
   FROM f JOIN r ON r.table_no = f.table_no AND r.row_no = f.row_no + 1)
SELECT table_no, row_no, fragment FROM f""", "fx_blocks", recursive=True))
def split_tall(spark, sf):
    li = fx.with_positions(fx.table(spark, sf, "lineitem").withColumn("table_no", F.col("l_orderkey")), ["table_no"],
                           ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], name="row_no", start=0)
    rows = li.select("table_no", "row_no", (F.col("l_quantity").cast("int") * 8).alias("height_px"))
    tables = rows.select("table_no").distinct().withColumn("offset_px", F.col("table_no") % 900)
    return paging.split_tall(rows, tables, 900)


@query(fx.sql("""
SELECT doc_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rank FROM fx_edits) WHERE rank <= 50""", "fx_edits"))
def bounded_history(spark, sf):
    return longs(history.bounded_history(fx.edits(spark, sf)).select("doc_id", "event_id", "rank"), "rank")


@query(fx.sql("""
, p AS (SELECT *, lag(ts) OVER w AS pt, lag(coalesce_key) OVER w AS pk FROM fx_edits WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id))
SELECT doc_id, event_id, CAST(sum(CASE WHEN coalesce_key = pk AND ts <= pt + INTERVAL 30 MINUTE THEN 0 ELSE 1 END)
   OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS BIGINT) AS run_no FROM p""", "fx_edits"))
def edit_runs(spark, sf):
    return history.edit_runs(fx.edits(spark, sf), idle="30 minutes").select("doc_id", "event_id", "run_no")


@query(fx.sql("""
SELECT doc_id, step, op, state, undo_depth, redo_depth FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) - 1 AS step, 'push' AS op, CAST(event_id AS VARCHAR) AS state,
         least(50, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id)) AS undo_depth, CAST(0 AS BIGINT) AS redo_depth FROM fx_edits)""", "fx_edits"))
def undo_of_pushes(spark, sf):
    """Replaying pushes only: the newest state, at most fifty steps back, nothing to redo."""
    ops = fx.with_positions(fx.edits(spark, sf), ["doc_id"], ["ts", "event_id"], name="at", start=0).select(
        "doc_id", "at", F.lit("push").alias("op"), F.col("event_id").cast("string").alias("state"))
    return history.undo_redo(ops).withColumn("op", F.lit("push")).select("doc_id", F.col("at").alias("step"), "op", "state", "undo_depth", "redo_depth")


@query()
def undo_redo(spark, sf):
    """Pushes mixed with undo and redo, replayed per document."""
    ops = fx.with_positions(fx.edits(spark, sf), ["doc_id"], ["ts", "event_id"], name="at", start=0)
    op = F.when(F.col("kind") == "deleted", "undo").when(F.col("kind") == "done", "redo").otherwise("push")
    return history.undo_redo(ops.select("doc_id", "at", op.alias("op"), F.col("block_id").alias("state")))
