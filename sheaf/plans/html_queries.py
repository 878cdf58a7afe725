"""Queries over HTML pages: the page as document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, html
from ..sources import lake
from ..streaming.feeds import shared_folder
from . import fixtures as fx
from .registry import query


def pages(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", "html")


# Markup put behind the heading of every page, so that quotes, preformatted text, tables, pictures and nested lists occur.
SNIPPET = (
    '<blockquote><p>q{id}</p></blockquote><pre>a{id}\n\n b\n</pre>'
    '<p style="text-align:center; color:red">s <b style="font-weight:normal">w <b>x{id}</b></b> <span style="color:#ff0000;font-size:12px;font-weight:normal">y</span></p>'
    '<table><tr><th>h{id}<td colspan="2">c</tr><tr><td rowspan=2>r<td>z<td>zz</tr><tr><td>u</table>'
    '<img src="http://e.org/{id}.png" width="{w}" height="300" alt="A"><img src="javascript:no"><a href="javascript:x">bad</a> <a href="mailto:m{id}@e.org">mail</a>'
    '<ol><li>one<ul><li>sub{id}</ul><li>two<p>more</p></ol>')


def decorated(spark, sf):
    pieces = SNIPPET.replace("{id}", "\0id\0").replace("{w}", "\0w\0").split("\0")
    named = {"id": F.col("page_id").cast("string"), "w": (500 + F.col("page_id") % 200).cast("string")}
    snippet = F.concat(*[named.get(p, F.lit(p)) for p in pieces])
    return pages(spark, sf).withColumn("html", F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), snippet)))


PAGES_SQL = r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
       '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g') AS html FROM pages)
, k AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS n, unnest(l) AS tok FROM (SELECT page_id, regexp_extract_all(html, '<[^<>]*>|[^<]+') AS l FROM c))
, t AS (SELECT *, nullif(lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS tag, starts_with(tok, '</') AS closing FROM k)
, w AS (SELECT *, sum(CASE WHEN tag = 'ul' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER o AS lists,
    sum(CASE WHEN tag IN ('b', 'strong') THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER o AS bold,
    max(CASE WHEN tag IN ('article', 'div', 'footer', 'h1', 'li', 'nav', 'p', 'ul', 'body', 'html') THEN n END) OVER o AS block_n,
    max(CASE WHEN tag IN ('li', 'ul') THEN n END) OVER o AS item_n, max(CASE WHEN tag = 'a' THEN n END) OVER o AS link_n FROM t WINDOW o AS (PARTITION BY page_id ORDER BY n))
, x AS (SELECT w.*, coalesce(w.lists > 0 AND i.tag = 'li' AND NOT i.closing, false) AS in_item, coalesce(b.tag = 'h1' AND NOT b.closing, false) AS in_h
    FROM w LEFT JOIN t i ON i.page_id = w.page_id AND i.n = w.item_n LEFT JOIN t b ON b.page_id = w.page_id AND b.n = w.block_n)
, r AS (SELECT page_id, n, CASE WHEN in_item THEN item_n ELSE coalesce(block_n, -1) END AS block_at, CASE WHEN in_item THEN 'li' WHEN in_h THEN 'h' ELSE 'p' END AS kind, bold > 0 AS b, lists,
    CASE WHEN tag = 'br' THEN chr(10) ELSE regexp_replace(replace(replace(replace(replace(tok, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\t\n\r ]+', ' ', 'g') END AS text
    FROM x WHERE tag IS NULL OR (tag = 'br' AND NOT closing)) """


@query(PAGES_SQL + r"""
, g AS (SELECT page_id, block_at, arg_min(kind, n) AS kind, arg_min(lists, n) AS lists, string_agg(text, '' ORDER BY n) AS text FROM r GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_at) - 1 AS seq, kind, CAST(CASE kind WHEN 'h' THEN 1 WHEN 'li' THEN lists - 1 ELSE 0 END AS BIGINT) AS level,
   CASE WHEN kind = 'li' THEN false END AS ordered, regexp_replace(regexp_replace(trim(text, ' '), ' *\n *', chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text
FROM g WHERE regexp_replace(text, '[\s\x{00A0}]', '', 'g') <> ''""")
def html_blocks(spark, sf):
    return html.html_blocks(pages(spark, sf)).select("page_id", "seq", "kind", F.col("level").cast("long").alias("level"), "ordered", "text")


@query(PAGES_SQL + "SELECT page_id, block_at, n AS tok_no, kind, text, b FROM r")
def html_runs(spark, sf):
    return html.html_runs(pages(spark, sf)).select("page_id", "block_at", "tok_no", "kind", "text", "b")


@query(PAGES_SQL + r"""
SELECT page_id, n AS tok_no, href, regexp_matches(href, '(?i)^(https?:|mailto:|#)') AS safe, CASE WHEN regexp_matches(href, '(?i)^(https?:|mailto:|#)') THEN href END AS kept
FROM (SELECT page_id, n, regexp_extract(tok, 'href="([^"]*)"', 1) AS href FROM t WHERE tag = 'a' AND NOT closing)""")
def html_links(spark, sf):
    links = html.html_links(pages(spark, sf)).select("page_id", "tok_no", "href", "safe")
    kept = html.safe_links(links).select("page_id", "tok_no", F.col("href").alias("kept"))
    return links.join(kept, ["page_id", "tok_no"])


DECORATION = """(VALUES (1, 'p', 0, 40, NULL, 'q{id}'), (2, 'pre', 0, 0, NULL, 'a{id}'), (3, 'pre', 0, 0, NULL, ''), (4, 'pre', 0, 0, NULL, ' b'), (5, 'p', 0, 0, NULL, 's w x{id} y'),
  (6, 'table', 0, 0, NULL, ''), (7, 'p', 0, 0, NULL, 'bad mail'), (8, 'li', 0, 0, true, 'one'), (9, 'li', 1, 0, false, 'sub{id}'), (10, 'li', 0, 0, true, 'two' || chr(10) || 'more')) AS v(off, kind, level, indent, ordered, text)"""


@query(PAGES_SQL + rf"""
, g AS (SELECT page_id, block_at, arg_min(kind, n) AS kind, arg_min(lists, n) AS lists, string_agg(text, '' ORDER BY n) AS text FROM r GROUP BY ALL)
, o AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_at) - 1 AS seq, kind, CAST(CASE kind WHEN 'h' THEN 1 WHEN 'li' THEN lists - 1 ELSE 0 END AS BIGINT) AS level, CAST(0 AS BIGINT) AS indent_px,
   CASE WHEN kind = 'li' THEN false END AS ordered, regexp_replace(regexp_replace(trim(text, ' '), ' *\n *', chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text
   FROM g WHERE regexp_replace(text, '[\s\x{{00A0}}]', '', 'g') <> '')
, h AS (SELECT page_id, seq AS head FROM o WHERE kind = 'h')
SELECT page_id, CAST(seq + CASE WHEN seq > head THEN 10 ELSE 0 END AS BIGINT) AS seq, kind, level, indent_px, ordered, text FROM o JOIN h USING (page_id)
UNION ALL SELECT page_id, CAST(head + v.off AS BIGINT), v.kind, CAST(v.level AS BIGINT), CAST(v.indent AS BIGINT), v.ordered, replace(v.text, '{{id}}', CAST(page_id AS VARCHAR)) FROM h CROSS JOIN {DECORATION}""")
def html_block_kinds(spark, sf):
    """Whole decorated pages: their own blocks around a quote, preformatted lines, a table, pictures and nested lists."""
    return html.html_blocks(decorated(spark, sf)).select(
        "page_id", "seq", "kind", F.col("level").cast("long").alias("level"), F.col("indent_px").cast("long").alias("indent_px"), "ordered", "text")


LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'


def with_links(spark, sf, to):
    """Decorated pages whose navigation links have become ``to``, in which $1 is an address and $2 a text."""
    return decorated(spark, sf).withColumn("html", F.regexp_replace("html", LINK, to))


#: Every navigation link of a page: its place, address and text.
LINKS_SQL = rf"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS a, regexp_extract_all(html, '{LINK}', 2) AS b FROM pages)
, u AS (SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS i, unnest(a) AS a, unnest(b) AS b FROM m)
, links AS (SELECT page_id, i, replace(replace(a, '&quot;', '"'), '&amp;', '&') AS address, replace(replace(b, '&quot;', '"'), '&amp;', '&') AS text FROM u) """


@query(PAGES_SQL + """SELECT page_id, text, kind = 'h' AS b FROM r
UNION ALL SELECT page_id, v.text || CASE WHEN v.text = 'x' THEN CAST(page_id AS VARCHAR) ELSE '' END, v.b FROM pages CROSS JOIN (VALUES ('s ', false), ('w ', false), ('x', true), (' ', false), ('y', false)) AS v(text, b)""")
def html_bold_wrappers(spark, sf):
    """All runs of pages whose bold elements say that they are normal, and whose headings hold a plain one, which emboldens; and of
    the paragraph with both kinds in each other."""
    off = F.replace("html", F.lit("<b>"), F.lit('<b style="font-weight: normal">'))
    for old, new in (("<strong>", '<strong style="font-weight:400">'), ("<h1>", "<h1><b>"), ("</h1>", "</b></h1>")):
        off = F.replace(off, F.lit(old), F.lit(new))
    whole = html.html_runs(pages(spark, sf).withColumn("html", off))
    nested = html.html_runs(decorated(spark, sf)).filter(F.col("style").contains("text-align:center"))
    return whole.union(nested).select("page_id", "text", "b")


@query(LINKS_SQL + """
SELECT page_id, concat('http://e.org/', page_id, '.png') AS src, 'A' AS alt, CAST(least(600, 500 + page_id % 200) AS DOUBLE) AS width,
  CAST(floor(least(600, 500 + page_id % 200) * (300 / (500 + page_id % 200)::DOUBLE) + 0.5) AS BIGINT) AS height, true AS external FROM pages
UNION ALL SELECT page_id, address, text, 600.0::DOUBLE, CAST(77 AS BIGINT), true FROM links
UNION ALL SELECT page_id, concat('data:', address), NULL, 20.0::DOUBLE, NULL, false FROM links""")
def html_images(spark, sf):
    """Pictures of three kinds: one of its own for each page, and two for each of its links."""
    return html.html_images(with_links(spark, sf, '<li><img src="$1" alt="$2" width="700" height="90"><img src="data:$1" style="width: 20px"></li>')).drop("tok_no")


@query(LINKS_SQL + """
SELECT page_id, v.tag, v.prop, v.value FROM pages CROSS JOIN (VALUES ('p', 'text-align', 'center'), ('span', 'color', '#ff0000'), ('span', 'font-size', '12px')) AS v(tag, prop, value)
UNION ALL SELECT page_id, 'span', 'font-family', trim(address) FROM links UNION ALL SELECT page_id, 'div', 'text-align', 'right' FROM links""")
def style_whitelist(spark, sf):
    """Declarations kept: those of the snippet, and of the elements that each link of a page has become; inline properties do not
    count on blocks, nor block properties inline."""
    to = '<li><span style="font-family: $1; text-align: left">$2</span><div style="TEXT-ALIGN:right;font-family:$1"></div></li>'
    return html.style_declarations(with_links(spark, sf, to)).drop("tok_no")


@query(LINKS_SQL + r"""
SELECT page_id, CAST(v.r AS BIGINT) AS row_no, CAST(v.c AS BIGINT) AS col, CAST(v.cs AS BIGINT) AS colspan, CAST(v.rs AS BIGINT) AS rowspan, v.h AS is_header, replace(v.t, '{id}', CAST(page_id AS VARCHAR)) AS text
FROM pages CROSS JOIN (VALUES (0, 0, 1, 1, true, 'h{id}'), (0, 1, 2, 1, false, 'c'), (1, 0, 1, 2, false, 'r'), (1, 1, 1, 1, false, 'z'), (1, 2, 1, 1, false, 'zz'), (2, 1, 1, 1, false, 'u')) AS v(r, c, cs, rs, h, t)
UNION ALL SELECT page_id, 2 * i, 0, 1, 2, true, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) FROM links
UNION ALL SELECT page_id, 2 * i, 1, 2, 1, false, trim(regexp_replace(address, '[\s\x{00A0}]+', ' ', 'g')) FROM links UNION ALL SELECT page_id, 2 * i + 1, 1, 1, 1, false, 'under it' FROM links""")
def html_tables(spark, sf):
    """Cells of page tables at their grid columns; the column under a row span is taken. Each page has a table made of its links:
    two rows a link, the text spanning both."""
    linked = with_links(spark, sf, '<tr><th rowspan="2">$2<td colspan=2>$1</tr><tr><td>under it')
    tables = linked.withColumn("html", F.regexp_replace("html", r"(?s)<nav><ul>(.*?)</ul></nav>", "<table>$1</table>"))
    cells = html.html_cells(tables)
    placed = grids.place_spanned_cells(cells, ("page_id", "table_at"))
    return placed.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("row_no", "col", "colspan", "rowspan")], "is_header", "text")


@query("SELECT page_id, page_id % 3 = 0 AS internal FROM pages")
def internal_html(spark, sf):
    marked = pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit('<td class="docx-cell">'))).otherwise(F.col("html")))
    return marked.select("page_id", html.is_internal_html(F.col("html")).alias("internal"))


@query("SELECT page_id, page_id % 3 = 0 AS inline FROM pages")
def inline_pages(spark, sf):
    """Every third page cut down to one plain paragraph, which is taken as inline text."""
    plain = fx.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>"), "url", F.lit("</p>"))).otherwise(F.col("html")).alias("html"))
    return html.inline_pages(html.html_blocks(plain))


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN concat('changed', chr(10), text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM d)
SELECT d.doc_id, lang, CAST(length(text) AS BIGINT) AS chars, n_blocks, block_chars
FROM d JOIN (SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS block_chars FROM b GROUP BY doc_id) USING (doc_id)""")
def write_and_read_lake(spark, sf):
    """A corpus is loaded, then one in which every seventh document changed and every eleventh is gone, and that again."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("format"), "text", "lang")
    later = docs.filter(F.col("doc_id") % 11 != 0).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("changed\n"), "text")).otherwise(F.col("text")))
    folder = shared_folder(spark, "lake")
    for corpus in (docs, later, later):
        corpus = corpus.withColumn("content_sha256", F.sha2("text", 256))
        lake.load_increment(spark, corpus, {"blocks": lake.read_text_documents(corpus)}, folder, whole=True)
    blocks = lake.read_lake(spark, folder, "blocks").groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("block_chars"))
    return lake.read_lake(spark, folder).select("doc_id", "lang", F.length("text").cast("long").alias("chars")).join(blocks, "doc_id")
