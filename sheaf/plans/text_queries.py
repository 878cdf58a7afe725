"""Queries over the text of documents: reading, counting, searching, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, text, units
from ..operators import diff, paging, references, search
from ..sources import lake
from . import fixtures as fx
from .registry import query

# The white space class in the comparison engine's notation, and its word pattern.
WS = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORDS = r"[\p{L}\p{N}''-]+"


def documents_as_runs(spark, sf):
    """Lines as runs; every ninth line stands for computed, non-editable content."""
    return fx.blocks(spark, sf).withColumn("editable", F.col("seq") % 9 != 8)


@query(r"""
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS seq, unnest(l) AS text
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents)""")
def read_text_documents(spark, sf):
    return lake.read_text_documents(fx.table(spark, sf, "documents")).select("doc_id", F.col("seq").cast("long"), "text")


@query(fx.sql(rf"""
SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS words,
       CAST(sum(length(regexp_replace(text, '{WS}', '', 'g'))) AS BIGINT) AS chars
FROM fx_blocks GROUP BY doc_id""", "fx_blocks"))
def doc_counts(spark, sf):
    return search.doc_counts(fx.blocks(spark, sf))


FIND_SQL = r"""
, hits AS (SELECT doc_id, seq, text AS line, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s
           FROM fx_blocks WHERE seq % 9 <> 8 AND regexp_matches(text, '{p}'))
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(i - 1 AS BIGINT) AS match_no,
       CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS "start",
       CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS "end",
       m[i] AS text
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)"""


def _found(spark, sf, *args, **kwargs):
    found = search.find(search.searchable(documents_as_runs(spark, sf)), *args, **kwargs)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("seq", "match_no", "start", "end")], "text")


@query(fx.sql(FIND_SQL.format(p="(?i)the"), "fx_blocks"))
def find_literal(spark, sf):
    return _found(spark, sf, "the")


@query(fx.sql(FIND_SQL.format(p="[aeiou]{3,}"), "fx_blocks"))
def find_regex(spark, sf):
    """Matches of a pattern; a pattern that cannot be read adds none."""
    return _found(spark, sf, "[aeiou]{3,}", match_case=True, regex=True).unionByName(_found(spark, sf, "[aeiou", regex=True))


@query(fx.sql(r"""
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(len(regexp_extract_all(text, '(?i)\bthe\b')) AS BIGINT) AS n
FROM fx_blocks WHERE seq % 9 <> 8 AND regexp_matches(text, '(?i)\bthe\b')""", "fx_blocks"))
def find_whole_word(spark, sf):
    return _found(spark, sf, "the", whole_word=True).groupBy("doc_id", "seq").agg(F.count("*").alias("n"))


@query(fx.sql(r"""
SELECT doc_id, CAST(seq AS BIGINT) AS seq, regexp_replace(text, '(?i)the', 'd$1\\a', 'g') AS text,
       CAST(len(regexp_extract_all(text, '(?i)the')) AS BIGINT) AS replaced
FROM fx_blocks WHERE seq % 9 <> 8""", "fx_blocks"))
def replace_all(spark, sf):
    done = search.replace_all(search.searchable(documents_as_runs(spark, sf)), "the", "d$1\\a")
    return done.select("doc_id", F.col("seq").cast("long").alias("seq"), "text", "replaced")


@query(fx.sql(r"SELECT DISTINCT doc_id FROM fx_blocks WHERE seq % 9 <> 8 AND regexp_matches(text, '(?i)the')", "fx_blocks"))
def replaced_documents(spark, sf):
    return search.touched_documents(search.replace_all(search.searchable(documents_as_runs(spark, sf)), "the", "x"))


@query(rf"""
SELECT page_id, CAST(count(*) FILTER (regexp_replace(piece, '{WS}', '', 'g') = '') AS BIGINT) AS blank, CAST(count(*) AS BIGINT) AS pieces
FROM (SELECT page_id, unnest(string_split_regex(html, '<[^>]+>')) AS piece FROM pages) GROUP BY page_id""")
def empty_blocks(spark, sf):
    """Pieces of a page between tags that hold nothing visible."""
    pieces = fx.table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "<[^>]+>", -1)).alias("piece"))
    return pieces.groupBy("page_id").agg(F.count_if(text.is_blank(F.col("piece"))).alias("blank"), F.count("*").alias("pieces"))


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')),
    '\b\d{{1,2}}:\d{{2}}(:\d{{2}})?\b', '<time>', 'g'), '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b', '<date>', 'g') AS masked
FROM documents""")
def mask_volatile(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.mask_volatile(F.col("text")).alias("masked"))


@query("""
SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
       replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS url FROM pages""")
def escape_markup(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", text.escape_html(F.col("html")).alias("html"), text.escape_attr(F.col("url")).alias("url"))


@query(fx.sql(rf"""
SELECT doc_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '{WS}+', ' ', 'g')) AS text
FROM fx_blocks GROUP BY doc_id""", "fx_blocks"))
def flatten_text(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", references.flatten_text(F.split("text", "\n")).alias("text"))


@query(rf"""
SELECT page_id AS doc_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'))
       = trim(regexp_replace(regexp_replace(replace(html, 'the', 'thé'), '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g')) AS same
FROM pages""")
def text_equality(spark, sf):
    pages = fx.table(spark, sf, "pages").withColumnRenamed("page_id", "doc_id")
    return diff.text_equality(pages, pages.withColumn("html", F.replace("html", F.lit("the"), F.lit("thé"))))


@query(r"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(lpad(to_hex(s_suppkey * 37 % 4096), 3, '0'))
       WHEN s_suppkey % 3 = 1 THEN NULL ELSE NULL END AS short, h AS six, c AS rgb
FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN upper(lpad(to_hex(s_suppkey * 7919 % 16777216), 6, '0')) END AS h,
     upper(concat(lpad(to_hex(s_suppkey % 256), 2, '0'), lpad(to_hex(s_nationkey % 256), 2, '0'), '07')) AS c FROM supplier)
""".replace("upper(lpad(to_hex(s_suppkey * 37 % 4096), 3, '0'))",
            "regexp_replace(upper(lpad(to_hex(s_suppkey * 37 % 4096), 3, '0')), '(.)', '\\1\\1', 'g')"))
def colours(spark, sf):
    s = fx.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    hexed = lambda n, width: F.lpad(F.lower(F.hex(n)), width, "0")
    short = F.when(key % 3 == 0, F.concat(F.lit("#"), hexed(key * 37 % 4096, 3))).when(key % 3 == 1, "red")
    six = F.when(key % 3 == 0, F.concat(F.lit(" #"), hexed(key * 7919 % 16777216, 6))).when(key % 3 == 1, "#12345")
    rgb = F.concat(F.lit("rgba("), key % 256, F.lit(", "), F.col("s_nationkey") % 256, F.lit(",7,0.5)"))
    return s.select("s_suppkey", units.to_hex6(short).alias("short"), units.to_hex6(six).alias("six"), units.to_hex6(rgb).alias("rgb"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 96 / 1440 AS twips_px,
       CAST(floor(l_extendedprice * 100 / 9525 + 0.5) AS BIGINT) AS emu_px, l_quantity * (96 / 2.54) AS cm_px,
       l_quantity / 6 AS pica_in, CAST(floor(l_quantity * 2 + 0.5) AS BIGINT) AS half_pt, CAST(floor(l_quantity * 1.5 + 0.5) AS BIGINT) AS half_pt_px
FROM lineitem""".replace("l_quantity * 96 / 1440", "l_quantity / 15").replace("l_quantity / 6 AS", "l_quantity * (1.0::DOUBLE / 6) AS")
   .replace("(96 / 2.54)", "(96.0::DOUBLE / 2.54::DOUBLE)").replace("* 1.5", "* 1.5::DOUBLE"))
def unit_lengths(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", units.twips_to_px(q).alias("twips_px"),
        units.emu_to_px((F.col("l_extendedprice") * 100).cast("string")).alias("emu_px"),
        units.length_to_px(F.concat(q, F.lit("cm"))).alias("cm_px"), units.length_to_inches(F.concat(q, F.lit("pc"))).alias("pica_in"),
        units.font_size_half_points(F.concat(q, F.lit("pt"))).alias("half_pt"),
        units.font_size_half_points(F.concat(q, F.lit("px"))).alias("half_pt_px"))


ROMAN_SQL = """concat(repeat('m', CAST(floor(n / 1000) AS INT)),
   ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][CAST(floor(n / 100) AS INT) % 10 + 1],
   ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(floor(n / 10) AS INT) % 10 + 1],
   ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1])"""


@query(f"""
WITH l AS (SELECT p_partkey, p_size, CAST(p_partkey % 800 AS INT) AS n FROM part)
SELECT p_partkey, CAST(n AS VARCHAR) AS "decimal",
  CASE WHEN n < 1 THEN CAST(n AS VARCHAR) ELSE {ROMAN_SQL} END AS roman,
  CASE WHEN n < 1 THEN CAST(n AS VARCHAR) WHEN n <= 26 THEN chr(64 + n)
       WHEN n <= 702 THEN chr(64 + CAST(floor((n - 1) / 26) AS INT)) || chr(65 + (n - 1) % 26)
       ELSE chr(64 + CAST(floor((floor((n - 1) / 26) - 1) / 26) AS INT)) || chr(65 + (CAST(floor((n - 1) / 26) AS INT) - 1) % 26) || chr(65 + (n - 1) % 26) END AS letter
FROM l""")
def page_number_formats(spark, sf):
    n = F.col("p_partkey") % 800
    return fx.table(spark, sf, "part").select(
        "p_partkey", fields.page_number(n, F.lit("decimal")).alias("decimal"),
        fields.page_number(n, F.lit("lowerRoman")).alias("roman"), fields.page_number(n, F.lit("upperLetter")).alias("letter"))


@query(r"""
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'bm' || p_size END AS target,
  CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'direction' ELSE 'page' END END AS shows,
  CASE p_partkey % 4 WHEN 2 THEN p_type END AS sequence,
  CASE p_partkey % 4 WHEN 3 THEN ['PAGE', 'NUMPAGES', 'DATE', 'TIME', 'AUTHOR', 'FILENAME'][p_size % 6 + 1] END AS info,
  CASE p_partkey % 4 WHEN 0 THEN 'xref' WHEN 1 THEN 'xref' WHEN 2 THEN 'seq' ELSE ['PAGE', 'NUMPAGES', 'DATE', 'TIME', 'AUTHOR', 'FILENAME'][p_size % 6 + 1] END AS kind,
  CASE p_partkey % 4 WHEN 3 THEN '\@ "x"' WHEN 1 THEN '' WHEN 0 THEN '' ELSE '' END AS switches
FROM part""")
def field_instructions(spark, sf):
    part, key, size = fx.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    info = F.element_at(F.array(*[F.lit(k) for k in fields.INFO_FIELDS]), size % 6 + 1)
    instr = (
        F.when(key % 4 == 0, F.concat(F.lit(' REF "'), F.col("p_name"), F.lit('" \\h ')))
        .when(key % 4 == 1, F.concat(F.lit(" pageref bm"), size, F.when(size % 2 == 0, " \\p").otherwise(" \\h")))
        .when(key % 4 == 2, F.concat(F.lit("SEQ "), F.col("p_type"), F.lit(" \\* ARABIC")))
        .otherwise(F.concat(F.lower(info), F.lit(' \\@ "x" '))))
    i = F.col("i")
    return part.withColumn("i", instr).select(
        "p_partkey", fields.reference_target(i).alias("target"), fields.reference_format(i).alias("shows"),
        fields.sequence_name(i).alias("sequence"), fields.info_field(i).alias("info"), fields.field_kind(i).alias("kind"),
        fields.field_switches(i).alias("switches"))


@query(r"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ul' WHEN 1 THEN 'ol' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS rest
FROM orders""")
def typed_list_markers(spark, sf):
    key = F.col("o_orderkey")
    line = F.concat(F.when(key % 3 == 0, "\t•\t").when(key % 3 == 1, F.concat(key, F.lit(".\t"))).otherwise(F.lit("x")), F.col("o_orderpriority"))
    m = fields.list_marker(line)
    return fx.table(spark, sf, "orders").select("o_orderkey", m["kind"].alias("kind"), m["rest"].alias("rest"))


@query(r"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'equation' ELSE 'figure' END AS kind, c_mktsegment AS caption,
  c_name AS family, c_nationkey + 1 AS px, 'dashed' AS style, upper(lpad(to_hex(c_custkey), 6, '0')) AS hex,
  greatest(1, CAST(floor((c_nationkey + 1) / 6 + 0.5) AS BIGINT)) AS table_px,
  greatest(1, CAST(floor((c_nationkey + 1) / 8 * (96 / 72) + 0.5) AS BIGINT)) AS para_px
FROM customer""".replace("c_nationkey + 1 AS px", "CAST(c_nationkey + 1 AS BIGINT) AS px"))
def captions_and_borders(spark, sf):
    c, key = fx.table(spark, sf, "customer"), F.col("c_custkey")
    hexed = F.lpad(F.hex(key), 6, "0")
    size = (F.col("c_nationkey") + 1)
    css = units.css_border(F.concat(size, F.lit("px dashed #"), F.lower(hexed)))
    return c.select(
        "c_custkey",
        fields.caption_kind(F.when(key % 3 == 0, "Table").when(key % 3 == 1, "EQUATION").otherwise("Figure")).alias("kind"),
        fields.caption_text(F.concat(F.lit(" : "), F.col("c_mktsegment"), F.lit(" "))).alias("caption"),
        units.first_font_family(F.concat(F.lit("'"), F.col("c_name"), F.lit("', serif"))).alias("family"),
        css["px"].alias("px"), css["style"].alias("style"), css["hex"].alias("hex"),
        units.docx_table_border(F.lit("single"), size.cast("string"), F.lit("auto"))["px"].alias("table_px"),
        units.docx_paragraph_border(F.lit("single"), size.cast("string"), F.lit("auto"))["px"].alias("para_px"))


TOP_SQL = fx.sql(rf"""
, f(doc_id, seq, page, y, height_px) AS (
    SELECT doc_id, seq, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(height_px AS BIGINT) FROM fx_blocks WHERE seq = 0
    UNION ALL
    SELECT b.doc_id, b.seq,
           CASE WHEN f.y + f.height_px > 0 AND f.y + f.height_px + b.height_px > {fx.CONTENT_HEIGHT} + 1
                THEN f.page + greatest(1, CAST(ceil((f.y + f.height_px) / {fx.PAGE_STEP}) AS BIGINT)) ELSE f.page END,
           CASE WHEN f.y + f.height_px > 0 AND f.y + f.height_px + b.height_px > {fx.CONTENT_HEIGHT} + 1 THEN 0 ELSE f.y + f.height_px END,
           b.height_px
    FROM f JOIN fx_blocks b ON b.doc_id = f.doc_id AND b.seq = f.seq + 1)
SELECT c.doc_id, c.words, c.chars, p.pages FROM (
    SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS words,
           CAST(sum(length(regexp_replace(text, '{WS}', '', 'g'))) AS BIGINT) AS chars FROM fx_blocks GROUP BY doc_id) c
JOIN (SELECT doc_id, CAST(max(page) + 1 AS BIGINT) AS pages FROM f GROUP BY doc_id) p USING (doc_id)
ORDER BY pages DESC, words DESC, doc_id LIMIT 10""", "fx_blocks", recursive=True)


@query(TOP_SQL)
def longest_documents(spark, sf):
    """Words, characters and pages per document, the ten longest."""
    docs = fx.blocks(spark, sf)
    paged = paging.paginate(docs.drop("forced"), fx.PAGE_STEP, fx.CONTENT_HEIGHT)
    pages = paged.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    return search.doc_counts(docs).join(pages, "doc_id").orderBy(F.desc("pages"), F.desc("words"), "doc_id").limit(10)
