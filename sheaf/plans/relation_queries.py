"""Queries that resolve relations between document parts: threads, styles, references, revisions, tables, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, grids, history, numbering, references, revisions, styles, threads
from . import fixtures as fx
from .order_queries import longs
from .registry import query

# --- comments ---------------------------------------------------------------------------------------------------

# A comment is a thread when it has no earlier parent, or its parent is not one itself.
THREADS_SQL = fx.sql("""
, p AS (SELECT c.*, d.comment_id AS parent FROM fx_comments c LEFT JOIN fx_comments d
        ON d.doc_id = c.doc_id AND d.para_id = c.parent_para_id AND d.ref_ord < c.ref_ord)
, t(doc_id, comment_id, parent, is_reply) AS (
    SELECT doc_id, comment_id, parent, false FROM p WHERE parent IS NULL
    UNION ALL
    SELECT p.doc_id, p.comment_id, p.parent, NOT t.is_reply FROM p JOIN t ON t.doc_id = p.doc_id AND t.comment_id = p.parent)
, placed AS (SELECT c.*, t.is_reply, CASE WHEN t.is_reply THEN t.parent ELSE c.comment_id END AS thread_id FROM fx_comments c JOIN t USING (doc_id, comment_id))
""", "fx_comments", recursive=True)


@query(THREADS_SQL + "SELECT doc_id, comment_id, thread_id, is_reply FROM placed")
def comment_threads(spark, sf):
    return threads.comment_threads(fx.comments(spark, sf)).select("doc_id", "comment_id", "thread_id", "is_reply")


@query(THREADS_SQL + """
, r AS (SELECT doc_id, thread_id, count(*) AS reactions FROM placed WHERE length(text) % 4 = 0 GROUP BY ALL)
SELECT doc_id, thread_id, CAST(sum(is_reply::INT) AS BIGINT) AS replies, count(DISTINCT author) AS participants, bool_or(NOT is_reply AND done) AS resolved,
       max(ref_ord) AS last_ref, coalesce(any_value(r.reactions), 0) AS reactions
FROM placed LEFT JOIN r USING (doc_id, thread_id) GROUP BY ALL""")
def thread_rollup(spark, sf):
    c = fx.comments(spark, sf)
    return threads.thread_rollup(threads.comment_threads(c), c.filter(F.length("text") % 4 == 0).select("doc_id", "comment_id"))


def comments_with_reactions(spark, sf):
    """Each comment's lines, with a header and two reaction lines by the neighbouring turns put in."""
    turn = F.col("ref_ord")
    line = lambda who, emoji: F.concat(F.lit("u"), (who % 3).cast("string"), F.lit(" reacted with "), emoji, F.lit(" now"))
    extra = F.array(F.lit("Total reactions: 2"), line(turn, F.lit("👍")), line(turn + 1, F.when(turn % 2 == 0, "👍").otherwise("🎉")))
    return fx.comments(spark, sf).withColumn("paras", F.concat(F.split("text", "\n"), extra))


@query(fx.sql("""
, l AS (SELECT doc_id, comment_id, len(string_split(text, chr(10))) AS n, ref_ord AS r FROM fx_comments)
, x AS (SELECT doc_id, comment_id, n + 1 AS para, concat('u', r % 3) AS person, '👍' AS emoji FROM l
        UNION ALL SELECT doc_id, comment_id, n + 2, concat('u', (r + 1) % 3), CASE WHEN r % 2 = 0 THEN '👍' ELSE '🎉' END FROM l)
SELECT doc_id, comment_id, emoji, CAST(min(para) AS BIGINT) AS first_para, list(person ORDER BY para) AS people FROM x GROUP BY ALL""", "fx_comments"))
def reactions(spark, sf):
    return longs(threads.reactions(comments_with_reactions(spark, sf)), "first_para")


@query(fx.sql("SELECT doc_id, comment_id, trim(text, E' \\t\\n\\r') AS text FROM fx_comments", "fx_comments"))
def comment_text(spark, sf):
    return comments_with_reactions(spark, sf).select("doc_id", "comment_id", threads.comment_text(F.col("paras")).alias("text"))


@query(fx.sql("""
SELECT doc_id, ref_ord, CAST((SELECT max(comment_id) FROM fx_comments x WHERE x.doc_id = c.doc_id AND x.comment_id % 2 = 0)
   + row_number() OVER (PARTITION BY doc_id ORDER BY ref_ord) AS BIGINT) AS comment_id FROM fx_comments c WHERE comment_id % 2 = 1""", "fx_comments"))
def next_ids(spark, sf):
    c = fx.comments(spark, sf)
    old = c.filter("comment_id % 2 = 0").select("doc_id", F.col("comment_id").cast("string").alias("comment_id"))
    odd = old.unionByName(old.withColumn("comment_id", F.lit("custom")))
    new = c.filter("comment_id % 2 = 1").select("doc_id", "ref_ord")
    return threads.next_ids(odd, new, ["doc_id"], "comment_id", "ref_ord").select("doc_id", "ref_ord", "comment_id")


@query(fx.sql("""
SELECT doc_id, kind, edit_key AS key, CASE WHEN kind IN ('done', 'edited') THEN arg_max(value, (ts, event_id)) ELSE arg_min(value, (ts, event_id)) END AS value
FROM fx_edits GROUP BY doc_id, kind, edit_key""", "fx_edits"))
def merge_comment_edits(spark, sf):
    return threads.merge_keyed(fx.edits(spark, sf).withColumnRenamed("edit_key", "key"))


def comment_edit_log(spark, sf):
    """An edit log over the comments: edits of odd ones, replies to every third, threads resolved and deleted."""
    c = fx.comments(spark, sf)
    cid = F.col("comment_id")
    row = lambda kind, key, value: c.select(
        "doc_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"), F.col("ref_ord"), cid.alias("event_id"))
    reply = F.to_json(F.struct((cid + 500).alias("id"), F.concat(F.lit("R"), cid).alias("paraId"), F.col("para_id").alias("parentParaId"),
                               F.lit("me").alias("author"), F.concat(F.lit("re "), F.col("author")).alias("text")))
    log = (
        row("edited", cid, F.concat(F.lit("new "), F.col("author"))).filter("event_id % 2 = 1")
        .unionByName(row("edited", cid, F.lit("old")).filter("event_id % 2 = 1").withColumn("ref_ord", F.lit(-1)))
        .unionByName(row("reply", cid + 500, reply).filter("event_id % 3 = 0"))
        .unionByName(row("reply", cid + 500, F.lit("not json")).filter("event_id % 3 = 0").withColumn("ref_ord", F.lit(-1)))
        .unionByName(row("done", F.col("para_id"), F.lit("true")).filter("event_id % 5 = 0"))
        .unionByName(row("deleted", cid, F.lit("1")).filter("event_id % 7 = 0")))
    return log.withColumn("ts", F.col("ref_ord"))


@query(THREADS_SQL + """
, kept AS (SELECT doc_id, comment_id, thread_id, is_reply, author, CASE WHEN comment_id % 2 = 1 THEN concat('new ', author) ELSE text END AS text,
                  para_id, parent_para_id, done OR comment_id % 5 = 0 AS done FROM placed)
, added AS (SELECT doc_id, comment_id + 500 AS comment_id, comment_id AS thread_id, true AS is_reply, 'me' AS author, concat('re ', author) AS text,
                   concat('R', comment_id) AS para_id, para_id AS parent_para_id, false AS done FROM placed WHERE NOT is_reply AND comment_id % 3 = 0)
SELECT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) e
WHERE NOT EXISTS (SELECT 1 FROM fx_comments d WHERE d.doc_id = e.doc_id AND d.comment_id % 7 = 0 AND d.comment_id IN (e.comment_id, e.thread_id))""")
def apply_comment_edits(spark, sf):
    placed = threads.comment_threads(fx.comments(spark, sf)).select(
        "doc_id", "comment_id", "thread_id", "is_reply", "author", "text", "para_id", "parent_para_id", "done")
    return threads.apply_comment_edits(placed, threads.merge_comment_edits(comment_edit_log(spark, sf)))


# --- styles -----------------------------------------------------------------------------------------------------

ANCESTORS_SQL = fx.sql("""
, a(style_id, ancestor, distance, path) AS (
    SELECT style_id, style_id, CAST(0 AS BIGINT), [style_id] FROM fx_styles
    UNION ALL
    SELECT a.style_id, s.based_on, a.distance + 1, list_append(a.path, s.based_on) FROM a JOIN fx_styles s ON s.style_id = a.ancestor
    WHERE s.based_on IS NOT NULL AND NOT list_contains(a.path, s.based_on) AND s.based_on IN (SELECT style_id FROM fx_styles))
""", "fx_styles", recursive=True)


def style_table(spark, sf):
    props = F.map_filter(F.create_map(F.lit("color"), F.col("p_color"), F.lit("size"), F.col("p_size").cast("string")), lambda _, v: v.isNotNull())
    return fx.styles(spark, sf).select("style_id", "based_on", "name", props.alias("props"))


@query(ANCESTORS_SQL + "SELECT style_id, ancestor, distance FROM a")
def style_ancestors(spark, sf):
    return styles.ancestors(fx.styles(spark, sf))


@query(ANCESTORS_SQL + """
, p AS (SELECT style_id AS ancestor, 'color' AS prop, p_color AS value FROM fx_styles WHERE p_color IS NOT NULL
        UNION ALL SELECT style_id, 'size', CAST(p_size AS VARCHAR) FROM fx_styles WHERE p_size IS NOT NULL)
SELECT a.style_id, p.prop, arg_min(p.value, a.distance) AS value, min(a.distance) AS distance FROM a JOIN p USING (ancestor) GROUP BY ALL""")
def resolve_styles(spark, sf):
    return styles.resolve_styles(style_table(spark, sf))


@query(fx.sql("""
SELECT style_id, 'color' AS prop, p_color AS value FROM fx_styles WHERE p_color IS NOT NULL
UNION ALL SELECT style_id, 'size', CAST(p_size AS VARCHAR) FROM fx_styles WHERE p_size IS NOT NULL""", "fx_styles"))
def own_style_properties(spark, sf):
    return styles.resolve_styles(style_table(spark, sf), own_only=True).select("style_id", "prop", "value")


@query(fx.sql("""
SELECT CASE WHEN style_id % 50 = 0 THEN concat('Heading ', 1 + style_id % 9) ELSE CAST(style_id AS VARCHAR) END AS style_id, replace(name, '#', ' ') AS display
FROM fx_styles WHERE style_id % 11 <> 0 AND style_id % 13 <> 0 AND style_id % 50 <> 0""", "fx_styles"))
def style_picker(spark, sf):
    key = F.col("style_id")
    s = fx.styles(spark, sf).select(
        F.when(key % 50 == 0, F.concat(F.lit("Heading "), 1 + key % 9)).otherwise(key.cast("string")).alias("style_id"),
        F.replace("name", F.lit("#"), F.lit("_20_")).alias("name"), (key % 11 == 0).alias("is_default"), (key % 13 == 0).alias("hidden"))
    return styles.sorted_picker(s).select("style_id", "display")


@query(fx.sql("""
, e AS (SELECT style_id + CASE WHEN style_id % 5 = 4 THEN 2000000 ELSE 0 END AS style_id, concat('edit ', name) AS name, p_size FROM fx_styles WHERE style_id % 4 = 0)
SELECT coalesce(s.style_id, e.style_id) AS style_id, CASE WHEN s.style_id IS NULL THEN e.name ELSE s.name END AS name, s.based_on,
       s.p_color AS kept, CASE WHEN e.style_id IS NULL THEN NULL ELSE concat('e', e.style_id) END AS size FROM fx_styles s FULL JOIN e USING (style_id)""", "fx_styles"))
def upsert_styles(spark, sf):
    key = F.col("style_id")
    edits = fx.styles(spark, sf).filter("style_id % 4 = 0").select(
        (key + F.when(key % 5 == 4, 2000000).otherwise(0)).alias("style_id"), F.concat(F.lit("edit "), F.col("name")).alias("name"))
    edits = edits.withColumn("props", F.create_map(F.lit("size"), F.concat(F.lit("e"), key), F.lit("kept"), F.lit("not modelled")))
    s = fx.styles(spark, sf).select("style_id", "name", "based_on", F.map_filter(F.create_map(F.lit("kept"), F.col("p_color")), lambda _, v: v.isNotNull()).alias("props"))
    once = styles.upsert_styles(s, edits, ["size"])
    twice = styles.upsert_styles(once, edits, ["size"])
    return twice.select("style_id", "name", "based_on", F.try_element_at("props", F.lit("kept")).alias("kept"), F.try_element_at("props", F.lit("size")).alias("size"))


@query(fx.sql("""
SELECT style_id, name FROM fx_styles WHERE style_id % 3 = 0
UNION ALL SELECT style_id, upper(name) FROM fx_styles WHERE style_id % 3 <> 0""", "fx_styles"))
def prefer_content_styles(spark, sf):
    s = fx.styles(spark, sf).select("style_id", "name")
    return styles.prefer(s.filter("style_id % 3 = 0"), s.withColumn("name", F.upper("name")), ["style_id"])


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey WHEN o_custkey % 3 = 1 AND floor(o_custkey / 10) % 3 = 0 THEN CAST(floor(o_custkey / 10) AS BIGINT) END AS named_style
FROM orders""")
def effective_style(spark, sf):
    key = F.col("c_custkey")
    c = fx.table(spark, sf, "customer").withColumn("scope", F.lit(1))
    named = c.filter(key % 3 == 0).select("scope", key.alias("style_id"))
    automatic = c.filter(key % 3 == 1).select("scope", key.alias("style_id"), F.floor(key / 10).alias("based_on"))
    blocks = fx.table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("scope"), F.col("o_custkey").alias("style_id"))
    return styles.effective_style(blocks, named, automatic, ("scope",)).select("o_orderkey", "named_style")


@query("""
WITH e AS (SELECT l_suppkey AS doc_id, l_partkey AS target, min(l_linenumber) AS id FROM lineitem WHERE l_quantity < 20 GROUP BY ALL)
, t AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS target FROM lineitem WHERE l_quantity >= 20)
, top AS (SELECT l_suppkey AS doc_id, max(l_linenumber) AS top FROM lineitem WHERE l_quantity < 20 GROUP BY ALL)
SELECT doc_id, target, CAST(id AS BIGINT) AS id, false AS minted FROM t JOIN e USING (doc_id, target)
UNION ALL SELECT doc_id, target, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY doc_id ORDER BY target) AS BIGINT), true
FROM t ANTI JOIN e USING (doc_id, target) LEFT JOIN top USING (doc_id)""")
def reuse_or_mint(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("target"), F.col("l_linenumber").cast("long").alias("id"), "l_quantity")
    return styles.reuse_or_mint(li.filter("l_quantity >= 20"), li.filter("l_quantity < 20").drop("l_quantity"), "target", "id")


@query("""
SELECT DISTINCT p_brand, sha256(concat('brand=', p_brand, ' type=', p_type)) AS signature FROM part""")
def style_signatures(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_brand", styles.style_signature(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("signature")).distinct()


# --- references and ranges --------------------------------------------------------------------------------------

def bookmarks(spark, sf):
    m = fx.marks(spark, sf)
    return m.select("doc_id", F.col("bookmark").alias("name"), "pos", F.floor((F.col("pos") - 1) / 46).alias("page"),
                    F.when(F.col("level") > 0, F.concat(F.lit("text "), F.col("pos"))).alias("text"))


def xrefs(spark, sf):
    fmt = F.element_at(F.array(F.lit("text"), F.lit("page"), F.lit("direction")), (F.col("pos") % 3 + 1).cast("int"))
    return fx.marks(spark, sf).select("doc_id", "pos", F.col("xref").alias("target"), fmt.alias("fmt"), F.lit("cached").alias("cached"))


@query(fx.sql("""
, b AS (SELECT doc_id, bookmark, min(pos) AS b_at, arg_min(level, pos) AS level FROM fx_marks GROUP BY ALL)
SELECT m.doc_id, m.pos, m.xref AS target, CASE WHEN b.b_at IS NULL THEN 'cached' WHEN m.pos % 3 = 1 THEN CAST(CAST(floor((b.b_at - 1) / 46) AS BIGINT) + 1 AS VARCHAR)
   WHEN m.pos % 3 = 2 THEN CASE WHEN b.b_at > m.pos THEN 'below' ELSE 'above' END WHEN b.level > 0 THEN concat('text ', b.b_at) ELSE m.xref END AS resolved
FROM fx_marks m LEFT JOIN b ON b.doc_id = m.doc_id AND b.bookmark = m.xref""", "fx_marks"))
def resolve_xrefs(spark, sf):
    return references.resolve_xrefs(xrefs(spark, sf), bookmarks(spark, sf)).select("doc_id", "pos", "target", "resolved")


@query(fx.sql("SELECT doc_id, pos, xref AS target FROM fx_marks m WHERE NOT EXISTS (SELECT 1 FROM fx_marks b WHERE b.doc_id = m.doc_id AND b.bookmark = m.xref)", "fx_marks"))
def dangling_refs(spark, sf):
    return references.dangling_refs(xrefs(spark, sf), bookmarks(spark, sf)).select("doc_id", "pos", "target")


@query(fx.sql("""
SELECT doc_id, pos, 'heading' AS kind, concat('h', pos) AS label FROM fx_marks WHERE level BETWEEN 1 AND 3
UNION ALL SELECT doc_id, pos, 'bookmark', bookmark FROM fx_marks
UNION ALL SELECT doc_id, pos, 'table', num_id FROM fx_marks WHERE boundary""", "fx_marks"))
def reference_targets(spark, sf):
    m = fx.marks(spark, sf)
    captions = m.select("doc_id", "pos", F.when(F.col("boundary"), "table").alias("caption_kind"), F.col("num_id").alias("text"))
    heads = m.select("doc_id", "pos", F.col("level").alias("heading"), F.concat(F.lit("h"), F.col("pos")).alias("text"))
    return references.reference_targets(heads, bookmarks(spark, sf), captions)


@query(fx.sql("""
, r AS (SELECT doc_id, pos AS id, pos AS start_pos, pos + 1 + quantity % 7 AS end_pos FROM fx_marks WHERE boundary)
SELECT r.doc_id, r.id, m.pos FROM r JOIN fx_marks m ON m.doc_id = r.doc_id AND m.pos >= r.start_pos AND m.pos < r.end_pos""", "fx_marks"))
def runs_in_range(spark, sf):
    m = fx.marks(spark, sf)
    ranges = m.filter("boundary").select("doc_id", F.col("pos").alias("id"), F.col("pos").alias("start_pos"), (F.col("pos") + 1 + F.col("quantity") % 7).alias("end_pos"))
    return references.in_ranges(ranges, m.select("doc_id", "pos"), bucket=64).select("doc_id", "id", "pos")


@query(fx.sql("""
, r AS (SELECT doc_id, concat('r', pos) AS name, pos AS start_pos, pos + 1 + quantity % 7 AS end_pos FROM fx_marks WHERE boundary)
, h AS (SELECT r.doc_id, r.name, CAST(floor(m.pos / 3) AS BIGINT) AS seq, m.pos, concat(m.num_id, ' ', m.bookmark, ' ') AS text FROM r JOIN fx_marks m ON m.doc_id = r.doc_id AND m.pos >= r.start_pos AND m.pos < r.end_pos)
, b AS (SELECT doc_id, name, seq, string_agg(text, '' ORDER BY pos) AS text FROM h GROUP BY ALL)
SELECT doc_id, name, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '\\s+', ' ', 'g')) AS text FROM b GROUP BY ALL""", "fx_marks"))
def range_text(spark, sf):
    m = fx.marks(spark, sf)
    ranges = m.filter("boundary").select("doc_id", F.concat(F.lit("r"), F.col("pos")).alias("name"), F.col("pos").alias("start_pos"), (F.col("pos") + 1 + F.col("quantity") % 7).alias("end_pos"))
    runs = m.select("doc_id", "pos", F.floor(F.col("pos") / 3).alias("seq"), F.concat_ws(" ", "num_id", "bookmark", F.lit("")).alias("text"))
    return references.range_text(ranges, runs)


@query(fx.sql("""
, n AS (SELECT DISTINCT doc_id, note_kind, quantity AS note_id FROM fx_marks WHERE quantity % 3 = 0)
SELECT m.doc_id, m.pos, m.note_kind, CAST(m.quantity AS BIGINT) AS note_id FROM fx_marks m JOIN n ON n.doc_id = m.doc_id AND n.note_kind = m.note_kind AND n.note_id = m.quantity WHERE m.boundary""", "fx_marks"))
def attach_notes(spark, sf):
    m = fx.marks(spark, sf).withColumn("note_id", F.col("quantity").cast("long"))
    notes = m.filter("quantity % 3 = 0").select("doc_id", "note_kind", "note_id").distinct()
    return references.attach_notes(m.filter("boundary").select("doc_id", "pos", "note_kind", "note_id"), notes).select("doc_id", "pos", "note_kind", "note_id")


@query(fx.sql("""
, n AS (SELECT DISTINCT doc_id, note_kind, quantity AS note_id FROM fx_marks)
SELECT doc_id, note_kind, CAST(note_id AS BIGINT) AS note_id FROM n WHERE EXISTS (SELECT 1 FROM fx_marks m WHERE m.boundary AND m.doc_id = n.doc_id AND m.note_kind = n.note_kind AND m.quantity = n.note_id)""", "fx_marks"))
def referenced_notes(spark, sf):
    m = fx.marks(spark, sf).withColumn("note_id", F.col("quantity").cast("long"))
    return references.referenced_notes(m.select("doc_id", "note_kind", "note_id").distinct(), m.filter("boundary"))


@query(fx.sql("""
, d AS (SELECT * FROM (VALUES ('en', 'greet', 'Hello {name}, {count} new'), ('en', 'bye', 'Bye'), ('fr', 'greet', 'Bonjour {name} {other}'), ('de', 'bye', 'Tschüss {name}')) AS v(locale, key, text))
, r AS (SELECT doc_id, lang, ['greet', 'bye', 'none'][doc_id % 3 + 1] AS key, CASE WHEN lang IN ('fr', 'de', 'en') THEN lang ELSE 'en' END AS loc, source FROM documents)
SELECT doc_id, replace(replace(coalesce(o.text, e.text, r.key), '{name}', r.source), '{count}', '3') AS label
FROM r LEFT JOIN d o ON o.locale = r.loc AND o.key = r.key LEFT JOIN d e ON e.locale = 'en' AND e.key = r.key"""))
def translate(spark, sf):
    d = spark.createDataFrame(
        [("en", "greet", "Hello {name}, {count} new"), ("en", "bye", "Bye"), ("fr", "greet", "Bonjour {name} {other}"), ("de", "bye", "Tschüss {name}")],
        "locale string, key string, text string")
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.upper("lang"), F.lit("-x")).alias("locale"),
        F.element_at(F.array(F.lit("greet"), F.lit("bye"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int")).alias("key"),
        F.create_map(F.lit("name"), F.col("source"), F.lit("count"), F.lit("3")).alias("params"))
    return references.translate(rows, d, ["en", "fr", "de"]).select("doc_id", "label")


# --- revisions --------------------------------------------------------------------------------------------------

def runs_with_formats(spark, sf):
    """Revisions, every undecided fifth one a format change."""
    r = fx.runs(spark, sf)
    plain = F.col("rev_kind").isNull() & (F.col("seq") % 5 == 0)
    return r.withColumn("fmt", F.lit("bold")).withColumn("old_fmt", F.when(plain, "plain")).withColumn(
        "rev_kind", F.when(plain, "fmt").otherwise(F.col("rev_kind")))


FMT_SQL = ", r AS (SELECT *, CASE WHEN rev_kind IS NULL AND seq % 5 = 0 THEN 'fmt' ELSE rev_kind END AS k FROM fx_runs) "


@query(fx.sql(FMT_SQL + "SELECT doc_id, seq, text, 'bold' AS fmt, CAST(NULL AS VARCHAR) AS rev_kind FROM r WHERE k IS DISTINCT FROM 'del'", "fx_runs"))
def accept_all(spark, sf):
    return revisions.accept_all(runs_with_formats(spark, sf)).select("doc_id", "seq", "text", "fmt", F.col("rev_kind").cast("string").alias("rev_kind"))


@query(fx.sql(FMT_SQL + "SELECT doc_id, seq, text, CASE WHEN k = 'fmt' THEN 'plain' ELSE 'bold' END AS fmt FROM r WHERE k IS DISTINCT FROM 'ins'", "fx_runs"))
def reject_all(spark, sf):
    return revisions.reject_all(runs_with_formats(spark, sf)).select("doc_id", "seq", "text", "fmt")


@query(fx.sql(FMT_SQL + """
SELECT doc_id, seq, CASE WHEN k = 'fmt' AND rev_author = 'u2' THEN 'plain' ELSE 'bold' END AS fmt, CASE WHEN rev_author IN ('u1', 'u2') THEN NULL ELSE k END AS rev_kind
FROM r WHERE NOT coalesce((rev_author = 'u1' AND k = 'del') OR (rev_author = 'u2' AND k = 'ins'), false)""", "fx_runs"))
def resolve_changes(spark, sf):
    decisions = fx.runs(spark, sf).select("rev_author").distinct().filter(F.col("rev_author").isin("u1", "u2")).withColumn("accept", F.col("rev_author") == "u1")
    return revisions.resolve_changes(runs_with_formats(spark, sf), decisions, ["rev_author"]).select("doc_id", "seq", "fmt", "rev_kind")


PARAS_SQL = """
, p AS (SELECT *, coalesce(lag(rev_para) OVER (PARTITION BY doc_id ORDER BY seq) = '{mark}', false) AS joined FROM fx_runs)
SELECT doc_id, seq, CAST(sum((NOT joined)::INT) OVER w AS BIGINT) AS para_no, max(CASE WHEN NOT joined THEN seq END) OVER w AS merged_into
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY seq)"""


@query(fx.sql(PARAS_SQL.format(mark="del"), "fx_runs"))
def merge_paragraphs_accepting(spark, sf):
    return revisions.merge_paragraphs(fx.runs(spark, sf), accept=True).select("doc_id", "seq", "para_no", "merged_into")


@query(fx.sql(PARAS_SQL.format(mark="ins"), "fx_runs"))
def merge_paragraphs_rejecting(spark, sf):
    return revisions.merge_paragraphs(fx.runs(spark, sf), accept=False).select("doc_id", "seq", "para_no", "merged_into")


@query(fx.sql("""
, a AS (SELECT doc_id, seq, length(text) AS n, CASE WHEN rev_kind = 'ins' THEN concat('u', CAST(floor((seq % 5) / 2) AS INT)) END AS who FROM fx_runs)
, o AS (SELECT *, who IS NOT NULL AND who IS DISTINCT FROM lag(who) OVER (PARTITION BY doc_id ORDER BY seq) AS opens FROM a)
, c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS change_no FROM o)
SELECT doc_id, CAST(change_no AS BIGINT) AS change_no, min(who) AS author, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_chars
FROM c WHERE who IS NOT NULL GROUP BY doc_id, change_no""", "fx_runs"))
def merge_adjacent_insertions(spark, sf):
    r = fx.runs(spark, sf).withColumn("rev_author", F.concat(F.lit("u"), F.floor(F.col("seq") % 5 / 2)))
    return revisions.insertion_changes(r)


@query(fx.sql("""
SELECT doc_id, seq, CASE WHEN seq % 4 = 0 THEN 'del' ELSE rev_kind END AS rev_kind,
       CASE WHEN seq % 4 = 0 AND rev_kind IS DISTINCT FROM 'del' THEN 'u3' ELSE rev_author END AS rev_author
FROM fx_runs WHERE NOT coalesce(seq % 4 = 0 AND rev_kind = 'ins' AND rev_author = 'u3', false)""", "fx_runs"))
def suggest_deletion(spark, sf):
    out = revisions.suggest_deletion(fx.runs(spark, sf), F.col("seq") % 4 == 0, "u3", F.col("rev_date"))
    return out.select("doc_id", "seq", "rev_kind", "rev_author")


@query(fx.sql("SELECT rev_author, rev_kind, CAST(rev_date AS DATE) AS day, count(*) AS changes, CAST(sum(length(text)) AS BIGINT) AS chars FROM fx_runs WHERE rev_kind IS NOT NULL GROUP BY ALL", "fx_runs"))
def revision_stats(spark, sf):
    return revisions.revision_stats(fx.runs(spark, sf))


@query(fx.sql("SELECT c_custkey AS doc_id FROM customer WHERE EXISTS (SELECT 1 FROM fx_runs r WHERE r.doc_id = c_custkey AND rev_kind IN ('ins', 'del'))", "fx_runs"))
def has_revisions(spark, sf):
    return revisions.has_revisions(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), fx.runs(spark, sf))


# --- tables -----------------------------------------------------------------------------------------------------

PLACED_SQL = """
, placed AS (SELECT *, CAST(coalesce(sum(colspan) OVER (PARTITION BY table_no, row_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col FROM fx_cells)
, prev AS (SELECT *, NOT coalesce(vmerge = 'cont' AND lag(row_no) OVER (PARTITION BY table_no, col ORDER BY row_no) = row_no - 1, false) AS head FROM placed)
, island AS (SELECT *, max(CASE WHEN head THEN row_no END) OVER (PARTITION BY table_no, col ORDER BY row_no) AS top FROM prev)
, counted AS (SELECT *, CASE WHEN vmerge = 'restart' THEN count(*) OVER (PARTITION BY table_no, col, top) ELSE 1 END AS rowspan FROM island)
, spanned AS (SELECT * FROM counted WHERE vmerge IS DISTINCT FROM 'cont') """


@query(fx.sql(PLACED_SQL + "SELECT table_no, row_no, CAST(cell_no AS BIGINT) AS cell_no, col FROM placed", "fx_cells"))
def place_cells(spark, sf):
    return longs(grids.place_cells(fx.cells(spark, sf)).select("table_no", "row_no", "cell_no", "col"), "cell_no")


def spanned(spark, sf):
    return grids.vmerge_to_rowspan(grids.place_cells(fx.cells(spark, sf)))


@query(fx.sql(PLACED_SQL + "SELECT table_no, row_no, CAST(cell_no AS BIGINT) AS cell_no, col, rowspan FROM spanned", "fx_cells"))
def vmerge_to_rowspan(spark, sf):
    return longs(spanned(spark, sf).select("table_no", "row_no", "cell_no", "col", "rowspan"), "cell_no")


@query(fx.sql(PLACED_SQL + """SELECT table_no, row_no + r AS grid_row, col + c AS grid_col, row_no AS anchor_row, col AS anchor_col, text
FROM (SELECT *, unnest(range(0, rowspan)) AS r FROM spanned) CROSS JOIN (VALUES (0), (1)) AS g(c) WHERE c < colspan""", "fx_cells"))
def expand_grid(spark, sf):
    return grids.expand_grid(spanned(spark, sf))


@query(fx.sql(PLACED_SQL + """SELECT table_no, count(DISTINCT row_no) AS n_rows, CAST(max(col + colspan) AS BIGINT) AS n_cols, count(*) AS n_cells,
  count(DISTINCT CASE WHEN row_no = 1 THEN row_no END) AS n_header_rows FROM placed GROUP BY table_no""", "fx_cells"))
def table_shape(spark, sf):
    return grids.table_shape(grids.place_cells(fx.cells(spark, sf)).withColumn("is_header", F.col("row_no") == 1))


@query(fx.sql(PLACED_SQL + """
, single AS (SELECT table_no, col, max(length(text)) AS w FROM placed WHERE colspan = 1 GROUP BY ALL)
, a AS (SELECT table_no, avg(w) AS mean FROM single GROUP BY ALL)
, g AS (SELECT table_no, unnest(range(0, max(col + colspan))) AS col FROM placed GROUP BY table_no)
SELECT g.table_no, g.col, CAST(floor(coalesce(s.w, a.mean, 64) + 0.5) AS BIGINT) AS width_px FROM g LEFT JOIN single s USING (table_no, col) LEFT JOIN a USING (table_no)""", "fx_cells"))
def column_widths(spark, sf):
    return grids.column_widths(grids.place_cells(fx.cells(spark, sf)).withColumn("width_px", F.length("text")))


@query()
def place_spanned_cells(spark, sf):
    """Grid columns of cells whose covered positions are not written out (brute force is in the tests)."""
    cells = spanned(spark, sf).select("table_no", "row_no", "cell_no", "colspan", "rowspan", "text")
    return grids.place_spanned_cells(cells)


@query(fx.sql(PLACED_SQL + """
, e AS (SELECT table_no, min(row_no) AS r0, max(row_no + rowspan) AS r1, max(col + colspan) AS c1 FROM spanned GROUP BY ALL)
, t AS (SELECT table_no, concat('t', table_no % 5) AS top, 'right' AS "right", CASE WHEN table_no % 2 = 0 THEN 'bottom' END AS bottom, 'left' AS "left", 'ih' AS ih, CASE WHEN table_no % 3 = 0 THEN 'iv' END AS iv FROM e)
SELECT s.table_no, s.row_no, s.col, nullif(coalesce(CASE WHEN length(s.text) % 3 = 0 THEN 'off' END, CASE WHEN s.row_no = e.r0 THEN t.top ELSE t.ih END), 'off') AS border_top,
  CASE WHEN s.col + s.colspan = e.c1 THEN t."right" ELSE t.iv END AS border_right,
  CASE WHEN s.row_no + s.rowspan = e.r1 THEN t.bottom ELSE t.ih END AS border_bottom,
  coalesce(CASE WHEN length(s.text) % 3 = 1 THEN 'own' END, CASE WHEN s.col = 0 THEN t."left" ELSE t.iv END) AS border_left
FROM spanned s JOIN e USING (table_no) JOIN t USING (table_no)""", "fx_cells"))
def resolve_cell_borders(spark, sf):
    key, n = F.col("table_no"), F.length("text") % 3
    none = F.lit(None).cast("string")
    cells = spanned(spark, sf).select("*", F.when(n == 0, "off").alias("cell_top"), none.alias("cell_right"), none.alias("cell_bottom"), F.when(n == 1, "own").alias("cell_left"))
    borders = cells.select("table_no").distinct().select(
        "table_no", F.concat(F.lit("t"), key % 5).alias("top"), F.lit("right").alias("right"), F.when(key % 2 == 0, "bottom").alias("bottom"),
        F.lit("left").alias("left"), F.lit("ih").alias("inside_h"), F.when(key % 3 == 0, "iv").alias("inside_v"))
    return grids.resolve_cell_borders(cells, borders).select("table_no", "row_no", "col", *[f"border_{s}" for s in ("top", "right", "bottom", "left")])


# --- differences ------------------------------------------------------------------------------------------------

@query(fx.sql("""
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.block_id, a.block_id) AS block_id,
  CASE WHEN b.block_id IS NULL THEN 'added' WHEN a.block_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM fx_before b FULL JOIN fx_after a ON a.doc_id = b.doc_id AND a.block_id = b.block_id WHERE a.text IS DISTINCT FROM b.text""", "fx_before", "fx_after"))
def diff_blocks(spark, sf):
    return diff.diff_blocks(fx.before(spark, sf), fx.after(spark, sf))


@query(fx.sql("""
, kb AS (SELECT doc_id, block_id, lag(block_id) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM fx_before SEMI JOIN fx_after USING (doc_id, block_id))
, ka AS (SELECT doc_id, block_id, lag(block_id) OVER (PARTITION BY doc_id ORDER BY CASE WHEN seq % 5 = 0 THEN seq + 7 ELSE seq * 1.0 END) AS p FROM fx_after SEMI JOIN fx_before USING (doc_id, block_id))
SELECT doc_id, block_id FROM kb JOIN ka USING (doc_id, block_id) WHERE kb.p IS DISTINCT FROM ka.p""".replace("seq + 7", "seq + 7.5"), "fx_before", "fx_after"))
def moved_blocks(spark, sf):
    moved = fx.after(spark, sf).withColumn("seq", 2 * F.col("seq") + F.when(F.col("seq") % 5 == 0, 15).otherwise(0))
    return diff.moved_blocks(fx.before(spark, sf), moved)


@query(fx.sql("SELECT doc_id, CAST(seq AS BIGINT) AS seq, block_id, text FROM fx_after WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, seq, block_id, text FROM fx_before WHERE doc_id % 3 = 0", "fx_before", "fx_after"))
def apply_changes(spark, sf):
    """Applying the difference to the first state gives the second, for the documents that have a message."""
    b, a = fx.before(spark, sf), fx.after(spark, sf).filter("doc_id % 3 <> 0")
    d = diff.diff_blocks(b.filter("doc_id % 3 <> 0"), a)
    changed = a.join(d.filter("change <> 'removed'"), ["doc_id", "block_id"], "left_semi")
    return longs(diff.apply_changes(b, changed, a.select("doc_id", "seq", "block_id"), b.filter("doc_id % 3 <> 0").select("doc_id")), "seq")


PARTS_SQL = """
, w AS (SELECT doc_id, ['docx', 'odt'][doc_id % 2 + 1] AS format, seq, text,
        CASE WHEN doc_id % 2 = 0 THEN concat('word/', ['document', 'styles', 'header2', 'theme', 'numbering'][seq % 5 + 1], '.xml')
             ELSE concat(['content', 'styles', 'meta', 'settings', 'manifest'][seq % 5 + 1], '.xml') END AS part FROM {view})
, {name} AS (SELECT doc_id, format, part, max(seq) AS s, sha256(string_agg(text, '|' ORDER BY seq)) AS h FROM w GROUP BY ALL)"""


def part_table(blocks):
    docx = F.concat(F.lit("word/"), F.element_at(F.array(*[F.lit(x) for x in ("document", "styles", "header2", "theme", "numbering")]), (F.col("seq") % 5 + 1).cast("int")), F.lit(".xml"))
    odt = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("content", "styles", "meta", "settings", "manifest")]), (F.col("seq") % 5 + 1).cast("int")), F.lit(".xml"))
    named = blocks.withColumn("part", F.when(F.col("doc_id") % 2 == 0, docx).otherwise(odt)).withColumn("format", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("odt"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "|")
    return named.groupBy("doc_id", "format", "part").agg(F.sha2(text, 256).alias("sha256"))


BOTH_SQL = fx.sql(PARTS_SQL.format(view="fx_before", name="pb") + PARTS_SQL.format(view="fx_after", name="pa").replace(", w AS", ", w2 AS").replace("FROM w GROUP", "FROM w2 GROUP"), "fx_before", "fx_after")
CHANGED_SQL = BOTH_SQL + ", ch AS (SELECT coalesce(pb.doc_id, pa.doc_id) AS doc_id, coalesce(pb.part, pa.part) AS part FROM pb FULL JOIN pa ON pb.doc_id = pa.doc_id AND pb.part = pa.part WHERE pb.h IS DISTINCT FROM pa.h) "


@query(CHANGED_SQL + "SELECT * FROM ch")
def changed_parts(spark, sf):
    return diff.changed_parts(part_table(fx.before(spark, sf)), part_table(fx.after(spark, sf)))


@query(CHANGED_SQL + """SELECT doc_id, ['docx', 'odt'][doc_id % 2 + 1] AS format, part FROM ch
WHERE NOT CASE WHEN doc_id % 2 = 0 THEN part IN ('word/document.xml', 'word/header2.xml') ELSE part IN ('content.xml', 'styles.xml') END""")
def preservation(spark, sf):
    return diff.preservation(part_table(fx.before(spark, sf)), part_table(fx.after(spark, sf)))


@query(BOTH_SQL + """
, g AS (SELECT doc_id, part, 0 AS generation, h FROM pb UNION ALL SELECT doc_id, part, 1, h FROM pa UNION ALL
        SELECT doc_id, part, 2, CASE WHEN doc_id % 4 = 0 THEN concat(h, 'x') ELSE h END FROM pa WHERE doc_id % 10 <> 0 OR part NOT LIKE '%styles%')
SELECT a.doc_id, a.part, CAST(2 AS BIGINT) AS generation FROM (SELECT * FROM g WHERE generation = 1) a LEFT JOIN (SELECT * FROM g WHERE generation = 2) b USING (doc_id, part) WHERE a.h IS DISTINCT FROM b.h""")
def fixed_point(spark, sf):
    g0, g1 = part_table(fx.before(spark, sf)), part_table(fx.after(spark, sf))
    drift = F.when(F.col("doc_id") % 4 == 0, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256"))
    g2 = g1.filter((F.col("doc_id") % 10 != 0) | ~F.col("part").contains("styles")).withColumn("sha256", drift)
    every = g0.withColumn("generation", F.lit(0)).unionByName(g1.withColumn("generation", F.lit(1))).unionByName(g2.withColumn("generation", F.lit(2)))
    return longs(diff.fixed_point(every), "generation")


@query(fx.sql("""
, m AS (SELECT doc_id, seq, concat('word/x.xml:', seq, ': Element p[', seq, ']: kind ', kind, ' ', level, CASE WHEN (doc_id + seq) % 7 = 0 THEN ' new' ELSE '' END) AS message,
       concat('Element p[]: kind ', kind, ' ', level, CASE WHEN (doc_id + seq) % 7 = 0 THEN ' new' ELSE '' END) AS k FROM fx_blocks)
SELECT doc_id, message, k AS kind FROM m ANTI JOIN (SELECT DISTINCT doc_id, k FROM m WHERE seq % 2 = 0) USING (doc_id, k) WHERE seq % 2 = 1""", "fx_blocks"))
def introduced_complaints(spark, sf):
    fresh = F.when((F.col("doc_id") + F.col("seq")) % 7 == 0, " new").otherwise("")
    m = fx.blocks(spark, sf).select("doc_id", "seq", F.concat(F.lit("word/x.xml:"), "seq", F.lit(": Element p["), "seq", F.lit("]: kind "), "kind", F.lit(" "), "level", fresh).alias("message"))
    return diff.introduced(m.filter("seq % 2 = 0"), m.filter("seq % 2 = 1")).select("doc_id", "message", "kind")


def summary(spark, sf, second: bool):
    """Three properties per order line: a length (rounded to px in the second reading), a text and an indent."""
    li = fx.table(spark, sf, "orders")
    cm = F.col("o_totalprice") % 50 / 10
    inches = F.concat(F.round(cm / 2.54 + F.when(F.col("o_orderkey") % 10 == 0, 0.5).otherwise(0.001), 5), F.lit("in"))
    length = inches if second else F.concat(F.round(cm, 5), F.lit("cm"))
    text = F.concat("o_orderpriority", F.when(F.lit(second), F.when(F.col("o_orderkey") % 7 == 0, " x").otherwise("  ")).otherwise(""))
    zero = F.when(F.lit(second), None).otherwise("0in")
    rows = lambda prop, v: li.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("key"), F.lit(prop).alias("prop"), v.cast("string").alias("value"))
    return rows("margin", length).unionByName(rows("text", text)).unionByName(rows("indent", zero).filter(F.col("value").isNotNull()))


@query("""
SELECT o_custkey AS doc_id, o_orderkey AS key, 'margin' AS prop FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_custkey, o_orderkey, 'text' FROM orders WHERE o_orderkey % 7 = 0""")
def diff_summaries(spark, sf):
    return diff.diff_summaries(summary(spark, sf, False), summary(spark, sf, True)).select("doc_id", "key", "prop")


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS key FROM orders WHERE o_orderkey % 7 = 0)
, k AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS key, 'reader' AS reason FROM orders WHERE o_orderkey % 5 = 0)
SELECT doc_id, key, CASE WHEN k.reason IS NULL THEN 'failure' ELSE 'known' END AS status, k.reason FROM d LEFT JOIN k USING (doc_id, key)
UNION ALL SELECT doc_id, key, 'stale', reason FROM k ANTI JOIN d USING (doc_id, key)""")
def classify_known(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("key"), "o_orderkey")
    known = o.filter("o_orderkey % 5 = 0").select("doc_id", "key", F.lit("reader").alias("reason")).distinct()
    return diff.classify_known(o.filter("o_orderkey % 7 = 0").drop("o_orderkey"), known)


@query("SELECT sha256(text) AS sha256, substr(sha256(text), 1, 16) AS media_id, count(*) AS copies FROM documents GROUP BY text")
def media_dedup(spark, sf):
    """Identical payloads share one copy: here the texts of documents as bytes."""
    return history.media_dedup(fx.table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content")))


@query(fx.sql("""
, s AS (SELECT doc_id, seq % 4 AS slot, seq, text, length(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[^\\p{L}]', '', 'g')) AS letters FROM fx_blocks)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(seq AS BIGINT) AS section, text AS html FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, slot ORDER BY letters DESC, seq) = 1""", "fx_blocks"))
def running_band(spark, sf):
    b = fx.blocks(spark, sf).select("doc_id", (F.col("seq") % 4).alias("slot"), F.col("seq").alias("section"), F.col("text").alias("html"))
    return longs(numbering.running_band(b, ["doc_id", "slot"]), "slot", "section")
