"""Document-shaped views over the driver's tables, once as DataFrames and once as SQL for the comparison engine.

They stand in for parsed documents: lines of ``documents`` as blocks, ``conversations`` as comments, ``events`` as an
edit log, ``lineitem`` as positions in long documents, ``customer`` as styles, ``orders`` as runs with revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import with_positions

# Page size used by the paging queries: A4 at 96 dpi, one inch margins, 24 px between pages.
PAGE_STEP = 1147
CONTENT_HEIGHT = 931


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    size = F.length("text")
    return lines.select(
        "doc_id", "seq", "text",
        F.when(size <= 24, "h").otherwise("p").alias("kind"),
        (1 + F.col("seq") % 3).alias("level"),
        (20 * (1 + F.floor(size / 80))).cast("int").alias("height_px"),
        (F.col("seq") % 17 == 16).alias("forced"),
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    para = lambda t: F.concat(F.lit("P"), (conv * 1000 + t).cast("string"))
    return c.select(
        conv.alias("doc_id"), (conv * 1000 + turn).alias("comment_id"), F.col("role").alias("author"),
        turn.alias("ref_ord"), "text", para(turn).alias("para_id"),
        F.when(turn == 0, F.lit(None)).when(turn % 5 == 4, para(turn - 1)).otherwise(para(F.lit(0))).alias("parent_para_id"),
        ((turn == 0) & (conv % 3 == 0)).alias("done"),
    )


def edits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 3).alias("session"), F.concat(F.lit("b"), (k % 20).cast("string")).alias("block_id"),
        F.when(kind == "view", "t").when(kind == "click", "note").alias("coalesce_key"),
        F.when(kind == "view", "reaction").when(kind == "click", "reply").when(kind == "purchase", "done")
        .when(kind == "error", "deleted").otherwise("edited").alias("kind"),
        F.concat(F.lit("k"), (k % 20).cast("string")).alias("edit_key"), "value",
    )


def marks(spark: SparkSession, sf: str) -> DataFrame:
    ordered = with_positions(
        table(spark, sf, "lineitem").withColumn("doc_id", F.col("l_suppkey")), ["doc_id"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return ordered.select(
        "doc_id", "pos", F.col("l_returnflag").alias("seq_name"),
        F.when(F.col("l_linestatus") == "O", "footnote").otherwise("endnote").alias("note_kind"),
        (F.col("l_quantity").cast("int") % 4).alias("level"), (F.col("l_tax") >= 0.02).alias("is_list"),
        F.concat(F.lit("n"), F.col("l_partkey") % 3).alias("num_id"), (F.col("l_quantity") >= 48).alias("boundary"),
        F.concat(F.lit("bm"), F.col("l_partkey") % 50).alias("bookmark"),
        F.concat(F.lit("bm"), (F.col("l_partkey") * 7) % 60).alias("xref"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def styles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("style_id"),
        F.when(key < 10, F.lit(None)).when(key % 97 == 0, key).otherwise(F.floor(key / 10)).cast("long").alias("based_on"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("p_color"),
        F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey")).alias("p_size"), F.col("c_name").alias("name"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_positions(
        table(spark, sf, "lineitem").withColumn("table_no", F.col("l_orderkey")), ["table_no"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], name="row_no")
    return rows.withColumn("cell_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "table_no", "row_no", "cell_no", (1 + (F.col("l_partkey") + F.col("cell_no")) % 2).cast("int").alias("colspan"),
        F.when(F.col("l_returnflag") == "A", "restart").when(F.col("l_returnflag") == "N", "cont").alias("vmerge"),
        F.concat(F.lit("c"), F.col("l_partkey")).alias("text"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), key.alias("seq"), F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "F", "ins").when(F.col("o_orderstatus") == "P", "del").alias("rev_kind"),
        F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("rev_author"), F.col("o_orderdate").alias("rev_date"),
        F.when(key % 7 == 0, "ins").when(key % 7 == 1, "del").alias("rev_para"),
    )


def before(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("doc_id", F.concat_ws("-", "doc_id", "seq").alias("block_id"), "seq", "text")


def after(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf)
    mixed = F.col("doc_id") + F.col("seq")
    kept = b.filter(mixed % 11 != 0).select(
        "doc_id", F.concat_ws("-", "doc_id", "seq").alias("block_id"), "seq",
        F.when(mixed % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    new = b.filter((F.col("seq") == 0) & (F.col("doc_id") % 4 == 0)).select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-new")).alias("block_id"),
        F.lit(100000).alias("seq"), F.lit("added").alias("text"))
    return kept.unionByName(new)


SQL = {
    "fx_blocks": """
        SELECT doc_id, seq, text, CASE WHEN length(text) <= 24 THEN 'h' ELSE 'p' END AS kind, 1 + seq % 3 AS level,
               20 * (1 + CAST(floor(length(text) / 80) AS INT)) AS height_px, (seq % 17 = 16) AS forced
        FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS seq, unnest(l) AS text
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "fx_comments": """
        SELECT conv_id AS doc_id, conv_id * 1000 + turn AS comment_id, role AS author, turn AS ref_ord, text,
               concat('P', conv_id * 1000 + turn) AS para_id,
               CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN concat('P', conv_id * 1000 + turn - 1)
                    ELSE concat('P', conv_id * 1000) END AS parent_para_id,
               (turn = 0 AND conv_id % 3 = 0) AS done
        FROM conversations""",
    "fx_edits": """
        SELECT event_id, user_id AS doc_id, ts, event_id % 3 AS session, concat('b', k % 20) AS block_id,
               CASE event_type WHEN 'view' THEN 't' WHEN 'click' THEN 'note' END AS coalesce_key,
               CASE event_type WHEN 'view' THEN 'reaction' WHEN 'click' THEN 'reply' WHEN 'purchase' THEN 'done'
                               WHEN 'error' THEN 'deleted' ELSE 'edited' END AS kind,
               concat('k', k % 20) AS edit_key, value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "fx_marks": """
        SELECT l_suppkey AS doc_id,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS pos,
               l_returnflag AS seq_name, CASE WHEN l_linestatus = 'O' THEN 'footnote' ELSE 'endnote' END AS note_kind,
               CAST(l_quantity AS INT) % 4 AS level, (l_tax >= 0.02) AS is_list, concat('n', l_partkey % 3) AS num_id,
               (l_quantity >= 48) AS boundary, concat('bm', l_partkey % 50) AS bookmark,
               concat('bm', (l_partkey * 7) % 60) AS xref, CAST(l_quantity AS INT) AS quantity
        FROM lineitem""",
    "fx_styles": """
        SELECT c_custkey AS style_id,
               CASE WHEN c_custkey < 10 THEN NULL WHEN c_custkey % 97 = 0 THEN c_custkey
                    ELSE CAST(floor(c_custkey / 10) AS BIGINT) END AS based_on,
               CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS p_color,
               CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey END AS p_size, c_name AS name
        FROM customer""",
    "fx_cells": """
        SELECT l_orderkey AS table_no, row_no, c AS cell_no, CAST(1 + (l_partkey + c) % 2 AS INT) AS colspan,
               CASE l_returnflag WHEN 'A' THEN 'restart' WHEN 'N' THEN 'cont' END AS vmerge,
               concat('c', l_partkey) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_no
              FROM lineitem) CROSS JOIN (VALUES (1), (2), (3)) AS g(c)""",
    "fx_runs": """
        SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderpriority AS text,
               CASE o_orderstatus WHEN 'F' THEN 'ins' WHEN 'P' THEN 'del' END AS rev_kind,
               concat('u', o_custkey % 5) AS rev_author, o_orderdate AS rev_date,
               CASE o_orderkey % 7 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' END AS rev_para
        FROM orders""",
    "fx_before": "SELECT doc_id, concat(doc_id, '-', seq) AS block_id, seq, text FROM fx_blocks",
    "fx_after": """
        SELECT doc_id, concat(doc_id, '-', seq) AS block_id, seq,
               CASE WHEN (doc_id + seq) % 7 = 0 THEN concat(text, '!') ELSE text END AS text
        FROM fx_blocks WHERE (doc_id + seq) % 11 <> 0
        UNION ALL
        SELECT doc_id, concat(doc_id, '-new'), 100000, 'added' FROM fx_blocks WHERE seq = 0 AND doc_id % 4 = 0""",
}
NEEDS = {"fx_before": ["fx_blocks"], "fx_after": ["fx_blocks"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` preceded by the named views as common table expressions. ``body`` may continue with ", more AS (...)"."""
    names: list[str] = []
    for view in views:
        names += [v for v in [*NEEDS.get(view, []), view] if v not in names]
    if not names:
        return "WITH " + body.lstrip().removeprefix(",")
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
