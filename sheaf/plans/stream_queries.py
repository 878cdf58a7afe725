"""Queries that run a stream over the driver's tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators.scan import TASK_ROWS, last_row, scan, with_positions
from ..streaming import feeds, live
from . import fixtures as fx
from .registry import query
from .text_queries import WORDS, WS


def edit_stream(spark, sf):
    """The edit log as a stream of its files."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return feeds.read_table_feed(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("session"),
        F.concat(F.lit("b"), k % 20).alias("block_id"), F.when(kind == "view", "t").when(kind == "click", "note").alias("coalesce_key"),
        F.when(kind == "view", "reaction").when(kind == "click", "reply").when(kind == "purchase", "done").when(kind == "error", "deleted").otherwise("edited").alias("kind"),
        F.concat(F.lit("k"), k % 20).alias("edit_key"), "value")


def scrambled(spark, df):
    """``df`` as a feed of four portions, each with events from all times, read one portion per micro-batch. A portion is one file,
    or several where it has more rows than one task should write and read."""
    folder = feeds.shared_folder(spark, "feed")
    files = max(1, -(-df.count() // (4 * TASK_ROWS)))
    for k in (2, 0, 3, 1):
        portion = df.filter(F.col("event_id") % 4 == k)
        portion = portion.coalesce(1) if files == 1 else portion.repartition(files, "event_id")
        portion.write.mode("append").parquet(f"{folder}/edits.parquet")
    return feeds.read_table_feed(spark, folder, "edits", files_per_trigger=files)


def edit_files(spark, sf):
    return scrambled(spark, fx.edits(spark, sf))


def change_messages(spark, sf):
    """Each edit as a change message: the new content of its block, and the ids held after it in block order."""
    placed = with_positions(fx.edits(spark, sf), ["doc_id"], ["ts", "event_id"], start=0)
    ids = [f"b{i}" for i in range(20)]
    held = scan(placed, ["doc_id"], "pos", **{f"_{i}": last_row(F.col("block_id") == i, kind=F.col("kind")) for i in ids})
    order = F.array_compact(F.array(*[F.when(F.col(f"_{i}.kind") != "deleted", F.lit(i)) for i in ids]))
    gone = F.col("kind") == "deleted"
    return held.select(
        "doc_id", "session", "ts", "event_id",
        F.when(gone, F.array().cast("array<struct<id:string,html:string>>")).otherwise(F.array(F.struct(F.col("block_id").alias("id"), F.col("value").cast("string").alias("html")))).alias("changed"),
        F.when(gone, F.array("block_id")).otherwise(F.array().cast("array<string>")).alias("removed"), order.alias("order"))


def message_feed(spark, sf):
    """The messages written out as JSON lines and read back as a feed."""
    folder = feeds.shared_folder(spark, "feed")
    change_messages(spark, sf).write.json(folder)
    return feeds.read_change_feed(spark, folder, schemas.BLOCK_CHANGES)


LIVE_SQL = fx.sql("""
, z AS (SELECT doc_id, block_id, arg_max(kind, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS html FROM fx_edits {where} GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(substr(block_id, 2) AS INT)) - 1 AS BIGINT) AS seq, block_id, html FROM z WHERE kind <> 'deleted'""", "fx_edits")


@query(LIVE_SQL.format(where=""))
def live_blocks(spark, sf):
    emitted = feeds.drain(live.live_blocks(message_feed(spark, sf)))
    return live.current_blocks(emitted).withColumn("html", F.col("html").cast("double"))


@query(fx.sql("SELECT event_id, doc_id, CAST(len(changed) AS BIGINT) AS n_changed FROM (SELECT event_id, doc_id, CASE WHEN kind = 'deleted' THEN [] ELSE [1] END AS changed, session FROM fx_edits) WHERE session <> 1", "fx_edits"))
def foreign_edits(spark, sf):
    out = feeds.drain(feeds.foreign_edits(message_feed(spark, sf), 1))
    return out.select("event_id", "doc_id", F.size("changed").cast("long").alias("n_changed"))


@query(fx.sql("""
, p AS (SELECT doc_id, event_id, block_id, kind, value, lag(kind) OVER w AS pk, lag(value) OVER w AS pv, row_number() OVER d AS rn FROM fx_edits
  WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY ts, event_id), d AS (PARTITION BY doc_id ORDER BY ts, event_id))
SELECT doc_id, event_id, CAST(CASE WHEN kind = 'deleted' THEN 0 ELSE 1 END AS BIGINT) AS n_changed, CAST(CASE WHEN kind = 'deleted' THEN 1 ELSE 0 END AS BIGINT) AS n_removed
FROM p WHERE rn > 1 AND event_id % 5 <> 0 AND CASE WHEN kind = 'deleted' THEN coalesce(pk, 'deleted') <> 'deleted' ELSE coalesce(pk, 'deleted') = 'deleted' OR pv IS DISTINCT FROM value END""", "fx_edits"))
def emit_block_changes(spark, sf):
    """Snapshots of the blocks after each edit turned back into change messages; every fifth is a peer's echo."""
    placed = with_positions(fx.edits(spark, sf), ["doc_id"], ["ts", "event_id"], start=0)
    ids = [f"b{i}" for i in range(20)]
    held = scan(placed, ["doc_id"], "pos", **{f"_{i}": last_row(F.col("block_id") == i, kind=F.col("kind"), value=F.col("value")) for i in ids})
    blocks = F.array_compact(F.array(*[
        F.when(F.col(f"_{i}.kind") != "deleted", F.struct(F.lit(i).alias("id"), F.col(f"_{i}.value").cast("string").alias("html"))) for i in ids]))
    folder = feeds.shared_folder(spark, "feed")
    held.select("doc_id", "ts", "event_id", (F.col("event_id") % 5 == 0).alias("echo"), blocks.alias("blocks")).write.json(folder)
    stream = feeds.read_change_feed(spark, folder, "doc_id bigint, ts timestamp, event_id bigint, echo boolean, blocks array<struct<id:string,html:string>>")
    out = feeds.drain(live.emit_block_changes(stream))
    return out.select("doc_id", "event_id", F.size("changed").cast("long").alias("n_changed"), F.size("removed").cast("long").alias("n_removed"))


@query(fx.sql("""
, p AS (SELECT doc_id, coalesce_key, ts, event_id, CASE WHEN coalesce_key = lag(coalesce_key) OVER w AND ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM fx_edits WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id))
, s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM p)
SELECT doc_id, max(coalesce_key) AS coalesce_key, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY doc_id, no""", "fx_edits"))
def typing_sessions(spark, sf):
    """Files out of order: a watermark of the whole span lets every edit find its run."""
    return live.current_sessions(feeds.drain(live.typing_sessions(edit_files(spark, sf), idle="30 minutes", delay="400 days")))


@query(fx.sql("""SELECT doc_id, kind, edit_key, CAST(count(DISTINCT 1) AS BIGINT) AS n FROM fx_edits WHERE kind NOT IN ('done', 'edited') GROUP BY ALL""", "fx_edits"))
def first_deliveries(spark, sf):
    """Every edit delivered twice still counts once."""
    twice = edit_files(spark, sf).withColumn("_d", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_d")
    out = feeds.drain(live.first_deliveries(twice))
    return out.groupBy("doc_id", "kind", "edit_key").agg(F.count("*").alias("n"))


@query(fx.sql("SELECT doc_id, kind, edit_key AS id, arg_max(value, (ts, event_id)) AS value FROM fx_edits WHERE kind IN ('done', 'edited') GROUP BY ALL", "fx_edits"))
def last_deliveries(spark, sf):
    out = feeds.drain(live.last_deliveries(edit_files(spark, sf)))
    return feeds.latest(out, ["doc_id", "kind", "id"]).withColumn("value", F.col("value").cast("double"))


@query(fx.sql("""
, e AS (SELECT doc_id, CASE event_id % 3 WHEN 0 THEN 'geometry' WHEN 1 THEN 'band' ELSE 'note' END AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE edit_key END AS id, edit_key, value, ts, event_id FROM fx_edits)
, g AS (SELECT doc_id, 'geometry' AS kind, '' AS id, CAST(count(DISTINCT edit_key) AS BIGINT) AS fields, NULL::DOUBLE AS value FROM e WHERE kind = 'geometry' GROUP BY doc_id)
SELECT * FROM g UNION ALL SELECT doc_id, kind, id, NULL, arg_max(value, (ts, event_id)) FROM e WHERE kind <> 'geometry' AND CAST(substr(id, 2) AS INT) % 2 = 0 GROUP BY doc_id, kind, id""", "fx_edits"))
def live_extras(spark, sf):
    """Bands and notes with even keys exist; geometry edits each set one field; the last value of each is current."""
    which = F.when(F.col("event_id") % 3 == 0, "geometry").when(F.col("event_id") % 3 == 1, "band").otherwise("note")
    value = F.when(which == "geometry", F.concat(F.lit('{"'), "edit_key", F.lit('": '), F.col("value").cast("string"), F.lit("}"))).otherwise(F.col("value").cast("string"))
    extras = edit_files(spark, sf).select("doc_id", "ts", "event_id", which.alias("kind"), F.when(which == "geometry", "").otherwise(F.col("edit_key")).alias("id"), value.alias("value"))
    keys = fx.edits(spark, sf).select("doc_id", "edit_key").distinct().filter(F.substr("edit_key", F.lit(2)).cast("int") % 2 == 0)
    known = keys.select("doc_id", F.explode(F.array(F.lit("band"), F.lit("note"))).alias("kind"), F.col("edit_key").alias("id"))
    out = feeds.latest(feeds.drain(live.live_extras(extras, known)), ["doc_id", "kind", "id"])
    geometry = F.col("kind") == "geometry"
    return out.select("doc_id", "kind", "id", F.when(geometry, F.size(F.json_object_keys("value"))).cast("long").alias("fields"),
                      F.when(~geometry, F.col("value").try_cast("double")).alias("value"))


@query(fx.sql("""
, last AS (SELECT doc_id, max_by(event_id, (ts, event_id)) AS event_id FROM fx_edits GROUP BY doc_id)
SELECT DISTINCT e.doc_id, concat('s', s.n) AS peer, concat('b', (CAST(substr(e.block_id, 2) AS INT) + s.n) % 20) AS block_id
FROM fx_edits e JOIN last USING (doc_id, event_id) CROSS JOIN (VALUES (0), (1), (2)) AS s(n)
WHERE e.kind <> 'deleted' AND EXISTS (SELECT 1 FROM fx_edits b WHERE b.doc_id = e.doc_id AND b.block_id = concat('b', (CAST(substr(e.block_id, 2) AS INT) + s.n) % 20))""", "fx_edits"))
def presence(spark, sf):
    """Each edit reports three peers, at its own block and at the two after it; a deletion reports that nobody is left."""
    at = F.substr("block_id", F.lit(2)).cast("int")
    carets = F.array(*[F.struct(F.lit(f"s{n}").alias("id"), F.concat(F.lit("b"), (at + n) % 20).alias("block_id")) for n in range(3)])
    messages = edit_files(spark, sf).select("doc_id", "ts", "event_id", F.when(F.col("kind") == "deleted", F.slice(carets, 1, 0)).otherwise(carets).alias("carets"))
    blocks = fx.edits(spark, sf).select("doc_id", "block_id").distinct()
    return live.shown_peers(feeds.latest(feeds.drain(live.presence_sets(messages), "update"), ["doc_id"]), blocks)


@query(fx.sql(rf"""
SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS words, CAST(sum(length(regexp_replace(text, '{WS}', '', 'g'))) AS BIGINT) AS chars FROM fx_blocks GROUP BY doc_id""", "fx_blocks"))
def live_counts(spark, sf):
    lines = feeds.read_table_feed(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return feeds.latest(feeds.drain(live.live_counts(lines), "update"), ["doc_id"])


@query(fx.sql("SELECT doc_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM fx_edits GROUP BY ALL", "fx_edits"))
def hourly_counts(spark, sf):
    return feeds.latest(feeds.drain(live.hourly_counts(edit_files(spark, sf)), "update"), ["doc_id", "hour"])


@query(fx.sql("SELECT doc_id, event_id, coalesce_key FROM fx_edits", "fx_edits"))
def stored_table_feed(spark, sf):
    """A table stored as a folder of part files, as a stream of two files a batch."""
    folder = feeds.shared_folder(spark, "tables")
    fx.edits(spark, sf).repartition(5, "event_id").write.parquet(f"{folder}/edits.parquet")
    return feeds.drain(feeds.read_table_feed(spark, folder, "edits", files_per_trigger=2).select("doc_id", "event_id", "coalesce_key")).drop("batch_id")


@query()
def undo_redo_stream(spark, sf):
    """The undo replay as a stream (its rows equal those of the batch query; see the tests)."""
    op = F.when(F.col("kind") == "deleted", "undo").when(F.col("kind") == "done", "redo").otherwise("push")
    ops = edit_stream(spark, sf).select("doc_id", "ts", "event_id", op.alias("op"), F.col("block_id").alias("state"))
    return feeds.drain(live.undo_redo(ops)).drop("batch_id")
