"""Streams against their batch twins, over several micro-batches."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from sheaf import schemas
from sheaf.operators import history
from sheaf.plans import catalog, fixtures, stream_queries
from sheaf.streaming import feeds, live

SF = "/root/testdata/sf0.001"


def test_undo_stream_equals_the_batch_replay(spark, rows):
    batch = fixtures.with_positions(fixtures.edits(spark, SF), ["doc_id"], ["ts", "event_id"], name="at", start=0)
    op = F.when(F.col("kind") == "deleted", "undo").when(F.col("kind") == "done", "redo").otherwise("push")
    ids = batch.select("doc_id", "at", "event_id")
    want = history.undo_redo(batch.select("doc_id", "at", op.alias("op"), F.col("block_id").alias("state"))).join(ids, ["doc_id", "at"])
    columns = ("doc_id", "event_id", "state", "undo_depth", "redo_depth")
    assert rows(catalog.QUERIES["undo_redo_stream"](spark, SF), *columns) == rows(want, *columns)


def test_blocks_follow_the_order_over_several_batches(spark, tmp_path):
    message = lambda n, changed, order, removed=(): {"doc_id": 1, "session": 0, "ts": f"2024-01-01T00:00:0{n}Z", "event_id": n, "order": order, "removed": list(removed),
                                                     "changed": [{"id": k, "html": v} for k, v in changed.items()]}
    feed = tmp_path / "feed"
    feed.mkdir()
    steps = [message(0, {"a": "1", "b": "1"}, ["a", "b"]), message(1, {"b": "2"}, ["b", "a", "ghost"]), message(2, {}, ["b"], ["a"]), message(3, {"c": "3"}, ["c", "a", "b"])]
    for n, m in enumerate(steps):
        (feed / f"{n}.json").write_text(json.dumps(m))
        os.utime(feed / f"{n}.json", (1_700_000_000 + n,) * 2)  # files arrive one after the other
    stream = feeds.read_change_feed(spark, str(feed), schemas.BLOCK_CHANGES, files_per_trigger=1)
    got = live.current_blocks(feeds.drain(live.live_blocks(stream)))
    # b keeps its newer content; a was dropped by an order and does not come back without content.
    assert [(r.seq, r.block_id, r.html) for r in got.orderBy("seq").collect()] == [(0, "c", "3"), (1, "b", "2")]


def test_older_events_in_later_batches_change_nothing(spark):
    """Day 2 arrives before day 1: extras keep the newer value, geometry field by field; an empty presence set clears peers."""
    def message(event, day, **fields):
        return (1, f"2024-01-0{day} 00:00:00", event, *fields.values())

    folder = feeds.shared_folder(spark, "late")
    extras = [("note", "n", '{"a": 2}', 2, 20), ("geometry", "", '{"w": 2}', 2, 21), ("note", "n", '{"a": 1}', 1, 10),
              ("geometry", "", '{"w": 1, "h": 1}', 1, 11), ("note", "n", "unreadable", 3, 30)]
    for kind, id, value, day, event in extras:
        row = spark.createDataFrame([message(event, day, kind=kind, id=id, value=value)], "doc_id bigint, ts string, event_id bigint, kind string, id string, value string")
        row.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/extras.parquet")
    stream = feeds.read_table_feed(spark, folder, "extras", files_per_trigger=1)
    out = feeds.latest(feeds.drain(live.live_extras(stream)), ["doc_id", "kind", "id"])
    assert {r.kind: json.loads(r.value) for r in out.collect()} == {"note": {"a": 2}, "geometry": {"h": 1, "w": 2}}

    carets = "carets array<struct<id:string,block_id:string>>"
    for day, event, peers in ((1, 1, [("p", "b0"), ("q", "b9")]), (3, 3, []), (2, 2, [("r", "b0")])):
        row = spark.createDataFrame([message(event, day, carets=peers)], f"doc_id bigint, ts string, event_id bigint, {carets}")
        row.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/peers.parquet")
    sets = feeds.drain(live.presence_sets(feeds.read_table_feed(spark, folder, "peers", files_per_trigger=1)), "update")
    blocks = spark.createDataFrame([(1, "b0")], "doc_id bigint, block_id string")
    assert [r.peer for r in live.shown_peers(sets.filter("batch_id = 0"), blocks).collect()] == ["p"]
    assert live.shown_peers(feeds.latest(sets, ["doc_id"]), blocks).count() == 0


def test_typing_runs_break_at_keys_and_close_behind_the_watermark(spark, rows):
    """Final runs and open ones together are the batch operator's runs, whatever the micro-batches."""
    edits = [(1, 1, 0, "t"), (1, 2, 1, "t"), (1, 3, 2, "n"), (1, 4, 3, "t"), (1, 5, 4, None), (1, 6, 5, None), (1, 7, 400, "t"), (2, 8, 1, "t"), (1, 9, 4000, "t"), (1, 10, 4001, "t")]
    df = spark.createDataFrame(edits, "doc_id bigint, event_id bigint, s bigint, coalesce_key string").select(
        "doc_id", "event_id", "coalesce_key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    folder = feeds.shared_folder(spark, "typing")
    for low, high in ((0, 3), (3, 6), (6, 9), (9, 10), (10, 11)):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{folder}/edits.parquet")
    emitted = feeds.drain(live.typing_sessions(feeds.read_table_feed(spark, folder, "edits", files_per_trigger=1), idle="60 seconds", delay="10 minutes"))
    batch = history.edit_runs(df, "60 seconds").groupBy("doc_id", "run_no").agg(F.max("coalesce_key").alias("coalesce_key"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    columns = ("doc_id", "coalesce_key", "started", "ended", "n")
    assert rows(live.current_sessions(emitted), *columns) == rows(batch, *columns)
    assert emitted.filter("final").count() > 0


def test_last_run_of_a_silent_document_becomes_final(spark, rows):
    """Other documents move the watermark on; the run ends without an edit of its own, and an edit that comes late joins it."""
    edits = [(1, 1, 0, "t"), (1, 2, 1, "t"), (2, 3, 30, "u"), (1, 4, 2, "t"), (2, 5, 100, "u"), (2, 6, 5000, "u"), (3, 7, 9000, None)]
    df = spark.createDataFrame(edits, "doc_id bigint, event_id bigint, s bigint, coalesce_key string").select(
        "doc_id", "event_id", "coalesce_key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    folder = feeds.shared_folder(spark, "silent")
    for i in range(1, 8):
        df.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(f"{folder}/edits.parquet")
    emitted = feeds.drain(live.typing_sessions(feeds.read_table_feed(spark, folder, "edits", files_per_trigger=1), idle="5 seconds", delay="60 seconds"))
    assert rows(emitted.filter("final"), "doc_id", "n") == [(1, 3), (2, 1), (2, 1), (2, 1)]
    assert rows(live.current_sessions(emitted), "doc_id", "n") == [(1, 3), (2, 1), (2, 1), (2, 1), (3, 1)]


def test_a_long_run_is_kept_as_one_row(spark, rows):
    """Edits behind the watermark are folded: with a micro-batch an edit, the run comes out whole and its state stays short."""
    from sheaf.streaming.live import _TypingSessions

    class Held:
        def __init__(self):
            self.value, self.timers = None, set()

        exists = lambda self: self.value is not None
        get = lambda self: self.value or []
        clear = lambda self: setattr(self, "value", None)
        update = put = lambda self, v: setattr(self, "value", v)
        getValueState = getListState = lambda self, *_: Held()
        listTimers = lambda self: self.timers
        deleteTimer = lambda self, t: self.timers.discard(t)
        registerTimer = lambda self, t: self.timers.add(t)

    class Clock:
        def __init__(self, s):
            self.getCurrentWatermarkInMs = lambda: s * 1000

    p, handle, longest = _TypingSessions(pd.Timedelta("5 seconds")), Held(), 0
    p.init(handle)
    for s in range(1000):
        frame = pd.DataFrame({"ts": [pd.Timestamp(s, unit="s")], "event_id": [s], "coalesce_key": ["t"]})
        out, = p.handleInputRows((1,), iter([frame]), Clock(max(0, s - 10)))
        longest = max(longest, len(p.edits.get()))
        assert out.values.tolist() == [[1, "t", pd.Timestamp(0), pd.Timestamp(s, unit="s"), s + 1, False]] and len(handle.timers) == 1
    assert longest <= 12 and handle.timers == {(999 + 5) * 1000 + 1}
    out, = p.handleExpiredTimer((1,), Clock(1005), None)
    assert out["final"].tolist() == [True] and out["n"].tolist() == [1000] and not p.settled.exists() and not handle.timers


def test_nothing_to_stream(spark):
    folder = feeds.shared_folder(spark, "none")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{folder}/t.parquet")
    assert feeds.drain(feeds.read_table_feed(spark, folder, "t")).count() == 0


def test_messages_applied_in_batch_give_the_live_state(spark, rows):
    want = catalog.QUERIES["live_blocks"](spark, SF)
    newest = stream_queries.change_messages(spark, SF).groupBy("doc_id").agg(F.max_by("order", F.struct("ts", "event_id")).alias("order"))
    order = newest.select("doc_id", F.posexplode("order").alias("seq", "block_id"))
    assert rows(want, "doc_id", "block_id") == rows(order, "doc_id", "block_id")


def test_feed_can_be_written_and_read_back(spark, tmp_path):
    source = feeds.read_table_feed(spark, SF, "events").select("event_id")
    query = feeds.write_change_feed(source, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1000
