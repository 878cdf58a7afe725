"""Findings of round 4."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from sheaf.streaming import feeds, live


class Calls:
    """Map state that counts how often it is read and written."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_state_calls_grow_with_documents_not_with_snapshots_or_blocks():
    state, p = Calls(), live._EmitChanges()
    p.init(state)
    n, ids = 200, json.dumps([f"b{i}" for i in range(50)])
    frame = pd.DataFrame({"doc": [f"={k % 2}" for k in range(n)], "ts": range(n), "event_id": range(n), "echo": False, "ids": ids,
                          "htmls": [json.dumps([str(k // 2 if i == 7 else 0) for i in range(50)]) for k in range(n)]})
    out, = p.handleInputRows((0,), iter([frame[100:], frame[:100]]), None)
    assert state.calls == 4 and len(out) == n - 2 and set(out["changed"].map(lambda c: len(json.loads(c)))) == {1}


def test_state_calls_grow_with_documents_not_with_extras():
    state, p = Calls(), live._LiveExtras()
    p.init(state)
    n = 300
    frame = pd.DataFrame({"doc": [f"={k % 3}" for k in range(n)], "kind": "band", "id": [f"k{k % 30}" for k in range(n)],
                          "ts": range(n), "event_id": range(n), "value": [str(k) for k in range(n)]})
    out, = p.handleInputRows((0,), iter([frame[100:], frame[:100]]), None)
    assert state.calls == 6 and sorted(out["value"].astype(int)) == list(range(n - 30, n))
    assert list(p.handleInputRows((0,), iter([frame]), None)) == [] and state.calls == 12  # nothing new


def test_snapshots_over_two_batches(spark, tmp_path):
    """Contents without a value, documents without an id, echoes, removals and moves."""
    def snapshot(n, doc, echo=False, **blocks):
        return json.dumps({"doc_id": doc, "ts": f"2024-01-01T00:00:0{n}Z", "event_id": n, "echo": echo, "blocks": [{"id": i, "html": h} for i, h in blocks.items()]})

    batches = [[snapshot(2, 1, a="2", b=None), snapshot(1, 1, a="1"), snapshot(3, None, a="é\"")],
               [snapshot(4, 1, b=None, a="2"), snapshot(6, 1, b="6"), snapshot(5, 1, True, b="5", a="2"), snapshot(7, None)]]
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, lines in enumerate(batches):
        (feed / f"{n}.json").write_text("\n".join(lines))
        os.utime(feed / f"{n}.json", (1_700_000_000 + n,) * 2)
    stream = feeds.read_change_feed(spark, str(feed), "doc_id bigint, ts timestamp, event_id bigint, echo boolean, blocks array<struct<id:string,html:string>>", files_per_trigger=1)
    out = feeds.drain(live.emit_block_changes(stream)).orderBy("event_id").collect()
    assert [(r.doc_id, r.event_id, [tuple(c) for c in r.changed], r.removed, r.order, r.batch_id) for r in out] == [
        (1, 2, [("a", "2"), ("b", None)], [], ["a", "b"], 0), (1, 6, [("b", "6")], ["a"], ["b"], 1), (None, 7, [], ["a"], [], 1)]


def test_last_write_holds_over_batches_and_only_changes_come_out(spark):
    folder = feeds.shared_folder(spark, "last")
    for rows in ([(1, 5, "5"), (None, 2, "2"), (1, 1, "1")], [(1, 4, "4"), (None, 3, "2")], [(1, 6, None)]):
        df = spark.createDataFrame([(d, n, v) for d, n, v in rows], "doc_id bigint, event_id bigint, value string")
        df.select("*", F.timestamp_seconds("event_id").alias("ts"), F.lit("done").alias("kind"), F.lit("k").alias("edit_key")).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    out = feeds.drain(live.last_deliveries(feeds.read_table_feed(spark, folder, "t", files_per_trigger=1)))
    assert sorted(((r.batch_id, str(r.doc_id), r.value) for r in out.collect())) == [(0, "1", "5"), (0, "None", "2"), (2, "1", None)]


def test_words_of_the_whole_corpus_are_counted(spark):
    from sheaf.llm import bpe

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate(F.floor(F.col("id") / 2).cast("string"), "0123456789", "abcdefghij")).alias("text"))
    assert len(set(bpe.frequent_words(docs))) == 15_000


def test_nearest_element_and_path_below_it(spark):
    from sheaf.sources.nodes import inside, path_below

    near = inside("a", "b")
    assert str(near).count("array_position") == 2  # a filter works out what it repeats again
    rows = spark.createDataFrame([(["r", "a", "b", "c"], [0, 1, 4, 9]), (["a", "a"], [0, 3]), (["r", "c"], [0, 2])], "trail array<string>, ids array<int>")
    got = rows.select(near, inside("b"), F.when(near.isNotNull(), path_below("a"))).collect()
    assert list(map(tuple, got)) == [(4, 4, "b/c"), (3, None, ""), (None, None, None)]


def test_rows_are_narrow_where_they_are_grouped(spark):
    """A group-by of nodes sorts its input: trails are read before it, not within."""
    from sheaf.plans import package_queries as queries
    from sheaf.sources import docx, odt

    sf = "/root/testdata/sf0.001"
    for df in (odt.blocks(queries.odt_nodes(spark, sf)), docx.blocks(queries.docx_nodes(spark, sf)), docx.runs(queries.docx_nodes(spark, sf))):
        grouped = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
        assert grouped and not any("trail#" in x for x in grouped)
