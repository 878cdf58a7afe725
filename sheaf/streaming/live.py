"""State kept per document while its feed runs: blocks, extras, undo, presence, counts, typing runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import char_count, word_count
from ..operators.history import step


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """The messages a key got in one micro-batch, by event time and id. The trigger bounds how many there are."""
    frames = [f for f in rows if len(f)]
    if frames:
        yield from pd.concat(frames).sort_values(["ts", "event_id"]).to_dict("records")


def _ids(value) -> list:
    return [] if value is None else list(value)


#: Documents are dealt to so many groups where the state of each is small: a group costs some milliseconds a micro-batch, and
#: what lies in its map state is read and written by document.
BUCKETS = 1024


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _doc() -> Column:
    """``doc_id`` as the text by which map state knows it."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("doc")


def _doc_id(feed: DataFrame) -> Column:
    """``doc_id`` of ``feed`` back from ``doc``."""
    return F.when(F.col("doc") != "", F.substr("doc", F.lit(2))).cast(feed.schema["doc_id"].dataType).alias("doc_id")


def _clock(name: str) -> Column:
    """Where a message stands in the order of events, by one column. Messages without it come first."""
    value = F.unix_micros(F.col(name).cast("timestamp")) if name == "ts" else F.col(name).cast("long")
    return F.coalesce(value, F.lit(-(1 << 63))).alias(name)


class _LiveBlocks(StatefulProcessor):
    """Blocks by id and the order of a document. Content sits in map state; of a micro-batch only what it leaves is written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.html = handle.getMapState("html", "block_id string", "html string")
        self.order = handle.getValueState("order", "ids array<string>")

    def handleInputRows(self, key, rows, timerValues):
        held = _ids(self.order.get()[0]) if self.order.exists() else []
        before, touched, last = list(held), {}, None
        for m in _in_order(rows):
            last = m
            incoming = {c["id"]: c["html"] for c in _ids(m["changed"])}
            known = set(held)
            wanted = [i for i in _ids(m["order"]) if i in incoming or i in known]
            for gone in known.difference(wanted):
                touched[gone] = None
            for i in wanted:
                if i in incoming:
                    touched[i] = incoming[i]
            held = wanted
        if last is None:
            return
        # Each call to the state is a round trip: one per block, not per message.
        kept, was = set(held), set(before)
        for i, h in touched.items():
            if i in kept:
                self.html.updateValue((i,), (h,))
            elif i in was:
                self.html.removeKey((i,))
        if held != before:
            self.order.update((held,))
        out = [(key[0], "removed" if h is None else "block", i, h, None) for i, h in touched.items()]
        if held != before:
            out.append((key[0], "order", None, None, held))
        yield pd.DataFrame(out, columns=["doc_id", "row", "block_id", "html", "order"])

    def close(self) -> None:
        pass


def live_blocks(changes: DataFrame) -> DataFrame:
    """Maintain every document's blocks from its change messages; emits what each micro-batch changed.

    Rows: ``block`` (new content), ``removed``, and ``order`` when the order changed. The order of a message is
    authoritative: incoming content wins, else held content, ids it does not list disappear, unknown ids are skipped.
    """
    key = changes.schema["doc_id"].dataType.simpleString()
    return changes.groupBy("doc_id").transformWithStateInPandas(
        _LiveBlocks(), f"doc_id {key}, row string, block_id string, html string, `order` array<string>", "Append", "None")


def current_blocks(emitted: DataFrame) -> DataFrame:
    """(doc_id, seq, block_id, html): the state of all documents from what ``live_blocks`` has emitted so far."""
    content = emitted.filter("row <> 'order'").groupBy("doc_id", "block_id").agg(F.max_by("html", "batch_id").alias("html"))
    order = emitted.filter("row = 'order'").groupBy("doc_id").agg(F.max_by("order", "batch_id").alias("order"))
    return order.select("doc_id", F.posexplode("order").alias("seq", "block_id")).join(content, ["doc_id", "block_id"]).filter(
        F.col("html").isNotNull()).select("doc_id", F.col("seq").cast("long").alias("seq"), "block_id", "html")


class _EmitChanges(StatefulProcessor):
    """The last reported snapshot of each document of a bucket; a new one is described by its difference to it.

    Snapshots are JSON: the ids and, in the same order, the contents. Each document met costs one read and one write of the state,
    however many snapshots and blocks it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "doc_id string", "ids string, htmls string")

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        came = pd.concat(frames).sort_values(["doc", "ts", "event_id"])
        out = []
        for (doc,), f in came.groupby(["doc"], sort=False):
            ids, htmls = self.held.getValue((doc,)) or (None, None)
            held = None if ids is None else dict(zip(json.loads(ids), json.loads(htmls)))
            for event_id, echo, ids, htmls in zip(f["event_id"], f["echo"], f["ids"], f["htmls"]):
                now = dict(zip(json.loads(ids), json.loads(htmls)))
                # The first snapshot is the state subscribed to, not an edit; a pure move changes no content.
                if held is not None and not echo:
                    changed = [{"id": i, "html": h} for i, h in now.items() if i not in held or held[i] != h]
                    removed = [i for i in held if i not in now]
                    if changed or removed:
                        out.append((doc, event_id, json.dumps(changed), json.dumps(removed), json.dumps(list(now))))
                held = now
            self.held.updateValue((doc,), (json.dumps(list(held)), json.dumps(list(held.values()))))
        if out:
            yield pd.DataFrame(out, columns=["doc", "event_id", "changed", "removed", "order"])

    def close(self) -> None:
        pass


def emit_block_changes(snapshots: DataFrame) -> DataFrame:
    """Change messages out of snapshots (doc_id, ts, event_id, echo, blocks ARRAY<STRUCT<id,html>>).

    An ``echo`` snapshot holds a peer's change: it moves the baseline but is not announced.
    """
    as_json = lambda part: F.to_json(F.coalesce(F.col(f"blocks.{part}"), F.array().cast("array<string>")))
    sent = snapshots.select(_bucket("doc_id"), _doc(), _clock("ts"), "event_id", F.coalesce("echo", F.lit(False)).alias("echo"),
                            as_json("id").alias("ids"), as_json("html").alias("htmls"))
    emitted = sent.groupBy("bucket").transformWithStateInPandas(
        _EmitChanges(), "doc string, event_id bigint, changed string, removed string, `order` string", "Append", "None")
    return emitted.select(
        _doc_id(snapshots), "event_id", F.from_json("changed", "array<struct<id:string,html:string>>").alias("changed"),
        F.from_json("removed", "array<string>").alias("removed"), F.from_json("order", "array<string>").alias("order"))


class _UndoRedo(StatefulProcessor):
    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stacks = handle.getValueState("stacks", "base string, undo array<string>, redo array<string>")

    def handleInputRows(self, key, rows, timerValues):
        base, undo, redo = self.stacks.get() if self.stacks.exists() else (None, [], [])
        undo, redo, out = _ids(undo), _ids(redo), []
        for m in _in_order(rows):
            base, undo, redo = step(base, undo, redo, m["op"], m["state"], self.cap)
            out.append((key[0], m["event_id"], base, len(undo), len(redo)))
        if out:
            self.stacks.update((base, undo, redo))
            yield pd.DataFrame(out, columns=["doc_id", "event_id", "state", "undo_depth", "redo_depth"])

    def close(self) -> None:
        pass


def undo_redo(ops: DataFrame, cap: int = 50) -> DataFrame:
    """(doc_id, event_id, state, undo_depth, redo_depth) after each operation; the stacks are the state."""
    key = ops.schema["doc_id"].dataType.simpleString()
    return ops.groupBy("doc_id").transformWithStateInPandas(
        _UndoRedo(cap), f"doc_id {key}, event_id bigint, state string, undo_depth bigint, redo_depth bigint", "Append", "None")


class _LiveExtras(StatefulProcessor):
    """The extras of the documents of a bucket, with the clock of the event that set each; geometry has a clock for each field.

    An event older than the one a value comes from changes nothing, in whichever micro-batch it arrives. So messages are taken as
    they come, without a sort, and each document met costs one read and one write of the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.extras = handle.getMapState("extras", "doc_id string", "extras string")

    def handleInputRows(self, key, rows, timerValues):
        docs, touched = {}, {}
        for f in rows:
            for doc, kind, id, *clock, message in zip(*(f[c].tolist() for c in ("doc", "kind", "id", "ts", "event_id", "value"))):
                if doc not in docs:
                    held = self.extras.getValue((doc,))
                    # Text of kind and id: value, clocks.
                    docs[doc] = json.loads(held[0]) if held else {}
                name = json.dumps([kind, id])
                if (doc, name) not in touched:
                    extra = docs[doc].setdefault(name, [None, {}])
                    touched[doc, name] = kind, id, extra, extra[0]
                self._apply(kind, touched[doc, name][2], message, clock)
        out = [(doc, kind, id, extra[0]) for (doc, _), (kind, id, extra, was) in touched.items() if extra[0] != was]
        for doc, extras in docs.items():
            self.extras.updateValue((doc,), (json.dumps(extras),))
        if out:
            yield pd.DataFrame(out, columns=["doc", "kind", "id", "value"])

    @staticmethod
    def _apply(kind: str, extra: list, message: str | None, clock: list[int]) -> None:
        clocks = extra[1]
        try:
            if kind == "geometry":
                fields = {k: v for k, v in json.loads(message).items() if clock >= clocks.get(k, clock)}
                clocks.update(dict.fromkeys(fields, clock))
                # Sorted keys, so that the same geometry always compares equal.
                extra[0] = json.dumps({**(json.loads(extra[0]) if extra[0] else {}), **fields}, sort_keys=True)
                return
            if kind in ("note", "styles"):
                json.loads(message)
        except (AttributeError, TypeError, ValueError):
            return  # unreadable: what is held stays
        if clock >= clocks.get("", clock):
            clocks[""] = clock
            extra[0] = message

    def close(self) -> None:
        pass


def live_extras(extras: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Current extras per (doc_id, kind, id), emitted only when a micro-batch changed them.

    ``known`` lists the bands and notes (doc_id, kind, id) that documents have: others are ignored, since applying them
    would create parts nobody asked for. A document's extras lie together in the state; its messages are folded one at a time.
    """
    if known is not None:
        owned = extras.filter(F.col("kind").isin("band", "note")).join(known, ["doc_id", "kind", "id"], "left_semi")
        extras = owned.unionByName(extras.filter(~F.col("kind").isin("band", "note")))
    sent = extras.select(_bucket("doc_id"), _doc(), "kind", "id", _clock("ts"), _clock("event_id"), "value")
    emitted = sent.groupBy("bucket").transformWithStateInPandas(_LiveExtras(), "doc string, kind string, id string, value string", "Append", "None")
    return emitted.select(_doc_id(extras), "kind", "id", "value")


def first_deliveries(edits: DataFrame, delay: str | None = None) -> DataFrame:
    """Edits that count once (reactions, replies, deletions): redeliveries are dropped.

    Keys are remembered for ever, in RocksDB. Where a feed bounds how late it redelivers, ``delay`` of event time bounds the
    memory instead.
    """
    once, key = edits.filter(~F.col("kind").isin("done", "edited")), ["doc_id", "kind", "edit_key"]
    return once.dropDuplicates(key) if delay is None else once.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def last_deliveries(edits: DataFrame) -> DataFrame:
    """Edits whose last write holds (done, edited): the current value per key, emitted only when it changes."""
    rows = edits.filter(F.col("kind").isin("done", "edited")).select("doc_id", "kind", F.col("edit_key").alias("id"), "ts", "event_id", F.col("value").cast("string").alias("value"))
    return live_extras(rows)


def presence_sets(messages: DataFrame) -> DataFrame:
    """(doc_id, carets): the set of peers each document's newest message gave, which may be empty. For streams in update
    mode and for batches: a message replaces the whole set."""
    return messages.groupBy("doc_id").agg(F.max_by(F.coalesce("carets", F.array()), F.struct("ts", "event_id")).alias("carets"))


def shown_peers(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, peer, block_id): who is where. Peers in unknown blocks are not shown."""
    peers = sets.select("doc_id", F.explode("carets").alias("c")).select("doc_id", F.col("c.id").alias("peer"), F.col("c.block_id").alias("block_id"))
    return peers.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")


def live_counts(blocks: DataFrame) -> DataFrame:
    """Running words and characters per document, for streams in update mode."""
    return blocks.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("words"), F.sum(char_count(F.col("text"))).alias("chars"))


def hourly_counts(edits: DataFrame, delay: str | None = None) -> DataFrame:
    """Edits per document and hour. In update mode an hour's row is its count so far; with a ``delay``, hours that the
    watermark has passed are final, leave the state, and are what append mode puts out."""
    timed = edits.withWatermark("ts", delay) if delay else edits
    return timed.groupBy("doc_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(
        "doc_id", F.col("w.start").alias("hour"), "n")


class _TypingSessions(StatefulProcessor):
    """The runs of a document that a later arrival may still change.

    Nothing arrives any more from before the watermark. So of a run only the edits behind it are kept one by one; those before
    are one row (first, last, count), and a run is final as soon as an edit of the next one lies before it, or its idle time has
    passed. A timer ends the last run of a document that falls silent. A call's rows are a document's runs since the last final
    one, so the open runs of its newest batch are its open runs now.
    """

    def __init__(self, idle: pd.Timedelta) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "coalesce_key string, started timestamp, ended timestamp, n bigint")
        self.edits = handle.getListState("edits", "ts timestamp, event_id bigint, coalesce_key string")

    def handleInputRows(self, key, rows, timerValues):
        came = [e for f in rows for e in zip(f["ts"], f["event_id"], f["coalesce_key"])]
        yield from self._runs(key, came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._runs(key, [], timerValues)

    def _runs(self, key, came: list, timerValues) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        runs = []  # [key, started, ended, n, last edit before the watermark, edits behind it]
        if self.settled.exists():
            name, started, ended, n = self.settled.get()
            runs.append([name, pd.Timestamp(started), pd.Timestamp(ended), n, pd.Timestamp(ended), []])
        held = [(pd.Timestamp(ts), i, name) for ts, i, name in self.edits.get()]
        for ts, i, name in sorted([*held, *came], key=lambda e: e[:2]):
            name = name if isinstance(name, str) else None
            if not (runs and name is not None and runs[-1][0] == name and ts - runs[-1][2] <= self.idle):
                runs.append([name, ts, ts, 0, None, []])
            run = runs[-1]
            run[2], run[3] = ts, run[3] + 1
            if ts < mark:
                run[4] = ts
            else:
                run[5].append((ts.to_pydatetime(), int(i), name))
        if not runs:
            return
        final = [r[2] + self.idle < mark or k + 1 < len(runs) and runs[k + 1][1] < mark for k, r in enumerate(runs)]
        self._keep([r for r, done in zip(runs, final) if not done])
        yield pd.DataFrame([(key[0], *r[:4], done) for r, done in zip(runs, final)], columns=["doc_id", "coalesce_key", "started", "ended", "n", "final"])

    def _keep(self, left: list) -> None:
        """``left`` are the open runs; only the first can have edits before the watermark."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.settled.clear()
        self.edits.clear()
        if not left:
            return
        name, started, ended, n, before, behind = left[0]
        if before is not None:
            self.settled.update((name, started.to_pydatetime(), before.to_pydatetime(), int(n) - len(behind)))
        if fresh := [e for r in left for e in r[5]]:
            self.edits.put(fresh)
        self.handle.registerTimer((ended + self.idle).value // 1_000_000 + 1)

    def close(self) -> None:
        pass


def typing_sessions(edits: DataFrame, idle: str = "400 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """Typing runs as ``history.edit_runs`` cuts them: (doc_id, coalesce_key, started, ended, n, final).

    A run ends after ``idle`` without an edit, at a change of key, and at every edit without key, which is a run of its
    own. Final runs come out once, also those of a document without further edits, when the watermark has passed them; runs that
    an edit within ``delay`` may still change come out again whenever their document gets edits or one of them becomes final.
    ``current_sessions`` reads both. The state of a document is its edits within ``delay``, however long its runs are.
    """
    key = edits.schema["doc_id"].dataType.simpleString()
    timed = edits.select("doc_id", "ts", "event_id", "coalesce_key").withWatermark("ts", delay)
    return timed.groupBy("doc_id").transformWithStateInPandas(
        _TypingSessions(pd.Timedelta(idle)), f"doc_id {key}, coalesce_key string, started timestamp, ended timestamp, n bigint, final boolean",
        "Append", "EventTime")


def current_sessions(emitted: DataFrame) -> DataFrame:
    """All runs so far, the last ones still open, out of what ``typing_sessions`` has emitted."""
    newest = emitted.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    open_ = emitted.filter("not final").join(newest, ["doc_id", "batch_id"], "left_semi")
    return emitted.filter("final").unionByName(open_).drop("batch_id", "final")
