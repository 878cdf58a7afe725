"""Edit histories: bounded snapshots, typing runs, shared media and undo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .scan import extent, last_row, running_sum, scan, with_positions


def bounded_history(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` snapshots of each document. The rank filter is applied before the shuffle as well."""
    newest = Window.partitionBy("doc_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return snapshots.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep)


def edit_runs(edits: DataFrame, idle: str = "400 milliseconds") -> DataFrame:
    """Add ``run_no`` (1, 2, ... per document): one undo step per typing run.

    A run ends after ``idle`` without an edit, when the coalesce key changes, and at every discrete edit (null key),
    which is a step of its own. ``edits`` has doc_id, ts, event_id, coalesce_key.
    """
    placed = with_positions(edits, ["doc_id"], ["ts", "event_id"], name="_pos", start=0)
    longest = extent(placed, "_pos")
    prev = scan(placed, ["doc_id"], "_pos", longest=longest, _prev=last_row(inclusive=False, ts=F.col("ts"), key=F.col("coalesce_key")))
    same = (F.col("coalesce_key") == F.col("_prev.key")) & (F.col("ts") <= F.col("_prev.ts") + F.expr(f"INTERVAL '{idle}'"))
    opened = prev.withColumn("_open", (~F.coalesce(same, F.lit(False))).cast("long"))
    return scan(opened, ["doc_id"], "_pos", longest=longest, run_no=running_sum(F.col("_open"))).drop("_pos", "_prev", "_open")


def run_snapshots(runs: DataFrame) -> DataFrame:
    """One row per typing run: its key, first and last edit and length."""
    return runs.groupBy("doc_id", "run_no").agg(
        F.min("coalesce_key").alias("coalesce_key"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_edits"))


def media_dedup(images: DataFrame) -> DataFrame:
    """(sha256, media_id, copies): one id per distinct payload; equal payloads share it."""
    pooled = images.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.count("*").alias("copies"))
    return pooled.withColumn("media_id", F.substr("sha256", F.lit(1), F.lit(16)))


UNDO_ROWS = 1_000_000


def undo_redo(ops: DataFrame, cap: int = 50, chunk_rows: int = UNDO_ROWS) -> DataFrame:
    """(doc_id, at, state, undo_depth, redo_depth) after each operation.

    ``ops`` has doc_id, at (dense from 0), op (push, undo, redo) and state. A push whose state equals the current one
    is ignored; a push clears the redo stack and forgets the oldest step beyond ``cap``. Undo and redo without a step
    do nothing. The base is the state before the first push, null here.

    What an operation sees is bounded (the two stacks), but which states they hold depends on all earlier operations,
    so a document longer than ``chunk_rows`` is replayed chunk after chunk: each round replays one chunk of every
    document still open, streaming Arrow batches, and hands the stacks to the next round as rows.
    """
    key = ops.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {key}, at bigint, op string, state string, undo array<string>, redo array<string>"
    rows = ops.select("doc_id", F.col("at").cast("long").alias("at"), "op", "state",
                      F.lit(None).cast("array<string>").alias("undo"), F.lit(None).cast("array<string>").alias("redo"))
    longest = rows.agg(F.max("at")).first()[0] or 0
    stacks, out = None, None
    for k in range(longest // chunk_rows + 1):
        part = rows.filter(F.floor(F.col("at") / chunk_rows) == k)
        if stacks is not None:
            part = part.unionByName(stacks.join(part.select("doc_id").distinct(), "doc_id", "left_semi"))
        replayed = part.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInPandas(_replayer(cap), shape)
        if longest >= chunk_rows:
            replayed = settle(replayed)
        here = replayed.filter("op = 'out'").select(
            "doc_id", "at", "state", F.size("undo").cast("long").alias("undo_depth"), F.size("redo").cast("long").alias("redo_depth"))
        stacks = replayed.filter("op = 'stacks'").withColumn("at", F.lit(-1).cast("long")).withColumn("op", F.lit("enter"))
        out = here if out is None else out.unionByName(here)
    return out


def step(base, undo: list, redo: list, op: str, state, cap: int = 50) -> tuple:
    """One operation on (current state, undo stack, redo stack)."""
    if op == "push" and state != base:
        return state, [*undo, base][-cap:], []
    if op == "undo" and undo:
        return undo[-1], undo[:-1], [*redo, base]
    if op == "redo" and redo:
        return redo[-1], [*undo, base], redo[:-1]
    return base, undo, redo


def _replayer(cap: int):
    def replay(batches):
        doc, base, undo, redo = None, None, [], []
        started = False
        for pdf in batches:
            rows = []
            for d, at, op, state, u, r in zip(*(pdf[c] for c in ("doc_id", "at", "op", "state", "undo", "redo"))):
                if not started or d != doc:
                    if started:
                        rows.append((doc, -1, "stacks", base, undo, redo))
                    started, doc, base, undo, redo = True, d, None, [], []
                if op == "enter":
                    base, undo, redo = state, list(u), list(r)
                    continue
                base, undo, redo = step(base, undo, redo, op, state, cap)
                rows.append((d, at, "out", base, undo, redo))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "op", "state", "undo", "redo"])
        if started:
            yield pd.DataFrame([(doc, -1, "stacks", base, undo, redo)], columns=["doc_id", "at", "op", "state", "undo", "redo"])

    return replay
