"""Ordered scans, numbering and paging: chunked plans must equal plain ones, and both the rules done by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions import fields
from sheaf.operators import history, numbering, paging
from sheaf.operators.scan import first_row, last_row, next_row, running_max, running_sum, scan, with_positions


def fill(heights, forced, step, content, reserve=lambda p: 0):
    page, y, out = 0, 0, []
    for h, f in zip(heights, forced):
        if y > page * step and (f or y + h > page * step + content - reserve(page) + 1):
            page = max(page + 1, math.ceil(y / step))
            y = page * step
        out.append((page, y - page * step))
        y += h
    return out


def test_scan_in_chunks_equals_plain_windows(spark, rows):
    rng = random.Random(3)
    data = [(d, i, rng.randint(0, 9), rng.random() < 0.1) for d in range(4) for i in range(rng.choice([3, 50, 131]))]
    df = spark.createDataFrame(data, "d int, i long, v int, m boolean")
    values = dict(
        s=running_sum(F.col("v")), e=running_sum(F.col("v"), inclusive=False), top=running_max(F.col("v")),
        last=last_row(F.col("m"), v=F.col("v")), prev=last_row(inclusive=False, v=F.col("v")), nxt=next_row(F.col("m"), v=F.col("v")),
        one=first_row(F.col("m"), v=F.col("v")))
    plain = scan(df, ["d"], "i", **values)
    assert rows(plain) == rows(scan(df, ["d"], "i", chunk_rows=7, **values))
    want = []
    for d in range(4):
        mine = [r for r in data if r[0] == d]
        for k, r in enumerate(mine):
            marked = [x for x in mine[: k + 1] if x[3]]
            ahead = [x for x in mine[k:] if x[3]]
            want.append((d, r[1], sum(x[2] for x in mine[: k + 1]), sum(x[2] for x in mine[:k]), marked[-1][1] if marked else None,
                         ahead[0][1] if ahead else None, marked[0][1] if marked else None))
    got = plain.select("d", "i", "s", "e", F.col("last.at").alias("l"), F.col("nxt.at").alias("n"), F.col("one.at").alias("o"))
    assert rows(got) == sorted(want, key=repr)


def test_positions_of_a_large_group_come_from_ranges(spark, rows):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.hash("id").alias("v"), "id")
    assert rows(with_positions(df, ["k"], ["v", "id"])) == rows(with_positions(df, ["k"], ["v", "id"], max_group_rows=20))


@pytest.mark.parametrize("heights, forced, spacers, cards", [
    ([400] * 4, [], {2: 300}, 2), ([1500, 200], [], {1: 700}, 3), ([1500], [], {}, 2), ([100] * 4, [2], {2: 900}, 2), ([100, 100], [0], {}, 1)])
def test_golden_pages(spark, heights, forced, spacers, cards):
    df = spark.createDataFrame([(1, i, h, i in forced) for i, h in enumerate(heights)], "doc_id int, seq long, height_px int, forced boolean")
    paged = paging.paginate(df, 1100, 1000)
    assert {r.seq: r.spacer_px for r in paged.collect() if r.spacer_px} == spacers
    assert paging.card_counts(paged, df, 1100).first().cards == cards


def test_pages_of_no_size(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 1, 50)], "doc_id int, seq long, height_px int")
    assert {r.page for r in paging.paginate(df, 0, 100).collect()} == {0}


def test_long_documents_fill_pages_chunk_by_chunk(spark):
    rng = random.Random(1)
    data, want = [], {}
    for d in range(8):
        n = rng.choice([1, 40, 90, 200])
        hs = [rng.choice([0, 20, 40, 930, 932, 933, 1500, 3000]) if d % 3 else 20 for _ in range(n)]
        fs = [rng.random() < 0.05 for _ in range(n)]
        want |= {(d, i): o for i, o in enumerate(fill(hs, fs, 1147, 931))}
        data += [(d, i, h, f) for i, (h, f) in enumerate(zip(hs, fs))]
    df = spark.createDataFrame(data, "doc_id int, seq long, height_px int, forced boolean")
    got = {(r.doc_id, r.seq): (r.page, r.offset_px) for r in paging.paginate(df, 1147, 931, chunk_blocks=7, map_fan=3).collect()}
    assert got == want
    assert all(a.page <= b.page for a, b in zip(*(lambda x: (x, x[1:]))([r for r in paging.paginate(df, 1147, 931).filter("doc_id = 3").orderBy("seq").collect()])))


def test_notes_of_long_documents_are_reserved_in_rounds(spark):
    rng = random.Random(2)
    hs = {d: [rng.choice([20, 60, 400]) for _ in range(n)] for d, n in ((1, 25), (2, 4))}
    noted = {d: [i for i in range(len(h)) if rng.random() < 0.3] for d, h in hs.items()}
    blocks = spark.createDataFrame([(d, i, h) for d, x in hs.items() for i, h in enumerate(x)], "doc_id int, seq long, height_px int")
    refs = spark.createDataFrame([(d, i, 40) for d, x in noted.items() for i in x], "doc_id int, seq long, height_px int")
    want = {}
    for d, h in hs.items():
        first = fill(h, [False] * len(h), 1147, 931)
        room = {}
        for i in noted[d]:
            room[first[i][0]] = room.get(first[i][0], 8) + 40
        want |= {(d, i): o for i, o in enumerate(fill(h, [False] * len(h), 1147, 931, lambda p: room.get(p, 0)))}
    for chunk in (1000, 6):
        got = {(r.doc_id, r.seq): (r.page, r.offset_px) for r in paging.paginate_with_notes(blocks, refs, 1147, 931, chunk_blocks=chunk).collect()}
        assert got == want


def test_list_restart_and_continuation(spark):
    lines = "A A . A B . B b A".split()  # upper case: level 0 of list A or B; a dot closes the list
    data = [(1, i, c != ".", 0 if c.isupper() else 1, c.upper(), True) for i, c in enumerate(lines)]
    df = spark.createDataFrame(data, "doc_id int, pos long, is_list boolean, level int, num_id string, ordered boolean")
    starts = spark.createDataFrame([("A", 5), ("B", 1)], "num_id string, start int")
    got = {r.pos: (r.list_start, r.number) for r in numbering.number_lists(df, starts).collect()}
    # The second list is decided by A, so it continues at 7 and counts A once; the third is decided by B.
    assert got == {0: (5, 5), 1: (5, 6), 3: (7, 7), 4: (7, 8), 6: (1, 1), 7: (1, 1), 8: (1, 2)}


@pytest.mark.parametrize("n, fmt, text", [
    (4, "decimal", "4"), (4, None, "4"), (1994, "lowerRoman", "mcmxciv"), (3, "upperRoman", "III"), (27, "lowerLetter", "aa"), (26, "upperLetter", "Z"), (703, "lowerLetter", "aaa"), (0, "lowerRoman", "0")])
def test_page_labels(spark, n, fmt, text):
    assert spark.range(1).select(fields.page_number(F.lit(n), F.lit(fmt))).first()[0] == text


def test_typing_runs_break_on_idle_key_change_and_discrete_edits(spark):
    data = [(1, 0, "t"), (1, 300, "t"), (1, 800, "t"), (1, 900, "n"), (1, 950, None), (1, 960, None), (1, 970, "t")]
    df = spark.createDataFrame([(d, i, ms, k) for i, (d, ms, k) in enumerate(data)], "doc_id int, event_id long, ms long, coalesce_key string").withColumn("ts", F.timestamp_millis("ms"))
    assert [r.run_no for r in history.edit_runs(df).orderBy("event_id").collect()] == [1, 1, 2, 3, 4, 5, 6]


def replayed(ops, cap):
    base, undo, redo, out = None, [], [], []
    for op, state in ops:
        base, undo, redo = history.step(base, undo, redo, op, state, cap)
        out.append((base, len(undo), len(redo)))
    return out


def test_undo_stack_by_hand():
    ops = [("push", "a"), ("push", "a"), ("push", "b"), ("undo", None), ("redo", None), ("undo", None), ("push", "c"), ("redo", None), ("undo", None), ("undo", None), ("undo", None)]
    assert replayed(ops, 50) == [("a", 1, 0), ("a", 1, 0), ("b", 2, 0), ("a", 1, 1), ("b", 2, 0), ("a", 1, 1), ("c", 2, 0), ("c", 2, 0), ("a", 1, 1), (None, 0, 2), (None, 0, 2)]


def test_long_histories_replay_in_rounds(spark):
    rng = random.Random(5)
    data, want = [], {}
    for d, n in ((1, 60), (2, 9), (3, 25)):
        ops = [(rng.choice(["push", "push", "undo", "redo"]), rng.choice("abc")) for _ in range(n)]
        data += [(d, i, op, s) for i, (op, s) in enumerate(ops)]
        want |= {(d, i): x for i, x in enumerate(replayed(ops, 4))}
    df = spark.createDataFrame(data, "doc_id int, at long, op string, state string")
    for chunk in (1000, 8):
        got = {(r.doc_id, r.at): (r.state, r.undo_depth, r.redo_depth) for r in history.undo_redo(df, 4, chunk_rows=chunk).collect()}
        assert got == want
