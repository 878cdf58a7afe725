"""Conversation structure repair: turns aligned to an alternating grammar by Wagner-Fischer tables.

A sound conversation's roles read ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn, ending with the
assistant, or nothing at all. Turns are kept, get another role, are deleted, or are inserted; blank turns and repeats must go.
The roles of all feasible lengths are the beginnings of two alternating strings, one with a system turn in front. The turns are
aligned to each: one table per string holds the costs for all its lengths, each feasible length an end of its own. Only a band of
the table is filled in, after Ukkonen: with an incumbent cost in hand an alignment has no more deletions and insertions than that
cost pays for. The incumbent comes from a narrow band first, and from one string for the other. Of the cheapest alignments the
one whose audit, the initials of its edits (D, I, K, R) in order, is least in ASCII is traced back and taken.

A conversation may be of any length. Its turns are cut into segments of SEGMENT rows; a segment's tables give its cost from each
state of the grammar to each other; the costs of what follows are carried back from segment to segment, one small row each, and
then each segment traces back on its own, from whichever state it is entered in. A conversation of one segment skips all that.
So no task holds the turns of a conversation, but for the parts of one segment. Turns are inserted before a row of their segment
or behind the last one.

Rows are ordered by turn (nulls first), then role and text. Null roles and texts are empty; a null conv_id is a conversation.
Repeated rows are repeats. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import with_positions
from .common import SPACE, map_rows, n_parts, shared_folder, stored, to_batches

RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
SEGMENT = 64
#: How far the grammar has got: nothing said, system said, user said, assistant said. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
_SOUND = (0, NEVER, NEVER, 0)
# A row's code: its role by initial, and what is wrong with it.
S, U, A, OTHER = range(4)
BLANK, REPEAT, TRUNCATED = 4, 8, 16


def symbol(entry: int, system: bool, j: int) -> int:
    """The role in place j of the string that goes on from ``entry``."""
    if system:
        return S if j == 0 else (U, A)[(j - 1) % 2]
    return (A, U)[j % 2] if entry == USER else (U, A)[j % 2]


def state_after(entry: int, system: bool, j: int) -> int:
    """How far the grammar has got behind the first j roles."""
    if j == 0:
        return entry
    return (SYSTEM, USER, ASSISTANT)[symbol(entry, system, j - 1)]


def table(codes: list[int], entry: int, system: bool, ends: tuple, last: bool, low: int, high: int) -> list[list[int]]:
    """cost[i][k]: the least cost of turns from i on against roles from i + low + k on, with ``ends`` for the state behind them."""
    n, width = len(codes), high - low + 1
    row = [NEVER] * (width + 1)  # one more, so that there is always a next
    for k in range(width - 1, -1, -1):
        j = n + low + k
        if j >= (1 if system else 0):
            row[k] = ends[state_after(entry, system, j)]
            if last and row[k + 1] + INSERT < row[k]:
                row[k] = row[k + 1] + INSERT
    out = [row]
    for i in range(n - 1, -1, -1):
        below, row, code = row, [NEVER] * (width + 1), codes[i]
        role, stays = code & 3, not code & (BLANK | REPEAT)
        extra = CUT_SHORT if code & TRUNCATED else 0
        for k in range(width - 1, -1, -1):
            j = i + low + k
            if j < 0:
                break
            want = symbol(entry, system, j)
            best = DELETE + below[k - 1] if k else NEVER
            if want != S and row[k + 1] + INSERT < best:
                best = row[k + 1] + INSERT
            if stays and (role == want or want != S):
                best = min(best, below[k] + extra + (0 if role == want else RENAME))
            row[k] = best
        out.append(row)
    return out[::-1]


def traced(codes: list[int], entry: int, system: bool, ends: tuple, low: int, cost: list[list[int]]) -> tuple[str, int]:
    """The least audit of the cheapest alignments in a table, and the state behind it."""
    i = j = 0
    audit = []
    while True:
        k = j - i - low
        left = cost[i][k]
        if i == len(codes):
            if j >= (1 if system else 0) and left == ends[state_after(entry, system, j)]:
                return "".join(audit), state_after(entry, system, j)
            audit.append("I")
            j += 1
            continue
        want, code = symbol(entry, system, j), codes[i]
        if k and left == DELETE + cost[i + 1][k - 1]:
            audit.append("D")
            i += 1
        elif want != S and left == INSERT + cost[i][k + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if code & 3 == want else "R")
            i += 1
            j += 1


def align(codes: list[int], entry: int, ends: tuple = _SOUND, last: bool = True) -> tuple[int, str, int] | None:
    """(cost, audit, state behind) of the best alignment from ``entry``; None if there is none."""
    n, best, after = len(codes), None, min(ends)
    must = sum(1 for c in codes if c & (BLANK | REPEAT))
    for system in (False, True) if entry == START else (False,):
        low, high = -min(n, must + 2), 2
        while True:
            cost = table(codes, entry, system, ends, last, low, high)
            total = cost[0][-low]
            incumbent = min(total, best[0] if best else NEVER)
            deletions = min(n, (incumbent - after) // DELETE) if incumbent < NEVER else n
            insertions = (incumbent - after) // INSERT if incumbent < NEVER else 3
            if -low >= deletions and high >= insertions:
                break
            low, high = min(low, -deletions), max(high, insertions)
        if total < NEVER and (best is None or total <= best[0]):
            found = total, *traced(codes, entry, system, ends, low, cost)
            if best is None or found[:2] < best[:2]:
                best = found
    return best


def costs_between(codes: list[int]) -> list[int]:
    """The cost of a segment that another follows, from each state (row) to each state."""
    out = []
    for entry in range(4):
        for to in range(4):
            found = align(codes, entry, tuple(0 if s == to else NEVER for s in range(4)), False)
            out.append(found[0] if found else NEVER)
    return out


def illegal_pairs(roles: list[int]) -> int:
    """Neighbours other than su, ua and au."""
    return sum(1 for p in zip(roles, roles[1:]) if p not in ((S, U), (U, A), (A, U)))


# --- Jobs ---


def key_of(conv_id: str = "conv_id") -> Column:
    """A name for each conversation, the one without an id included."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("none"))


def id_of(key: str, kind) -> Column:
    return F.when(F.col(key) != "none", F.substring(key, 2, 1 << 30)).cast(kind)


def placed(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, turn, role, text, pos (from 0) and seg of all rows, written down once."""
    rows = conversations.select(key_of().alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = with_positions(rows, ["conv"], ["turn", "role", "text"], name="pos", start=0)
    return stored(numbered.withColumn("seg", F.floor(F.col("pos") / segment).cast("bigint")), f"{shared_folder(conversations.sparkSession, 'repair')}/rows")


def faults(rows: DataFrame) -> DataFrame:
    """conv, pos, seg and code of each row. Of a row's faults the first of blank, repeat, truncated counts."""
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit("|"), "role", "text"), 256)
    seen = rows.select("conv", "pos", "seg", said.alias("said"), role.alias("role"), (bare == "").alias("blank"),
                       (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = seen.where("not blank").groupBy("conv", "said").agg(F.min("pos").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), REPEAT).when(F.col("cut"), TRUNCATED).otherwise(0)
    return seen.join(first, ["conv", "said"], "left").select("conv", "pos", "seg", (F.col("role") + fault).alias("code"))


def _in_order(df: DataFrame, order: list, rows, schema: str) -> DataFrame:
    """``rows`` reads the rows of whole conversations in order, as tuples, one at a time, and gives tuples of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    dealt = df.repartition(n_parts(df), "conv").sortWithinPartitions("conv", *order)
    return dealt.mapInArrow(lambda batches: to_batches(rows(tuples(batches)), arrow, 1000), schema)


def _carried_back(rows: Iterable[tuple]) -> Iterator[tuple]:
    """From the last segment to the second: what it costs from each state to end well, for the segment before."""
    conv, ends = None, _SOUND
    for here, seg, costs in rows:
        if here != conv:
            conv, ends = here, _SOUND
        ends = tuple(min(min(c + e for c, e in zip(costs[4 * s:4 * s + 4], ends)), NEVER) for s in range(4))
        yield conv, seg - 1, ends


def _entered(rows: Iterable[tuple]) -> Iterator[tuple]:
    """From the first segment to the last: the audit from the state in which the segment before left off."""
    conv, state, role = None, START, None
    for here, seg, costs, audits, after, pairs, first, last in rows:
        if here != conv:
            conv, state, role = here, START, None
        pairs += 0 if role is None else illegal_pairs([role, first])
        yield conv, seg, audits[state], state, pairs, costs[state]
        state, role = after[state], last


def audits(coded: DataFrame) -> DataFrame:
    """conv, seg, audit, state (at entry), illegal (pairs that end in the segment) and cost (from here on) of each segment of ``faults``."""
    place = F.array_sort(F.collect_list(F.struct("pos", "code")))
    folder = shared_folder(coded.sparkSession, "repair")
    segments = stored(coded.groupBy("conv", "seg").agg(place.alias("c")).select("conv", "seg", F.col("c.code").alias("codes")), f"{folder}/segments")

    def between(batch: pa.RecordBatch) -> Iterator[tuple]:
        for conv, seg, codes in zip(*(c.to_pylist() for c in batch.columns)):
            yield conv, seg, costs_between(codes)

    costs = map_rows(segments.where("seg > 0"), between, "conv string, seg bigint, costs array<bigint>")
    ends = _in_order(costs, [F.desc("seg")], _carried_back, "conv string, seg bigint, ends array<bigint>")

    def aligned(batch: pa.RecordBatch) -> Iterator[tuple]:
        for conv, seg, codes, ends in zip(*(c.to_pylist() for c in batch.columns)):
            found = [align(codes, e, tuple(ends or _SOUND), ends is None) if e == START or seg else None for e in range(4)]
            cost, audit, after = zip(*[f or (NEVER, None, START) for f in found])
            roles = [c & 3 for c in codes]
            yield conv, seg, cost, audit, after, illegal_pairs(roles), roles[0], roles[-1]

    traces = map_rows(segments.join(ends, ["conv", "seg"], "left").select("conv", "seg", "codes", "ends"), aligned,
                      "conv string, seg bigint, costs array<bigint>, audits array<string>, after array<int>, pairs bigint, first int, last int")
    return _in_order(traces, ["seg"], _entered, "conv string, seg bigint, audit string, state int, illegal bigint, cost bigint")


def mended(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """conv, seg and the repaired turns of each segment, as an array of role and text, from ``placed`` and ``audits``."""
    turns = rows.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))

    def applied(batch: pa.RecordBatch) -> Iterator[tuple]:
        for conv, seg, turns, audit, state in zip(*(c.to_pylist() for c in batch.columns)):
            out, left = [], iter(turns)
            for edit in audit:
                turn = next(left) if edit != "I" else None
                if edit == "D":
                    continue
                role = turn["role"] if edit == "K" else "assistant" if state == USER else "user"
                out.append({"role": role, "text": turn["text"] if turn else ""})
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield conv, seg, out

    return map_rows(turns.join(audit, ["conv", "seg"]).select("conv", "seg", "turns", "audit", "state"), applied,
                    "conv string, seg bigint, turns array<struct<role:string,text:string>>")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations, a row per turn: conv_id, seg and place (its order within the conversation), role, text."""
    rows = placed(conversations, segment)
    turns = mended(rows, audits(faults(rows)))
    return turns.select(id_of("conv", conversations.schema["conv_id"].dataType).alias("conv_id"), "seg", F.posexplode("turns").alias("place", "t")).select(
        "conv_id", "seg", "place", "t.role", "t.text")


def _digested(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of each conversation: cost, audit, illegal pairs and the digest of its turns, which are read segment by segment."""

    def close():
        return conv, cost, "".join(audit), illegal, digest.hexdigest()

    conv = None
    for here, _, part, pairs, total, said in rows:
        if here != conv:
            if conv is not None:
                yield close()
            conv, cost, audit, illegal, digest, begun = here, total, [], 0, sha256(), False
        audit.append(part)
        illegal += pairs
        if said is not None:
            digest.update((("\n" if begun else "") + said).encode())
            begun = True
    if conv is not None:
        yield close()


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation: conv_id, gaps in its turns, blank, duplicate and truncated rows, illegal pairs, cost and audit of the
    repair, and the digest of the repaired turns (``role:text``, joined by line feeds)."""
    rows = placed(conversations, segment)
    coded = stored(faults(rows), f"{shared_folder(conversations.sparkSession, 'repair')}/faults")
    audit = stored(audits(coded), f"{shared_folder(conversations.sparkSession, 'repair')}/audits")
    said = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    told = audit.join(mended(rows, audit).select("conv", "seg", said.alias("said")), ["conv", "seg"]).select("conv", "seg", "audit", "illegal", "cost", "said")
    digests = _in_order(told, ["seg"], _digested, "conv string, cost bigint, audit string, illegal bigint, repaired_sha256 string")
    code = F.col("code")
    counts = coded.groupBy("conv").agg(F.count_if(code.bitwiseAND(BLANK) > 0).alias("blank"), F.count_if(code.bitwiseAND(REPEAT) > 0).alias("duplicate"),
                                       F.count_if(code.bitwiseAND(TRUNCATED) > 0).alias("truncated"))
    turn = F.col("turn").cast("bigint")
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    return gaps.join(counts, "conv").join(digests, "conv").select(
        id_of("conv", conversations.schema["conv_id"].dataType).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
