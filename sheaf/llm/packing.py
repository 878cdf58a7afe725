"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest permitted length. Pieces are dealt by hash into groups of about
GROUP_ROWS pieces, and each group is packed on its own: longest piece first, into the open bin it fills best. Where no open
bin fits, a new one is opened, of the permitted length that then costs least for each token: what would fill it is sought
among the pieces to come, largest first, and its cost shrunk to that content is shared by the content. In the end each bin is
shrunk to the shortest permitted length that holds it. The same is done with every permitted length as the one always opened,
and the cheapest of these packings is kept. A bin's cost is its length plus ``attention`` times the square of its length. The
more bins a group has, the less the split into groups costs; a group holds thousands of pieces.

Lengths are counted in words or given by a column of token counts. Documents without words are one piece of length 0 in a
bin of the shortest length with others. Rows with equal ids are packed as documents of their own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, n_parts, shared_folder, stored

LENGTHS = (512, 1024, 2048, 4096)
GROUP_ROWS = 20_000
#: Pieces sought to fill a bin before its length is chosen.
LOOK_AHEAD = 8


@dataclass(frozen=True)
class Cost:
    """What a sequence of some length costs to train on, relative to a token."""

    attention: float = 1 / 16_384

    def __call__(self, length: int) -> float:
        return length + self.attention * length * length


def cheapest_opening(lengths: list[int], at: int, permitted: tuple[int, ...], cost: Cost) -> int:
    """The length to open for piece ``at``: cheapest per token, filled with the largest of the pieces behind it that fit."""
    best = None
    for size in permitted:
        room = size - lengths[at]
        if room < 0:
            continue
        k = at + 1
        for _ in range(LOOK_AHEAD):  # pieces come longest first: the next that fits
            k = bisect.bisect_left(lengths, -room, k, key=lambda n: -n)
            if k == len(lengths) or not room:
                break
            room -= lengths[k]
            k += 1
        filled = max(1, size - room)
        price = cost(next(c for c in permitted if c >= filled)) / filled
        if best is None or price < best[0]:
            best = price, size
    return best[1]


def best_fit(lengths: list[int], open_at: int | None, permitted: tuple[int, ...], cost: Cost = Cost()) -> tuple[list[int], list[int]]:
    """Packs lengths, given longest first: the bin of each, and the contents of each bin.

    A new bin has the length ``open_at``, or the shortest permitted one that holds the piece; where ``open_at`` is None, the
    length is chosen for each bin (``cheapest_opening``). Bins are kept by the room
    they have left; the least room that is enough is found from a bit mask of the rooms in use.
    """
    rooms: list[list[int]] = [[] for _ in range(permitted[-1] + 1)]
    mask, where, held = 0, [], []
    for i, n in enumerate(lengths):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            if open_at is None:
                room = cheapest_opening(lengths, i, permitted, cost)
            else:
                room = open_at if n <= open_at else next(c for c in permitted if c >= n)
            k = len(held)
            held.append(0)
        held[k] += n
        room -= n
        rooms[room].append(k)
        mask |= 1 << room
        where.append(k)
    return where, held


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS, cost: Cost = Cost()) -> tuple[list[int], list[int]]:
    """The cheapest of the packings that choose a length for each bin or open one length always: bin of each piece, length of each bin."""
    best = None
    for open_at in (*permitted, None):
        where, held = best_fit(lengths, open_at, permitted, cost)
        sizes = [next(c for c in permitted if c >= n) for n in held]
        total = sum(map(cost, sizes))
        if best is None or total <= best[0]:
            best = total, where, sizes
    return best[1], best[2]


_PIECE = pa.schema([("group", pa.int64()), ("bin", pa.int64()), ("bin_length", pa.int64()), ("bin_offset", pa.int64()),
                    ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_PIECE_SQL = "group bigint, bin bigint, bin_length bigint, bin_offset bigint, doc_id bigint, piece bigint, start bigint, length bigint"


def word_count(text: str = "text"):
    """Words of a text; runs of the six ASCII white-space characters part them."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.translate(bare, " ", "")) + 1).cast("bigint")


def pack_documents(docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, tokens=None, group_rows: int = GROUP_ROWS,
                   cost: Cost = Cost()) -> DataFrame:
    """A row for each piece: the bin (group, bin), its length, the piece's place in it, and the piece: tokens start to
    start + length of document doc_id. ``tokens`` is a column expression of document lengths; the default counts words."""
    permitted = tuple(sorted(permitted))
    longest = permitted[-1]
    n = word_count() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")
    sized = stored(docs.select("doc_id", n.alias("n"), F.monotonically_increasing_id().alias("row")), f"{shared_folder(docs.sparkSession, 'packing')}/sizes")
    n_pieces = sized.agg(F.sum(F.greatest(F.ceil(F.col("n") / longest), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-n_pieces // group_rows))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(longest).cast("bigint"))
    pieces = (sized.select("doc_id", "row", "n", F.posexplode(starts).alias("piece", "start"))
              .select(F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)).alias("group"), "doc_id",
                      F.col("piece").cast("bigint").alias("piece"), "start", F.least(F.col("n") - F.col("start"), F.lit(longest)).alias("length")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def close():
            nonlocal held
            rows = held
            where, sizes = pack([r[3] for r in rows], permitted, cost)
            used = [0] * len(sizes)
            out = []
            for (doc_id, piece, start, n), k in zip(rows, where):
                out.append((group, k, sizes[k], used[k], doc_id, piece, start, n))
                used[k] += n
            held = []
            return batch_of(_PIECE, *zip(*out))

        for batch in batches:
            for small in bounded(batch):
                for g, doc_id, piece, start, n in zip(*(c.to_pylist() for c in small.columns)):
                    if g != group:
                        if held:
                            yield close()
                        group = g
                    held.append((doc_id, piece, start, n))
        if held:
            yield close()

    dealt = pieces.repartition(min(groups, n_parts(docs)), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(run, _PIECE_SQL)


def bin_text(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The words of every bin, pieces in order, for training: group, bin, bin_length, text. A bin's size is bounded."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", words.alias("words")).join(pieces, "doc_id").select(
        "group", "bin", "bin_length", F.struct("bin_offset", "doc_id", "piece", F.array_join(F.slice("words", F.col("start").cast("int") + 1, F.col("length").cast("int")), " ").alias("text")).alias("p"))
    parts = F.array_sort(F.collect_list("p"))
    return cut.groupBy("group", "bin", "bin_length").agg(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), " ").alias("text"))
