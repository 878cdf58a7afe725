"""Greedy page fill and everything derived from the page a block lands on.

Filling pages is an ordered fold: where a block goes depends on all blocks before it. Documents up to ``CHUNK_BLOCKS``
blocks are folded in one step. Longer documents are cut into chunks; each chunk is summarised by what it does to *any*
offset it may be entered at (few cases: the first block that starts a new page decides the rest), summaries are
composed along the document as a tree, and every chunk is then folded in parallel from its exact entry state. No task
ever holds more than one chunk of blocks or one node of the tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import page_number
from ..session import settle
from .scan import extent, first_row, last_row, running_sum, scan

CHUNK_BLOCKS = 2048
MAP_FAN = 512
SLACK_PX = 1

_FOLDED = "array<struct<seq:bigint,page:bigint,offset_px:double,spacer_px:double>>"
_CASES = "array<struct<top:double,bottom:double,forced:boolean,pages:bigint,leave:double>>"


def _px(value: float | str) -> Column:
    """A length given as a number or as the name of a column."""
    return F.col(value).cast("double") if isinstance(value, str) else F.lit(float(value))


def fill(heights, forced, page: int, offset: float, step: float, content: float, reserve: dict) -> tuple[list, list, list, int, float]:
    """(pages, offsets, gaps) of blocks in order, folded from a state, and the state after them; ``reserve`` (page -> px) is kept free."""
    pages, offsets, gaps = [], [], []
    limit = content - reserve.get(page, 0.0) + SLACK_PX
    for height, starts in zip(heights, forced):
        gap = None
        if offset > 0 and (starts or offset + height > limit):
            ahead = max(1, math.ceil(offset / step))
            gap = ahead * step - offset or None
            page, offset = page + ahead, 0.0
            limit = content - reserve.get(page, 0.0) + SLACK_PX
        pages.append(page)
        offsets.append(offset)
        gaps.append(gap)
        offset += height
    return pages, offsets, gaps, page, offset


def _fold(chunks: DataFrame, keys: list[str], base_px: float = 0) -> DataFrame:
    """(keys, out, end_page, end_offset, _step): every chunk folded from ``in_page`` and ``in_offset``.

    ``room``, a MAP(page -> px), is kept free. With ``notes``, ARRAY<STRUCT(seq, px)>, chunks are folded twice, the second time with
    ``base_px`` and the notes of each page of the first kept free.
    """
    schema = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            at = {name: batch.column(name) for name in batch.schema.names}
            seq, height, forced = at["items"].flatten().flatten()
            heights, starts, ends = height.to_pylist(), forced.to_pylist(), np.cumsum(at["items"].value_lengths().to_numpy())
            seqs = seq.to_pylist() if "notes" in at else []
            out, after = ([], [], []), ([], [])
            states = zip(*[at[c].to_pylist() for c in ("in_page", "in_offset", "_step", "_content")])
            for i, (page, offset, step, content) in enumerate(states):
                cut = slice(ends[i - 1] if i else 0, ends[i])
                room = dict(at["room"][i].as_py() or ()) if "room" in at else {}
                if "notes" in at and (notes := at["notes"][i].as_py()):
                    notes = {n["seq"]: n["px"] for n in notes}
                    for s, p in zip(seqs[cut], fill(heights[cut], starts[cut], page, offset, step, content, room)[0]):
                        if s in notes:
                            room[p] = room.get(p, float(base_px)) + notes[s]
                *placed, page, offset = fill(heights[cut], starts[cut], page, offset, step, content, room)
                for column, values in zip((*out, *after), (*placed, [page], [offset])):
                    column.extend(values)
            rows = pa.StructArray.from_arrays(
                [seq, pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["seq", "page", "offset_px", "spacer_px"])
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*[at[k] for k in keys], lists, pa.array(after[0], pa.int64()), pa.array(after[1], pa.float64()), at["_step"]],
                                             names=[*keys, "out", "end_page", "end_offset", "_step"])

    used = [c for c in (*keys, "items", "in_page", "in_offset", "_step", "_content", "room", "notes") if c in chunks.columns]
    return chunks.select(*used).mapInArrow(run, f"{schema}, out {_FOLDED}, end_page bigint, end_offset double, _step double")


def _entered(chunks: DataFrame, page: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Chunks with the state they are entered at, by default the top of a document."""
    return chunks.withColumns({"in_page": F.lit(0).cast("long") if page is None else page, "in_offset": F.lit(0.0) if offset is None else offset})


def _placed(folded: DataFrame, keys: list[str]) -> DataFrame:
    """A row per folded block."""
    return folded.select(*keys, F.explode("out").alias("o")).select(*keys, "o.*")


def _chunked(blocks: DataFrame, keys: list[str], chunk_blocks: int, step: float | str = 0, content: float | str = 0) -> DataFrame:
    """Blocks in chunks, with the page step and content height of their key."""
    forced = F.col("forced") if "forced" in blocks.columns else F.lit(False)
    return (
        blocks.select(
            *keys, _px(step).alias("_step"), _px(content).alias("_content"), F.floor(F.col("seq") / chunk_blocks).cast("long").alias("chunk"),
            F.struct(F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("height_px"), F.lit(0)).cast("double").alias("height"),
                     F.coalesce(forced, F.lit(False)).alias("forced")).alias("b"))
        .groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("b")).alias("items"), F.max("_step").alias("_step"), F.max("_content").alias("_content"))
    )


def paginate(
    blocks: DataFrame, page_step: float | str, content_height: float | str, keys: tuple[str, ...] = ("doc_id",),
    chunk_blocks: int = CHUNK_BLOCKS, map_fan: int = MAP_FAN,
) -> DataFrame:
    """(keys, seq, page, offset_px, spacer_px): the page of each block, its offset there and the gap put before it.

    ``blocks`` has keys, seq (dense from 0 within keys), height_px and optionally forced (start a new page here).
    A block is never split; it moves to the next page when it would overrun by more than one px. A block taller than a
    page overruns, and the next block continues at the following page boundary. ``seq`` must be unique within keys.
    Step and content height are numbers, or names of columns that are constant within keys and positive.
    """
    keys = list(keys)
    if any(not isinstance(x, str) and x <= 0 for x in (page_step, content_height)):
        return blocks.select(*keys, F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("page"),
                             F.lit(0.0).alias("offset_px"), F.lit(None).cast("double").alias("spacer_px"))
    chunks = _chunked(blocks, keys, chunk_blocks, page_step, content_height)
    page, offset = None, None
    longest = blocks.agg(F.max("seq")).first()[0]
    if longest is not None and longest >= chunk_blocks:
        entry = _entry_states(chunks, keys, longest // chunk_blocks, map_fan)
        chunks = chunks.join(entry, [*keys, "chunk"], "left")
        page, offset = F.coalesce("in_page", F.lit(0)), F.coalesce("in_offset", F.lit(0.0))
    return _placed(_fold(_entered(chunks, page, offset), keys), keys)


def chunk_effect(height: np.ndarray, forced: np.ndarray, step: float, content: float) -> tuple[list[dict], float]:
    """What a chunk does to an entry offset: the blocks that can be its first page start, and its total height.

    ``top``/``bottom`` are the heights before and through that block; ``pages`` and ``leave`` are the page turns after
    it and the offset at the end of the chunk, which no longer depend on the entry offset.
    """
    n = len(height)
    edge = np.concatenate([[0.0], np.cumsum(height)])
    # First block that starts the page after one started at block j: the first forced block or the first that does not
    # fit, but never a block that still sits at the very top of j's page.
    below = np.searchsorted(edge, edge[:-1], side="right")
    overrun = np.searchsorted(edge, edge[:-1] + content + SLACK_PX, side="right") - 1
    force_at = np.flatnonzero(forced)
    at = np.searchsorted(force_at, below)
    next_forced = np.where(at < len(force_at), np.append(force_at, n)[np.minimum(at, len(force_at))], n)
    following = np.minimum(np.maximum(np.minimum(overrun, n), below), next_forced)
    turns, leave = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1)
    for j in range(n - 1, -1, -1):
        k = int(following[j])
        if k >= n:
            leave[j] = edge[n] - edge[j]
        else:
            turns[j] = turns[k] + max(1, int(np.ceil((edge[k] - edge[j]) / step)))
            leave[j] = leave[k]
    cases = []
    for j in range(n):
        # Once a page's worth has passed, some earlier case has applied whatever the entry offset was.
        cases.append({"top": float(edge[j]), "bottom": float(edge[j + 1]), "forced": bool(forced[j]),
                      "pages": int(turns[j]), "leave": float(leave[j])})
        if edge[j] > 0 and (forced[j] or edge[j + 1] > content + SLACK_PX):
            break
    return cases, float(edge[n])


def enter(cases, total: float, page: int, offset: float, step: float, content: float) -> tuple[int, float]:
    """Apply a chunk's effect to an entry state."""
    for c in cases:
        y = offset + c["top"]
        if y > 0 and (c["forced"] or offset + c["bottom"] > content + SLACK_PX):
            return page + max(1, int(np.ceil(y / step))) + int(c["pages"]), float(c["leave"])
    return page, offset + total


def compose(first, first_total: float, second, second_total: float, step: float, content: float):
    """The effect of two neighbouring chunks as one."""
    cases = []
    for c in first:
        page, leave = enter(second, second_total, int(c["pages"]), float(c["leave"]), step, content)
        cases.append({**c, "pages": page, "leave": leave})
    closed = bool(first) and first[-1]["top"] > 0 and (first[-1]["forced"] or first[-1]["bottom"] > content + SLACK_PX)
    if not closed:
        for c in second:
            cases.append({**c, "top": c["top"] + first_total, "bottom": c["bottom"] + first_total})
            last = cases[-1]
            if last["top"] > 0 and (last["forced"] or last["bottom"] > content + SLACK_PX):
                break
    return cases, first_total + second_total


def _entry_states(chunks: DataFrame, keys: list[str], last_chunk: int, fan: int) -> DataFrame:
    """(keys, chunk, in_page, in_offset) for the chunks of documents that have more than one."""
    long_docs = chunks.filter(F.col("chunk") > 0).select(*keys).distinct()
    schema = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def summarise(batches):
        for pdf in batches:
            out = pdf[[*keys, "chunk", "_step", "_content"]].copy()
            effects = [
                chunk_effect(np.array([b["height"] for b in items], dtype=float),
                             np.array([b["forced"] for b in items], dtype=bool), step, content)
                for items, step, content in zip(pdf["items"], pdf["_step"], pdf["_content"])
            ]
            out["cases"] = [c for c, _ in effects]
            out["total"] = [t for _, t in effects]
            yield out

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        step, content = pdf["_step"].iloc[0], pdf["_content"].iloc[0]
        cases, total = None, 0.0
        for c, t in zip(pdf["cases"], pdf["total"]):
            c = list(c)
            cases, total = (c, t) if cases is None else compose(cases, total, c, t, step, content)
        head = pdf.iloc[0]
        return pd.DataFrame([{**{k: head[k] for k in keys}, "chunk": int(head["chunk"]) // fan, "_step": step, "_content": content, "cases": cases, "total": total}])

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        page, offset = int(pdf["in_page"].iloc[0]), float(pdf["in_offset"].iloc[0])
        rows = []
        for _, r in pdf.iterrows():
            rows.append({**{k: r[k] for k in keys}, "chunk": int(r["chunk"]), "in_page": page, "in_offset": offset})
            page, offset = enter(r["cases"], r["total"], page, offset, r["_step"], r["_content"])
        return pd.DataFrame(rows)

    effect_type = f"{schema}, chunk bigint, _step double, _content double, cases {_CASES}, total double"
    levels = [settle(chunks.join(long_docs, keys, "left_semi").mapInPandas(summarise, effect_type))]
    top = last_chunk
    while top >= fan:
        up = levels[-1].withColumn("_node", F.floor(F.col("chunk") / fan))
        levels.append(settle(up.groupBy(*keys, "_node").applyInPandas(merge, effect_type)))
        top //= fan
    state_type = f"{schema}, chunk bigint, in_page bigint, in_offset double"
    state = None
    for level in reversed(levels):
        nodes = level.withColumn("_node", F.floor(F.col("chunk") / fan).cast("long"))
        if state is None:
            nodes = nodes.withColumn("in_page", F.lit(0).cast("long")).withColumn("in_offset", F.lit(0.0))
        else:
            nodes = nodes.join(state.withColumnRenamed("chunk", "_node"), [*keys, "_node"])
        state = nodes.groupBy(*keys, "_node").applyInPandas(descend, state_type)
    return state


def doc_pages(paged: DataFrame) -> DataFrame:
    """(doc_id, page, first_seq, last_seq, n_blocks): the block range of each page."""
    return paged.groupBy("doc_id", "page").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_blocks"))


def card_counts(paged: DataFrame, blocks: DataFrame, page_step: float | str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, cards): pages to draw. An oversized last block may need more than the page it starts on."""
    keys = list(keys)
    sized = paged.join(blocks.select(*keys, "seq", "height_px", _px(page_step).alias("_step")), [*keys, "seq"])
    end = F.ceil((F.col("page") * F.col("_step") + F.col("offset_px") + F.col("height_px")) / F.col("_step"))
    last = F.max_by(F.struct((F.col("page") + 1).alias("a"), end.alias("b")), F.col("seq"))
    return sized.groupBy(*keys).agg(last.alias("_l")).select(
        *keys, F.greatest(F.col("_l.a"), F.col("_l.b").cast("long")).alias("cards"))


def page_counts(paged: DataFrame) -> DataFrame:
    """(doc_id, cards) from the pages blocks land on."""
    return paged.groupBy("doc_id").agg((F.max("page") + 1).alias("cards"))


def refresh_page_fields(found: DataFrame, paged: DataFrame, counts: DataFrame, start: int = 1, fmt: str | None = None) -> DataFrame:
    """Add ``shown`` to fields (doc_id, seq, kind, cached): NUMPAGES counts pages, PAGE labels the field's own page.

    Dates, times, authors and file names keep their cached snapshot.
    """
    label = page_number(F.col("page") + F.lit(start), F.lit(fmt))
    shown = F.when(F.col("kind") == "NUMPAGES", F.col("cards").cast("string")).when(F.col("kind") == "PAGE", label).otherwise(F.col("cached"))
    return found.join(paged.select("doc_id", "seq", "page"), ["doc_id", "seq"]).join(counts, "doc_id").withColumn("shown", shown).drop("cards")


def forced_breaks(blocks: DataFrame) -> DataFrame:
    """Add ``forced``: a manual break marker block forces the next block; a marker inside a block forces that block.

    Expects ``is_marker`` (the block is a marker) and ``has_marker`` (one sits inside it), both boolean.
    """
    scanned = scan(blocks, ["doc_id"], "seq", _prev=last_row(inclusive=False, marker=F.col("is_marker")))
    after_marker = F.coalesce(F.col("_prev.marker"), F.lit(False))
    inside = F.col("has_marker") & F.col("_prev").isNotNull() & ~F.col("is_marker")
    return scanned.withColumn("forced", after_marker | inside).drop("_prev")


def reserves(paged: DataFrame, note_refs: DataFrame, base_px: float = 8) -> DataFrame:
    """(doc_id, page, reserve_px): ``base_px`` plus the heights of the footnotes referenced on the page.

    ``note_refs`` has doc_id, seq (the block holding the reference) and height_px of the note.
    """
    return (
        note_refs.select("doc_id", "seq", F.col("height_px").cast("double").alias("_h"))
        .join(paged.select("doc_id", "seq", "page"), ["doc_id", "seq"])
        .groupBy("doc_id", "page").agg((F.lit(float(base_px)) + F.sum("_h")).alias("reserve_px"))
    )


def paginate_with_notes(
    blocks: DataFrame, note_refs: DataFrame, page_step: float, content_height: float, base_px: float = 8,
    chunk_blocks: int = CHUNK_BLOCKS,
) -> DataFrame:
    """Two passes: page the blocks, reserve room for the footnotes each page references, page again. Exactly two.

    The room depends on the absolute page number, so a document longer than one chunk is folded chunk after chunk, in
    rounds: each round folds one chunk of every document that is still open and hands its end state to the next. A
    round never holds more than one chunk of a document; only the number of rounds grows with the longest document.
    """
    chunks = _chunked(blocks, ["doc_id"], chunk_blocks, page_step, content_height)
    longest = blocks.agg(F.max("seq")).first()[0] or 0
    if longest < chunk_blocks:
        # Documents of one chunk are folded twice where they are: the notes of a document come to its blocks, not each note to its block.
        of_block = note_refs.groupBy("doc_id", F.col("seq").cast("long").alias("seq")).agg(F.sum(F.col("height_px").cast("double")).alias("px"))
        notes = of_block.filter("px is not null").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "px")).alias("notes"))
        return _placed(_fold(_entered(chunks.join(notes, "doc_id", "left")), ["doc_id"], base_px), ["doc_id"])
    first = paginate(blocks, page_step, content_height, chunk_blocks=chunk_blocks)
    chunks, reserve = settle(chunks), settle(reserves(first, note_refs, base_px))
    state = chunks.filter("chunk = 0").select("doc_id", F.lit(0).cast("long").alias("in_page"), F.lit(0.0).alias("in_offset"))
    done: list[DataFrame] = []
    for k in range(longest // chunk_blocks + 1):
        now = chunks.filter(F.col("chunk") == k).join(state, "doc_id")
        # Pages this chunk can reach: at most one turn per block plus the pages that oversized blocks run over.
        reach = F.size("items") + F.ceil((F.aggregate(
            "items", F.lit(0.0), lambda s, b: s + b["height"]) + F.col("in_offset")) / F.lit(float(page_step))) + 1
        near = (
            now.select("doc_id", "in_page", (F.col("in_page") + reach).alias("_end")).join(reserve, "doc_id")
            .filter((F.col("page") >= F.col("in_page")) & (F.col("page") <= F.col("_end")))
            .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "reserve_px"))).alias("room"))
        )
        folded = settle(_fold(now.join(near, "doc_id", "left"), ["doc_id"]))
        done.append(_placed(folded, ["doc_id"]))
        state = folded.select("doc_id", F.col("end_page").alias("in_page"), F.col("end_offset").alias("in_offset"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def section_numbers(blocks: DataFrame, leading: bool = False, order: str = "seq", longest: int | None = None) -> DataFrame:
    """Add ``section`` (0-based). Trailing: a boundary block ends its section; leading: it starts one. ``longest`` as in ``scan``."""
    flag = F.coalesce(F.col("boundary"), F.lit(False)).cast("long")
    if not leading:
        return scan(blocks, ["doc_id"], order, longest=longest, section=running_sum(flag, inclusive=False))
    # A boundary on the very first block opens section 0 rather than an empty section before it.
    out = scan(blocks, ["doc_id"], order, longest=longest, _n=running_sum(flag), _first=first_row(flag=flag))
    return out.withColumn("section", F.col("_n") - F.col("_first.flag")).drop("_n", "_first")


def paginate_sections(blocks: DataFrame, page_step: float | str, content_height: float | str, longest: int | None = None) -> DataFrame:
    """Page each section on its own and number pages through the document: (doc_id, section, seq, page, page_in_section).

    ``blocks`` has doc_id, section, seq, height_px. Sections restart the fold, so they are paged independently, each with
    its own page step and content height where these are columns. ``longest`` is the largest ``seq`` if it is known.

    Where no section is longer than one chunk, blocks become a row per section before anything is joined or counted.
    """
    longest = extent(blocks, "seq") if longest is None else longest
    positive = all(isinstance(x, str) or x > 0 for x in (page_step, content_height))
    if positive and (longest < CHUNK_BLOCKS or (blocks.groupBy("doc_id", "section").count().agg(F.max("count")).first()[0] or 0) <= CHUNK_BLOCKS):
        keys = ["doc_id", "section"]
        whole = _chunked(blocks, keys, longest + 1, page_step, content_height)
        cards = F.greatest(F.col("end_page") + 1, F.ceil((F.col("end_page") * F.col("_step") + F.col("end_offset")) / F.col("_step")).cast("long"))
        placed = scan(_fold(_entered(whole), keys), ["doc_id"], "section", longest=longest, _before=running_sum(cards, inclusive=False))
        return _placed(placed, [*keys, "_before"]).select(
            *keys, "seq", (F.col("page") + F.col("_before")).alias("page"), F.col("page").alias("page_in_section"))
    starts = blocks.groupBy("doc_id", "section").agg(F.min("seq").alias("_first"))
    local = blocks.join(starts, ["doc_id", "section"]).withColumn("seq", F.col("seq") - F.col("_first"))
    paged = paginate(local, page_step, content_height, keys=("doc_id", "section"))
    cards = card_counts(paged, local, page_step, ("doc_id", "section"))
    shifted = scan(cards, ["doc_id"], "section", _before=running_sum(F.col("cards"), inclusive=False))
    return (
        paged.join(shifted.select("doc_id", "section", "_before"), ["doc_id", "section"])
        .join(starts, ["doc_id", "section"])
        .select("doc_id", "section", (F.col("seq") + F.col("_first")).alias("seq"),
                (F.col("page") + F.col("_before")).alias("page"), F.col("page").alias("page_in_section"))
    )


def split_tall(rows: DataFrame, tables: DataFrame, content_height: float, slack_px: float = 2, min_first_px: float = 40) -> DataFrame:
    """(table key, row, fragment): cut tables taller than a page at row boundaries.

    ``rows`` has table_no, row_no (dense from 0) and height_px; ``tables`` has table_no and offset_px, where the table
    starts on its page. The first fragment fills the room left there if that is at least ``min_first_px``; tables of
    fewer than two rows stay whole. Filling fragments is the page fill of rows with a slack the other way round.
    """
    sizes = rows.groupBy("table_no").agg(F.sum("height_px").alias("_total"), F.count("*").alias("_rows"))
    tall = sizes.filter((F.col("_total") > content_height + slack_px) & (F.col("_rows") >= 2)).join(tables, "table_no").select(
        "table_no", (F.lit(content_height) - F.col("offset_px")).alias("_room"))
    # A fragment takes rows while their sum stays within limit - slack. Adding the space already used on the page to the
    # first row makes the first fragment smaller; a sliver is skipped by adding nothing. The fold allows one px of
    # overrun, which is taken off its content height.
    used = F.when(F.col("_room") >= min_first_px, F.lit(float(content_height)) - F.col("_room")).otherwise(F.lit(0.0))
    limit = float(content_height) - slack_px - SLACK_PX
    body = rows.join(tall, "table_no").select(
        "table_no", F.col("row_no").cast("long").alias("seq"),
        (F.col("height_px") + F.when(F.col("row_no") == 0, used).otherwise(F.lit(0.0))).alias("height_px"))
    step = float(2 ** 40)  # one page per turn whatever an oversized row measures
    paged = paginate(body, step, limit, keys=("table_no",))
    return paged.select("table_no", F.col("seq").alias("row_no"), F.col("page").alias("fragment"))
