"""Substring dedup over sliding sentence spans.

A text is cut into sentences; a run is one or two consecutive sentences with at least 25 words, or three and more with at
least 12. The shortest run that starts with each sentence and the shortest one that ends with it are hashed, however many
sentences they take: of a passage cut alike, they cover all that any longer runs would, and all of one of more than 50 words
whatever its sentences are. Runs are joined over all documents; a sentence goes if a run that covers it occurs at an earlier
place, places being ordered by doc_id and then by position. Runs are compared by their words, lower-cased, without regard
to white space.

Sentences end behind . ! ? or an ellipsis followed by white space, at line feeds, behind the full stops of Chinese and
Japanese, and before a capitalised word, since a passage pasted into a sentence mostly starts with one. Copies that differ
in where their capitals stand are cut differently and seldom share a run.

Rows without a doc_id or text are kept as they are. Rows with the same doc_id count as one document: only another place
in it, or an earlier document, makes a run a repeated one. Text between removed sentences is kept to the character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, shared_folder, stored

RUN = 3
RUN_WORDS = 12
SHORT_RUN_WORDS = 25
#: Where a sentence may end: behind its stop, at a line feed, behind a full stop without white space, before a capital.
_END = re.compile(r"[.!?…][\"'”’)\]]?(\s++)(?=\S)|(\n\s*+)|[。！？]|(\s++)(?=[A-Z\x80-\U0010ffff])")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, without the white space between them."""
    out, start = [], 0
    for m in _END.finditer(text):
        k, end = m.lastindex, m.end()
        at = m.start(k) if k else end
        if k == 3 and (c := text[end]) > "Z" and category(c) != "Lu":
            at = text.find("\n", at, end)
            if at < 0:
                continue
        if at > start:
            out.append((start, at))
        start = end
    if start < len(text):
        out.append((start, len(text)))
    return out


def runs(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """The sentences, and the runs as (first sentence, number of sentences, digest)."""
    cuts = sentences(text)
    said, at, ends = [], [0], [0]  # the words, joined by one space; words and bytes before each sentence
    n_words = n_bytes = 0
    for a, b in cuts:
        words = text[a:b].lower().split()
        if words:
            part = " ".join(words).encode()
            said.append(part)
            n_words += len(words)
            n_bytes += len(part) + 1
        at.append(n_words)
        ends.append(n_bytes)
    flat = b" ".join(said)
    spans, last, end, start = set(), len(cuts), 0, 0
    for i in range(last):
        here, behind = at[i], at[i + 1]
        end = max(end, i + RUN)  # of the shortest run of three and more from here
        while end < last and at[end] - here < RUN_WORDS:
            end += 1
        e, short = i + 1, min(i + RUN, last + 1)
        while e < short and at[e] - here < SHORT_RUN_WORDS:
            e += 1
        if e < short:
            spans.add((i, e))
        elif end <= last and at[end] - here >= RUN_WORDS:
            spans.add((i, end))
        while start + RUN <= i and behind - at[start + 1] >= RUN_WORDS:
            start += 1  # of the shortest run of three and more up to here
        b, short = i, max(i - RUN + 1, -1)
        while b > short and behind - at[b] < SHORT_RUN_WORDS:
            b -= 1
        if b > short:
            spans.add((b, i + 1))
        elif i + 1 - start >= RUN and behind - at[start] >= RUN_WORDS:
            spans.add((start, i + 1))
    return cuts, [(a, b - a, md5(flat[ends[a]:ends[b] - 1]).digest()) for a, b in sorted(spans)]


_RUN = pa.schema([("doc_id", pa.int64()), ("told", pa.int64()), ("span", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("again", pa.bool_())])


def run_rows(docs: DataFrame) -> DataFrame:
    """A row per run: doc_id, told (a hash of the text, as ids may repeat), span (its start << 32 | the start of the sentence
    behind it), its digest, and whether the same text holds it at an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch, 4_000_000):
                ids, hashes, spans, keys, again = [], [], [], [], []
                for doc_id, text, told in zip(*(c.to_pylist() for c in small.columns)):
                    cuts, found = runs(text)
                    starts = [a for a, _ in cuts] + [len(text)]
                    ids += [doc_id] * len(found)
                    hashes += [told] * len(found)
                    spans += [starts[i] << 32 | starts[i + n] for i, n, _ in found]
                    seen: set[bytes] = set()
                    for *_, k in found:
                        again.append(k in seen)
                        seen.add(k)
                        keys.append(k)
                two = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield batch_of(_RUN, ids, hashes, spans, two[:, 0], two[:, 1], again)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("told")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id bigint, told bigint, span bigint, k1 bigint, k2 bigint, again boolean")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Per document and text, the spans of the runs that are not the first of their kind.

    A text's own repeats are known as it is read. The first place of each other run is found by a combining aggregate. The runs
    found more than once are written down before they meet the rows: a run that very many documents share then is a skewed side
    of a plain join, which Spark splits, beside one row.
    """
    folder = shared_folder(docs.sparkSession, "spans")
    rows = stored(run_rows(docs), f"{folder}/runs")  # read twice below
    place = F.struct("doc_id", "span")
    once = rows.where("not again").select("k1", "k2", "doc_id", "told", "span")
    ends = once.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    shared = stored(ends.where("n > 1").select("k1", "k2", "first"), f"{folder}/shared")
    later = once.join(shared, ["k1", "k2"]).where(place > F.col("first")).select("doc_id", "told", "span")
    gone = later.union(rows.where("again").select("doc_id", "told", "span"))
    return gone.groupBy("doc_id", "told").agg(F.collect_set("span").alias("spans"))


def stretches(spans: list[int]) -> list[tuple[int, int]]:
    """The stretches of text that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans):
        a, b = span >> 32, span & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, n_removed (code points), removed (start and end of each stretch)."""
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("told")).join(repeated_runs(docs), ["doc_id", "told"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                texts, sizes, cut = [], [], []
                for text, spans in zip(small.column("text").to_pylist(), small.column("spans").to_pylist()):
                    out = stretches(spans) if spans else []
                    at, kept = 0, []
                    for a, b in out:
                        kept.append(text[at:a])
                        at = b
                    texts.append("".join(kept) + text[at:] if out else text)
                    sizes.append(sum(b - a for a, b in out))
                    cut.append([{"start": a, "end": b} for a, b in out])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([small.column("doc_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(cut, kind)],
                                      names=["doc_id", "text", "n_removed", "removed"])

    return joined.mapInArrow(run, "doc_id bigint, text string, n_removed bigint, removed array<struct<start:bigint,end:bigint>>")
