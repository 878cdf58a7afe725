"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

An index is three tables in the shared folder. ``holders`` has a row for each key and document that holds it, ``counts``
the number of documents of each key with the smallest and largest of them, ``filters`` a cuckoo filter of the live keys
of each shard. Inserting documents asks the filters first: a key that its filter does not know is new and is appended
without reading the exact table; only the others meet ``counts``. Deleting documents takes their holder rows away, counts
the keys they held anew, and takes keys without holders out of the filters. Later inserts and verdicts are then the same
as if the deleted documents had never been there.

A line's key is the md5 of the line, stripped of white space and with A-Z lower-cased; shorter lines have no key.
Rows without a doc_id hold no lines and are kept whole. Rows with the same doc_id count as one document. A null text is
one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, bounded, free_name, map_rows, n_parts, shared_folder, stored

MIN_CHARS = 10
#: Keys that a shard should hold, about: a bound on what one task keeps of them.
SHARD_KEYS = 250_000
#: Portions in which ``dedup_all`` inserts a corpus.
PORTIONS = 2
SLOTS = 4
LOAD = 0.85
HOLDERS = "key binary, doc_id bigint"
COUNTS = "key binary, shard int, n_docs bigint, first_doc bigint, last_doc bigint"
FILTERS = "shard int, n_keys bigint, slots binary"


@dataclass(frozen=True)
class LineIndex:
    shards: int
    holders: DataFrame
    counts: DataFrame
    filters: DataFrame


def empty_index(spark: SparkSession, shards: int) -> LineIndex:
    """``shards`` should leave about SHARD_KEYS keys to a shard."""
    return LineIndex(shards, *(spark.createDataFrame([], s) for s in (HOLDERS, COUNTS, FILTERS)))


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    bare = line.strip(SPACE)
    return md5(bare.encode().lower()).digest() if len(bare) >= min_chars else None  # bytes.lower() changes A-Z only


def holders(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The distinct keys of each document."""

    def rows(batch: pa.RecordBatch):
        for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            for key in {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}:
                yield key, doc_id

    return map_rows(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), rows, HOLDERS)


# --- Cuckoo filters: buckets of SLOTS 16-bit fingerprints; 0 is an empty slot. ---


def _places(keys: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of each key (16 bytes as two words)."""
    prints = ((keys[:, 1] & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16)
    first = ((keys[:, 0] >> np.uint64(8)) & np.uint64(mask)).astype(np.int64)
    return prints, first, first ^ _step(prints, mask)


def _step(prints: np.ndarray, mask: int) -> np.ndarray:
    return ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)).astype(np.int64) & mask


def as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def new_filter(n_keys: int) -> np.ndarray:
    buckets = 1 << max(4, int(np.ceil(np.log2(max(n_keys, 1) / (LOAD * SLOTS)))))
    return np.zeros((buckets, SLOTS), np.uint16)


def filter_has(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A filter without buckets stands for one that gave up: it may hold anything."""
    if not len(slots):
        return np.ones(len(keys), bool)
    prints, first, second = _places(keys, len(slots) - 1)
    return (slots[first] == prints[:, None]).any(1) | (slots[second] == prints[:, None]).any(1)


def filter_add(slots: np.ndarray, keys: np.ndarray) -> bool:
    """Adds every key (also one that looks present: deletions must find as many copies). False: the filter is full."""
    if not len(slots):
        return not len(keys)
    mask = len(slots) - 1
    prints, first, second = _places(keys, mask)
    for turn in range(2):  # whatever finds room in its first or else its second bucket, all at once
        buckets = second if turn else first
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        slots.sort(axis=1)  # empty slots first
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        fits = rank < SLOTS - np.count_nonzero(slots[b], axis=1)
        slots[b[fits], rank[fits]] = prints[order][fits]
        left = order[~fits]
        prints, first, second = prints[left], first[left], second[left]
    for p, b in zip(prints, first.tolist()):
        for turn in range(500):
            empty = np.flatnonzero(slots[b] == 0)
            if len(empty):
                slots[b, empty[0]] = p
                break
            p, slots[b, turn % SLOTS] = slots[b, turn % SLOTS], p  # the one put out goes to its other bucket
            b ^= int(_step(np.array([p]), mask)[0])
        else:
            return False
    return True


def filter_remove(slots: np.ndarray, keys: np.ndarray) -> None:
    """Takes one copy of each key's fingerprint out. Only keys that were added may be removed."""
    for p, b1, b2 in zip(*_places(keys, len(slots) - 1)):
        for b in (int(b1), int(b2)):
            at = np.flatnonzero(slots[b] == p)
            if len(at):
                slots[b, at[0]] = 0
                break


def filled(n_keys: int, keys: np.ndarray) -> np.ndarray:
    """A filter with room for ``n_keys``, holding ``keys``."""
    slots = new_filter(n_keys)
    while not filter_add(slots, keys):
        slots = new_filter(2 * slots.size)
    return slots


# --- The index ---

_ANSWER = "key binary, shard int, n_keys bigint, slots binary"
_NONE = np.zeros((0, 2), np.uint64)
_LIVE, _ASKED = 1, 2  # kinds of rows after a shard's filter (0): its live keys where the filter must be rebuilt, keys to ask or change


def _per_shard(change, keys: DataFrame, filters: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Runs ``change(slots, n_keys, live, asked) -> (slots, n_keys, answers)`` for each shard.

    ``slots`` is None where a shard has no filter yet. The result has a row for each filter returned (key null) and for
    each asked key that is an answer.
    """
    cols = ["shard", "kind", "key", "n_keys", "slots"]
    stream = filters.withColumns({"kind": F.lit(0), "key": F.lit(None).cast("binary")}).select(cols)
    for kind, df in ((_LIVE, live), (_ASKED, keys)):
        if df is not None:
            empty = {"kind": F.lit(kind), "n_keys": F.lit(None).cast("bigint"), "slots": F.lit(None).cast("binary")}
            stream = stream.union(df.withColumns(empty).select(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("shard", pa.int32()), ("n_keys", pa.int64()), ("slots", pa.binary())])

        def close(shard, held):
            slots, n_keys = held.get(0, (None, 0))
            asked = held.get(_ASKED, [])
            slots, n_keys, answers = change(slots, n_keys, as_words(held.get(_LIVE, [])), as_words(asked))
            if slots is not None:
                yield pa.record_batch([[None], [shard], [n_keys], [slots.tobytes()]], schema=schema)
            found = [asked[i] for i in np.flatnonzero(answers)]
            for i in range(0, len(found), 50_000):
                part = found[i:i + 50_000]
                yield pa.record_batch([part, [shard] * len(part), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], schema=schema)

        current, held = None, {}
        for batch in batches:
            for small in bounded(batch):
                for shard, kind, key, n_keys, slots in zip(*(c.to_pylist() for c in small.columns)):
                    if shard != current and held:
                        yield from close(current, held)
                        held = {}
                    current = shard
                    if kind == 0:
                        held[0] = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), n_keys
                    else:
                        held.setdefault(kind, []).append(key)
        if held:
            yield from close(current, held)

    return stream.repartition(n_parts(keys), "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _ANSWER)


def _probe(slots, n_keys, live, asked):
    return None, 0, np.zeros(len(asked), bool) if slots is None else filter_has(slots, asked)


def _add(slots, n_keys, live, asked):
    if slots is None or len(live):
        slots = filled(len(live) + len(asked), live)
    if not filter_add(slots, asked):
        slots = _NONE.astype(np.uint16)  # says "perhaps" to everything, and is rebuilt at the next insert
    return slots, n_keys + len(asked), []


def _remove(slots, n_keys, live, asked):
    if slots is not None and len(slots):
        filter_remove(slots, asked)
    return slots, n_keys - len(asked), []


def _counted(rows: DataFrame, shards: int) -> DataFrame:
    """Reference counts of holder rows, combined before the shuffle: a line on every page is one row per task."""
    total = rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return total.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "n_docs", "first_doc", "last_doc")


def _changed_filters(old: DataFrame, answer: DataFrame, folder: str) -> DataFrame:
    new = answer.where("key is null").select("shard", "n_keys", "slots")
    return stored(old.join(new.select("shard"), "shard", "left_anti").union(new), folder)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with ``docs`` in it. Their ids must be new to it: delete a changed document first."""
    folder = shared_folder(docs.sparkSession, "lines")
    return insert_holders(index, stored(holders(docs, min_chars), f"{folder}/holders"))


def insert_holders(index: LineIndex, new: DataFrame) -> LineIndex:
    """``insert`` for documents whose ``holders`` have been written down."""
    folder = shared_folder(new.sparkSession, "lines")
    delta = stored(_counted(new, index.shards), f"{folder}/delta")
    perhaps = stored(_per_shard(_probe, delta, index.filters).select("key"), f"{folder}/perhaps")
    known = index.counts.join(perhaps, "key", "left_semi")  # the filter's answers, made exact
    fresh = delta.join(known, "key", "left_anti")
    n_new = fresh.groupBy("shard").agg(F.count("*").alias("n_new"))
    full = index.filters.join(n_new, "shard").where(F.col("n_keys") + F.col("n_new") > F.length("slots") / 2 * LOAD)
    filters = _per_shard(_add, fresh, index.filters, index.counts.join(full, "shard", "left_semi"))
    merged = (known.union(delta.join(known, "key", "left_semi")).groupBy("key", "shard")
              .agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")))
    counts = index.counts.join(known, "key", "left_anti").union(fresh).union(merged)
    return LineIndex(index.shards, index.holders.union(new), stored(counts, f"{folder}/counts"),
                     _changed_filters(index.filters, filters, f"{folder}/filters"))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index as if the documents of ``doc_ids`` (a doc_id column) had never been inserted."""
    folder = shared_folder(doc_ids.sparkSession, "lines")
    ids = doc_ids.select("doc_id").distinct()
    kept = stored(index.holders.join(ids, "doc_id", "left_anti").select("key", "doc_id"), f"{folder}/holders")
    touched = stored(index.holders.join(ids, "doc_id", "left_semi").select("key").distinct(), f"{folder}/touched")
    again = stored(_counted(kept.join(touched, "key", "left_semi"), index.shards), f"{folder}/again")
    gone = index.counts.join(touched, "key", "left_semi").join(again, "key", "left_anti")
    counts = index.counts.join(touched, "key", "left_anti").union(again)
    return LineIndex(index.shards, kept, stored(counts, f"{folder}/counts"),
                     _changed_filters(index.filters, _per_shard(_remove, gone, index.filters), f"{folder}/filters"))


def dedup(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` of the index without the lines that another document with a smaller id holds.

    Columns: doc_id, text, n_lines (before), n_dropped, and the other columns of ``docs`` as the struct ``rest``.
    """
    shared = index.counts.where("first_doc < last_doc").select("key", "first_doc")
    drop = (index.holders.join(shared, "key").where("doc_id > first_doc")
            .groupBy("doc_id").agg(F.collect_list("key").alias("drop")))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    none = F.lit(0).alias(free_name(rest, "_none"))  # a struct needs a field
    packed = docs.select("doc_id", "text", F.struct(none, *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    joined = packed.join(drop, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(small.column("text").to_pylist(), small.column("drop").to_pylist()):
                    lines = kept = (text or "").split("\n")
                    if keys:
                        gone = set(keys)
                        kept = [x for x in lines if line_key(x, min_chars) not in gone]
                    texts.append("\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.record_batch([small.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                                       pa.array(n_dropped, pa.int64()), small.column("rest")],
                                      names=["doc_id", "text", "n_lines", "n_dropped", "rest"])

    return joined.mapInArrow(run, T.StructType([*[T.StructField(n, T.StringType() if n == "text" else T.LongType()) for n in
                                                  ("doc_id", "text", "n_lines", "n_dropped")], packed.schema["rest"]]))


def dedup_all(docs: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS, portions: int = PORTIONS) -> DataFrame:
    """``docs`` inserted into a new index and deduplicated against it; columns as of ``dedup``.

    The corpus goes in by ``portions``, dealt by doc_id, as it would arrive: from the second on, the filters tell which keys may
    be known. The number of shards follows from the number of keys.
    """
    spark = docs.sparkSession
    new = stored(holders(docs, min_chars), f"{shared_folder(spark, 'lines')}/holders")
    index = empty_index(spark, shards or max(8, -(-new.count() // SHARD_KEYS)))
    for k in range(portions):
        index = insert_holders(index, new.where(F.pmod(F.xxhash64("doc_id"), F.lit(portions)) == k))
    return dedup(index, docs, min_chars)
