"""Byte-pair encoding through a memory-mapped transducer of frequent words.

The most frequent words of the corpus are encoded once and compiled into a minimal acyclic transducer: words share prefixes and
suffixes, the numbers on the arcs of a word's path add up to its place in a table of token ids. The file is written to the
shared folder, fetched by each executor and memory-mapped by its workers, which keep it from task to task. Words that it does
not hold are merged pair by pair, those of many texts at once, so results are exact for any text. Encoding and decoding agree
with the ``tokenizers`` library on the same file.

A null text is empty. Only byte-level vocabularies without normaliser are supported.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import struct
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_folder, stored

#: Words compiled into the transducer: a bound on the file (some MB) and on what the driver gathers.
LEXICON_WORDS = 100_000
#: Words beside those of the transducer that a worker remembers before it forgets them.
MEMO_WORDS = 150_000
#: Fixed value: how byte-level vocabularies of this kind cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable ones for themselves, the others moved up by 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = piece.encode() if piece in self.specials else bytes(letters[c] for c in piece)
        for piece, i in self.specials.items():
            self.pieces[i] = piece.encode()
        self.bytes = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


#: Up to this many symbols, looking through all pairs at each step beats a heap.
SHORT = 40
_NEVER = (1 << 62, -1)
#: Words are merged side by side with others of up to so many bytes; longer ones one by one.
WIDTHS = (8, 12, 16, 24, 40)
LEARNT_AT_ONCE = 20_000
#: Bytes of text that are cut into words at a time; as words they take some twelve times as much.
CUT_AT_ONCE = 2_000_000


def merge_word(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merges neighbours, lowest rank first and leftmost among equals. ``merges``: a << 32 | b -> rank, id."""
    return _merge_short(symbols, merges.get) if len(symbols) <= SHORT else _merge_long(symbols, merges)


def _merge_short(symbols: list[int], get) -> list[int]:
    ranks = [get(a << 32 | b, _NEVER) for a, b in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) is not _NEVER:
        i = ranks.index(best)
        symbols[i:i + 2] = [best[1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(symbols[i - 1] << 32 | symbols[i], _NEVER)
        if i < len(ranks):
            ranks[i] = get(symbols[i] << 32 | symbols[i + 1], _NEVER)
    return symbols


def _merge_long(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """With a heap, in n log n steps."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (m := merges.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(heap, (m[0], i, symbols[i], symbols[j], m[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


# --- The transducer ---


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arcs of the minimal acyclic transducer of ``words`` (sorted, distinct): a word's arc outputs add up to its index.

    States are built depth first and merged as soon as no later word can change them: two states with the same arcs and
    the same ending are one.
    """
    known: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of finished states: (byte, target)
    finals: list[bool] = []

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(state[1])
            finals.append(state[0])
        return known[key]

    path: list[list] = [[False, []]]  # open states along the last word: is it an end, its finished arcs
    last = b""
    for word in words:
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        for i in range(len(last), shared, -1):
            path[i - 1][1].append((last[i - 1], finish(path.pop())))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], finish(path.pop())))
    root = finish(path[0])

    below = []  # words that can be read from each state; targets are finished before their sources
    for final, out in zip(finals, arcs):
        below.append(int(final) + sum(below[t] for _, t in out))
    letters, targets, outputs = [], [], []  # a letter is a state and a byte: ascending, as words are sorted
    for state, (final, out) in enumerate(zip(finals, arcs)):
        before = int(final)
        for letter, t in out:
            letters.append(state << 8 | letter)
            targets.append(t)
            outputs.append(before)
            before += below[t]
    return {"letters": np.array(letters, np.uint64), "targets": np.array(targets, np.uint32), "outputs": np.array(outputs, np.uint32),
            "finals": np.array(finals, np.uint8), "root": np.array([root], np.uint32)}


def pair_table(merges: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """A hash table of the pairs that merge: a pair stands in its slot or in one of the next few, with its rank and new id."""
    size = 1 << max(4, (4 * len(merges)).bit_length())
    keys, rank, new, steps = np.full(size, _NO_PAIR, np.uint64), np.zeros(size, np.uint32), np.zeros(size, np.uint32), 1
    pairs = np.array([a << 32 | b for a, b, _ in merges], np.uint64)
    for k, (slot, pair) in enumerate(zip(_slot(pairs, size).tolist(), pairs.tolist())):
        step = 1
        while keys[slot] != _NO_PAIR:
            slot, step = (slot + 1) % size, step + 1
        keys[slot], rank[slot], new[slot], steps = pair, k, merges[k][2], max(steps, step)
    return {"pair_keys": keys, "pair_ranks": rank, "pair_ids": new, "pair_steps": np.array([steps], np.uint32)}


_NO_PAIR = np.uint64((1 << 64) - 1)
_UNMERGED = np.uint32((1 << 32) - 1)


def _slot(pairs: np.ndarray, size: int) -> np.ndarray:
    return ((pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays one after the other, each on a multiple of eight bytes, behind a table of where they are."""
    head, body = {}, b""
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(body), a.nbytes]
        body += a.tobytes() + b"\0" * (-a.nbytes % 8)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + body


class Lexicon:
    """A memory-mapped lexicon file: the transducer, the ids of its words, merges and pieces of the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size, = struct.unpack_from("<Q", self.file)
        places, base = json.loads(self.file[8:8 + size]), 8 + size
        a = self.arrays = {k: np.frombuffer(self.file, kind, n // np.dtype(kind).itemsize, base + at) for k, (kind, at, n) in places.items()}
        self.bytes = a["bytes"].astype(np.uint32)
        self.steps = int(a["pair_steps"][0])
        self.id_starts, self.ids = a["id_starts"].tolist(), a["ids"].tobytes()
        ends, pieces = a["piece_ends"].tolist(), a["pieces"].tobytes()
        self.pieces = [pieces[i:j] for i, j in zip([0, *ends], ends)]
        self.specials = {self.pieces[i].decode(): i for i in a["specials"].tolist()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}  # words of the transducer that have been met
        self.memo: dict[str, bytes] = {}  # these and others

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        a = self.arrays
        used = np.flatnonzero(a["pair_keys"] != _NO_PAIR)
        return dict(zip(a["pair_keys"][used].tolist(), zip(a["pair_ranks"][used].tolist(), a["pair_ids"][used].tolist())))

    def walk(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word (bytes starts to starts + sizes of ``flat``) that the transducer accepts, -1 for others."""
        a = self.arrays
        letters, targets, outputs = a["letters"], a["targets"], a["outputs"]
        out, who = np.full(len(starts), -1, np.int64), np.arange(len(starts))
        state, total = np.full(len(starts), a["root"][0], np.uint64), np.zeros(len(starts), np.int64)
        for j in itertools.count():
            done = sizes[who] == j
            ends = done & (a["finals"][state] != 0)
            out[who[ends]] = total[ends]
            who, state, total = who[~done], state[~done], total[~done]
            if not len(who) or not len(letters):
                return out
            key = state << np.uint64(8) | flat[starts[who] + j].astype(np.uint64)
            arc = np.minimum(np.searchsorted(letters, key), len(letters) - 1)
            there = letters[arc] == key
            who, arc = who[there], arc[there]
            state, total = targets[arc].astype(np.uint64), total[there] + outputs[arc]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new id of pairs; _UNMERGED where there is no merge."""
        a = self.arrays
        keys, size = a["pair_keys"], len(a["pair_keys"])
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = _slot(pair, size).astype(np.int64)
        rank, new = np.full(len(pair), _UNMERGED, np.uint32), np.zeros(len(pair), np.uint32)
        open_ = np.arange(len(pair))
        for _ in range(self.steps):
            held = keys[slot]
            hit = held == pair[open_]
            rank[open_[hit]], new[open_[hit]] = a["pair_ranks"][slot[hit]], a["pair_ids"][slot[hit]]
            on = ~hit & (held != _NO_PAIR)
            if not on.any():
                break
            open_, slot = open_[on], (slot[on] + 1) % size
        return rank, new

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row of ``symbols`` (its first ``sizes`` entries): lowest rank first, leftmost among equals."""
        n, width = symbols.shape
        columns = np.arange(width)[None, :]
        rank, new = np.full((n, width), _UNMERGED, np.uint32), np.zeros((n, width), np.uint32)
        pairs = np.nonzero(columns < sizes[:, None] - 1)
        rank[pairs], new[pairs] = self.look_up(symbols[pairs], symbols[pairs[0], pairs[1] + 1])
        who = np.arange(n)
        out, left = symbols.copy(), sizes.copy()
        while True:
            best = rank.argmin(1)
            here = np.arange(len(who))
            on = rank[here, best] != _UNMERGED
            if not on.all():
                out[who[~on]], left[who[~on]] = symbols[~on], sizes[~on]
                who, symbols, sizes, rank, new, best = who[on], symbols[on], sizes[on], rank[on], new[on], best[on]
                here = np.arange(len(who))
            if not len(who):
                return out, left
            merged = new[here, best]
            moved = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols, rank, new = (np.take_along_axis(x, moved, 1) for x in (symbols, rank, new))
            symbols[here, best] = merged
            sizes = sizes - 1
            rank[here, best] = _UNMERGED
            i = np.flatnonzero(best > 0)  # the pairs before and behind what was merged are new
            k = best[i]
            rank[i, k - 1], new[i, k - 1] = self.look_up(symbols[i, k - 1], merged[i])
            i = np.flatnonzero(best + 1 < sizes)
            k = best[i]
            rank[i, k], new[i, k] = self.look_up(merged[i], symbols[i, k + 1])

    def learn(self, words: set[str]) -> None:
        """Puts the ids of ``words`` into the memo, as little-endian 32-bit integers."""
        if len(self.memo) - len(self.known) > MEMO_WORDS:
            self.memo = dict(self.known)
        words = [w for w in words if w not in self.memo]
        for i in range(0, len(words), LEARNT_AT_ONCE):
            self._learn(words[i:i + LEARNT_AT_ONCE])

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(raw), np.uint8)
        numbers = self.walk(flat, starts, sizes)
        for k, i in zip(numbers.tolist(), range(len(words))):
            if k >= 0:
                self.memo[words[i]] = self.known[words[i]] = self.ids[4 * self.id_starts[k]:4 * self.id_starts[k + 1]]
        other = numbers < 0
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero(other & (sizes > low) & (sizes <= width))
            low = width
            if len(rows):
                places = np.minimum(starts[rows, None] + np.arange(width)[None, :], len(flat) - 1)
                ids, n = self.merge_all(self.bytes[flat[places]], sizes[rows])
                whole, line = ids.astype("<u4").tobytes(), 4 * width
                for at, (i, k) in enumerate(zip(rows.tolist(), n.tolist())):
                    self.memo[words[i]] = whole[at * line:at * line + 4 * k]
        for i in np.flatnonzero(other & (sizes > low)).tolist():
            ids = merge_word(self.bytes[np.frombuffer(raw[i], np.uint8)].tolist(), self.merges)
            self.memo[words[i]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, out = [], []
        for text in texts:
            if self.special and any(s in text for s in self.specials):
                parts = self.special.split(text)
                cut.append([p for k, part in enumerate(parts) for p in ([self.specials[part]] if k % 2 else self.words.findall(part))])
            else:
                cut.append(self.words.findall(text))
        new: set = set()
        new.update(*cut)
        self.learn({w for w in new if isinstance(w, str)} if self.special else new)
        look = self.memo.__getitem__
        for text, words in zip(texts, cut):
            try:
                out.append(b"".join(map(look, words)))
            except KeyError:  # special tokens stand among the words
                out.append(b"".join(struct.pack("<I", w) if isinstance(w, int) else look(w) for w in words))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def lexicon(name: str) -> Lexicon:
    """The lexicon of a published file; a worker keeps the last two it has opened, with what it has learnt, from task to task."""
    kept = vars(sys.modules["pyspark"]).setdefault("_lexicons_of_worker", {})
    if name not in kept:
        for old in list(kept)[:-1]:
            del kept[old]
        kept[name] = Lexicon(SparkFiles.get(name))
    return kept[name]


# --- Jobs ---


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in the corpus; counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = regex.compile(WORDS), Counter()
        for batch in batches:
            for small in bounded(batch):
                for text in small.column(0).to_pylist():
                    count.update(words.findall(text))
                    if len(count) > MEMO_WORDS:
                        yield flush(count)
                        count = Counter()
        if count:
            yield flush(count)

    def flush(count):
        return pa.record_batch([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    return (docs.select("text").where("text is not null").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """At most ``most`` words: all those above the lowest frequency in the corpus at which they are not more."""
    counts = word_counts(docs).where("n > 1 and length(word) <= 64")
    counts = stored(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("level")), f"{shared_folder(docs.sparkSession, 'words')}/counts")
    kept, lowest = 0, None
    for level, n in sorted(((r.level, r.n) for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        if kept + n > most:
            break
        kept, lowest = kept + n, level
    return [] if lowest is None else [r.word for r in counts.where(F.col("level") >= lowest).select("word").collect()]


def lexicon_file(vocabulary: Vocabulary, words: list[str]) -> bytes:
    merges = {a << 32 | b: (rank, new) for rank, (a, b, new) in enumerate(vocabulary.merges)}
    raw = sorted({w.encode() for w in words})
    ids = [merge_word([vocabulary.bytes[b] for b in w], merges) for w in raw]
    arrays = compile_words(raw)
    arrays["id_starts"] = np.cumsum([0, *map(len, ids)]).astype(np.uint32)
    arrays["ids"] = np.array([i for x in ids for i in x], np.uint32)
    arrays["bytes"] = np.array(vocabulary.bytes, np.uint32)
    arrays |= pair_table(vocabulary.merges)
    arrays["pieces"] = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
    arrays["piece_ends"] = np.cumsum(list(map(len, vocabulary.pieces))).astype(np.uint32)
    arrays["specials"] = np.array(list(vocabulary.specials.values()), np.uint32)
    return to_file(arrays)


def publish(docs: DataFrame, data: bytes) -> str:
    """Writes the file to the shared folder and has executors fetch it; the name to open it by."""
    context = docs.sparkSession.sparkContext
    folder = shared_folder(docs.sparkSession, "lexicon")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}.bin")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    context.addFile(path.toString())
    return folder.rsplit("/", 1)[-1] + ".bin"


def encode_documents(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (32-bit little-endian integers), n_tokens."""
    name = publish(docs, lexicon_file(Vocabulary(tokenizer), frequent_words(docs, lexicon_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(name)
        for batch in batches:
            for small in bounded(batch, CUT_AT_ONCE):
                ids = words.encode([t or "" for t in small.column(1).to_pylist()])
                yield pa.record_batch([small.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                                      names=["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of ids, special tokens included."""
    name = publish(encoded, lexicon_file(Vocabulary(tokenizer), []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(name)
        for batch in batches:
            for small in bounded(batch):
                yield small.append_column("text", pa.array([words.decode(i) for i in small.column("ids").to_pylist()], pa.string()))

    return encoded.mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint, text string")
