"""Jaccard self-join of documents on sets of word n-grams, by filters under several token orders.

Two sets with a similarity of 80 in 100 or more share a token among the first fifth (and one) of their tokens, whatever
order all tokens are put in, as long as both sets use the same. Candidates have to pass three orders:

1. *Rarest first.* Of each set the WINDOW share (all of it by default) that comes first in the order of hashes is looked at. A
   similar pair shares at least a number of tokens there that follows from its sizes, so each set may leave out that many
   (less one) of them: those that most other sets have. How many sets have a token is counted exactly up to HOT; beyond, the
   order among common tokens is that of their hashes. Tokens of one set only match nothing, so a text that merely quotes a
   popular passage drops out here.
2. *Another order of hashes:* the first fifths (and one) must share as many tokens as follows from the sizes.
3. *Sizes:* the smaller set must have 80 in 100 of the larger one's tokens. They also tell how much of both windows must be left
   behind a first common token.

Pairs that pass are verified on the whole sets. Equal sets are one node from the start. Within each group of nodes that share
a token the nodes are first compared with two of them only; links found so far give components, and then every pair of
nodes of different components that still may meet is compared. Pairs within a component need no comparison, so components
are exact and large groups of near copies cost no more than their size.

Sets are of 64-bit hashes of n-grams. A null text and one without words are empty and linked with nothing. Rows without a
doc_id take part, but cannot name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, n_parts, shared_folder, stored

WORDS = 5
THRESHOLD = 80  # in 100
#: Share of a set that is looked at; less of it costs less to shuffle and lets more pairs through.
WINDOW = 1.0
#: Sets of a token are counted exactly up to this; commoner tokens are ordered by hash.
HOT = 32
FLUSH = 1_500_000
MEMO = 300_000
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray, by: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(by)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class Shingler:
    """The sorted distinct hashes of a text's word n-grams (of its whole word sequence where that is shorter)."""

    def __init__(self, n: int = WORDS):
        self.n, self.hashes = n, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
        if not words:
            return np.zeros(0, _U)
        if len(self.hashes) > MEMO:
            self.hashes.clear()
        w = np.fromiter(map(self.hashes.__getitem__, words), _U, len(words))
        width = min(self.n, len(w))
        out = np.full(len(w) - width + 1, width, _U)
        for i in range(width):
            out = out * _MULT + w[i:len(w) - width + 1 + i]
        return np.unique(_mixed(out))


def least_shared(a, b):
    """The fewest tokens that similar sets of these sizes share."""
    return -(-THRESHOLD * (a + b) // (100 + THRESHOLD))


def prefix_size(n: int) -> int:
    return n - -(-THRESHOLD * n // 100) + 1 if n else 0


def window_size(n):
    return np.maximum(np.ceil(WINDOW * n), n - -(-THRESHOLD * n // 100) + 1).astype(np.int64)


_NEEDS: dict[int, int] = {}


def window_need(n: int) -> int:
    """The fewest tokens that a set of ``n`` and any similar one share where their windows overlap."""
    if n not in _NEEDS:
        if len(_NEEDS) > 100_000:
            _NEEDS.clear()
        other = np.arange(-(-THRESHOLD * n // 100), 100 * n // THRESHOLD + 1)
        shared = np.minimum(least_shared(n, other), np.minimum(n, other))
        beyond = np.maximum(n - int(window_size(np.int64(n))), other - window_size(other))  # of the set whose window ends first
        _NEEDS[n] = max(1, int((shared - beyond).min()))
    return _NEEDS[n]


def node_of(tokens: np.ndarray) -> int:
    """The identity of a set."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def other_prefix(tokens: np.ndarray) -> np.ndarray:
    """The prefix under the second order, as 32-bit values."""
    order = _mixed(tokens, 0xD6E8FEB86659FD93)
    k = prefix_size(len(tokens))
    return np.unique((np.partition(order, k - 1)[:k] & _U(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, told (hash of the text), n (size of the set), node, check (more of the set's hash), need, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            for small in bounded(batch):
                sets = [shingles(t) for t in small.column(1).to_pylist()]
                keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                nodes = [node_of(s) if len(s) else None for s in sets]
                yield pa.record_batch([
                    small.column(0), small.column(2), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array([k and int.from_bytes(k[8:], "little", signed=True) for k in keys], pa.int64()),
                    pa.array([window_need(len(s)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([other_prefix(s) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                    names=["doc_id", "told", "n", "node", "check", "need", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("told")).mapInArrow(
        run, "doc_id bigint, told bigint, n bigint, node bigint, check bigint, need bigint, prefix array<int>")


# --- Order 1: which tokens of the windows do other sets have? ---

_BLOB = "part int, home int, low binary, high binary, at binary, weight binary, nodes binary"


def _blobs(tokens: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's (token, node) rows by ranges of tokens. Tokens of more than HOT nodes are told apart here: their rows skip
    the count and are spread, and one row of weight HOT + 1 is counted for them."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[new], nodes[new]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    sizes = np.diff(np.r_[starts, len(tokens)])
    hot = np.repeat(sizes > HOT, sizes)
    head = np.zeros(len(tokens), bool)
    head[starts] = True
    counted = ~hot | head
    home = (tokens >> _U(32)) * _U(parts) >> _U(32)
    weight = np.where(hot, HOT + 1, 1).astype(np.uint8)
    for rows, spread in ((counted, False), (hot, True)):
        t, h, n, w = tokens[rows], home[rows], nodes[rows], weight[rows]
        edges = np.searchsorted(h, np.arange(parts + 1, dtype=_U))
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if a == b:
                continue
            own, at = np.unique(n[a:b], return_inverse=True)
            at = at.astype(np.uint16 if len(own) < 65536 else np.uint32)
            part = parts + int(t[a] % _U(parts)) if spread else p
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([p], pa.int32()),
                                   pa.array([(t[a:b] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()], pa.binary()),
                                   pa.array([(t[a:b] >> _U(32) & _U(0xFF)).astype(np.uint8).tobytes()], pa.binary()),
                                   pa.array([at.tobytes()], pa.binary()), pa.array([w[a:b].tobytes()], pa.binary()),
                                   pa.array([own.tobytes()], pa.binary())], names=[c.split()[0] for c in _BLOB.split(", ")])


def shared_tokens(docs: DataFrame) -> DataFrame:
    """token, node, df: window tokens of at least two sets; df is the number of sets, HOT + 1 standing for more than HOT.

    Tokens are packed into arrays before they are shuffled. A token is its range and 40 bits of its hash there.
    """
    parts = 2 * n_parts(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, tokens, nodes, held = Shingler(), [], [], 0
        for batch in batches:
            for small in bounded(batch):
                for text in small.column(0).to_pylist():
                    s = shingles(text)
                    if not len(s):
                        continue
                    w = s[:int(window_size(np.int64(len(s))))]
                    tokens.append(w)
                    nodes.append(np.full(len(w), node_of(s), np.int64))
                    held += len(w)
                    if held >= FLUSH:
                        yield from _blobs(np.concatenate(tokens), np.concatenate(nodes), parts)
                        tokens, nodes, held = [], [], 0
        if held:
            yield from _blobs(np.concatenate(tokens), np.concatenate(nodes), parts)

    def rows(token, node, df):
        for i in range(0, len(token), 200_000):
            yield pa.record_batch([pa.array(x[i:i + 200_000], pa.int64()) for x in (token, node, df)], names=["token", "node", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part, home, low, high, at, weight, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                low = np.frombuffer(low, np.uint32).astype(np.int64)
                token = np.int64(home) << np.int64(40) | np.frombuffer(high, np.uint8).astype(np.int64) << np.int64(32) | low
                own = np.frombuffer(nodes, np.int64)
                node = own[np.frombuffer(at, np.uint16 if len(own) < 65536 else np.uint32)]
                if part >= parts:
                    yield from rows(token, node, np.full(len(token), HOT + 1, np.int64))
                else:
                    held.append((token, node, np.frombuffer(weight, np.uint8)))
        if not held:
            return
        token, node, weight = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((weight, node, token))
        token, node, weight = token[order], node[order], weight[order]
        last = np.ones(len(token), bool)  # a row of each token and node, the heaviest
        last[:-1] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, weight = token[last], node[last], weight[last]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.minimum(np.add.reduceat(weight, starts, dtype=np.int64), HOT + 1)
        df = np.repeat(df, np.diff(np.r_[starts, len(token)]))
        keep = (df > 1) & (weight == 1)  # rows of weight HOT + 1 have been passed on already
        yield from rows(token[keep], node[keep], df[keep])

    packed = docs.select("text").where("text is not null").mapInArrow(pack, _BLOB)
    return packed.repartitionById(2 * parts, "part").mapInArrow(count, "token bigint, node bigint, df bigint")


def rarest(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, node, n, alone, pos: of each set the tokens by which it has to meet any similar set, with their place in its
    window, rarest first. The ``alone`` tokens that no other set has come first and meet nothing; of all, need - 1 may be
    left out."""
    grouped = tokens.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("held"))
    size = F.size("held")
    kept = (grouped.join(nodes.select("node", "n", "need"), "node").where(size >= F.col("need"))
            .withColumn("alone", (window(F.col("n")) - size).cast("int"))
            .select("node", "n", "alone", F.slice("held", F.lit(1), F.greatest(F.lit(0), size - F.col("need") + 1).cast("int")).alias("held")))
    return kept.select("node", "n", "alone", F.posexplode("held").alias("i", "h")).select(
        F.col("h.token").alias("token"), "node", "n", "alone", (F.col("alone") + F.col("i") + 1).alias("pos"))


# --- Pairs, verification, components ---


def prefix(n: Column) -> Column:
    return n - F.ceil(n * THRESHOLD / 100) + 1


def window(n: Column) -> Column:
    return F.greatest(F.ceil(n * WINDOW), prefix(n))


def shared_least(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * THRESHOLD / (100 + THRESHOLD))


def may_meet(a: str, b: str) -> Column:
    """Whether two sets may be similar and this token the first of the rarest-first order that both windows have: sizes, and
    enough window left behind it on both sides."""
    n = {s: F.col(f"{s}.n") for s in (a, b)}
    need = F.greatest(F.lit(1), shared_least(n[a], n[b]) - F.greatest(*[x - window(x) for x in n.values()]))
    near = F.least(*n.values()) * 100 >= F.greatest(*n.values()) * THRESHOLD
    return near & (F.col(f"{a}.pos") <= window(n[a]) - need + 1) & (F.col(f"{b}.pos") <= window(n[b]) - need + 1)


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar: by the second order first, then on the whole sets."""
    side = {s: members.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"prefix_{s}")) for s in "ab"}
    text = {s: members.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
    # Tokens that the prefixes must share; those that fell together as 32-bit values are allowed for.
    n = [F.col(f"n_{s}") for s in "ab"]
    lost = sum((prefix(x) - F.size(f"prefix_{s}") for x, s in zip(n, "ab")), F.lit(0))
    need = F.greatest(F.lit(1), shared_least(*n) - F.greatest(*[x - prefix(x) for x in n]) - lost)
    likely = pairs.join(side["a"], "a").join(side["b"], "b").where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= need).select("a", "b")
    both = likely.join(text["a"], "a").join(text["b"], "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, b_last, b_set = Shingler(), None, None
        for batch in batches:
            for small in bounded(batch):
                left, right = [], []
                for a, b, ta, tb in zip(*(c.to_pylist() for c in small.columns)):
                    if b != b_last:
                        b_last, b_set = b, shingles(tb)
                    a_set = shingles(ta)
                    common = len(np.intersect1d(a_set, b_set, assume_unique=True))
                    if 100 * common >= THRESHOLD * (len(a_set) + len(b_set) - common):
                        left.append(a)
                        right.append(b)
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, label of the nodes in ``links`` (a, b): the smallest node of each component.

    Stars are alternately formed around the smallest neighbour of each node, among larger and among smaller neighbours,
    until nothing changes; rounds grow with the logarithm of the longest path. Every round is written down.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    turn, now = 0, state(edges)
    while True:
        turn += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.u", "e.v").where("u <> v").distinct(), f"{folder}/edges{turn}")
        edges, before, now = new, now, state(new)
        if now == before:
            break
    label = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).where("a <> b").distinct()


def _pairs_with_pivots(held: DataFrame) -> DataFrame:
    """Each node with two nodes of each of its tokens: the one with the smallest share of tokens of its own, which is likest to
    what a group of near copies was made from, and the smallest one."""
    row = F.struct("node", "n", "pos")
    ends = held.groupBy("token").agg(F.min_by(row, F.struct(F.col("alone") / window(F.col("n")), "node")).alias("plain"),
                                     F.min_by(row, "node").alias("low"), F.max("node").alias("high")).where("low.node < high")
    pivots = ends.select("token", F.explode(F.array_distinct(F.array("plain", "low"))).alias("p")).select("token", "p.*")
    return _ordered(held.alias("x").join(pivots.alias("y"), "token").where(may_meet("x", "y")))


def _pairs_between(held: DataFrame, label: DataFrame) -> DataFrame:
    """All pairs of nodes that may meet in a token and lie in different components so far."""
    known = held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    # Sizes of a pair differ by a factor of 1.25 at most: they lie in the same step or in neighbouring ones.
    step = F.floor(F.ln(F.col("n").cast("double")) / F.ln(F.lit(1.01 * 100 / THRESHOLD))).cast("int")
    rows = known.join(mixed, "token", "left_semi").withColumn("step", step)
    near = rows.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", F.col("step") + F.col("up"))
    x, y = rows.alias("x"), near.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.up") == 1) | (F.col("x.node") < F.col("y.node")))
    return _ordered(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.step") == F.col("y.step")) & apart & may_meet("x", "y")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_copies (documents with the same set)."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "n_copies")


def grouped(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with told (xxhash64 of the text) and component, which rows with equal ids need to be told apart; the
    component of a document without words is null."""
    folder = shared_folder(docs.sparkSession, "jaccard")
    sets = stored(document_sets(docs), f"{folder}/sets")
    # Two sets with the same 64-bit node but different check would be taken for one: never seen, but not left to chance.
    clash = F.when(F.min("check") != F.max("check"), F.raise_error(F.lit("two sets have the same hash")))
    nodes = stored(sets.where("node is not null").groupBy("node").agg(
        F.min("n").alias("n"), F.min("need").alias("need"), F.min(F.struct("doc_id", "told")).alias("one"), F.min("doc_id").alias("first"),
        F.count("*").alias("n_copies"), clash.cast("string").alias("clash")), f"{folder}/nodes")
    held = stored(rarest(shared_tokens(docs), nodes), f"{folder}/held")
    pairs = stored(_pairs_with_pivots(held), f"{folder}/pairs")
    alone = held.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    met = held.join(alone, "token", "left_semi").select("node").distinct()
    chosen = nodes.join(met, "node", "left_semi").select("node", "one.doc_id", "one.told")
    x, y = sets.where("node is not null").alias("x"), chosen.alias("y")
    one = (F.col("x.node") == F.col("y.node")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.told") == F.col("y.told"))
    prefixes = x.join(y, one, "left_semi").dropDuplicates(["node"])
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("told"))
    same = (texts["doc_id"].eqNullSafe(prefixes["doc_id"])) & (texts["told"] == prefixes["told"])
    members = stored(texts.join(prefixes, same).select("node", "n", "prefix", "text").dropDuplicates(["node"]), f"{folder}/members")
    links = stored(verified(pairs, members), f"{folder}/links")
    label = components(links, f"{folder}/first")
    more = stored(verified(_pairs_between(held, label), members), f"{folder}/more")
    label = stored(components(links.union(more), f"{folder}/second"), f"{folder}/labels")
    named = nodes.select("node", "first", "n_copies").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    found = named.join(smallest, "label").select("node", "label", "component", "n_copies")
    return sets.select("doc_id", "told", "n", "node").join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        "told", F.col("label").alias("component"))
