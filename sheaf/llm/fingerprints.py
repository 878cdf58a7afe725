"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo a prime, the hash of every prefix; the hash of any span follows from two entries,
so spans are compared in constant time and the longest common extension of two positions is found by binary search.
A text's fingerprint is its whole hash and its sketch: the SKETCH smallest mixed hashes of its spans of SPAN code points
(of the whole text where that is shorter). The likeness of two fingerprints estimates the share of spans that the two
texts have in common. Two moduli near 2^31 make a 62-bit hash.

A null text is empty; the fingerprint of an empty text has no sketch and is like other empty ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, n_parts

SPAN = 16
SKETCH = 64
#: Two primes below 2^31, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
_U = np.uint64


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1, or more, of a base. Of each base the longest array is kept; shorter ones are its beginnings."""
    out = _POWERS.get((base, prime))
    done = 0 if out is None else len(out)
    if done < n:
        grown = np.ones(n, _U)
        if done:
            grown[:done] = out
        done = max(done, 1)
        while done < n:  # doubling: the next block is the block so far times one power
            step = min(done, n - done)
            grown[done:done + step] = grown[:step] * _U(pow(base, done, prime)) % _U(prime)
            done += step
        out = _POWERS[base, prime] = grown
    return out


def _sized(n: int) -> int:
    return 1 << max(10, int(n).bit_length())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixHash:
    """Prefix arrays of a text under both primes. Entry i is the sum of (code + 1) * base^position over the first i code points."""

    def __init__(self, text: str, start: PrefixHash | None = None, kept: int = 0):
        """With ``start``: its first ``kept`` code points are those of ``text``, and its arrays are continued from there."""
        self.codes = codes(text)
        self.n = n = len(self.codes)
        self.size = _sized(n)
        self.prefix = []
        for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
            terms = (self.codes[kept:].astype(_U) + _U(1)) * _powers(base, prime, self.size)[kept:n] % _U(prime)
            sums = np.zeros(n + 1, _U)
            if start:
                sums[:kept + 1] = start.prefix[k][:kept + 1]
            np.cumsum(terms, out=sums[kept + 1:])  # below 2^64 for texts of up to 2^32 code points
            sums[kept + 1:] = (sums[kept + 1:] + sums[kept]) % _U(prime)
            self.prefix.append(sums)

    def spans(self, starts, ends) -> np.ndarray:
        """Hashes of many spans, independent of where they stand."""
        out = None
        for (base, prime), h in zip(zip(BASES, PRIMES), self.prefix):
            back = _powers(pow(base, -1, prime), prime, self.size)
            part = (h[ends] + _U(prime) - h[starts]) % _U(prime) * back[starts] % _U(prime)
            out = part if out is None else out << _U(31) | part
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def rolling(self, width: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of ``width`` that start at ``first`` or later."""
        stop = self.n - width + 1
        if stop <= first:
            return np.zeros(0, _U)
        out = None
        for (base, prime), h in zip(zip(BASES, PRIMES), self.prefix):
            back = _powers(pow(base, -1, prime), prime, self.size)
            part = (h[first + width:stop + width] + _U(prime) - h[first:stop]) % _U(prime) * back[first:stop] % _U(prime)
            out = part if out is None else out << _U(31) | part
        return out


def same_span(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by binary search over span equality."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def smallest(hashes: np.ndarray, most: int = SKETCH) -> np.ndarray:
    """The smallest distinct 32-bit mixes of some hashes, ascending."""
    mixed = hashes * _U(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> _U(29)) * _U(0xBF58476D1CE4E5B9) >> _U(32)
    few = mixed
    want = 2 * most
    while len(few) > want:  # more than needed, in case of repeats
        part = np.unique(np.partition(few, want)[:want])
        if len(part) >= most or want >= len(mixed):
            few = part
            break
        want *= 8
    return np.unique(few)[:most].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the span sets behind two sketches: the share of the smallest hashes of both together
    that are in both."""
    both = np.union1d(a, b)[:max(len(a), len(b))]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def fingerprint(h: PrefixHash, sketch: np.ndarray) -> str:
    whole = h.span(0, h.n) if h.n else 0
    return f"{h.n:x}.{whole:016x}." + sketch.astype(">u4").tobytes().hex()


def _window(h: PrefixHash) -> int:
    return max(1, min(SPAN, h.n))


class Finger:
    """A text's hash, the hashes of its spans, its sketch and its fingerprint. What an edited text shares with the start of
    the text it was made from is reused."""

    def __init__(self, text: str, source: Finger | None = None, kept: int = 0):
        self.hash = PrefixHash(text, source and source.hash, kept)
        width = _window(self.hash)
        if source and width == _window(source.hash):
            reused = max(0, kept - width + 1)
            self.rolled = np.concatenate([source.rolled[:reused], self.hash.rolling(width, reused)])
        else:
            self.rolled = self.hash.rolling(width)
        self.sketch = smallest(self.rolled)
        self.text = fingerprint(self.hash, self.sketch)


def edited(own: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of another."""
    k = len(own) // 4
    return own[:len(own) - k] + following[:k]


# --- Each document beside the next one ---


_ALONE, _OWN, _GUEST = 0, 1, 2


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, kind: ranges of ascending doc_id, each followed by the first document of the next range as guest.

    The ranges come from approximate quantiles of the ids, one number per partition; only ids are read for that. The
    last range has the first document of all as its guest. Rows without an id stand alone and are spread by their text.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("doc_id") >= c)) if cuts else F.lit(0)
    firsts = {r.part: r.first for r in ids.groupBy(part.alias("part")).agg(F.min("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    host = dict(zip(used[1:] + used[:1], used))  # the range before each
    known = range(len(cuts) + 1)
    first = F.array(*[F.lit(firsts.get(p)).cast("bigint") for p in known])[F.col("part")]
    before = F.array(*[F.lit(host.get(p)).cast("int") for p in known])[F.col("part")]
    place = F.struct(F.col("part"), F.when(F.col("doc_id").isNull(), _ALONE).otherwise(_OWN).alias("kind"))
    guest = F.when(F.col("doc_id") == first, F.struct(before.alias("part"), F.lit(_GUEST).alias("kind")))
    spread = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("part", F.when(F.col("doc_id").isNull(), spread).otherwise(part))
            .select("doc_id", "text", F.explode(F.array_compact(F.array(place, guest))).alias("at"))
            .select("doc_id", "text", "at.part", "at.kind"))


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                  ("common_prefix", pa.int64())])


def compare(doc_id: int | None, own: str, a: Finger, following: str, b: Finger) -> tuple:
    changed = edited(own, following)
    e = Finger(changed, a, len(own) - len(own) // 4)
    return (doc_id, a.hash.n, changed, a.text, e.text, likeness(a.sketch, e.sketch), likeness(a.sketch, b.sketch),
            common_extension(a.hash, 0, e.hash, 0))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each document: its fingerprint and that of its edited text, and how like the first is to the second and to
    the fingerprint of the next document in order of doc_id (the first one after the last; of rows with the same id, the
    next in order of text; an empty text after rows without id). ``common_prefix`` is how many code points the text and
    the edited text share from their start."""
    parts = parts or n_parts(docs)
    dealt = beside_next(docs, parts).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing, held = Finger(""), None
        for batch in batches:
            for small in bounded(batch, 4_000_000):
                out = []
                for doc_id, text, part, kind in zip(*(c.to_pylist() for c in small.columns)):
                    if kind == _GUEST and held is None:
                        continue  # another row with the guest's id
                    finger = Finger(text)
                    if kind == _ALONE:
                        out.append(compare(doc_id, text, finger, "", nothing))
                        continue
                    if held is not None:
                        out.append(compare(*held, text, finger))
                    held = None if kind == _GUEST else (doc_id, text, finger)
                if out:
                    yield batch_of(_ROW, *zip(*out))

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double, common_prefix bigint")
