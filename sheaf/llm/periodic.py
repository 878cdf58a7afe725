"""Runs of repeated words found as a text is read: online dyadic square catching.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least ``exponent`` periods and
``min_words`` words long and that no neighbouring word extends. ``SquareCatcher`` reads words in portions of any size and at
any time knows the runs of what it has read.

For each block size B, a power of two, catchers stand on the blocks of B words that have been completed. A catcher serves the
periods whose runs hold a whole block beside its copy one period before (``level_of``). A completed block is compared with
every suffix that starts one of these periods before it: the names of stretches of B words (the name of 2 B words is that of
two halves) make it one comparison of numbers. Where it matches, and the block before did not, the catcher for the period is
armed. Words appended since advance its comparison; once it has held for long enough the stretch is a repetition and becomes a
run, which is compared word by word, back to its start and on with each portion until a word breaks it. Squares at
neighbouring places so merge into one run. A period that is a multiple of a shorter one whose run covers the stretch says
nothing new and is dropped before.

Reading n words takes O(n log n) steps in numpy and O(n) memory: names are kept for the stretches that catchers can still
reach. Names are 64-bit hashes; a run is reported from its words.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

MIN_WORDS = 24
EXPONENT = 3
#: Words of a text that are appended at a time.
PORTION = 1 << 16
#: Below this, no names are dropped.
FEW_NAMES = 1 << 12
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_29, _32 = np.uint64(29), np.uint64(32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs. Not linear, so that texts built against polynomial hashes do not collide."""
    h = a * _A
    t = b * _B
    t ^= b >> _29
    h ^= t
    h ^= h >> _32
    h *= _C
    h ^= h >> _29
    return h


def matched_words(period: int, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> int:
    """Words of a run that must equal the word one period before."""
    return max(1, min_words - period, (exponent - 1) * period)


def level_of(period: int, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> int:
    """The largest k such that ``matched_words`` neighbouring words of this or any longer period hold a whole block of 2**k."""
    turn = min_words // exponent  # from here on the exponent decides
    least = min(matched_words(max(period, q), min_words, exponent) for q in (turn, turn + 1))
    return ((least + 1) // 2).bit_length() - 1


@lru_cache(1024)
def last_period(level: int, min_words: int, exponent: int) -> int:
    """The longest period of this level or those below; 0 if there is none."""
    return bisect.bisect_right(range(1, 8 << max(level, 0)), level, key=lambda q: level_of(q, min_words, exponent))


@dataclass
class Level:
    """Catchers of one block size, for periods first to last."""

    block: int
    first: int = 0
    last: int = 0
    names: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # of the stretches from ``base`` on
    base: int = 0
    done: int = 0  # blocks compared
    hits: np.ndarray | None = None  # by period, whether the last compared block matched
    armed: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))  # block starts, periods


class SquareCatcher:
    """Reads words (``append``); ``runs`` gives (start, length, period) of all runs so far by start, then period."""

    def __init__(self, min_words: int = MIN_WORDS, exponent: int = EXPONENT):
        self.min_words, self.exponent = min_words, exponent
        self.lexicon: dict = {}
        self.words = np.empty(0, np.uint64)
        self.n = 0
        self.levels: list[Level] = []
        self.found: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends, ascending
        self.open: set[tuple[int, int]] = set()  # (period, start) of runs that reach the last word

    def append(self, words: Iterable) -> None:
        lexicon = self.lexicon
        words = list(words)
        for w in dict.fromkeys(words):
            if w not in lexicon:
                lexicon[w] = len(lexicon) + 1
        self.append_ids(np.fromiter(map(lexicon.__getitem__, words), np.uint64, len(words)))

    def append_ids(self, ids: np.ndarray) -> None:
        """``append`` for words that the caller has numbered, from 1."""
        if not len(ids):
            return
        if len(self.words) < self.n + len(ids):
            self.words = np.concatenate([self.words[:self.n], ids, np.empty(self.n // 2 if self.n else 0, np.uint64)])
        else:
            self.words[self.n:self.n + len(ids)] = ids
        self.n += len(ids)
        if self.open:
            self._advance_open()
        k = 0
        while k < len(self.levels) or self._new_level(k):
            self._name(k)
            if self.levels[k].last:
                self._catch(self.levels[k])
            k += 1
        for k, level in enumerate(self.levels):  # after all, as each is named from the one below
            if len(level.names) > FEW_NAMES:
                self._forget(k, level)

    def _new_level(self, k: int) -> bool:
        """Catchers of the next block size, once the words are enough for one of their runs."""
        first = last_period(k - 1, self.min_words, self.exponent) + 1
        last = last_period(k, self.min_words, self.exponent)
        if self.n < (first + matched_words(first, self.min_words, self.exponent) if first <= last else 1 << k):
            return False
        level = Level(1 << k)
        if first <= last:
            level.first, level.last = first, last
            level.hits = np.zeros(last - first + 1, bool)
        self.levels.append(level)
        return True

    def _name(self, k: int) -> None:
        """Names of the stretches of 2**k words that the last portion completed."""
        level = self.levels[k]
        have, upto = level.base + len(level.names), self.n - level.block + 1
        if upto <= have:
            return
        if k == 0:
            new = self.words[have:upto]
        else:
            below = self.levels[k - 1]
            half = below.block
            new = _mixed(below.names[have - below.base:upto - below.base], below.names[have + half - below.base:upto + half - below.base])
        level.names = np.concatenate([level.names, new]) if len(level.names) else new.copy()

    def _forget(self, k: int, level: Level) -> None:
        """Drops the names that neither the catchers of this block size nor the names of the next one can need."""
        reach = self.n - 4 * level.block - level.last
        if level.last:
            reach = min(reach, level.done * level.block - level.last, *(level.armed[0] - level.armed[1]).tolist())
        if k + 1 < len(self.levels):
            above = self.levels[k + 1]
            reach = min(reach, above.base + len(above.names))
        else:
            return
        if reach - level.base > len(level.names) // 2:
            level.names, level.base = level.names[reach - level.base:].copy(), reach

    def _catch(self, level: Level) -> None:
        block, first, last, names, base = level.block, level.first, level.last, level.names, level.base
        ready = self.n // block
        starts, periods = level.armed
        if ready > level.done:
            # One row per completed block, one column per period, the longest first. Names before the text are 0.
            lowest = level.done * block - last
            left = names if lowest >= base else np.concatenate([np.zeros(base - lowest, np.uint64), names])
            view = np.ndarray((ready - level.done, last - first + 1), np.uint64, left, 8 * max(0, lowest - base), (8 * block, 8))
            hit = view == names[level.done * block - base::block][:ready - level.done, None]
            if hit.any():
                before = np.concatenate([level.hits[None, :], hit[:-1]])
                rows, cols = np.nonzero(hit & ~before)
                at, found = (rows + level.done) * block, last - cols
                inside = at >= found
                starts, periods = np.concatenate([starts, at[inside]]), np.concatenate([periods, found[inside]])
            level.hits, level.done = hit[-1].copy(), ready
        if not len(starts):
            return
        # The stretch that must have matched from the block on, if the run began before it as late as it can have.
        need = np.maximum(np.maximum(self.min_words - periods, (self.exponent - 1) * periods), 1) - (block - 1)
        known = starts + need <= self.n
        waiting = ~known
        level.armed = starts[waiting], periods[waiting]
        starts, periods, need = starts[known], periods[known], need[known]
        for most in (2 * block, block):  # names of its last words, and of those in the middle
            here = starts + np.minimum(need - block, most) - base
            held = names[here] == names[here - periods]
            starts, periods, need = starts[held], periods[held], need[held]
        if not len(starts):
            return
        order = np.argsort(periods, kind="stable")
        starts, periods, need = starts[order], periods[order], need[order]
        again = []
        if len(starts) > 1 and last < 2 * first:  # no period here is a multiple of another
            new = ~self._covered(starts, periods, need)
            again = [(s, q) for s, q in zip(starts[new].tolist(), periods[new].tolist()) if not self._report(s, q)]
        else:
            for i, (s, q) in enumerate(zip(starts.tolist(), periods.tolist())):
                if not self._covered(starts[i:i + 1], periods[i:i + 1], need[i:i + 1])[0] and not self._report(s, q):
                    again.append((s, q))
        if again:
            level.armed = tuple(np.append(a, b) for a, b in zip(level.armed, zip(*again)))

    def _covered(self, starts: np.ndarray, periods: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether a run whose period divides the period covers the stretch and its copy."""
        out = np.zeros(len(starts), bool)
        for p, (begins, ends) in self.found.items():
            if p > periods[-1]:
                continue
            k = np.searchsorted(begins, starts - periods, "right") - 1
            out |= (periods % p == 0) & (k >= 0) & (np.asarray(ends)[k] >= starts + need)
        return out

    def _first_difference(self, i: int, period: int) -> int:
        """The first place from i on where the word differs from that one period before."""
        step = 64
        while i < self.n:
            j = min(i + step, self.n)
            off = self.words[i:j] != self.words[i - period:j - period]
            k = int(off.argmax())
            if off[k]:
                return i + k
            i, step = j, step * 2
        return self.n

    def _report(self, start: int, period: int) -> bool:
        """Adds the run around a block that equals the words one period before. False: too short, but the next word may extend it."""
        end = self._first_difference(start, period)
        first = start
        while first > period and self.words[first - 1] == self.words[first - 1 - period]:
            first -= 1
        if end - first < matched_words(period, self.min_words, self.exponent):
            return end < self.n
        begins, ends = self.found.setdefault(period, ([], []))
        i = bisect.bisect_left(begins, first - period)
        if i < len(begins) and begins[i] == first - period:
            return True
        begins.insert(i, first - period)
        ends.insert(i, end)
        if end == self.n:
            self.open.add((period, first - period))
        return True

    def _advance_open(self) -> None:
        for period, start in list(self.open):
            begins, ends = self.found[period]
            i = bisect.bisect_left(begins, start)
            ends[i] = self._first_difference(ends[i], period)
            if ends[i] < self.n:
                self.open.remove((period, start))

    def runs(self) -> list[tuple[int, int, int]]:
        return sorted((b, e - b, q) for q, (begins, ends) in self.found.items() for b, e in zip(begins, ends))


def find_runs(words: list, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words."""
    if len(words) < min_words:
        return []
    catcher = SquareCatcher(min_words, exponent)
    for i in range(0, len(words), PORTION):
        catcher.append(words[i:i + PORTION])
    return catcher.runs()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words that stay when each run is cut down to its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + length) for s, length, q in runs):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < n:
        out.append((at, n))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equal ones the first, then the one with the shortest period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else None


_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT, edit=None) -> DataFrame:
    """A row per row of ``docs``: doc_id, text with every run cut down to its first period (words joined by one space), runs,
    and the strongest of them.

    Words are the stretches between the six ASCII white-space characters. A null text is empty, one without a run has no
    strongest. Rows are handled one by one, in whatever task holds them; rows with equal ids are texts of their own, other
    columns are not read. ``edit(doc_id, words)`` may replace the words of a text before runs are sought.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()  # of bytes: at the six ASCII white-space characters only
            if edit is not None:
                words = edit(doc_id, words)
            runs = find_runs(words, min_words, exponent)
            kept = [w for a, b in kept_words(len(words), runs) for w in words[a:b]] if runs else words
            told = [dict(zip(("start", "length", "period"), r)) for r in runs]
            best = strongest(runs)
            yield doc_id, b" ".join(kept).decode(), told, told[runs.index(best)] if best else None

    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id bigint, text string, runs array<{_RUN}>, strongest {_RUN}")
