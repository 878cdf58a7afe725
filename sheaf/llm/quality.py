"""Quality rules as a short-circuit cascade.

Every rule says whether it rejects a document. All must pass, so their order decides only the work: each rule is timed
and its rejections are counted on a sample, then the rules run in the order of rejections per second, and a document
leaves at the first rule that rejects it. Features shared by rules are computed once per document, when first needed.

A null text has no words. Words are runs of characters other than tab, line feed, vertical tab, form feed, carriage
return and space.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_BYTES, bounded

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Rows the order of the rules is estimated on; verdicts do not depend on it.
SAMPLE_ROWS = 400


class Text:
    """A document's text with the features that rules look at."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split() cuts at the six ASCII white-space characters only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, SPACE_BYTES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of WINDOW words that occur at least twice."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        width = 1
        while width < WINDOW:  # ranks of windows of 2, 4, 8 words; equal ranks mean equal windows
            pairs = ids[:-width] * np.int64(ids.max() + 1) + ids[width:]
            _, ids = np.unique(pairs, return_inverse=True)
            width *= 2
        twice = np.bincount(ids)[ids] > 1
        edges = np.zeros(self.n_words + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


Rule = Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    """Too few words, or mostly passages that repeat."""
    return t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words


def symbols(t: Text) -> bool:
    """More than one symbol for ten words."""
    return 10 * t.n_symbols > t.n_words


def word_length(t: Text) -> bool:
    """Words of fewer than 2 or more than 15 characters on average."""
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def repeated_lines(t: Text) -> bool:
    """More than half of the lines are copies of earlier ones."""
    return 2 * t.n_dup_lines > len(t.lines)


def stuttering(t: Text) -> bool:
    """More than three words in ten equal the word before."""
    return 10 * sum(map(bytes.__eq__, t.words, t.words[1:])) > 3 * t.n_words


def letters(t: Text) -> bool:
    """Fewer than six characters in ten of the words are letters."""
    return 10 * sum(map(str.isalpha, t.text)) < 6 * t.word_chars


def shouting(t: Text) -> bool:
    """More than half of the letters are capitals."""
    upper = sum(map(str.isupper, t.text))
    return 2 * upper > sum(map(str.isalpha, t.text))


RULES: tuple[Rule, ...] = (base_failed, symbols, word_length, repeated_lines, stuttering, letters, shouting)


def rejections_per_second(rules: tuple[Rule, ...], texts: list[str | None]) -> dict[str, float]:
    """Estimated on ``texts``, each rule on fresh features."""
    worth = {}
    for rule in rules:
        fresh = [Text(t) for t in texts]
        start = time.perf_counter()
        rejected = sum(map(rule, fresh))
        worth[rule.__name__] = rejected / (time.perf_counter() - start + 1e-9)
    return worth


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """``rules`` in the order of rejections per cost on a sample of the texts."""
    texts = [r.text for r in docs.select(F.substring("text", 1, 100_000).alias("text")).limit(sample_rows).collect()]
    worth = rejections_per_second(rules, texts)
    return tuple(sorted(rules, key=lambda r: -worth[r.__name__]))


def judge(t: Text, order: tuple[Rule, ...]) -> str | None:
    """The first rule of ``order`` that rejects the text."""
    return next((r.__name__ for r in order if r(t)), None)


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, the features, base_failed, kept, and the rule that rejected the document."""
    order = order or cascade(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                texts = [Text(t) for t in small.column("text").to_pylist()]
                rejected = [judge(t, order) for t in texts]
                columns = [small.column("doc_id"), *(pa.array([getattr(t, f) for t in texts], pa.int64()) for f in _FEATURES),
                           pa.array(map(base_failed, texts), pa.bool_()), pa.array([r is None for r in rejected], pa.bool_()),
                           pa.array(rejected, pa.string())]
                yield pa.record_batch(columns, names=["doc_id", *_FEATURES, "base_failed", "kept", "rejected_by"])

    schema = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in _FEATURES) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. Rules after the first rejection do not run."""
    order = order or cascade(docs)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                good = [judge(Text(t), order) is None for t in small.column(text).to_pylist()]
                yield small.filter(pa.array(good, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow cannot take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
