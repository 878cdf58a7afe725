"""The pipeline and the registered queries of the llm subpackage."""

import collections
import re

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import jaccard_join, line_dedup, packing, queries, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare.compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in plain.items() if quality.judge(quality.Text(t), quality.RULES) is None}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, SF)
    assert {r.doc_id: r.text for r in one.collect()} == kept and one.columns == docs.columns

    two = stage["line_dedup"](spark, one, SF)
    holders = collections.defaultdict(set)
    for i, t in kept.items():
        for line in t.split("\n"):
            holders[line_dedup.line_key(line)].add(i)
    lines = {i: "\n".join(x for x in t.split("\n") if (k := line_dedup.line_key(x)) is None or min(holders[k]) == i) for i, t in kept.items()}
    got = {r.doc_id: r for r in two.collect()}
    assert {i: r.text for i, r in got.items()} == lines and all(r.n_chars == len(r.text) for r in got.values()) and two.columns == docs.columns

    three = stage["ngram_jaccard_join"](spark, two, SF)
    sets = {i: set(map(int, jaccard_join.Shingler()(t))) for i, t in lines.items()}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    assert {r.doc_id for r in three.collect()} == {i for i, v in label.items() if i == v} and three.columns == docs.columns

    four = stage["pii"](spark, three, SF)
    assert four.columns == docs.columns and four.count() == three.count()
    before = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        assert re.sub(r"\S*[0-9@]\S*|u[0-9a-f]{12}@\S+", "", before[r.doc_id]) == re.sub(r"\S*[0-9@]\S*", "", r.text)
        assert r.n_chars == len(r.text)

    five = stage["best_fit_packing"](spark, four, SF).collect()
    want = {r.doc_id: len(r.text.encode().split()) for r in four.collect()}
    total = collections.Counter()
    for r in five:
        total[r.doc_id] += r.length
        assert r.bin_length in packing.LENGTHS and r.bin_offset + r.length <= r.bin_length
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in total.items() if n} and want.keys() == total.keys()


def test_copies_go_by_row(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = words(1) + " end"
    rows = [(1, words(1)), (2, near), (2, words(2)), (3, words(3)), (3, words(3)), (None, words(1)), (None, words(4)), (4, ""), (4, ""), (5, None), (6, words(2))]
    docs = spark.createDataFrame([(i, t, f"c{k}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, told string").withColumn("a.b", F.lit(1))
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, words(1)), (2, words(2)), (3, words(3)), (None, words(4)), (4, ""), (4, ""), (5, None)], key=repr)


def test_pipeline_takes_hostile_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, "a " * 50_000, "x", "s", 7)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for part in (docs, docs.limit(0)):
        out = part
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        out.collect()
    out = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, out, SF)
    assert out.count() > 0
