"""The operators of the llm subpackage against plain Python versions of their contracts, and on hostile rows."""

import collections
import hashlib
import math
import os
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import bpe, chat, fingerprints, jaccard_join, line_dedup, packing, pii, quality, site_tree, spans

SCHEMA = "doc_id bigint, text string, n_lines bigint, node bigint, drop string, rest string, part int"
WS = " \t\n\x0b\x0c\r"
LONG = "Long sentences go on and on. " * 20_000
PASSAGE = ("Nobody had seen the river rise so fast before that night in early spring. The bridge went first and then the mill, "
           "as the old man had foretold. In the morning there was only water where the market had been, and silence over all of it, "
           "broken now and then by a bell.")


def hostile(spark):
    """Nulls, empty and very long texts, repeated rows and ids, equal texts, and columns named like inner ones."""
    words = " ".join(f"word{i}" for i in range(60))
    near = " ".join(f"word{i}" for i in range(58)) + " other words"
    texts = [(1, "  A shared line here \nown line number one\n\nshort"), (2, "a SHARED line here\t\nshort\nown line number two"), (3, None), (4, ""),
             (5, LONG), (6, words), (7, words), (8, near), (9, "\x1c A shared line here"), (9, "\x1c A shared line here"), (10, "ÄÖ é 漢字。テスト！ x"),
             (None, "a shared line here\nlonely"), (None, None), (11, "Before it came this: " + PASSAGE + " and after."),
             (12, "Others wrote, " + PASSAGE + " So it goes."), (13, LONG), (14, words.upper()), (15, "x" * 70_000), (16, " \n \t\n"),
             (17, "tie tie tie tie tie tie tie tie tie tie tie tie")]
    docs = spark.createDataFrame([(i, t, 5, None, "x", "y", 3) for i, t in texts], SCHEMA)
    return docs.withColumns({c: F.lit(c) for c in ("_none", "_pii", "n_replaced", "a.b", "_NONE_")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 Line dedup ---


def lines_by_hand(docs):
    def key(line):
        bare = line.strip(WS)
        return re.sub("[A-Z]", lambda m: m[0].lower(), bare) if len(bare) >= 10 else None

    held = collections.defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or (k := key(x)) is None or len(held[k]) < 2 or i == min(held[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, rows):
    docs = hostile(spark)
    got = rows(line_dedup.dedup_all(docs, 3), "doc_id", "n_lines", "n_dropped", "text")
    assert got == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.dedup_all(empty(spark), 3).count() == 0
    for portions in (1, 3):
        assert rows(line_dedup.dedup_all(docs, portions=portions), "doc_id", "n_lines", "n_dropped", "text") == got
    assert line_dedup.dedup_all(docs).select("rest.`a.b`", "rest._none").first() == ("a.b", "_none")


def test_filters_answer_for_later_portions(spark, rows, monkeypatch):
    """The verdicts come through the filters: where they deny what they hold, lines of earlier portions are taken for new."""
    docs = hostile(spark)
    want = rows(line_dedup.dedup_all(docs, 3), "doc_id", "text")
    asked = []
    monkeypatch.setattr(line_dedup, "_per_shard", lambda change, *a, f=line_dedup._per_shard, **k: asked.append(change.__name__) or f(
        (lambda slots, n, live, keys: (None, 0, np.zeros(len(keys), bool))) if change.__name__ == "_probe" else change, *a, **k))
    assert rows(line_dedup.dedup_all(docs, 3), "doc_id", "text") != want and asked.count("_probe") == 2


def test_line_index_undoes_what_it_did(spark, rows):
    """Inserting in batches, deleting some and inserting again gives the tables of a fresh index."""
    text = lambda i: "\n".join(f"line number {(i * j) % 97}" for j in range(12))
    docs = spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id bigint, text string")
    index = line_dedup.insert(line_dedup.empty_index(spark, 4), docs.where("doc_id < 20"))
    index = line_dedup.insert(index, docs.where("doc_id >= 20"))
    fresh = line_dedup.insert(line_dedup.empty_index(spark, 4), docs)
    assert rows(index.counts) == rows(fresh.counts)
    smaller = line_dedup.delete(index, docs.where("doc_id % 3 = 0"))
    want = line_dedup.insert(line_dedup.empty_index(spark, 4), docs.where("doc_id % 3 <> 0"))
    assert rows(smaller.counts) == rows(want.counts)
    again = line_dedup.insert(smaller, docs.where("doc_id % 3 = 0"))
    assert rows(again.counts) == rows(fresh.counts)
    for i in (index, smaller, again):  # no live key is unknown to its filter, and the filters count the live keys
        held = {r.shard: np.frombuffer(r.slots, np.uint16).reshape(-1, 4) for r in i.filters.collect()}
        assert sum(r.n_keys for r in i.filters.collect()) == i.counts.count()
        for r in i.counts.collect():
            assert line_dedup.filter_has(held[r.shard], line_dedup.as_words([bytes(r.key)]))[0]
        assert sum(int((s > 0).sum()) for s in held.values()) == i.counts.count()
    assert rows(line_dedup.dedup(again, docs), "doc_id", "text") == [(r[0], r[3]) for r in lines_by_hand([(i, text(i)) for i in range(60)])]


def test_cuckoo_filter():
    keys = line_dedup.as_words([hashlib.md5(str(i).encode()).digest() for i in range(20_000)])
    slots = line_dedup.filled(10_000, keys[:10_000])
    assert line_dedup.filter_has(slots, keys[:10_000]).all()
    assert line_dedup.filter_has(slots, keys[10_000:]).mean() < 0.01
    line_dedup.filter_remove(slots, keys[:5000])
    assert line_dedup.filter_has(slots, keys[5000:10_000]).all()
    assert line_dedup.filter_has(slots, keys[:5000]).mean() < 0.01
    assert not line_dedup.filter_add(np.zeros((16, 4), np.uint16), keys[:100])
    assert line_dedup.filter_has(np.zeros((0, 4), np.uint16), keys[:3]).all()


# --- 2 Packing ---


def test_packing_fills_bins(spark):
    docs = hostile(spark)
    got = packing.pack_documents(docs, permitted=(64, 16, 128), group_rows=5).collect()
    size = {}
    for r in got:
        size.setdefault((r.group, r.bin), [r.bin_length, []])[1].append((r.bin_offset, r.length))
    for length, parts in size.values():
        total = sum(n for _, n in parts)
        assert total <= length == next(c for c in (16, 64, 128) if c >= total)
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    want = collections.Counter((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())
    pieces = collections.defaultdict(int)
    for r in got:
        pieces[r.doc_id] += r.length
    words = collections.defaultdict(int)
    for (i, n), k in want.items():
        words[i] += n * k
    assert pieces == words
    assert packing.pack_documents(empty(spark)).count() == 0
    assert packing.bin_text(docs.where("doc_id < 9"), packing.pack_documents(docs.where("doc_id < 9"), permitted=(64, 128))).count() > 0


def test_best_fit_takes_the_fullest_bin_and_the_cheapest_sizes():
    where, held = packing.best_fit([6, 5, 3, 2, 2], 8, (4, 8))
    assert held == [8, 8, 2] and where == [0, 1, 1, 0, 2]
    where, sizes = packing.pack([5, 3, 2], (4, 8), packing.Cost(attention=0))
    assert sorted(sizes) == [4, 8] and packing.pack([4, 4], (4, 8), packing.Cost(attention=1))[1] == [4, 4]


def partitions(n):
    if not n:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, [n - 1]]
        for k in range(len(rest)):
            yield [*rest[:k], [*rest[k], n - 1], *rest[k + 1:]]


def test_packing_is_near_the_best_of_all_packings():
    rng, permitted, ratios = np.random.default_rng(11), (4, 8, 16), []
    for attention in (0.0, 0.05, 0.5):
        cost = packing.Cost(attention)
        for _ in range(60):
            lengths = sorted(rng.integers(0, 17, int(rng.integers(1, 8))).tolist(), reverse=True)
            where, sizes = packing.pack(lengths, permitted, cost)
            held = [sum(n for n, k in zip(lengths, where) if k == b) for b in range(len(sizes))]
            assert all(n <= size == next(c for c in permitted if c >= n) for n, size in zip(held, sizes))
            best = min(sum(cost(next(c for c in permitted if c >= t)) for t in totals)
                       for p in partitions(len(lengths)) if max(totals := [sum(lengths[i] for i in part) for part in p]) <= 16)
            ratios.append(sum(map(cost, sizes)) / best)
            fixed = min(sum(cost(next(c for c in permitted if c >= n)) for n in packing.best_fit(lengths, o, permitted)[1]) for o in permitted)
            assert sum(map(cost, sizes)) <= fixed
    assert min(ratios) >= 1 - 1e-12 and np.mean(ratios) < 1.02 and max(ratios) < 1.35


def test_lengths_are_chosen_for_each_bin():
    # Two pieces of 9 want a bin of 16 with small ones, the pieces of 4 bins of their own.
    assert packing.cheapest_opening([9, 7, 4, 4], 0, (4, 8, 16), packing.Cost(0)) == 16
    assert packing.cheapest_opening([4, 4, 4, 3], 0, (4, 8, 16), packing.Cost(0.5)) == 4
    assert sorted(packing.best_fit([9, 7, 4, 4], None, (4, 8, 16), packing.Cost(0.5))[1]) == [4, 4, 16]


def test_few_very_long_documents_are_many_groups(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(600_000).alias("n"))
    got = packing.pack_documents(docs, (512, 1024), F.col("n"), group_rows=500)
    assert got.selectExpr("sum(length)").first()[0] == 8 * 600_000
    groups = got.groupBy("group").count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 700
    same = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"))
    assert max(r["count"] for r in packing.pack_documents(same, group_rows=500).groupBy("group").count().collect()) < 700


# --- 3 Fingerprints ---


def test_prefix_hash_answers_spans():
    a, b = fingerprints.PrefixHash("abracadabra, said é漢"), fingerprints.PrefixHash("xxcadabra, SAID")
    assert fingerprints.same_span(a, 0, a, 7, 4) and not fingerprints.same_span(a, 0, a, 6, 4)
    assert fingerprints.common_extension(a, 4, b, 2) == len("cadabra, ") and fingerprints.common_extension(a, 0, b, 0) == 0
    cut = fingerprints.PrefixHash("abracadXY", a, 7)
    assert [p.tolist() for p in cut.prefix] == [p.tolist() for p in fingerprints.PrefixHash("abracadXY").prefix]


def test_fingerprints(spark, rows):
    docs = hostile(spark)
    got = fingerprints.fingerprints(docs, 4).collect()
    known = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None))
    alone = [(None, r.text or "") for r in docs.collect() if r.doc_id is None]
    pairs = [(i, t, known[(k + 1) % len(known)][1]) for k, (i, t) in enumerate(known)] + [(i, t, "") for i, t in alone]
    want = []
    for i, t, after in pairs:
        e = fingerprints.edited(t, after)
        a, b, c = (fingerprints.Finger(x) for x in (t, e, after))
        want.append((i, len(t), e, a.text, b.text, fingerprints.likeness(a.sketch, b.sketch), fingerprints.likeness(a.sketch, c.sketch),
                     len(os.path.commonprefix([t, e]))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprints.fingerprints(empty(spark), 4).count() == 0
    one = docs.where("doc_id = 6")
    assert fingerprints.fingerprints(one, 4).first().near_next == 1.0


def test_fingerprints_by_hand():
    """Fingerprint and likeness restated with big numbers, span by span."""

    def span_hash(text):
        parts = [sum((ord(c) + 1) * pow(base, i, prime) for i, c in enumerate(text)) % prime for base, prime in zip(fingerprints.BASES, fingerprints.PRIMES)]
        return parts[0] << 31 | parts[1]

    def mix(h):
        m = h * 0x9E3779B97F4A7C15 % 2 ** 64
        return ((m ^ m >> 29) * 0xBF58476D1CE4E5B9 % 2 ** 64) >> 32

    def sketch(text):
        w = max(1, min(fingerprints.SPAN, len(text)))
        return sorted({mix(span_hash(text[i:i + w])) for i in range(len(text) - w + 1)})[:fingerprints.SKETCH] if text else []

    def like(a, b):
        both = sorted({*a, *b})[:max(len(a), len(b))]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    rng, texts = np.random.default_rng(8), ["", "a", "é漢😀" * 7, "tie " * 60]
    texts += ["".join(rng.choice(list("abc é漢😀\n"), int(rng.integers(1, 400)))) for _ in range(25)]
    for own, following in zip(texts, texts[1:] + texts[:1]):
        k = len(own) // 4
        changed = own[:len(own) - k] + following[:k]
        a, b = fingerprints.Finger(own), fingerprints.Finger(following)
        got = fingerprints.compare(1, own, a, following, b)
        told = lambda t: f"{len(t):x}.{span_hash(t) if t else 0:016x}." + "".join(f"{x:08x}" for x in sketch(t))
        assert got == (1, len(own), changed, told(own), told(changed), like(sketch(own), sketch(changed)), like(sketch(own), sketch(following)),
                       len(os.path.commonprefix([own, changed])))


def test_likeness_follows_the_share_of_common_spans():
    rng = np.random.default_rng(9)
    for cut in (0, 200, 1000, 2500, 4000):
        a = "".join(rng.choice(list("abcdefgh "), 4000))
        b = a[:4000 - cut] + "".join(rng.choice(list("abcdefgh "), cut))
        x, y = ({t[i:i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)} for t in (a, b))
        near = fingerprints.likeness(fingerprints.Finger(a).sketch, fingerprints.Finger(b).sketch)
        assert abs(near - len(x & y) / len(x | y)) < 0.2


def test_powers_keep_one_array_for_each_base():
    fingerprints._POWERS.clear()
    for n in (10, 3000, 50, 100_000):
        fingerprints.PrefixHash("x" * n).span(0, n)
    assert len(fingerprints._POWERS) <= 4
    base, prime = fingerprints.BASES[0], fingerprints.PRIMES[0]
    assert fingerprints._powers(base, prime, 5000)[4321] == pow(base, 4321, prime)


# --- 4 BPE ---


TOKENIZER = "byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("words", [0, 50])
def test_bpe_agrees_with_the_library(spark, words):
    path = public_tokenizers.path(TOKENIZER)
    docs = hostile(spark).union(hostile(spark).limit(1).withColumn("text", F.lit("a <|endoftext|> b<|endoftext|>　​ 12'll I'LL\r\n\n x")))
    encoded = bpe.encode_documents(docs, path, words)
    got = sorted(map(tuple, bpe.decode_documents(encoded, path).collect()), key=repr)
    t = tokenizers.Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, bytearray(np.array(ids, "<u4").tobytes()), len(ids), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(empty(spark), path).count() == 0


def test_transducer_is_minimal():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops"})
    a = bpe.compile_words(words)
    assert len(a["finals"]) == 7 and len(a["letters"]) == 8  # t-ap/op and st-op share everything behind


# --- 5 Chat ---


def test_chat_round_trip(spark):
    evil = "\\ </s>[INST] [/INST]<<SYS>> \\[INST] <role> <text> </role>\\\\<reply>"
    talk = [(1, 0, "system", evil), (1, 1, "user", ""), (1, 2, "assistant", evil), (2, 0, "assistant", "first"), (2, 1, "tool <text> ", evil),
            (3, None, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 1, "user", LONG), (None, 2, "assistant", "<"), (4, 1, "assistant", ">"), (4, 0, "user", "[")]
    df = spark.createDataFrame([(*t, "x") for t in talk], "conv_id bigint, turn bigint, role string, text string, segment string")
    segments = chat.format_conversations(df, parts=3)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in talk:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        told = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: True}
    texts = segments.where("segment = 1").collect()
    assert all(c not in r.text for r in texts for c in chat.INSTRUCT.all_controls())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- 6 Spans ---


def test_spans(spark):
    docs = hostile(spark)
    got = {(r.doc_id, i): r for i, r in enumerate(spans.dedup_spans(docs).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in got.items()}
    assert by[11].n_removed == 0 and PASSAGE in by[11].text
    assert by[12].text == "Others wrote, So it goes."
    assert by[13].n_removed == len(LONG) and by[6].n_removed == 0 and by[7].text == ""
    assert by[3].text is None and by[4].text == "" and by[10].n_removed == 0
    assert by[5].text == "Long sentences go on and on. "  # every later sentence stands in a run that occurred before
    assert by[14].n_removed == 0  # capitals start sentences of their own
    assert len(got) == docs.count() and spans.dedup_spans(empty(spark)).count() == 0
    for r in by.values():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


@pytest.mark.parametrize("passage", [
    " ".join(f"WORD{i}" for i in range(60)), " ".join(f"Anna Berg{i}, Carl Dorn{i}," for i in range(20)),
    "\n".join(f"line {i}" for i in range(40))], ids=["capitals", "names", "short lines"])
def test_spans_of_short_sentences(spark, passage):
    docs = spark.createDataFrame([(1, "before it\n" + passage + "\nbehind it"), (2, "elsewhere\n" + passage + "\nan end")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in spans.dedup_spans(docs).collect()}
    assert got == {1: docs.first().text, 2: "elsewhere\nan end"}


@pytest.mark.parametrize("sizes", [(15, 12, 14, 13, 10), (30, 21), (30, 5, 1, 1, 20), (26, 20, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 20, 26)])
def test_spans_cover_a_passage_to_its_ends(spark, sizes):
    passage = " ".join(" ".join(f"p{k}q{j}" for j in range(n)) + "." for k, n in enumerate(sizes))
    docs = spark.createDataFrame([(i, f"{a} stands before it.\n{passage}\n{b} comes behind it.") for i, a, b in ((1, "one", "two"), (2, "other", "more"))],
                                 "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in spans.dedup_spans(docs).collect()}[2] == "other stands before it.\nmore comes behind it."


def test_shortest_runs_cover_what_all_runs_cover():
    sizes = np.random.default_rng(5).choice([1, 2, 3, 8, 11, 13, 24, 26], (400, 9)).tolist()
    for i, row in enumerate(sizes):
        text = " ".join(" ".join(f"w{i}" for _ in range(n)) + "." for n in row)
        cuts, found = spans.runs(text)
        assert len(cuts) == 9 and all(sum(row[a:a + n]) >= (12 if n > 2 else 25) for a, n, _ in found)
        for a in range(9):
            for b in range(a + 1, 10):
                inside = [{*range(x, x + n)} for x, n, _ in found if a <= x and x + n <= b]
                longer = [{*range(x, y)} for x in range(a, b) for y in range(x + 1, b + 1) if sum(row[x:y]) >= (12 if y - x > 2 else 25)]
                assert set().union(*inside) == set().union(*longer)
                assert sum(row[a:b]) <= 50 or set().union(*inside) == {*range(a, b)}


# --- 7 Quality ---


def repeats_by_hand(words):
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_quality(spark):
    docs = hostile(spark)
    got = quality.measure(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for r in docs.where("doc_id is not null").collect():
        t, x = r.text or "", by[r.doc_id]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [line for line in t.split("\n") if line.strip(WS)]
        assert (x.n_words, x.word_chars, x.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert x.n_dup_lines == len(lines) - len(set(lines)) and x.n_repeat_words == repeats_by_hand(words)
        assert x.base_failed == (len(words) < 20 or 100 * x.n_repeat_words > 30 * len(words))
        assert not (x.base_failed and x.kept)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in got if r.kept}
    assert quality.measure(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).columns == empty(spark).columns and quality.keep_good(docs).columns == docs.columns


def test_order_of_rules_does_not_change_verdicts():
    texts = [quality.Text(t) for t in (PASSAGE, "a b", "# * " * 40, LONG, None, "One ONE two " * 30)]
    for order in (quality.RULES, quality.RULES[::-1]):
        assert [quality.judge(t, order) is None for t in texts] == [True, False, False, False, False, False]
    worth = quality.rejections_per_second(quality.RULES, [PASSAGE, "a b"])
    assert worth["base_failed"] > 0 and worth["letters"] == 0


# --- 8 PII ---


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    values = {"card": "4111111111111111", "card2": "5105-1051-0510-5100", "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789",
              "phone": "+1 (136) 555-7479", "ip": "239.98.141.179", "date": "1984-02-29", "date2": "31/12/1999", "mail": "some.one@mail4.example.com"}
    whole = ", ".join(values.values())
    docs = [(1, whole, 1), (2, f"x{whole[:0]} {values['card']}%%% and {values['phone']}.", 1), (3, "4111111111111112 999.1.1.1 2023-02-30 000-12-3456", 1),
            (4, None, None), (5, "", 1), (6, "plain words only", 1), (None, values["ip"], 1), (7, "9" * 50_000 + "@" * 1000, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_replaced int").withColumnRenamed("n_replaced", "kept")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    new = dict(zip(values, got[1].text.split(", ")))
    assert got[1].n_replaced == len(values) and all(new[k] != v for k, v in values.items())
    for k in set(values) - {"mail"}:
        assert re.sub(r"\d", "9", new[k]) == re.sub(r"\d", "9", values[k]) or k == "ip"
    assert luhn(new["card"]) and luhn(re.sub(r"\D", "", new["card2"]))
    bare = new["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert new["card"] in got[2].text and new["phone"] + "." in got[2].text and got[None].text == new["ip"]
    assert got[3].text == docs[2][1] and got[4].text is None and got[6].text == docs[5][1] and got[7].n_replaced == 0
    assert {r.text for r in pii.pseudonymise(df.where("doc_id = 1"), "other").collect()} != {got[1].text}
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_secrets_and_dates_in_other_forms(spark):
    secret = "ab12" + "9c3de0f4" * 4
    forms = [("2024-03-05", "%Y-%m-%d"), ("2024/03/05", "%Y/%m/%d"), ("05-03-2024", "%d-%m-%Y"), ("03/05/2024", "%m/%d/%Y"), ("March 5, 2024", "%B %d, %Y"),
             ("5 MAR 2024", "%d %b %Y"), ("5th of march 2024", None)]
    texts = [secret, secret.upper(), secret[:32].upper(), *[f for f, _ in forms], "31-02-2024", "February 30, 2024"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id int, text string")
    got = [r.text[2:-2] for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert got[0] != secret and got[1] == got[0].upper() and got[2] != texts[2] and re.fullmatch("[0-9A-F]{32}", got[2])
    days = {datetime.strptime(g, f) for g, (_, f) in zip(got[3:9], forms)}
    assert len(days) == 1 and days != {datetime(2024, 3, 5)}
    day = days.pop()
    assert re.fullmatch(rf"{day.day}(st|nd|rd|th) of {day:%B} {day:%Y}".lower(), got[9]) and got[10:] == texts[10:]


def test_feistel_is_a_permutation(spark):
    df = spark.range(75 * 48).select(pii.feistel(F.floor(F.col("id") / 48), F.col("id") % 48, F.lit(75), F.lit(48), "t", "k").alias("s"))
    assert df.select("s.x", "s.y").distinct().count() == 75 * 48
    assert df.where("s.x < 0 or s.x >= 75 or s.y < 0 or s.y >= 48").count() == 0


def feistel_by_hand(x, y, size_x, size_y, tweak, key):
    for i in range(pii.ROUNDS):
        drawn = int(hashlib.sha256(f"{key}|{tweak}|{i}|{x if i % 2 else y}".encode()).hexdigest()[:14], 16)
        x, y = (x, (y + drawn) % size_y) if i % 2 else ((x + drawn) % size_x, y)
    return x, y


def digits_by_hand(d, kind, key):
    left = len(d) // 2
    x, y = feistel_by_hand(int(d[:left]), int(d[left:]), 10 ** left, 10 ** (len(d) - left), f"{kind}{len(d)}", key)
    return f"{x:0{left}d}{y:0{len(d) - left}d}"


def shaped(old, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in old)


def test_pseudonyms_restated(spark):
    """Each kind of value against its permutation written in plain Python."""
    key = "a key"
    cards = [c[:-1] + next(str(k) for k in range(10) if luhn(c[:-1] + str(k))) for c in ("4111111111111110", "5500005555555550", "378282246310000", "6011000990139420", "4222222222220")]
    want = {}
    for c in cards:
        body = digits_by_hand(c[:-1], "card", key)
        want[c] = body + next(str(k) for k in range(10) if luhn(body + str(k)))
    for ip in ("10.20.30.40", "8.8.4.4", "255.0.1.99"):
        a, b, c, d = map(int, ip.split("."))
        x, y = feistel_by_hand(a * 256 + b, c * 256 + d, 65536, 65536, "ipv4", key)
        want[ip] = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for ssn in ("123-45-6789", "700-01-0001", "001-99-9999"):
        a, g, n = map(int, ssn.split("-"))
        x, y = feistel_by_hand((a - 2 if a > 666 else a - 1) * 99 + g - 1, n - 1, 898 * 99, 9999, "ssn", key)
        r = x // 99
        want[ssn] = f"{r + 2 if r >= 665 else r + 1:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    for day in ("1999-12-31", "2024-02-29", "1900-01-01", "2000-03-01"):
        d = datetime.strptime(day, "%Y-%m-%d").date()
        century = d.year // 100
        first = d.replace(year=century * 100, month=1, day=1)
        sizes = (75, 487) if century % 4 == 0 else (92, 397)
        x, y = feistel_by_hand(*divmod((d - first).days, sizes[1]), *sizes, f"date{century}", key)
        want[day] = datetime.fromordinal(first.toordinal() + x * sizes[1] + y).strftime("%Y-%m-%d")
    iban = "DE89370400440532013000"
    account = digits_by_hand(iban[4:], "iban", key)
    check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
    want[iban] = f"DE{check:02d}{account}"
    want["a.b@example.com"] = "u" + hashlib.sha256(f"{key}|email|a.b@example.com".encode()).hexdigest()[:12] + "@d" + hashlib.sha256(f"{key}|domain|example.com".encode()).hexdigest()[:8] + ".example"
    docs = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(want)], "doc_id int, text string")
    got = [r.text for r in pii.pseudonymise(docs, key).orderBy("doc_id").collect()]
    assert got == [f"see {w} there" for w in want.values()]
    phone = "(555) 123-4567"
    new = pii.pseudonymise(spark.createDataFrame([(1, phone)], "doc_id int, text string"), key).first().text
    assert new in (phone, shaped(phone, digits_by_hand("5551234567", "phone", key))) and new != phone


# --- 9 Pages ---


def page(body, extra=""):
    return f"<html><head><title>t</title></head><body><nav><a>Home</a></nav>{body}{extra}<footer>foot</footer></body></html>"


def test_pages(spark):
    html = {1: page("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p><b>five</b> six</article>", "<div class='cookie-notice'>no</div>"),
            2: page("<main><p>text</p><div id='comments'><p>reader</p></div><form>f</form></main>"), 3: None, 4: "", 5: "no markup <!-- <script> --> here",
            6: page("<div>only a div</div>"), 7: "<p" * 3000, 8: "<div>" * 3000 + "deep" + "</p>" * 3000, 9: page("<article>" + "word " * 200_000 + "</article>")}
    # A box that every page of a host repeats, under a name that says nothing.
    boxes = {100 + i: page("<div class='k'><p>" + " ".join(f"w{i}x{j}" for j in range(30)) + "</p>" * (i % 3 + 1) + "<p>more</p>" * (i % 4)
                           + "</div><div class='q'><p>The same words on each page</p></div>") for i in range(12)}
    data = [(i, f"https://Site{i}.example.com/x", h, "c", "d") for i, h in html.items()] + [(i, "http://u@host.org:80/p", h, "c", "d") for i, h in boxes.items()]
    data += [(None, None, "<p>no address", "c", "d"), (2, None, html[2], "c", "d")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string, host string, noise string")
    out = site_tree.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(data) and all(r.n_chars == len(r.text) for r in out)
    assert got[1] == "A & B\n\none two three four\n\nfive six" and got[2] == "text" and got[3] == got[4] == ""
    assert got[5] == "no markup here" and got[6] == "only a div" and got[8] == "deep" and got[None] == "no address" and len(got[9]) == 999_999
    for i in boxes:
        assert f"w{i - 100}x0" in got[i] and "same words" not in got[i]
    assert site_tree.extract(df.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {i} says what the article has to say.</p>" for i in range(6))
SAID = "\n\n".join(f"Paragraph {i} says what the article has to say." for i in range(6))


@pytest.mark.parametrize("html, text", [
    (f'<article class="post has-comments">{BODY}</article>', SAID), (f'<div id="page" class="no-sidebar">{BODY}</div>', SAID),
    (f'<div class="content-sidebar-wrap"><main>{BODY}</main><div class="sidebar">aside</div></div>', SAID),
    (f'<div class="long-form">{BODY}</div>', SAID), (f'<form action="/x"><div>{BODY}</div></form>', SAID),
    (f'<form action="/x"><main>{BODY}</main><form>search</form></form>', SAID),
    (f'<article><div class="entry-header"><h1>Head</h1></div><div class="form-body">{BODY}</div></article>', "Head\n\n" + SAID),
    (f'<article><h1>Head</h1><p>Short.</p><section class="comments">{BODY}</section></article>', "Head\n\nShort."),
    (f'<article class="card"><p>A card.</p></article><div>{BODY}</div>', "A card.\n\n" + SAID),
    (f'<article><h1>Head</h1><p>Short.</p></article><div>{BODY}</div>', "Head\n\nShort."),
    (f'<div class="wrap js-menu">{BODY}</div><div class="share">Share it</div><form>Name <input></form>', SAID),
    ('<div class="comments">Only readers speak here.</div>', "Only readers speak here."), ("<nav>Home</nav>", "")])
def test_names_do_not_take_the_article(html, text):
    assert "\n\n".join(site_tree.Extractor().blocks("h", f"<html><body><nav>Home</nav>{html}<footer>foot</footer></body></html>", set())) == text


def test_tree_decides_where_names_say_nothing(spark):
    rows = []
    for host, n in [("a.com", 12), ("b.com", 12), ("c.com", 9), ("small.com", 2)]:
        for i in range(n):
            own = "".join(f"<p>{host} {i} tells {k} things of its own.</p>" for k in range(1 + i % 4))
            rows.append((len(rows), f"http://{host}/{i}", page(f"<div class='k'>{own}</div>", f"<div class='q'><p>Read {host} daily.</p></div>")))
    # Copies of one page on one host: all of it looks like its frame, and stays.
    rows += [(1000 + i, f"http://copies.com/{i}", page(f"<div class='z'><h1>Head</h1><div>{BODY}</div></div>")) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    on = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    off = {r.page_id: r.text for r in site_tree.extract(pages, threshold=0.0).collect()}
    for i, url, _ in rows:
        if i >= 1000:
            assert on[i] == off[i] == "Head\n\n" + SAID
        else:
            assert "daily" in off[i] and "daily" not in on[i] and on[i] == off[i].rsplit("\n\n", 1)[0], url


def test_importance_by_hand(spark):
    rng, rows = np.random.default_rng(3), []
    for host in ("x.org", "y.org", "z.org", "w.org"):
        for i in range(int(rng.integers(1, 9))):
            parts = "".join(rng.choice([f"<p>{c}</p>", f"<b>{c}</b>", f"<div>{c}<br></div>", f"<i>{c}</i>"], 1)[0] for c in rng.choice(list("abc"), int(rng.integers(0, 4))))
            rows.append((host, parts))
    seen = collections.defaultdict(lambda: [0, collections.Counter(), collections.Counter()])
    for host, parts in rows:
        nodes = collections.defaultdict(lambda: [set(), set()])
        found = re.findall(r"<(p|b|i|div)>(.)", parts)
        nodes["div"][0].add(",".join(t for t, _ in found))
        nodes["div"][1] |= {a for _, a in found}
        for t, a in found:
            if t in ("p", "div"):
                nodes[f"div/{t}"][0].add("br" if t == "div" else "")
                nodes[f"div/{t}"][1].add(a)
        for path, (looks, says) in nodes.items():
            entry = seen[host, path]
            entry[0] += 1
            entry[1].update(looks)
            entry[2].update(says)

    def own(m, looks, says):
        if m == 1:
            return 1.0

        def spread(c):
            total = sum(c.values())
            return -sum(n / total * math.log(n / total, m) for n in c.values())

        rest = site_tree.DECAY ** len(looks)
        told = 1 - sum(n * math.log(n) for n in says.values()) / sum(says.values()) / math.log(m) if says else 0.0
        return (1 - rest) * min(1.0, spread(looks)) + rest * told

    alone = {k: (m, own(m, looks, says)) for k, (m, looks, says) in seen.items()}
    want = []
    for (host, path), (m, x) in alone.items():
        others = [v for (_, p), v in alone.items() if p == path]
        prior = sum(a * b for a, b in others) / sum(a for a, _ in others) if len(others) >= site_tree.PRIOR_HOSTS else None
        want.append((host, m, round(x if prior is None else (x * m + prior * site_tree.PRIOR_PAGES) / (m + site_tree.PRIOR_PAGES), 9)))
    pages = spark.createDataFrame([(f"http://{h}/", f"<div class=a>{x}</div>") for h, x in rows], "url string, html string")
    got = [(r.host, r.n_pages, round(r.importance, 9)) for r in site_tree.site_trees(pages).collect()]
    assert sorted(got) == sorted(want)


# --- 10 Jaccard join ---


def components_by_hand(docs):
    sets = []
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if label[a] != label[b] and x and 100 * len(x & y) >= 80 * len(x | y):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if v == old else v for v in label]
                    changed = True
    least = {}
    for (i, _), v in zip(sets, label):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    return sorted(((i, len(s), least.get(v)) for (i, s), v in zip(sets, label)), key=repr)


def test_jaccard_on_hostile_rows(spark, rows):
    docs = hostile(spark)
    got = rows(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == components_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_jaccard_finds_every_component(spark, rows):
    """Chains of edits, a passage in many documents, a large group of near copies, short texts: all as by comparing all pairs."""
    import random

    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(60):
        words = list(base)
        words[k % 120] = "edit"
        texts.append(" ".join(words))
    for _ in range(60):
        n = rng.choice((2, 6, 10, 60))
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(n // 2)] + passage + [rng.choice(vocabulary) for _ in range(n)]))
    texts += ["a b", "A  b", "a b c", "a b c d e", "a b c d e f"] * 2
    docs = [(3 * i + 1, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(jaccard_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == components_by_hand(docs)


def test_jaccard_links_sets_that_a_row_without_id_has(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, far = " ".join(words), " ".join(words[:58] + ["other", "end"]), " ".join(["new"] + words[:56] + ["other", "end"])
    docs = spark.createDataFrame([(5, text), (None, text), (9, near), (12, far), (None, far.upper()), (20, "of its own")], "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id, r.n_copies) for r in jaccard_join.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, 5, 2), (None, 5, 2), (9, 5, 1), (12, 5, 2), (None, 5, 2), (20, 20, 1)], key=repr)


def test_window_need_is_a_lower_bound():
    """Random similar sets share at least as many window tokens as ``window_need`` promises."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(10_000, n, replace=False)
        b = np.union1d(rng.choice(a, int(rng.integers(max(1, int(0.8 * n)), n + 1)), replace=False), rng.choice(10_000, int(rng.integers(0, n // 5 + 1))))
        order = rng.permutation(10_000)
        a, b = (x[np.argsort(order[x])] for x in (np.unique(a), b))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            wa, wb = (x[:int(jaccard_join.window_size(np.int64(len(x))))] for x in (a, b))
            shared = len(np.intersect1d(wa, wb))
            assert shared >= jaccard_join.window_need(len(a)) and shared >= jaccard_join.window_need(len(b))
