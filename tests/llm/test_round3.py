"""Operators 11 to 13 against plain Python versions."""

import functools
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sheaf.llm import mixing, periodic, queries, repair

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 70}" for i in range(30_000))
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (1, "other words", "x", 2), (None, "no id", None, 3), (None, None, None, None), (2, "", "", 4),
            (3, long, "x", 5), (4, " \t\n ", "y", 6), (5, "z " * 400, "é", 7), (6, "z " * 400, "é", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size bigint")
    for name in ("row", "_source", "_bucket", "target", "copies", "a.b", "place"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


# --- 11: runs of repeated words


def runs_by_hand(w, min_words=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(min_words, exponent * q) and not any(all(w[k] == w[k - p] for k in range(i - q + p, j)) for p in range(1, q)):
                out.append((i - q, j - i + q, q))
            i = j + 1
    return sorted(out)


def text_with_repeats(rng):
    w, letters = [], rng.choice([1, 2, 3, 8])
    for _ in range(rng.randint(0, 6)):
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        w += (part * rng.randint(1, 10))[:rng.randint(1, 90)] if rng.random() < 0.7 else part
    return w


def test_catcher_finds_all_runs_in_any_portions():
    rng = random.Random(5)
    texts = [text_with_repeats(rng) for _ in range(400)] + [[bin(i).count("1") % 2 for i in range(300)], [0] * 200, [0] * 90 + [1] + [0] * 90]
    for w in texts:
        for min_words, exponent in ((24, 3), (2, 2), (30, 3), (50, 4)):
            catcher, step = periodic.SquareCatcher(min_words, exponent), rng.choice([1, 5, 37, 1000])
            for i in range(0, len(w), step):
                catcher.append(w[i:i + step])
                if rng.random() < 0.03:
                    assert catcher.runs() == runs_by_hand(w[:i + step], min_words, exponent)
            assert catcher.runs() == runs_by_hand(w, min_words, exponent)


def test_names_are_dropped_and_runs_still_found(monkeypatch):
    monkeypatch.setattr(periodic, "FEW_NAMES", 8)
    rng = random.Random(6)
    for _ in range(60):
        w = [x for _ in range(4) for x in text_with_repeats(rng)]
        catcher = periodic.SquareCatcher()
        for i in range(0, len(w), 3):
            catcher.append(w[i:i + 3])
        assert catcher.runs() == runs_by_hand(w)
        assert len(w) < 300 or len(catcher.levels[0].names) < len(w)


def test_long_texts_take_little_time():
    assert periodic.find_runs([1] * 300_000) == [(0, 300_000, 1)]
    assert periodic.find_runs(list(range(700)) * 300) == [(0, 210_000, 700)]
    assert periodic.find_runs([1] * 50_000 + [2] + [1] * 50_000) == [(0, 50_000, 1), (50_001, 50_000, 1)]


def test_square_catching_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, seen = {r.doc_id: r for r in queries.op11_square_catching(spark, SF).collect()}, 0
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue  # the plain version is quadratic
        runs = runs_by_hand(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in runs)]
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_square_catching_on_hostile_rows(spark, hostile):
    got = {(r.doc_id, r.text): [tuple(x) for x in r.runs] for r in periodic.collapse_runs(hostile).collect()}
    assert got[3, " ".join(f"w{i}" for i in range(70))] == [(0, 30_000, 70)] and got[5, "z"] == [(0, 400, 1)] == got[6, "z"]
    assert got[None, ""] == [] and got[4, ""] == [] and got[None, "no id"] == []
    assert periodic.collapse_runs(hostile).count() == hostile.count() and periodic.collapse_runs(hostile.limit(0)).count() == 0


# --- 12: structure repair


def best_repair(codes):
    """The least (cost, audit) by trying everything."""

    @functools.cache
    def go(i, state, inserted):
        options = [(0, "")] if i == len(codes) and state in (0, 3) else []
        moves = [(1, 2)] if state != 2 else [(2, 3)]  # (role, state behind it)
        if inserted < 3:
            options += [(c + 5, "I" + a) for _, to in moves for c, a in [go(i, to, inserted + 1)]]
        if i < len(codes):
            role, extra = codes[i] & 3, 5 if codes[i] & 16 else 0
            options += [(c + 2, "D" + a) for c, a in [go(i + 1, state, 0)]]
            if not codes[i] & 12:
                for want, to in moves + ([(0, 1)] if state == 0 else []):
                    if role == want or want:
                        c, a = go(i + 1, to, 0)
                        options.append((c + extra + (role != want), ("K" if role == want else "R") + a))
        return min(options, default=(10 ** 9, ""))

    return go(0, 0, 0)


def some_codes(rng, n):
    return [rng.choice([0, 1, 2, 1, 2, 3]) + rng.choice([0, 0, 0, 4, 8, 16]) for _ in range(n)]


def test_alignment_is_cheapest_and_least():
    rng = random.Random(7)
    for _ in range(3000):
        codes = some_codes(rng, rng.randint(0, 9))
        assert repair.align(codes, repair.START)[:2] == best_repair(tuple(codes)), codes


def report_by_hand(rows, out):
    """The report of one conversation's rows, in order."""
    seen, codes, count = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare, code = text.strip(" \t\n\x0b\x0c\r"), 0
        if not bare:
            code, k = 4, 0
        elif (role, text) in seen:
            code, k = 8, 1
        elif bare[-1] not in ".!?":
            code, k = 16, 2
        if code:
            count[k] += 1
        seen.add((role, text))
        codes.append("sua".find((role or "x")[0]) % 4 + code)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(((a or "x")[0] + (b or "x")[0]) not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:]))
    cost, audit = best_repair(tuple(codes))
    left, told = list(rows), []
    for e in audit:
        row = left.pop(0) if e != "I" else (None, None, "")
        if e != "D":
            told.append([row[1] if e == "K" else None, row[2]])
    start = len(told) % 2
    for i, t in enumerate(told):
        t[0] = t[0] or ("system" if i < start else ("user", "assistant")[(i - start) % 2])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in told))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
    return gaps, *count, illegal, cost, audit, digest


FIELDS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def test_structure_repair_query(spark):
    told = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows = told.setdefault(r.conv_id, [])
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", r.text) if harm == 2 else r.text
        rows += [(r.turn, "user" if harm == 4 else r.role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries.op12_structure_repair(spark, SF).collect()}
    assert got == {c: report_by_hand(sorted(rows, key=order), None) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
                   for c, rows in told.items()}


@pytest.mark.parametrize("segment", [1, 4, 64])
def test_repair_in_segments(spark, segment):
    rng = random.Random(8)
    texts = ["Yes.", "No", "", " ", "Why?", "Well then!", "a b", "A.", "B.", "C.", "D.", "E."]
    rows = []
    for conv in (None, *range(12)):
        for i in range(rng.randint(1, 14)):
            turn = rng.choice([i, i, i, None, i + 1])
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "u"]), rng.choice([*texts, None]), "x"))
    rows += [(99, 0, "user", "Hello.", "x")] * 3
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string")
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn, role or "", text or ""))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.report(table, segment).collect()}
    assert got == {c: report_by_hand(sorted(r, key=order), None) for c, r in want.items()}
    turns = {}
    for r in repair.repair(table, segment).orderBy("conv_id", "seg", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: x[-1] for c, x in got.items()}
    assert repair.report(table.limit(0)).count() == 0 and repair.repair(table.limit(0)).count() == 0


# --- 13: mixing


def targets_by_hand(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2):
    """Excess over the caps is shared out again until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        whole, given = sum(weight[s] for s in free), left
        for s in sorted(free, key=names.index):
            target[s] += given * weight[s] / whole
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def check_mix(rows):
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    target = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1e-6 * sizes[s]
    return taken


def test_mix_query(spark):
    rows = queries.op13_systematic_mix(spark, SF).collect()
    check_mix(rows)
    again = queries.op13_systematic_mix(spark, SF).repartition(3).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == words


def test_mix_of_hot_and_tiny_sources_in_buckets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), "hot" if i % 2 else f"s{i % 40}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = mixing.sized(docs).drop("row")
    out = mixing.mix(sizes, mixing.source_targets(sizes), bucket_rows=100)
    got = out.collect()
    hot = [r for r in got if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) < 0.01 * hot[0].target + 60
    assert len(got) == 6000 and all(r.copies <= 2 for r in got)
    one = [r for r in mixing.mix(sizes, mixing.source_targets(sizes)).collect()]
    check_mix(one)
    # The sum runs on from bucket to bucket: the copies of a source are its expected ones, to one.
    assert abs(sum(r.copies for r in hot if r.size) - sum(1 for r in hot if r.size) * hot[0].target / hot[0].source_size) <= 1


@pytest.mark.parametrize("weights, share, most", [((1.0,), 1.0, 1), ((5.0, 1.0), 0.5, 3), ((1.0, 1.0, 8.0), 2.0, 2)])
def test_targets(spark, weights, share, most):
    sizes = {"a": 10, "b": 1000, "c": 50, "é": 7, "z": 0, None: 300, "": 20}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows, weights, share, most).collect()}
    want = targets_by_hand(sizes, weights, share, most)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mix_on_hostile_rows(spark, hostile):
    rows = mixing.mix_sizes(hostile).collect()
    assert len(rows) == hostile.count()
    check_mix(rows)
    drawn = mixing.draw(hostile)
    assert drawn.columns == hostile.columns
    kept = {(r.doc_id, r.text) for r in hostile.collect()}
    got = drawn.collect()
    assert len(got) == sum(r.copies for r in rows) and all((r.doc_id, r.text) in kept and r["a.b"] == "a.b" for r in got)
    for part in (hostile.limit(0), hostile.where("doc_id = 4 or doc_id = 2")):
        assert mixing.draw(part).count() == 0 and all(r.target == 0 for r in mixing.mix_sizes(part).collect())
