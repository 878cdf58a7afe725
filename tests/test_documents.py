"""Threads, revisions, tables, styles, HTML and packages on small inputs worked out by hand."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.functions import fields, maps, text, units
from sheaf.operators import diff, grids, html, references, revisions, search, styles, threads
from sheaf.sources import docx, lake, packages


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# --- comments

def test_thread_with_a_reaction_and_a_reply(spark, rows):
    c = spark.createDataFrame([
        (1, 0, "Ann", ["top comment", "Nicolas a réagi avec 👍 à 2024-01-01"], "P0", None, False, 10),
        (1, 1, "Bob", ["a reply"], "P1", "P0", False, 11), (1, 2, "Bob", ["reply to the reply"], "P2", "P1", True, 12),
        (1, 3, "Cyd", ["reply of the promoted"], "P3", "P2", False, 13), (1, 4, "Cyd", ["before its parent"], "P4", "P5", False, 14),
        (1, 5, "Cyd", ["late parent"], "P5", None, False, 15), (1, 6, "Dan", ["never referenced"], "P6", "P0", False, None),
        (1, 7, "Dan", ["lost"], "P7", "P1", False, None)],
        "doc_id int, comment_id long, author string, paras array<string>, para_id string, parent_para_id string, done boolean, ref_ord long")
    placed = threads.comment_threads(c)
    assert rows(placed, "comment_id", "thread_id", "is_reply") == [
        (0, 0, False), (1, 0, True), (2, 2, False), (3, 2, True), (4, 4, False), (5, 5, False), (6, 0, True)]
    assert rows(threads.reactions(c), "emoji", "people") == [("👍", ["Nicolas"])]
    assert placed.filter("comment_id = 0").select(threads.comment_text(F.col("paras"))).first()[0] == "top comment"
    rolled = {r.thread_id: (r.replies, r.resolved) for r in threads.thread_rollup(placed).collect()}
    assert rolled == {0: (2, False), 2: (1, True), 4: (0, False), 5: (0, False)}


def test_long_chains_of_replies_alternate(spark):
    c = spark.createDataFrame([(1, i, f"P{i}", f"P{i - 1}" if i else None, i) for i in range(37)], "doc_id int, comment_id long, para_id string, parent_para_id string, ref_ord long")
    assert {r.comment_id: r.is_reply for r in threads.comment_threads(c).collect()} == {i: i % 2 == 1 for i in range(37)}


def test_edit_log_is_idempotent_and_unreadable_rows_are_skipped(spark, rows):
    log = [(1, "done", "P", "true", 1), (1, "done", "P", "false", 2), (1, "done", "P", "maybe", 3), (1, "reaction", "x", '{"a":1}', 1), (1, "reaction", "x", '{"a":2}', 2), (1, "reply", "9", "{broken", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(log)], "doc_id int, kind string, key string, value string, ts int, event_id long")
    want = [("done", "P", "false"), ("reaction", "x", '{"a":1}')]
    assert rows(threads.merge_comment_edits(df), "kind", "key", "value") == want
    assert rows(threads.merge_comment_edits(df.unionByName(df)), "kind", "key", "value") == want


# --- revisions and search

def test_accepting_and_rejecting(spark, rows):
    runs = spark.createDataFrame([(1, 0, "in", "ins", "n", None), (1, 1, "out", "del", "n", None), (1, 2, "f", "fmt", "new", "old"), (1, 3, "p", None, "n", None)],
                                 "doc_id int, seq long, text string, rev_kind string, fmt string, old_fmt string")
    assert rows(revisions.accept_all(runs), "text", "fmt", "rev_kind") == [("f", "new", None), ("in", "n", None), ("p", "n", None)]
    assert rows(revisions.reject_all(runs), "text", "fmt", "rev_kind") == [("f", "old", None), ("out", "n", None), ("p", "n", None)]
    assert rows(revisions.accept_all(revisions.accept_all(runs)), "text") == rows(revisions.accept_all(runs), "text")


def test_paragraph_marks_join_and_the_last_only_clears(spark):
    b = spark.createDataFrame([(1, i, m) for i, m in enumerate(["del", "del", None, "ins", None, "del"])], "doc_id int, seq long, rev_para string")
    assert [r.merged_into for r in revisions.merge_paragraphs(b, accept=True).orderBy("seq").collect()] == [0, 0, 0, 3, 4, 5]
    assert [r.merged_into for r in revisions.merge_paragraphs(b, accept=False).orderBy("seq").collect()] == [0, 1, 2, 3, 3, 5]


def test_search_rules(spark, rows):
    runs = spark.createDataFrame([(1, 0, "Éa a cat, concat a.b A"), (1, 1, "x")], "doc_id int, seq long, text string")
    spans = lambda *a, **k: [(r.start, r.end) for r in search.find(runs, *a, **k).orderBy("start").collect()]
    assert spans("cat") == [(5, 8), (13, 16)] and spans("cat", whole_word=True) == [(5, 8)]
    assert spans("a", match_case=True, whole_word=True) == [(1, 2), (3, 4), (17, 18)]
    assert spans("a.b") == [(17, 20)] and spans("(", regex=True) == [] and spans("") == []
    assert spans("c*", regex=True) == [(5, 6), (10, 11), (13, 14)]  # empty matches are skipped
    assert rows(search.replace_all(runs, "cat", "$1\\"), "text", "replaced") == [("x", 0), ("Éa a $1\\, con$1\\ a.b A", 2)]
    for bad in ("(", "[a", "*", "a{2"):
        assert spans(bad, regex=True) == []
        assert rows(search.replace_all(runs, bad, "y", regex=True), "text", "replaced") == [("x", 0), ("Éa a cat, concat a.b A", 0)]


def test_search_in_text_with_noncharacters(spark):
    fill, open_, close = search.FILL, search.OPEN, search.CLOSE
    for text in (f"{fill}cat{fill}{fill}cat", f"{open_}cat{close}cat", f"{fill}{open_}cat{fill}{close}", f"cat{fill}{fill}{open_}cat"):
        for pattern in ("cat", f"cat{fill}", f"{fill}cat"):
            runs = spark.createDataFrame([(1, 0, text)], "doc_id int, seq long, text string")
            got = [(r.start, r.end, r.text) for r in search.find(runs, pattern, match_case=True).orderBy("start").collect()]
            assert got == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)], (text, pattern)


# --- tables and styles

def test_cells_around_row_spans(spark):
    rng = random.Random(4)
    data, want = [], {}
    for t in range(6):
        n = rng.randint(1, 12)
        at = [[False] * 60 for _ in range(n)]
        for r in range(n):
            col = 0
            for c in range(rng.randint(1, 4)):
                while at[r][col]:
                    col += 1
                cs, rs = rng.randint(1, 3), rng.choice([1, 1, 1, 2, 4])
                want[(t, r, c)] = col
                for down in range(r, min(n, r + rs)):
                    for x in range(col, col + cs):
                        at[down][x] = True
                data.append((t, r, c, cs, rs))
                col += cs
    df = spark.createDataFrame(data, "table_no int, row_no long, cell_no int, colspan int, rowspan int")
    assert {(r.table_no, r.row_no, r.cell_no): r.col for r in grids.place_spanned_cells(df).collect()} == want


def test_style_cycles_are_cut(spark, rows):
    s = spark.createDataFrame([("a", "b", {"x": "a"}), ("b", "c", {"x": "b", "y": "b"}), ("c", "a", {"z": "c"}), ("d", "gone", {"x": "d"})], "style_id string, based_on string, props map<string,string>")
    got = {(r.style_id, r.prop): r.value for r in styles.resolve_styles(s).collect()}
    assert got == {("a", "x"): "a", ("a", "y"): "b", ("a", "z"): "c", ("b", "x"): "b", ("b", "y"): "b", ("b", "z"): "c", ("c", "x"): "a", ("c", "y"): "b", ("c", "z"): "c", ("d", "x"): "d"}


def test_upserting_styles_twice_changes_nothing(spark, rows):
    s = spark.createDataFrame([("a", "A", None, {"size": "1", "keep": "k"})], "style_id string, name string, based_on string, props map<string,string>")
    e = spark.createDataFrame([("a", "other", {"color": "red"}), ("n", "New", {"size": "2"})], "style_id string, name string, props map<string,string>")
    once = styles.upsert_styles(s, e, ["size", "color"])
    assert rows(once, "style_id", "name", "props") == [("a", "A", {"keep": "k", "color": "red"}), ("n", "New", {"size": "2"})]
    assert rows(styles.upsert_styles(once, e, ["size", "color"]), "style_id", "name", "props") == rows(once, "style_id", "name", "props")


# --- scalars

@pytest.mark.parametrize("colour, hex6", [("#abc", "AABBCC"), ("a1b2c3", "A1B2C3"), ("rgb(255, 0, 16)", "FF0010"), ("rgba(1,2,3,.5)", "010203"), ("red", None), (None, None)])
def test_colours(spark, colour, hex6):
    assert one(spark, units.to_hex6(F.lit(colour).cast("string"))) == hex6


def test_scalar_rules(spark):
    assert one(spark, units.length_to_inches(F.lit("-2.54cm"))) == pytest.approx(-1)
    assert tuple(one(spark, units.odt_border(F.lit("#ff0000 0.75pt dashed")))) == (1, "dashed", "ff0000")
    assert one(spark, units.odt_border(F.lit("none"))) is None and one(spark, units.css_border(F.lit("2px none #000000"))) is None
    assert tuple(one(spark, fields.eq_ruby(F.lit("EQ \\* jc2 \\o\\ad(\\s\\up 9(kana),kanji)")))) == ("kanji", "kana")
    assert one(spark, maps.highlight_name(maps.highlight_hex(F.lit("darkCyan")))) == "darkCyan"
    assert one(spark, maps.odt_tab_type(F.lit("char"))) == "decimal"
    assert one(spark, text.mask_volatile(F.lit("at  9:05:10 on 1/2/2024"))) == "at <time> on <date>"
    assert one(spark, text.char_count(F.lit("a b﻿ c"))) == 3
    assert one(spark, fields.info_field(F.lit(" PAGEREF x"))) is None and one(spark, fields.info_field(F.lit(" page \\* x"))) == "PAGE"


def test_translation_keeps_unknown_parameters(spark):
    d = spark.createDataFrame([("en", "hi", "Hi {n} {m}"), ("fr", "hi", "Salut {n}")], "locale string, key string, text string")
    q = spark.createDataFrame([("fr-CA", "hi", {"n": "{m}"}), ("xx", "hi", {"n": "A"}), ("en", "?", {})], "locale string, key string, params map<string,string>")
    assert sorted(r.label for r in references.translate(q, d, ["en", "fr"]).collect()) == ["?", "Hi A {m}", "Salut {m}"]


def test_lengths_within_tolerance_are_no_difference(spark, rows):
    side = lambda *v: spark.createDataFrame([(1, "k", p, x) for p, x in zip("abcd", v)], "doc_id int, key string, prop string, value string")
    assert rows(diff.diff_summaries(side("1cm", "0in", "x  y", "2in"), side("0.394in", None, "x y", "2.02in")), "prop") == [("d",)]


# --- html

@pytest.mark.parametrize("markup, blocks", [
    ("<p>a<p>b", [("p", 0, "a"), ("p", 0, "b")]), ("<div>x <b>y</b></div>", [("p", 0, "x y")]), ("<h2>t</h2>tail", [("h", 2, "t"), ("p", 0, "tail")]),
    ("<ul><li>1<ol><li>2</ol><li>3</ul>", [("li", 0, "1"), ("li", 1, "2"), ("li", 0, "3")]), ("<p> &nbsp; </p><script>var a='<p>no</p>'</script><p>&#233;&eacute;&amp;lt;</p>", [("p", 0, "éé&lt;")]),
    ("<p>one<br>two</p>", [("p", 0, "one\ntwo")])])
def test_html_blocks(spark, markup, blocks):
    page = spark.createDataFrame([(1, markup)], "page_id int, html string")
    assert [(r.kind, r.level, r.text) for r in html.html_blocks(page).orderBy("seq").collect()] == blocks


def test_single_plain_paragraphs_are_inline(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "<h1>a</h1>"), (3, "<p>a</p><p>b</p>")], "page_id int, html string")
    assert {r.page_id: r.inline for r in html.inline_pages(html.html_blocks(pages)).collect()} == {1: True, 2: False, 3: False}


# --- packages

def zipped(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return buffer.getvalue()


def test_packages_are_sniffed_and_unreadable_ones_reported(spark, tmp_path):
    good = zipped(word__document_xml="<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:body></w:document>")
    files = {"a.docx": good, "b.docx": good[:30], "c.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"rest", "d.odt": zipped(mimetype="application/vnd.oasis.opendocument.text"),
             "e.docx": zipped(), "f.docx": zipped(word__document_xml="<w:document><w:p></w:document>")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    docs, parts, nodes = packages.read_packages(spark, str(tmp_path / "*"))
    assert {r.path[-6:]: (r.format, r.status) for r in docs.collect()} == {
        "a.docx": ("docx", "ok"), "b.docx": ("docx", "unreadable"), "/c.doc": ("doc", "unsupported"), "/d.odt": ("odt", "ok"), "e.docx": ("docx", "ok"), "f.docx": ("docx", "unreadable")}
    assert [(r.kind, r.text) for r in docx.blocks(nodes.join(docs.filter("path like '%a.docx'"), "doc_id", "left_semi")).collect()] == [("p", "hi")]
    assert parts.filter("error is not null").count() == 1


def test_formats_can_be_registered(spark):
    packages.register_format("flat", F.substring("content", 1, 4) == F.encode(F.lit("FLAT"), "UTF-8"), lambda content: [("main.xml", io.BytesIO(content[4:]))])
    try:
        files = spark.createDataFrame([("x", bytearray(b"FLAT<a><b/></a>"))], "path string, content binary")
        docs, _, nodes = packages.split_rows(packages.open_packages(files))
        assert docs.first().format == "flat" and sorted(r.tag for r in nodes.collect()) == ["a", "b"]
    finally:
        packages._EXTRA_FORMATS.clear()


def test_a_changed_document_replaces_the_old_one(spark, tmp_path, rows, monkeypatch):
    table = lambda *rows_: spark.createDataFrame(list(rows_), "doc_id int, path string, content_sha256 string, format string, text string")
    load = lambda docs, **how: sorted(r.doc_id for r in lake.load_increment(spark, docs, {"blocks": lake.read_text_documents(docs)}, str(tmp_path), **how).collect())
    docs = table((1, "a", "h1", "text", "x"), (2, "b", "h2", "text", "y"), (3, "c", "h3", "text", "w"))
    assert load(docs) == [1, 2, 3]
    again = table((1, "a", "h1", "text", "x"), (2, "b", "h4", "text", "y\nz\n"))
    assert load(again) == [2] and load(again) == []
    assert rows(lake.read_lake(spark, str(tmp_path)), "doc_id", "content_sha256") == [(1, "h1"), (2, "h4"), (3, "h3")]
    assert rows(lake.read_lake(spark, str(tmp_path), "blocks"), "doc_id", "text") == [(1, "x"), (2, "y"), (2, "z"), (3, "w")]
    assert load(again, whole=True) == [] and rows(lake.read_lake(spark, str(tmp_path)), "doc_id") == [(1,), (2,)]
    # A load that stopped before it was committed is invisible, and repeating it leaves nothing twice.
    third = table((1, "a", "h5", "text", "x2"), (2, "b", "h4", "text", "y\nz\n"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(lake, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        load(third)
    assert (1, "x") in rows(lake.read_lake(spark, str(tmp_path), "blocks"), "doc_id", "text")
    assert load(third) == [1]
    assert rows(lake.read_lake(spark, str(tmp_path), "blocks"), "doc_id", "text") == [(1, "x2"), (2, "y"), (2, "z")]


def test_tables_and_pictures_are_blocks(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><table><tr><td>x<table><tr><td>in</table></table><p><img src='u'></p><table></table><p> </p><p>b <img src='v'></p>")], "page_id bigint, html string")
    got = [(r.kind, r.text) for r in html.html_blocks(pages).orderBy("seq").collect()]
    assert got == [("p", "a"), ("table", ""), ("p", ""), ("p", "b")]


# --- the node store

def test_node_store_reads_what_a_table_needs(spark, tmp_path, capsys):
    from sheaf.plans import package_fixtures as px
    from sheaf.sources import docx, packages

    made = px.docx_files(spark, "/root/testdata/sf0.001").limit(20)
    files = spark.createDataFrame(made.collect(), made.schema)  # archives carry the time they were made
    opened = packages.open_packages(files)
    store = packages.store_packages(opened, str(tmp_path / "store"))
    again = packages.load_store(spark, str(tmp_path / "store"))
    for a, b in zip(packages.split_rows(store), packages.split_rows(opened)):
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(a) == key(b) != []
    nodes = packages.split_rows(again)[2]
    plan = docx.relationships(nodes)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(p for p in plan.split("\n\n") if "ReadSchema" in p)
    assert "part_class" in scan.split("PartitionFilters")[1].split("\n")[0] and "EqualTo(tag,Relationship)" in scan
    assert "trail" not in scan.split("ReadSchema")[1] and "text" not in scan.split("ReadSchema")[1]
    classes = {r.part_class for r in nodes.select("part_class").distinct().collect()}
    assert {"body", "styles", "links"} <= classes and {r.part_class for r in nodes.where("part = 'word/document.xml'").collect()} == {"body"}


# --- pages as tokens

@pytest.mark.parametrize("html, tokens", [
    ("a<!-- <script> -->b<p>c</script> d</p>", ["ab", "<p>", "c", "</script>", " d", "</p>"]),
    ("<script>var t = '<!--';</script>x<!-- y -->z", ["xz"]),
    ("<object>one<object>two</object>three</object>four", ["four"]),
    ("<svg><title>a</svg></title><svg/></svg>b</svg>c", ["c"]),
    ("<select><option>a<select>b</select></select>c", ["c"]),
    ("<style>p > a { }", []), ("<button>never closed", ["<button>", "never closed"]),
    ("a < b <c d='>'>e</c>", ["a ", "<", " b ", "<c d='>'>", "e", "</c>"]), ("<!DOCTYPE html><meta x><p>", ["<p>"]), ("", []), ("<", ["<"]),
    ("<template><!-- </template> --><p>in</p></template>out", ["out"])])
def test_tokens_of_a_page(html, tokens):
    from sheaf.operators.html_tokens import cut

    assert [t for t, _, _ in cut(html)] == tokens


def test_what_encloses_a_token(spark):
    from sheaf.operators import html

    page = ("<ul><li>a<ol><li><b>b</b></ol>c</ul><table><tr><td>d<table><tr><td>e</table></td></tr></table>"
            "<b style='font-weight: normal'>f<b>g</b>h</b><a href='#x'>i</a><blockquote><pre>j</pre></blockquote>")
    rows = {r.token: r for r in html.html_context(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()}
    assert [(rows[x].n_list, rows[x].list_tag, rows[x].item.at) for x in "abc"] == [(1, "ul", 1), (2, "ol", 4), (1, "ul", 1)]
    assert [(rows[x].n_table, rows[x].outer_at, rows[x].row_no) for x in "de"] == [(1, 11, 1), (2, 11, 1)]
    assert [(rows[x].n_b, rows[x].n_bold) for x in "bfgh"] == [(1, 1), (1, 0), (2, 1), (1, 0)]
    assert rows["i"].link.token == "<a href='#x'>" and not rows["i"].link.closing and rows["j"].n_pre == rows["j"].n_quote == 1


def test_comments_before_scripts_keep_their_text(spark, rows):
    from sheaf.operators import html

    pages = spark.createDataFrame([(1, "<p><!-- <script> -->text</p><p>more <script>gone</script>here</p>"), (2, "<p>a<object>x<object>y</object>z</object>b</p>")],
                                  "page_id int, html string")
    assert rows(html.html_blocks(pages), "page_id", "text") == [(1, "more here"), (1, "text"), (2, "ab")]


def test_styles_far_from_their_values(spark):
    """Chains whose only values lie far up, with gaps of every length, and cycles with and without a value."""
    rows = [(i, i - 1 if i else None, {"a": "root"} if i == 0 else {"b": str(i)} if i in (3, 40) else None) for i in range(70)]
    rows += [(100 + i, 100 + (i + 1) % 7, {"c": "loop"} if i == 4 else None) for i in range(7)] + [(200, 201, None), (201, 200, None), (202, 999, {"d": "x"})]
    table = spark.createDataFrame(rows, "style_id int, based_on int, props map<string,string>")
    own, up, want = {i: p or {} for i, _, p in rows}, {i: u for i, u, _ in rows}, {}
    for i in own:
        at, far, seen = i, 0, set()
        while at in own and at not in seen:
            seen.add(at)
            for prop, value in own[at].items():
                want.setdefault((i, prop), (value, far))
            at, far = up[at], far + 1
    got = {(r.style_id, r.prop): (r.value, r.distance) for r in styles.resolve_styles(table).collect()}
    assert got == want
    assert styles.resolve_styles(table.limit(0)).count() == 0


def test_two_loads_at_once(spark, rows, tmp_path, monkeypatch):
    """A load that another overtakes starts afresh from what that one has stored; readers keep to their version."""
    path = str(tmp_path / "lake")
    docs = lambda *r: spark.createDataFrame([(i, f"p{i}", h) for i, h in r], "doc_id int, path string, content_sha256 string")
    blocks = lambda d: {"blocks": d.selectExpr("doc_id", "content_sha256 as text")}
    lake.load_increment(spark, (d := docs((1, "a"), (2, "a"))), blocks(d), path)
    before = lake.read_lake(spark, path, "blocks")
    mine, other, commit, tries = docs((1, "b"), (2, "a")), docs((2, "c"), (3, "c")), lake._commit, []

    def overtaken(spark, path, version, loads):
        if not tries:  # the other load commits between our writing and our commit
            tries.append(version)
            lake.load_increment(spark, other, blocks(other), path)
        tries.append(version)
        return commit(spark, path, version, loads)

    monkeypatch.setattr(lake, "_commit", overtaken)
    changed = lake.load_increment(spark, mine, blocks(mine), path)
    assert tries == [1, 1, 1, 2] and rows(changed, "doc_id") == [(1,), (2,)]  # 2 counts as changed: the other load had changed it
    assert rows(lake.read_lake(spark, path), "doc_id", "content_sha256") == [(1, "b"), (2, "a"), (3, "c")]
    assert rows(lake.read_lake(spark, path, "blocks"), "doc_id", "text") == [(1, "b"), (2, "a"), (3, "c")]
    assert rows(lake.read_lake(spark, path, version=0), "doc_id", "content_sha256") == [(1, "a"), (2, "a")] and rows(before, "doc_id", "text") == [(1, "a"), (2, "a")]
    assert rows(lake.read_lake(spark, path, version=1), "doc_id", "content_sha256") == [(1, "a"), (2, "c"), (3, "c")]
    # What lost and what nobody can see goes; the rest reads the same from fewer folders.
    dropped = lake.vacuum(spark, path)
    assert len(dropped) == 4 and len([x for x in dropped if x.startswith("docs/load=000000001-")]) == 1
    assert len(lake.snapshot(spark, path)[1]) == 2 and lake.vacuum(spark, path) == []
    assert rows(lake.read_lake(spark, path, "blocks"), "doc_id", "text") == [(1, "b"), (2, "a"), (3, "c")]
    read = {f.split("load=")[1].split("/")[0] for f in lake.read_lake(spark, path, "blocks").inputFiles()}
    assert read == set(lake.snapshot(spark, path)[1])


def test_vacuum_keeps_what_hides_older_rows(spark, rows, tmp_path):
    path = str(tmp_path / "lake")
    docs = lambda *r: spark.createDataFrame([(i, f"p{i}", h) for i, h in r], "doc_id int, path string, content_sha256 string")
    assert lake.vacuum(spark, path) == [] and lake.snapshot(spark, path) == (-1, [])
    for corpus in (docs((1, "a"), (2, "a")), docs((2, "a")), docs((2, "b")), docs((3, "b"))):
        lake.load_increment(spark, corpus, {}, path, whole=True)
        now = rows(lake.read_lake(spark, path), "doc_id", "content_sha256")
        lake.vacuum(spark, path)
        assert rows(lake.read_lake(spark, path), "doc_id", "content_sha256") == now == rows(corpus, "doc_id", "content_sha256")
    assert len(lake.snapshot(spark, path)[1]) == 1
