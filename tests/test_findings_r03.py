"""Small inputs that went wrong, or grew, before the findings of round 3."""

import io
import random
import re
import tracemalloc

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from compare import compare
from pyspark.sql import functions as F

from sheaf import session
from sheaf.operators import grids, html, paging, scan
from sheaf.plans import catalog, package_fixtures, stream_queries
from sheaf.sources import lake, packages
from sheaf.streaming import feeds, live


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with documents of short and empty lines, so that positions in one part occur in another, and with long lines."""
    rng, folder = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    texts = ["\n".join(rng.choice(["", "ab", "lorem ipsum"]) for _ in range(rng.randint(60, 400))) for _ in range(12)]
    texts.append("\n".join("word " * 30_000 for _ in range(7)))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts, 2)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


# --- F1 to F24
def test_containers_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """Ten containers of 1.5 MB each: neither what goes to the workers nor what they return holds all of them."""
    parts = spark.range(0, 10, 1, 1).select(F.col("id").alias("doc_id"), F.array(F.struct(
        F.lit("word/document.xml").alias("name"), F.encode(F.repeat(F.lit("x"), 1_500_000), "UTF-8").alias("data"))).alias("parts"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    seen = []
    monkeypatch.setattr(packages, "keep", lambda opened, *_: seen.extend(opened.collect()))
    packages.store_packages(package_fixtures.zipped(parts, "docx").mapInArrow(sizes, "n long, bytes long"))
    assert sum(r["n"] for r in seen) == 10 and max(r["bytes"] for r in seen) < 7_000_000
    assert spark.conf.get(session.BATCH_BYTES) == "67108864b"


# --- F2 to F23
def test_a_node_store_is_written_without_sorting_its_rows(spark, tmp_path):
    """Rows reach their folders as they come: a sort by folder held and spilled all rows of a task."""
    parts = spark.range(0, 3, 1, 1).select(F.col("id").alias("doc_id"), F.array(*[
        F.struct(F.lit(name).alias("name"), F.encode(F.lit("<a><b>x</b></a>"), "UTF-8").alias("data"))
        for name in ("word/document.xml", "word/styles.xml", "word/document.xml.rels")]).alias("parts"))
    store = packages.store_packages(packages.open_packages(package_fixtures.zipped(parts, "docx")), str(tmp_path / "store"))
    writing = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    assert "MapInArrow" in writing and "Sort" not in writing
    docs, parts, nodes = packages.split_rows(store)
    assert (docs.count(), parts.count(), nodes.count()) == (3, 9, 27)
    assert len(list(tmp_path.glob("store/row=node/*/*.parquet"))) == 3
    assert spark.conf.get(session.OPEN_FILES) == "0"


# --- F3 to F22
def test_nodes_wait_for_their_batch_without_trails_of_their_own():
    """4,000 nodes below 200 elements: what encloses them is held once, beside one number of four bytes for each id."""
    xml = b"<a>" * 200 + b'<b k="v"/>' * 4000 + b"</a>" * 200
    rows = packages._Rows()
    list(packages.read_nodes(io.BytesIO(b"<a><b k='v'/></a>"), rows, "d", "warm")), rows.take()
    tracemalloc.start()
    done = [*packages.read_nodes(io.BytesIO(xml), rows, "d", "word/styles.xml"), rows.take()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = pa.Table.from_batches(done).slice(4199, 1).to_pylist()[0]
    assert (last["node_id"], last["parent_id"], last["depth"], last["ord"], last["tag"], last["attrs"]) == (4199, 199, 200, 3999, "b", [("k", "v")])
    assert last["trail"] == ["a"] * 200 + ["b"] and last["ids"] == [*range(200), 4199]
    assert peak < 12_000_000


# --- F25, F26
@pytest.mark.parametrize("name", ["docx_runs", "odt_runs"])
def test_runs_keep_to_their_part_and_stay_whole(spark, documents, name):
    folder, con = documents
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], folder) is None


def test_a_long_text_is_one_node():
    rows, text = packages._Rows(), "word " * 100_000
    done = [b for b in packages.read_nodes(io.BytesIO(f"<a>{text}<b/>{text}</a>".encode()), rows, "d", "p")]
    assert [t for b in [*done, rows.take()] for t in b.column("text").to_pylist() if t] == [text, text]


# --- F29 to F32, F35, F39 to F41, F43, F45
def dealt(df):
    """Partition numbers of the exchanges in a plan, as far as rows are dealt by keys."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


@pytest.fixture
def grid(spark, monkeypatch):
    """Cells of 500 tables of 4 rows of 2, numbered with at most 100 rows a task."""
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 500).alias("table_no"), F.col("id"))
    numbered = scan.with_positions(rows, ["table_no"], ["id"], "row_no")
    return numbered.select("table_no", "row_no", F.explode(F.array(F.lit(1), F.lit(2))).alias("cell_no"), F.lit(1).alias("colspan"), F.lit(2).alias("rowspan"))


def test_large_tables_are_dealt_to_more_tasks(grid):
    placed = grids.place_cells(grid)
    assert dealt(placed) == [20]
    assert [tuple(r) for r in placed.groupBy("row_no", "cell_no", "col").count().orderBy("row_no", "cell_no").collect()] == [
        (r, c, c - 1, 500) for r in range(1, 5) for c in (1, 2)]


def test_table_shape_deals_cells_once(grid):
    shape = grids.table_shape(grids.place_cells(grid).withColumn("is_header", F.col("row_no") == 1))
    assert dealt(shape) == [20]
    assert [tuple(r) for r in shape.drop("table_no").distinct().collect()] == [(4, 2, 8, 1)]


def test_bands_of_large_tables_are_dealt_to_more_tasks(grid):
    placed = grids.place_spanned_cells(grid)
    assert min(dealt(placed)) >= 20
    assert placed.count() == 4000


def test_many_groups_are_measured_by_buckets(spark, monkeypatch):
    """A bucket over the limit is looked at group by group: neighbours in one bucket do not count as one group."""
    monkeypatch.setattr(scan, "SIZE_BUCKETS", 1)
    df = spark.range(300).select((F.col("id") % 100).alias("k"), F.col("id"))
    out = scan.with_positions(df, ["k"], ["id"], max_group_rows=10)
    assert "_range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(i % 100, i, i // 100 + 1) for i in range(300)}


# --- F34, F44
def test_sections_are_paged_without_a_join(spark):
    """Sections of one chunk stay a row each: what pages them is dealt by document only, and gives what paging them as documents gives."""
    blocks = spark.range(3000).select(
        (F.col("id") % 3).alias("doc_id"), F.floor(F.col("id") / 3).alias("seq"), (20 + F.col("id") % 90 * 13).alias("height_px"), F.floor(F.col("id") / 60).alias("section"))
    got = paging.paginate_sections(blocks, 1147, 931)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in blocks.orderBy("doc_id", "seq").collect():
        rows.setdefault((r.doc_id, r.section), []).append(r)
    want, before = set(), {}
    for (doc, section), held in sorted(rows.items()):
        pages, offsets, _, page, end = paging.fill([float(r.height_px) for r in held], [False] * len(held), 0, 0.0, 1147, 931, {})
        first = before.get(doc, 0)
        want |= {(doc, section, r.seq, p + first, p) for r, p in zip(held, pages)}
        before[doc] = first + max(page + 1, -int(-(page * 1147 + end) // 1147))
    assert {tuple(r) for r in got.collect()} == want


def test_notes_of_short_documents_meet_them_once(spark):
    blocks = spark.range(900).select((F.col("id") % 3).alias("doc_id"), F.floor(F.col("id") / 3).alias("seq"), F.lit(20).alias("height_px"))
    refs = blocks.filter("seq % 7 = 0").withColumn("height_px", F.lit(40))
    got = paging.paginate_with_notes(blocks, refs, 1147, 931)
    assert len(re.findall(r"Join", got._jdf.queryExecution().executedPlan().toString())) <= 2
    rounds = paging.paginate_with_notes(blocks, refs, 1147, 931, chunk_blocks=64)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rounds.collect()}


# --- F37, F42
def test_pages_are_read_once_and_without_what_is_not_asked(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th colspan=2>a<td>b<tr><td>c &amp; d</table>")], "page_id long, html string")
    assert "link_token" not in html.tokens(pages)._jdf.queryExecution().executedPlan().toString()
    cells = html.html_cells(pages)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert [tuple(r)[2:] for r in cells.orderBy("row_no", "cell_no").collect()] == [
        (0, 1, 2, 1, True, "a"), (0, 2, 1, 1, False, "b"), (1, 1, 1, 1, False, "c & d")]


# --- F38
def test_loads_tell_what_is_stored_without_contents(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i), "text", f"h{i}", f"line {i}") for i in range(4)], "doc_id long, path string, format string, content_sha256 string, text string")
    folder = str(tmp_path / "lake")
    lake.load_increment(spark, docs, {"blocks": docs.select("doc_id", "text")}, folder, whole=True)
    lake.load_increment(spark, docs.filter("doc_id <> 2"), {"blocks": docs.select("doc_id", "text")}, folder, whole=True)
    gone = spark.read.parquet(f"{folder}/docs").filter("content_sha256 is null")
    assert [(r.doc_id, r.path, r.text) for r in gone.collect()] == [(2, "2", None)]
    blocks = lake.read_lake(spark, folder, "blocks")
    assert sorted(r.doc_id for r in blocks.collect()) == [0, 1, 3] == sorted(r.doc_id for r in lake.read_lake(spark, folder).collect())
    assert lake.read_lake(spark, folder, "blocks")._jdf.queryExecution().executedPlan().toString().count("text:string") == 1


# --- F33, F46
class State:
    """A state variable that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*_):
            self.calls.append(name)
            return False if name == "exists" else None

        return call


class Handle(State):
    getValueState = getListState = getMapState = lambda self, name, *_: State(self.calls)


def test_live_blocks_write_what_a_batch_leaves():
    calls = []
    p = live._LiveBlocks()
    p.init(Handle(calls))
    n = 200
    frame = pd.DataFrame({"ts": pd.to_datetime(range(n), unit="s"), "event_id": range(n), "changed": [[{"id": f"b{i % 2}", "html": str(i)}] for i in range(n)],
                          "order": [["b0", "b1"]] * (n - 1) + [["b1"]]})
    out, = p.handleInputRows((1,), iter([frame]), None)
    assert calls.count("updateValue") == 1 and "removeKey" not in calls
    assert out[["row", "block_id", "html"]].values.tolist()[:2] == [["removed", "b0", None], ["block", "b1", "199"]]


def test_large_feeds_are_written_and_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "TASK_ROWS", 100)
    feed = stream_queries.edit_files(spark, "/root/testdata/sf0.001")
    out = feeds.drain(feed.select("event_id")).groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct(F.expr("event_id % 4")).alias("portions")).collect()
    assert sorted((r.n, r.portions) for r in out) == [(250, 1)] * 4
