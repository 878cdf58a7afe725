"""Word-processor packages as tables: each container is opened once, every XML part becomes rows.

Only this step runs in Python workers: the standard zip and XML readers turn one file into rows of documents, parts and
nodes, streamed in Arrow batches. A file that cannot be read becomes a document row with a status, never a failed job.

The rows are written once, as a node store: Parquet in folders by kind of row and class of part (``nodes.PART_CLASSES``). The
tables derived from it read the folders of their parts only, the columns they use, and the row groups that hold their tags.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from array import array
from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep, small_batches
from .nodes import class_of

# What the container formats start with or contain.
COMPOUND_FILE_MAGIC = "D0CF11E0A1B11AE1"
ODT_MIMETYPE = b"opendocument.text"
XML_ENDINGS = (".xml", ".rels")

BATCH_ROWS = 4096
READ_BYTES = 1 << 16

_ROW = pa.schema([
    ("row", pa.string()), ("doc_id", pa.string()), ("path", pa.string()), ("format", pa.string()), ("status", pa.string()),
    ("error", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("part", pa.string()), ("is_xml", pa.bool_()),
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("trail", pa.list_(pa.string())), ("ids", pa.list_(pa.int32())),
    ("part_class", pa.string()),
])
_DDL = (
    "row string, doc_id string, path string, format string, status string, error string, n_bytes bigint, sha256 string, part string, "
    "is_xml boolean, node_id int, parent_id int, depth int, ord int, tag string, attrs map<string,string>, text string, "
    "trail array<string>, ids array<int>, part_class string")

ReadFn = Callable[[bytes], Iterable[tuple[str, io.IOBase]]]
_EXTRA_FORMATS: dict[str, tuple[Column, ReadFn]] = {}


def register_format(name: str, sniff: Column, read: ReadFn) -> None:
    """Add a container format: a test on the ``content`` column and a reader yielding (part name, byte stream)."""
    _EXTRA_FORMATS[name] = (sniff, read)


def sniff_format(content: Column) -> Column:
    """doc for a compound file, the name of a registered format, else zip (docx or odt, told apart when it is opened)."""
    out = F.when(F.hex(F.substring(content, 1, 8)) == COMPOUND_FILE_MAGIC, "doc")
    for name, (test, _) in _EXTRA_FORMATS.items():
        out = out.when(test, name)
    return out.otherwise("zip")


class _Rows:
    """Rows gathered and turned into Arrow batches: documents and parts row by row, nodes by what differs between them.

    Few trails and sets of attributes are different, so nodes hold their numbers and Arrow takes them from a list of each.
    """

    def __init__(self) -> None:
        self.others: list[dict] = []
        self.spans: list[tuple[str, str, int]] = []  # document, part, nodes that stand there
        self.trails: dict[tuple, int] = {}
        self.attrs: dict[tuple | None, int] = {}
        self.trail_of, self.attrs_of, self.ord, self.text = [], [], [], []
        self.ids = array("i")
        self.size = 0

    def add(self, **values) -> None:
        self.others.append(values)
        self.size += 1

    def add_span(self, doc_id: str, part: str, n: int) -> None:
        if n:
            self.spans.append((doc_id, part, n))
            self.size += n

    def _nodes(self) -> dict[str, pa.Array]:
        trail_of, span_of = np.array(self.trail_of), np.repeat(np.arange(len(self.spans)), [n for *_, n in self.spans])
        size = np.array([len(t) for t in self.trails], np.int32)[trail_of]
        ends, ids = np.cumsum(size, dtype=np.int32), np.array(self.ids, np.int32)
        one_of = lambda values, which, kind=pa.string(): pa.array(values, kind).take(pa.array(which))
        return {
            "row": one_of(["node"], np.zeros_like(span_of)), "doc_id": one_of([d for d, *_ in self.spans], span_of),
            "part": one_of([p for _, p, _ in self.spans], span_of), "part_class": one_of([class_of(p) for _, p, _ in self.spans], span_of),
            "node_id": pa.array(ids[ends - 1]), "parent_id": pa.array(ids[ends - 2], mask=size == 1), "depth": pa.array(size - 1),
            "ord": pa.array(self.ord, pa.int32()), "tag": one_of([t[-1] for t in self.trails], trail_of), "text": pa.array(self.text, pa.string()),
            "attrs": one_of([a if a is None else list(zip(a[::2], a[1::2], strict=True)) for a in self.attrs], self.attrs_of, _ROW.field("attrs").type),
            "trail": one_of(list(self.trails), trail_of, _ROW.field("trail").type),
            "ids": pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(ids)),
        }

    def take(self) -> pa.RecordBatch:
        columns = {f.name: pa.array([r.get(f.name) for r in self.others], f.type) for f in _ROW}
        if self.spans:
            n, nodes = self.size - len(self.others), self._nodes()
            columns = {f.name: pa.concat_arrays([nodes[f.name] if f.name in nodes else pa.nulls(n, f.type), columns[f.name]]) for f in _ROW}
        for held in (self.others, self.spans, self.trails, self.attrs, self.trail_of, self.attrs_of, self.ord, self.text):
            held.clear()
        del self.ids[:]
        self.size = 0
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=_ROW)


def read_nodes(stream, rows: _Rows, doc_id: str, part: str) -> Iterator[pa.RecordBatch]:
    """Append the elements and text of one XML part in document order, names as written; text is a node tagged #text.

    The parser hands out text in pieces, by its buffer and by what was read at once: a text is one node all the same.
    """
    trails, kinds = rows.trails, rows.attrs
    add_trail, add_attrs, add_ord, add_text, add_ids = rows.trail_of.append, rows.attrs_of.append, rows.ord.append, rows.text.append, rows.ids.extend
    stack: list[list] = [[(), array("i"), 0]]  # [trail, ids, children seen]
    count = 0
    pieces: list[str] = []

    def add(tag, attrs, text):
        nonlocal count
        top = stack[-1]
        trail, ids = (*top[0], tag), top[1][:]
        ids.append(count)
        add_trail(trails.setdefault(trail, len(trails))), add_attrs(kinds.setdefault(attrs, len(kinds)))
        add_ord(top[2]), add_text(text), add_ids(ids)
        top[2] += 1
        count += 1
        return [trail, ids, 0]

    def end_text():
        add("#text", None, "".join(pieces))
        pieces.clear()

    def start(tag, attrs):
        if pieces:
            end_text()
        stack.append(add(tag, tuple(attrs), None))

    def end(_):
        if pieces:
            end_text()
        stack.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = parser.ordered_attributes = True
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = pieces.append
    done = False
    while not done:
        before, chunk = count, stream.read(READ_BYTES)
        done = not chunk
        try:
            parser.Parse(chunk, done)
        finally:
            rows.add_span(doc_id, part, count - before)
        if rows.size >= BATCH_ROWS:
            yield rows.take()


def _zip_parts(content: bytes) -> tuple[str, Iterator[tuple[str, io.IOBase]]]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = [n for n in archive.namelist() if not n.endswith("/")]
    odt = "mimetype" in names and ODT_MIMETYPE in archive.read("mimetype")
    return ("odt" if odt else "docx"), ((n, archive.open(n)) for n in names)


class _Hashing:
    """A byte stream that counts and hashes what is read through it."""

    def __init__(self, raw) -> None:
        self.raw, self.size, self.digest = raw, 0, hashlib.sha256()

    def read(self, n: int = READ_BYTES) -> bytes:
        data = self.raw.read(n)
        self.size += len(data)
        self.digest.update(data)
        return data


def _package_rows(rows: _Rows, doc_id: str, path: str, fmt: str, content: bytes, readers: dict[str, ReadFn]) -> Iterator[pa.RecordBatch]:
    doc = {"row": "doc", "doc_id": doc_id, "path": path, "format": fmt, "status": "ok", "n_bytes": len(content),
           "sha256": hashlib.sha256(content).hexdigest()}
    if fmt == "doc":
        rows.add(**{**doc, "status": "unsupported"}, part_class=class_of(None))
        return
    try:
        if fmt in readers:
            parts = readers[fmt](content)
        else:
            doc["format"], parts = _zip_parts(content)
        for name, raw in parts:
            stream, error, is_xml = _Hashing(raw), None, name.endswith(XML_ENDINGS)
            if is_xml:
                try:
                    yield from read_nodes(stream, rows, doc_id, name)
                except expat.ExpatError as e:
                    error = str(e)
                    doc.update(status="unreadable", error=f"{name}: {e}")
            while stream.read():
                pass
            rows.add(row="part", doc_id=doc_id, part=name, n_bytes=stream.size, sha256=stream.digest.hexdigest(), is_xml=is_xml, error=error,
                     part_class=class_of(name))
    except Exception as e:  # noqa: BLE001 - any unreadable container is reported, not raised
        doc.update(status="unreadable", error=f"{type(e).__name__}: {e}")
    if doc["format"] == "zip":
        doc["format"] = "docx"
    rows.add(**doc, part_class=class_of(None))


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each turned into Python values when its turn comes: of containers only one is held twice."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def open_packages(files: DataFrame) -> DataFrame:
    """Rows of documents, parts and nodes (column ``row`` tells which) of ``files``: path, content and optionally doc_id."""
    doc_id = F.col("doc_id").cast("string") if "doc_id" in files.columns else F.substr(F.sha2("path", 256), F.lit(1), F.lit(32))
    readers = {name: read for name, (_, read) in _EXTRA_FORMATS.items()}

    def flatten(batches):
        rows = _Rows()
        for batch in batches:
            for f in one_by_one(batch):
                yield from _package_rows(rows, f["doc_id"], f["path"], f["format"], f["content"], readers)
                if rows.size >= BATCH_ROWS:
                    yield rows.take()
        if rows.size:
            yield rows.take()

    return files.select(doc_id.alias("doc_id"), "path", sniff_format(F.col("content")).alias("format"), "content").mapInArrow(flatten, _DDL)


def store_packages(opened: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of ``open_packages`` as a node store, in ``folder`` or in the shared folder of the session.

    Containers are large rows, which each task holds on both sides of its Python worker, so few go over at once.
    """
    with small_batches(opened.sparkSession):
        return keep(opened, "packages", ("row", "part_class"), folder)


def load_store(spark: SparkSession, folder: str) -> DataFrame:
    """A node store written before, for ``split_rows``."""
    return spark.read.schema(_DDL).parquet(folder)


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, parts, nodes) out of ``open_packages``."""
    docs = rows.filter("row = 'doc'").select("doc_id", "path", "format", "status", "error", "n_bytes", F.col("sha256").alias("content_sha256"))
    parts = rows.filter("row = 'part'").select("doc_id", "part", "n_bytes", "sha256", "is_xml", "error")
    nodes = rows.filter("row = 'node'").select("doc_id", "part", "node_id", "parent_id", "depth", "ord", "tag", "attrs", "text", "trail", "ids", "part_class")
    return docs, parts, nodes


def read_packages(spark: SparkSession, glob: str, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, parts, nodes) of all files matching ``glob``, out of a node store written to ``folder`` (or the shared folder)."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return split_rows(store_packages(open_packages(files), folder))
