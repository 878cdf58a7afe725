"""Plain text and format-independent tables: reading, uniting formats, writing only what changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the manifests.
LOG = "_log"


def read_text_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, text): one block per line; blank lines stay, one trailing line break is dropped. No shuffle."""
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)
    return documents.select("doc_id", F.posexplode(lines).alias("seq", "text"))


def union_formats(*tables: DataFrame) -> DataFrame:
    """One table for all formats; what a format does not know is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def new_or_changed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose (path, content_sha256) is not stored yet: an unchanged document is never written again."""
    return incoming.join(stored.select("path", "content_sha256"), ["path", "content_sha256"], "left_anti")


# --- The log: a manifest per version, each written by one load only ---


def _file_system(spark: SparkSession, path: str):
    """Hadoop's FileContext for ``path``, and its class of paths."""
    context = spark.sparkContext
    to_path = context._jvm.org.apache.hadoop.fs.Path
    return context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to_path(path).toUri(), context._jsc.hadoopConfiguration()), to_path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all manifests, ascending."""
    files, to_path = _file_system(spark, path)
    log = to_path(f"{path}/{LOG}")
    if not files.util().exists(log):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str, version: int) -> list[str]:
    """The loads that a version is made of, oldest first."""
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/{LOG}/{version:012d}.json").collect()))["loads"]


def _commit(spark: SparkSession, path: str, version: int, loads: list[str]) -> bool:
    """Makes ``loads`` the version, unless some other load has taken that number already: then nothing happens."""
    files, to_path = _file_system(spark, path)
    jvm, target = spark.sparkContext._jvm, to_path(f"{path}/{LOG}/{version:012d}.json")
    draft = to_path(f"{path}/{LOG}/.{uuid.uuid4().hex}")
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    fs = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(json.dumps({"loads": loads}).encode())
    out.close()
    try:
        files.rename(draft, target, no_options)  # fails where the target exists
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        files.delete(draft, False)
        return False


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """The newest version (or the one named) and its loads; -1 and none before anything was loaded."""
    known = _versions(spark, path)
    if version is None and not known:
        return -1, []
    version = known[-1] if version is None else version
    return version, _manifest(spark, path, version)


def _loads(spark: SparkSession, path: str, name: str, loads: list[str]) -> DataFrame:
    """The rows of a table that ``loads`` wrote, with the load of each."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/load={x}" for x in loads])


def _newest(docs: DataFrame) -> DataFrame:
    """The row of each path that the newest load wrote; a null content_sha256 says that the document is gone."""
    rest = [c for c in docs.columns if c != "path"]
    newest = docs.groupBy("path").agg(F.max_by(F.struct(*rest), "load").alias("_r"))
    return newest.select("path", "_r.*").filter("content_sha256 is not null")


def read_lake(spark: SparkSession, path: str, name: str = "docs", version: int | None = None) -> DataFrame:
    """The current rows of a table: those of each document's newest version. ``load`` tells which load wrote them.

    The rows are those of one version of the lake, the newest or the one given; later loads do not change what is read.
    """
    _, loads = snapshot(spark, path, version)
    docs = _loads(spark, path, "docs", loads)
    if name == "docs":
        return _newest(docs)
    ids = _newest(docs.select("path", "doc_id", "content_sha256", "load")).select("doc_id", "load")
    return _loads(spark, path, name, loads).join(ids, ["doc_id", "load"], "left_semi")


def load_increment(spark: SparkSession, docs: DataFrame, tables: Mapping[str, DataFrame], path: str, whole: bool = False) -> DataFrame:
    """Store the documents that are new or changed, with only their rows of the other tables; returns those documents.

    A load writes folders of its own and then takes the next version number with a manifest of all loads that count. Readers go
    by the newest manifest, so they see a load completely or not at all. Of two loads at once one takes the number; the other
    starts afresh from what the first has stored. Folders of loads that failed or lost are in no manifest (``vacuum``). With
    ``whole``, ``docs`` is the whole corpus, and stored documents that it lacks are marked as gone.
    """
    while True:
        version, loads = snapshot(spark, path)
        load, changed = _write_load(spark, docs, tables, path, whole, version + 1, loads)
        if load is None or _commit(spark, path, version + 1, [*loads, load]):
            return changed


def _write_load(spark: SparkSession, docs: DataFrame, tables: Mapping[str, DataFrame], path: str, whole: bool, number: int, loads: list[str]) -> tuple[str | None, DataFrame]:
    """The folder name of what ``docs`` adds to ``loads``, and the documents in it; no name if nothing has changed."""
    changed, gone = docs, None
    if loads:
        # What is stored is told by its ids: contents are neither compared nor moved, and a document that is gone leaves none.
        stored = _loads(spark, path, "docs", loads)
        current = _newest(stored.select(*[c for c in ("path", "doc_id", "format", "content_sha256", "load") if c in stored.columns]))
        changed = new_or_changed(docs, current)
        if whole:
            gone = current.join(docs.select("path"), "path", "left_anti").withColumn("content_sha256", F.lit(None).cast("string")).drop("load")
    written = changed if gone is None else changed.unionByName(gone, allowMissingColumns=True)
    if written.select("path").isEmpty():
        return None, docs.limit(0)
    load = f"{number:09d}-{uuid.uuid4().hex[:16]}"
    put = lambda name, df: (df.write.partitionBy("format") if "format" in df.columns else df.write).parquet(f"{path}/{name}/load={load}")
    put("docs", written)
    added = spark.read.schema(written.schema).parquet(f"{path}/docs/load={load}").filter("content_sha256 is not null")
    for name, df in tables.items():
        put(name, df.join(added.select("doc_id"), "doc_id", "left_semi"))
    return load, added


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Drops loads without a visible document from the lake and deletes the folders, by name, that none of the newest ``keep``
    versions needs. Loads that mark documents as gone stay while an older load does, as they hide its rows.

    Only run it while no load is under way: the folders of one that has not committed yet look like those of one that failed.
    """
    version, loads = snapshot(spark, path)
    if not loads:
        return []
    docs = _loads(spark, path, "docs", loads).select("path", "content_sha256", "load")
    seen = {r.load for r in _newest(docs).select("load").distinct().collect()}
    hiding = {r.load for r in docs.where("content_sha256 is null").select("load").distinct().collect()}
    live = [x for k, x in enumerate(loads) if x in seen or x in hiding and any(y in seen for y in loads[:k])]
    if live != loads and not _commit(spark, path, version + 1, live):
        return []  # a load has come in between
    wanted = {x for v in _versions(spark, path)[-keep:] for x in _manifest(spark, path, v)}
    files, to_path = _file_system(spark, path)
    dropped = []
    for table in files.util().listStatus(to_path(path)):
        if table.isDirectory() and table.getPath().getName() != LOG:
            for folder in files.util().listStatus(table.getPath()):
                name = folder.getPath().getName()
                if name.startswith("load=") and name.removeprefix("load=") not in wanted:
                    files.delete(folder.getPath(), True)
                    dropped.append(f"{table.getPath().getName()}/{name}")
    return sorted(dropped)
