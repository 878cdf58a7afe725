"""Comment threads, reactions and the merging of comment edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..session import settle
from .scan import running_sum, scan

# How reactions are written as lines of a comment.
REACTION_HEADER = r"(?iu)^\s*(nombre total de r[ée]actions|total reactions|r[ée]actions)\s*:"
REACTION_LINE = r"(?iu)^\s*(.+?)\s+(?:a r[ée]agi avec|reacted with)\s+(\S+)"


def comment_threads(comments: DataFrame) -> DataFrame:
    """Add ``thread_id`` and ``is_reply``; comments that belong to no thread and are never referenced are dropped.

    Comments are walked by ``ref_ord``, their first reference in the body. One whose parent is already a thread becomes
    its reply; any other becomes a thread itself, so a reply to a reply, or one referenced before its parent, is
    promoted. A comment never referenced is only kept as a reply of a thread.

    A comment is therefore a thread exactly when the chain of parents above it, following only parents referenced
    earlier, has even length. The parity of all chains is found by pointer doubling: each round halves every chain, so
    the number of joins grows with the logarithm of the deepest chain, and the widest thread only meets one parent row.
    """
    holder = comments.filter(F.col("para_id").isNotNull()).groupBy("doc_id", "para_id").agg(
        F.max_by(F.struct(F.col("comment_id").alias("parent"), F.col("ref_ord").alias("parent_ord")), F.col("comment_id")).alias("_p"))
    linked = comments.join(
        holder.select("doc_id", F.col("para_id").alias("parent_para_id"), "_p.parent", "_p.parent_ord"),
        ["doc_id", "parent_para_id"], "left")
    earlier = F.col("parent_ord") < F.col("ref_ord")
    state = settle(linked.filter(F.col("ref_ord").isNotNull()).select(
        "doc_id", "comment_id", F.when(earlier, F.col("parent")).alias("up"), F.when(earlier, 1).otherwise(0).alias("odd")))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        above = state.select("doc_id", F.col("comment_id").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        state = settle(state.join(above, ["doc_id", "up"], "left").select(
            "doc_id", "comment_id", F.col("_up").alias("up"), (F.col("odd") + F.coalesce("_odd", F.lit(0))).alias("odd")
        ).withColumn("odd", F.col("odd") % 2))
    is_reply = state.select("doc_id", "comment_id", (F.col("odd") == 1).alias("is_reply"))
    threads = is_reply.filter(~F.col("is_reply")).select("doc_id", F.col("comment_id").alias("parent"), F.lit(True).alias("_t"))
    placed = linked.join(is_reply, ["doc_id", "comment_id"], "left").join(threads, ["doc_id", "parent"], "left")
    unreferenced = F.col("ref_ord").isNull()
    reply = F.when(unreferenced, F.col("_t")).otherwise(F.col("is_reply"))
    return (
        placed.filter(~unreferenced | F.col("_t"))
        .withColumn("is_reply", reply)
        .withColumn("thread_id", F.when(F.col("is_reply"), F.col("parent")).otherwise(F.col("comment_id")))
        .select(*comments.columns, "thread_id", "is_reply")
    )


def reaction_lines(comments: DataFrame) -> DataFrame:
    """Reactions written as lines of a comment: (doc_id, comment_id, para_no, emoji, person)."""
    lines = comments.select("doc_id", "comment_id", F.posexplode("paras").alias("para_no", "para"))
    hit = F.col("para").rlike(REACTION_LINE) & ~F.col("para").rlike(REACTION_HEADER)
    return lines.filter(hit).select(
        "doc_id", "comment_id", "para_no", F.regexp_extract("para", REACTION_LINE, 2).alias("emoji"),
        F.trim(F.regexp_extract("para", REACTION_LINE, 1)).alias("person"))


def reactions(comments: DataFrame) -> DataFrame:
    """(doc_id, comment_id, emoji, first_para, people): people per emoji in the order in which they reacted."""
    return reaction_lines(comments).groupBy("doc_id", "comment_id", "emoji").agg(
        F.min("para_no").alias("first_para"),
        F.transform(F.sort_array(F.collect_list(F.struct("para_no", "person"))), lambda r: r["person"]).alias("people"))


def comment_text(paras: Column) -> Column:
    """The comment without its reaction lines and their headers."""
    return trim_space(F.array_join(
        F.filter(paras, lambda p: ~p.rlike(REACTION_HEADER) & ~p.rlike(REACTION_LINE)), "\n"))


def thread_rollup(threaded: DataFrame, reaction_rows: DataFrame | None = None) -> DataFrame:
    """Per thread: replies, participants, resolved, last activity and, when given, reactions."""
    rolled = threaded.groupBy("doc_id", "thread_id").agg(
        F.sum(F.col("is_reply").cast("long")).alias("replies"), F.countDistinct("author").alias("participants"),
        F.bool_or(~F.col("is_reply") & F.coalesce("done", F.lit(False))).alias("resolved"),
        F.max("ref_ord").alias("last_ref"))
    if reaction_rows is None:
        return rolled
    counted = reaction_rows.join(threaded.select("doc_id", "comment_id", "thread_id"), ["doc_id", "comment_id"]).groupBy(
        "doc_id", "thread_id").agg(F.count("*").alias("reactions"))
    return rolled.join(counted, ["doc_id", "thread_id"], "left").withColumn("reactions", F.coalesce("reactions", F.lit(0)))


def next_ids(existing: DataFrame, new: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Give ``new`` rows ids after the largest numeric id already present per key; ids that are not numbers are ignored."""
    top = existing.groupBy(*keys).agg(F.max(F.col(id_col).try_cast("long")).alias("_top"))
    numbered = scan(new, keys, order, _n=running_sum(F.lit(1)))
    return numbered.join(top, keys, "left").withColumn(id_col, F.coalesce(F.col("_top") + 1, F.lit(0)) + F.col("_n") - 1).drop("_top", "_n")


LAST_WINS = ("done", "edited")


def merge_comment_edits(log: DataFrame) -> DataFrame:
    """One row (doc_id, kind, key, value) per edit key: the last write for done and edited, the first for the others.

    Arrival order is (ts, event_id). Delivering an edit twice changes nothing. Rows without a readable value are
    skipped: a reaction or a reply must be JSON, done must be true or false.
    """
    readable = (
        F.when(F.col("kind").isin("reaction", "reply"), F.get_json_object("value", "$").isNotNull())
        .when(F.col("kind") == "done", F.col("value").isin("true", "false"))
        .when(F.col("kind").isin("deleted", "edited"), F.col("value").isNotNull()).otherwise(False))
    return merge_keyed(log.filter(readable))


def merge_keyed(log: DataFrame) -> DataFrame:
    """The merge rule on rows that are known to be readable."""
    clock = F.struct("ts", "event_id")
    merged = log.groupBy("doc_id", "kind", "key").agg(
        F.min_by("value", clock).alias("_first"), F.max_by("value", clock).alias("_last"))
    return merged.select("doc_id", "kind", "key", F.when(F.col("kind").isin(*LAST_WINS), F.col("_last")).otherwise(F.col("_first")).alias("value"))


def apply_comment_edits(comments: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply merged edits to (doc_id, comment_id, thread_id, is_reply, author, text, para_id, parent_para_id, done).

    ``edits`` is the outcome of ``merge_comment_edits``: a reply's value is JSON {id, paraId, parentParaId, author,
    text}, an edit's value the new text, a done key the thread's para_id, a deleted key a comment id. Order: edited,
    replies, done, deleted. Deleting a thread deletes its members. Unlike a word-processor file, which drops the other
    paragraphs of an edited comment and so may orphan its replies, ``para_id`` stays as it is.
    """
    pick = lambda kind: edits.filter(F.col("kind") == kind)
    edited = pick("edited").select("doc_id", F.col("key").cast("long").alias("comment_id"), F.col("value").alias("_text"))
    reply = F.from_json("value", "id bigint, paraId string, parentParaId string, author string, text string")
    replies = pick("reply").select("doc_id", reply.alias("r")).filter("r.id is not null").select(
        "doc_id", F.col("r.id").alias("comment_id"), F.col("r.author").alias("author"), F.col("r.text").alias("text"),
        F.col("r.paraId").alias("para_id"), F.col("r.parentParaId").alias("parent_para_id"))
    done = pick("done").select("doc_id", F.col("key").alias("para_id"), (F.col("value") == "true").alias("_done"))
    gone = pick("deleted").select("doc_id", F.col("key").cast("long").alias("_gone"))
    kept = comments.join(edited, ["doc_id", "comment_id"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    owners = kept.filter(~F.col("is_reply")).select("doc_id", F.col("para_id").alias("parent_para_id"), F.col("comment_id").alias("thread_id"))
    added = replies.join(kept.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti").join(
        owners, ["doc_id", "parent_para_id"]).withColumn("is_reply", F.lit(True)).withColumn("done", F.lit(False))
    every = kept.unionByName(added.select(*kept.columns)).join(done, ["doc_id", "para_id"], "left").withColumn(
        "done", F.coalesce("_done", "done")).drop("_done")
    no_self = every.join(gone, (every["doc_id"] == gone["doc_id"]) & (every["comment_id"] == gone["_gone"]), "left_anti")
    return no_self.join(gone, (no_self["doc_id"] == gone["doc_id"]) & (no_self["thread_id"] == gone["_gone"]), "left_anti").select(*comments.columns)
