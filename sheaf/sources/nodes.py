"""Small vocabulary for queries over XML nodes: where a node sits, and what encloses it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def up(n: int) -> Column:
    """Tag of the n-th ancestor."""
    return F.try_element_at("trail", F.lit(-1 - n))


def id_up(n: int) -> Column:
    """Id of the n-th ancestor."""
    return F.try_element_at("ids", F.lit(-1 - n))


def at(*tags: str) -> Column:
    """The node is the last of ``tags``, a child of the one before it, and so on."""
    test = F.col("tag") == tags[-1]
    for n, t in enumerate(reversed(tags[:-1]), 1):
        test = test & (up(n) == t)
    return F.coalesce(test, F.lit(False))


def inside(*tags: str) -> Column:
    """Id of the innermost enclosing (or same) element with one of ``tags``, or null.

    Ids grow towards the node, so the innermost of several is the greatest; a tag that is not there has position 0, which lies
    beyond the array. Every part stands here once: a filter by it is evaluated as it is written.
    """
    near = [F.get("ids", (F.size("ids") - F.array_position(F.reverse("trail"), t)).cast("int")) for t in tags]
    return F.greatest(*near) if len(near) > 1 else near[0]


def path_below(tag: str) -> Column:
    """Tags between the innermost enclosing (or same) ``tag`` and the node, which is the last of them, joined by slashes."""
    n = F.array_position(F.reverse("trail"), tag).cast("int") - 1
    return F.array_join(F.slice("trail", F.size("trail") - n + 1, F.greatest(n, F.lit(0))), "/")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def pick(where: Column, value: Column, last: bool = False) -> Column:
    """Aggregate: ``value`` of the first (or last) node in document order that satisfies ``where``."""
    return (F.max_by if last else F.min_by)(F.struct(value.alias("v")), F.when(where, F.col("node_id")))["v"]


def present(where: Column) -> Column:
    """Aggregate: some node satisfies ``where``."""
    return F.coalesce(F.bool_or(where), F.lit(False))


def joined_text(where: Column, text: Column) -> Column:
    """Aggregate: texts of the nodes satisfying ``where``, in document order. Meant for one paragraph, cell or note."""
    rows = F.array_sort(F.collect_list(F.when(where, F.struct(F.col("node_id").alias("n"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "")


#: Parts of one kind in a package: the folders of the node store. Names the formats prescribe.
PART_CLASSES = {
    "body": r"word/document\.xml", "notes": r"word/(?:foot|end)notes\.xml", "bands": r"word/(?:header|footer)[0-9]*\.xml",
    "comments": r"word/comments\.xml", "comment_threads": r"word/commentsExtended\.xml", "styles": r"word/styles\.xml",
    "numbering": r"word/numbering\.xml", "settings": r"word/settings\.xml", "links": r".*\.rels", "content": r"content\.xml",
    "odt_styles": r"styles\.xml",
}


def class_of(part: str | None) -> str:
    """The class of a part by its name; other where it has none, none where there is no part."""
    if part is None:
        return "none"
    return next((name for name, pattern in PART_CLASSES.items() if re.match(f"^(?:{pattern})$", part)), "other")


def part_nodes(nodes: DataFrame, *classes: str) -> DataFrame:
    """Nodes of the parts of one of ``classes``. In a node store each class is a folder of its own, so no other is read."""
    return nodes.filter(F.col("part_class").isin(*classes))
