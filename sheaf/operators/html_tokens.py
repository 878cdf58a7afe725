"""Pages cut into tags and text by one pass over their characters, with what encloses each token.

The reader is in one of four states: in text, in a tag, in a comment, or in an element whose content is not document text. So a
comment that holds a script is a comment, and a script that holds a comment is a script. Skipped elements may lie in each other;
one that is never closed is skipped to the end of the page if its content is raw text, and else read as if its tag were unknown.
Text on both sides of something left out is one token. A page is one row in one task and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary pasted pages are reduced to.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "body", "html",
]
SKIP_PAIRED = [
    "script", "style", "noscript", "template", "head", "title", "iframe", "object", "video", "audio", "svg", "math",
    "select", "textarea", "button", "colgroup",
]
SKIP_VOID = ["meta", "link", "embed", "input", "col"]
RAW_TEXT = ["script", "style", "title", "textarea", "iframe"]
INLINE_TAGS = {
    "b": ["b", "strong"], "i": ["i", "em"], "u": ["u", "ins"], "s": ["s", "strike", "del"], "sub": ["sub"], "sup": ["sup"],
    "mono": ["code", "kbd", "samp", "tt"],
}

#: A comment, the declaration of the document, a tag, text, or a character that opens nothing.
_PIECE = re.compile(r"""<!--.*?-->|<!doctype\b[^>]*>|<(/?)([a-z][a-z0-9]*)?[^<>"']*+(?:"[^"]*"[^<>"']*+|'[^']*'[^<>"']*+)*+>|[^<]++|<""", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TEXT}
_STYLE = re.compile(r"""\sstyle\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S | re.I)
_NORMAL = re.compile(r"font-weight\s*:\s*(?:normal|400)", re.I)
_COUNTED = {**{t: f"n_{k}" for k, tags in INLINE_TAGS.items() for t in tags}, "ul": "n_list", "ol": "n_list", "table": "n_table",
            "blockquote": "n_quote", "pre": "n_pre"}
COUNTS = [*[f"n_{k}" for k in INLINE_TAGS], "n_list", "n_table", "n_quote", "n_pre"]


def cut(html: str) -> Iterator[tuple[str, str | None, bool]]:
    """(token, tag, closing) in order; text has no tag."""
    text, at = [], 0
    while m := _PIECE.match(html, at):
        token, at = m[0], m.end()
        tag = (m[2] or "").lower()
        if token.startswith("<!--") or token[:9].lower() == "<!doctype":
            continue
        if tag in SKIP_VOID:
            continue
        if tag in SKIP_PAIRED and not m[1] and (end := _end_of(html, tag, at)):
            at = end
            continue
        if token[0] != "<":
            text.append(token)
            continue
        if text:
            yield "".join(text), None, False
            text = []
        yield token, tag or None, bool(m[1])
    if text:
        yield "".join(text), None, False


def _end_of(html: str, tag: str, at: int) -> int:
    """Where the content of a skipped element that opened before ``at`` ends, its end tag included; 0 if it has no end."""
    if tag in _RAW_END:
        m = _RAW_END[tag].search(html, at)
        return m.end() if m else len(html)
    depth = 1
    while m := _PIECE.match(html, at):
        at, inner = m.end(), (m[2] or "").lower()
        if inner == tag:
            depth += -1 if m[1] else 1
            if not depth:
                return at
        elif inner in _RAW_END and not m[1]:
            at = _end_of(html, inner, at)
    return 0


def _bold_is_off(token: str) -> bool:
    m = _STYLE.search(token)
    return bool(m and _NORMAL.search(unescape(m[1] or m[2] or m[3] or "")))


def context(html: str) -> Iterator[tuple]:
    """Every token with its number and what is open there; see ``html.html_context``."""
    count = dict.fromkeys(COUNTS, 0)
    bold, outer = 0, None
    link = block = (None, None, None, None)
    wrappers: dict[int, bool] = {}  # by depth of bold elements, whether the last one opened there says that it is none
    items, lists, cells, tables, rows = {}, {}, {}, {}, {}  # the last one at each depth of lists or tables
    for at, (token, tag, closing) in enumerate(cut(html)):
        if tag:
            name = _COUNTED.get(tag)
            if name:
                count[name] += -1 if closing else 1
            if name == "n_b":
                if closing:
                    bold -= 0 if wrappers.get(count["n_b"] + 1, False) else 1
                else:
                    off = wrappers[count["n_b"]] = _bold_is_off(token)
                    bold += 0 if off else 1
            in_list, in_table = count["n_list"], count["n_table"]
            if tag == "a":
                link = at, tag, closing, token
            if tag in _BLOCKS:
                block = at, tag, closing, token
            if tag == "li" or name == "n_list" and not closing:
                items[in_list] = at, tag, closing
                if tag != "li":
                    lists[in_list] = tag
            if tag in _CELLS:
                cells[in_table] = at, tag, closing
                if not closing and tag == "table":
                    tables[in_table] = at
                    if in_table == 1:
                        outer = at
                elif not closing and tag == "tr":
                    rows[in_table] = rows.get(in_table, 0) + 1
        in_list, in_table = count["n_list"], count["n_table"]
        yield (at, token, tag, closing, *count.values(), bold, *link, *block, *items.get(in_list, _NOTHING), lists.get(in_list),
               *cells.get(in_table, _NOTHING), tables.get(in_table), rows.get(in_table, 0), outer)


_BLOCKS, _CELLS, _NOTHING = frozenset(BLOCK_TAGS), frozenset(("td", "th", "tr", "table")), (None, None, None)
_PLACED = [("link", True), ("block", True), ("item", False), ("cell", False)]
_COLUMNS = [
    ("tok_no", pa.int32()), ("token", pa.string()), ("tag", pa.string()), ("closing", pa.bool_()),
    *[(c, pa.int64()) for c in COUNTS], ("n_bold", pa.int64()),
    *[(f"{n}_{f}", t) for n, long in _PLACED[:2] for f, t in (("at", pa.int32()), ("tag", pa.string()), ("closing", pa.bool_()), ("token", pa.string()))],
    *[(f"item_{f}", t) for f, t in (("at", pa.int32()), ("tag", pa.string()), ("closing", pa.bool_()))], ("list_tag", pa.string()),
    *[(f"cell_{f}", t) for f, t in (("at", pa.int32()), ("tag", pa.string()), ("closing", pa.bool_()))],
    ("table_at", pa.int32()), ("row_no", pa.int64()), ("outer_at", pa.int32()),
]
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}
TOKENS_AT_ONCE = 4096


def read_pages(pages: DataFrame, context_too: bool = True) -> DataFrame:
    """A row per token of every page: page_id and the columns of ``context``, or only those of the token. A null page has none.

    Pages become Python values one at a time, and only some thousand tokens are held at once.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    columns = _COLUMNS if context_too else _COLUMNS[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = context if context_too else lambda html: ((at, *token) for at, token in enumerate(cut(html)))
        for batch in batches:
            type_, ids, held = batch.schema.field(0).type, [], []

            def flush():
                values = [pa.array(c, t) for c, (_, t) in zip(zip(*held), columns)]
                return pa.RecordBatch.from_arrays([pa.array(ids, type_), *values], names=["page_id", *[n for n, _ in columns]])

            for page_id, html in zip(batch.column(0), batch.column(1)):
                page_id = page_id.as_py()
                for row in read(html.as_py() or ""):
                    ids.append(page_id)
                    held.append(row)
                    if len(held) == TOKENS_AT_ONCE:
                        yield flush()
                        ids, held = [], []
            if held:
                yield flush()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, " + ", ".join(f"{n} {_SQL[t]}" for n, t in columns))


def read_context(pages: DataFrame) -> DataFrame:
    """``read_pages`` with what belongs together as structs, null where there is none."""
    rows = read_pages(pages)
    structs = {"link": ("at", "tag", "closing", "token"), "block": ("at", "tag", "closing", "token"), "item": ("at", "tag", "closing"), "cell": ("at", "tag", "closing")}
    return rows.select(
        "page_id", "tok_no", "token", "tag", "closing", *COUNTS, "n_bold",
        *[F.when(F.col(f"{n}_at").isNotNull(), F.struct(*[F.col(f"{n}_{f}").alias(f) for f in fields])).alias(n) for n, fields in structs.items()],
        "list_tag", "table_at", "row_no", "outer_at")
