"""Text measures, search patterns and normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, and the pattern of a word.
SPACE_CLASS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORD = r"[\p{L}\p{N}'-]+"
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# An ASCII word boundary, written out because Java's \b also treats accented letters as word characters.
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"


def word_count(text: Column) -> Column:
    """Words: maximal runs of letters, digits, apostrophes and hyphens."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def char_count(text: Column) -> Column:
    """Characters (code points) that are not white space. A character table is twice as fast as the pattern here."""
    return F.length(F.translate(text, SPACE_CHARS, "")).cast("long")


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def is_blank(text: Column) -> Column:
    """Nothing but white space, or null."""
    return F.coalesce(F.translate(text, SPACE_CHARS, "") == "", F.lit(True))


def search_pattern(query: str, match_case: bool = False, whole_word: bool = False, regex: bool = False) -> str | None:
    """The Java pattern for a search box entry, or None when the entry is empty.

    Whole-word applies to literal queries only. Case-insensitive search folds ASCII and Unicode letters.
    """
    if not query:
        return None
    body = query if regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", query)
    if whole_word and not regex:
        word = r"[A-Za-z0-9_]"
        # A boundary is a change between word and non-word characters, so which side needs a guard depends on the
        # character of the query at that end.
        first, last = re.match(word, query[0]) is not None, re.match(word, query[-1]) is not None
        body = (NOT_AFTER_WORD if first else "(?<=[A-Za-z0-9_])") + body
        body = body + (NOT_BEFORE_WORD if last else "(?=[A-Za-z0-9_])")
    return body if match_case else "(?iu)" + body


def literal_replacement(text: str) -> str:
    """Escape a replacement so that Java inserts it as it is, without group references."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


# How a clock time and a date look in a cached field.
TIME_TEXT = r"\b\d{1,2}:\d{2}(:\d{2})?\b"
DATE_TEXT = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"


def mask_volatile(text: Column) -> Column:
    """Collapse white space, then replace clock times and dates by placeholders so cached fields compare equal."""
    timed = F.regexp_replace(collapse_space(text), TIME_TEXT, "<time>")
    return F.regexp_replace(timed, DATE_TEXT, "<date>")


def escape_html(text: Column) -> Column:
    """Escape markup in text content; the ampersand first."""
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(text: Column) -> Column:
    """Escape markup in an attribute value."""
    return F.replace(escape_html(text), F.lit('"'), F.lit("&quot;"))


def unescape_html(text: Column) -> Column:
    """Decode the predefined entities; the ampersand last, so that an escaped entity stays text."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def round_half_up(value: Column) -> Column:
    """Round halves towards plus infinity, as the source applications do (Spark's round goes away from zero)."""
    return F.floor(value + F.lit(0.5)).cast("long")
