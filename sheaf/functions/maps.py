"""Keyword mappings between the formats and the document vocabulary, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import DOCX_ALIGN, HIGHLIGHT_HEX, ODT_ALIGN, ODT_NUMBER_FORMAT, ODT_TAB_TYPE, lookup


def highlight_hex(name: Column) -> Column:
    """A named highlight as six hex digits."""
    return lookup(HIGHLIGHT_HEX, name)


def highlight_name(hex6: Column) -> Column:
    """The named highlight of a colour; null when the colour has none."""
    return lookup({h: n for n, h in HIGHLIGHT_HEX.items()}, F.upper(hex6))


def docx_align(value: Column) -> Column:
    return lookup(DOCX_ALIGN, value)


def odt_align(value: Column) -> Column:
    return lookup(ODT_ALIGN, value)


def odt_number_format(value: Column) -> Column:
    return lookup(ODT_NUMBER_FORMAT, value)


def odt_tab_type(value: Column) -> Column:
    return F.coalesce(lookup(ODT_TAB_TYPE, F.coalesce(value, F.lit("left"))), F.lit("left"))
