"""Lengths, colours, borders and other formatting values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_up

# Fixed values of the two file formats: units, colour names and keyword mappings.
PX_PER_UNIT = {"cm": 96 / 2.54, "mm": 96 / 25.4, "in": 96.0, "pt": 96 / 72, "px": 1.0}
INCH_PER_UNIT = {"in": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72, "pc": 1 / 6}
HIGHLIGHT_HEX = {
    "yellow": "FFFF00", "green": "00FF00", "cyan": "00FFFF", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000",
    "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000",
    "darkYellow": "808000", "darkGray": "808080", "lightGray": "C0C0C0", "black": "000000", "white": "FFFFFF",
}
DOCX_ALIGN = {
    "both": "justify", "distribute": "justify", "center": "center", "right": "right", "end": "right",
    "left": "left", "start": "left",
}
ODT_ALIGN = {
    "start": "left", "left": "left", "end": "right", "right": "right", "center": "center", "justify": "justify",
}
ODT_NUMBER_FORMAT = {
    "1": "decimal", "i": "lowerRoman", "I": "upperRoman", "a": "lowerLetter", "A": "upperLetter",
}
ODT_TAB_TYPE = {"left": "left", "center": "center", "right": "right", "char": "decimal"}
DOCX_BORDER_STYLE = {
    "single": "solid", "thick": "solid", "double": "double", "dashed": "dashed", "dotted": "dotted",
    "dashSmallGap": "dashed", "dotDash": "dashed", "dotDotDash": "dashed", "wave": "solid", "doubleWave": "double",
}
ODT_BORDER_STYLE = {
    "solid": "solid", "dashed": "dashed", "dotted": "dotted", "double": "double",
    "groove": "solid", "ridge": "solid", "inset": "solid", "outset": "solid", "fine": "solid",
}
IMAGE_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp",
}
PAGE_NUMBER_FORMATS = ["decimal", "lowerRoman", "upperRoman", "lowerLetter", "upperLetter"]


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table; null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _matched(text: Column, pattern: str, group: int) -> Column:
    """A group of a match, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def to_hex6(colour: Column) -> Column:
    """#rgb, #rrggbb (the # is optional), rgb() or rgba() as six upper-case hex digits; anything else is null."""
    text = F.trim(colour)
    six = _matched(text, r"^#?([0-9a-fA-F]{6})$", 1)
    three = _matched(text, r"^#?([0-9a-fA-F]{3})$", 1)
    doubled = F.regexp_replace(three, "(.)", "$1$1")
    rgb = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    parts = [F.hex(F.regexp_extract(text, rgb, i).cast("long")) for i in (1, 2, 3)]
    padded = [F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p) for p in parts]
    return F.upper(F.coalesce(six, doubled, F.when(text.rlike(rgb), F.concat(*padded))))


def twips_to_px(twips: Column) -> Column:
    """Twentieths of a point to px at 96 dpi."""
    return twips.try_cast("double") / F.lit(15.0)


def emu_to_px(emu: Column) -> Column:
    """English metric units to whole px."""
    return round_half_up(emu.try_cast("double") / F.lit(9525.0))


def length_to_px(length: Column) -> Column:
    """"5.2cm", "48pt", ... to px; null when the unit is unknown."""
    pattern = r"^([0-9.]+)(cm|mm|in|pt|px)$"
    text = F.trim(length)
    number = _matched(text, pattern, 1).try_cast("double")
    return number * lookup(PX_PER_UNIT, F.regexp_extract(text, pattern, 2))


def length_to_inches(length: Column) -> Column:
    """A signed length in in, cm, mm, pt or pc to inches; null otherwise."""
    pattern = r"^(-?[0-9]+(?:\.[0-9]+)?)(in|cm|mm|pt|pc)$"
    number = _matched(length, pattern, 1).try_cast("double")
    return number * lookup(INCH_PER_UNIT, F.regexp_extract(length, pattern, 2))


def font_size_half_points(size: Column) -> Column:
    """A font size in pt or px to half-points."""
    text = F.trim(size)
    points = _matched(text, r"^([0-9.]+)pt$", 1).try_cast("double")
    pixels = _matched(text, r"^([0-9.]+)px$", 1).try_cast("double")
    return F.coalesce(round_half_up(points * 2), round_half_up(pixels * F.lit(1.5)))


def first_font_family(fonts: Column) -> Column:
    """The first family of a CSS list, unquoted; null when empty."""
    return F.nullif(F.regexp_replace(F.trim(F.split(fonts, ",").getItem(0)), r"^['\"]|['\"]$", ""), F.lit(""))


def _border(px: Column, style: Column, hex6: Column) -> Column:
    return F.struct(F.greatest(F.lit(1).cast("long"), px).alias("px"), style.alias("style"), hex6.alias("hex"))


def css_border(value: Column) -> Column:
    """"1px solid #000000" to STRUCT(px, style, hex); null when absent or off."""
    pattern = r"^([0-9.]+)px\s+(\w+)\s+#?([0-9a-fA-F]{6})"
    text = F.trim(value)
    style = F.regexp_extract(text, pattern, 2)
    drawn = text.rlike(pattern) & ~style.isin("none", "hidden")
    px = round_half_up(F.regexp_extract(text, pattern, 1).try_cast("double"))
    return F.when(drawn, _border(px, style, F.upper(F.regexp_extract(text, pattern, 3))))


def docx_table_border(val: Column, size: Column, colour: Column) -> Column:
    """A table or cell border side. Sizes are eighths of a point, six of which make a px here."""
    drawn = val.isNotNull() & ~val.isin("nil", "none", "")
    eighths = F.coalesce(F.nullif(size.try_cast("double"), F.lit(0.0)), F.lit(4.0))
    hex6 = F.when(colour.isNull() | (colour == "auto"), F.lit("000000")).otherwise(F.regexp_replace(colour, "^#", ""))
    return F.when(drawn, _border(round_half_up(eighths / 6), F.coalesce(lookup(DOCX_BORDER_STYLE, val), F.lit("solid")), hex6))


def docx_paragraph_border(val: Column, size: Column, colour: Column) -> Column:
    """A paragraph border side. Sizes are eighths of a point at 96 dpi; an absent kind means a single line."""
    kind = F.coalesce(val, F.lit("single"))
    eighths = F.coalesce(size, F.lit("4")).try_cast("double")
    style = F.when(kind.isin("dashed", "dotted", "double"), kind).otherwise(F.lit("solid"))
    hex6 = F.when(colour.rlike("^[0-9a-fA-F]{6}$"), colour).otherwise(F.lit("000000"))
    return F.when(~kind.isin("nil", "none"), _border(round_half_up(eighths / 8 * (96 / 72)), style, hex6))


def odt_border(value: Column) -> Column:
    """An "0.5pt solid #000000" border, its parts in any order; null when absent or off."""
    text = F.trim(value)
    parts = F.split(text, r"\s+")
    last = lambda picked: F.try_element_at(picked, F.lit(-1))
    styles = F.filter(F.transform(parts, lambda p: lookup(ODT_BORDER_STYLE, F.lower(p))), lambda s: s.isNotNull())
    colours = F.filter(parts, lambda p: F.lower(p).rlike("^#[0-9a-f]{3,8}$"))
    widths = F.filter(F.transform(parts, lambda p: length_to_px(p)), lambda w: w > 0)
    drawn = (text != "") & ~F.lower(text).isin("none", "hidden")
    return F.when(drawn, _border(
        F.coalesce(round_half_up(last(widths)), F.lit(1).cast("long")), F.coalesce(last(styles), F.lit("solid")),
        F.coalesce(F.regexp_replace(last(colours), "^#", ""), F.lit("000000"))))


def flag(present: Column, val: Column) -> Column:
    """An on/off run property: on when present, unless its value switches it off."""
    return F.coalesce(present, F.lit(False)) & ~F.coalesce(val, F.lit("")).isin("false", "0", "none")


def style_flag(present: Column, val: Column) -> Column:
    """The tri-state form used in styles: null when absent, so that a parent's value shows through."""
    return F.when(present, ~F.coalesce(val, F.lit("")).isin("false", "0"))
