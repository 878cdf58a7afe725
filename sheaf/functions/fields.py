"""Field instructions, captions, list markers and page labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Information fields, and the digits of a Roman number.
INFO_FIELDS = ["PAGE", "NUMPAGES", "DATE", "TIME", "AUTHOR", "FILENAME"]
ROMAN_HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
ROMAN_TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
ROMAN_UNITS = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]

REFERENCE = r'(?i)^\s*(REF|PAGEREF)\s+("[^"]+"|\S+)'
SEQUENCE = r"(?i)^\s*SEQ\s+(\S+)"


def reference_target(instruction: Column) -> Column:
    """The bookmark a REF or PAGEREF field points at; null for other fields."""
    name = F.regexp_replace(F.regexp_extract(instruction, REFERENCE, 2), '^"|"$', "")
    return F.when(instruction.rlike(REFERENCE), name)


def reference_format(instruction: Column) -> Column:
    """What a reference shows: direction (with the p switch), page or text; null for other fields."""
    shown = (
        F.when(instruction.rlike(r"(?i)\\p\b"), "direction")
        .when(F.upper(F.regexp_extract(instruction, REFERENCE, 1)) == "PAGEREF", "page")
        .otherwise("text")
    )
    return F.when(instruction.rlike(REFERENCE), shown)


def sequence_name(instruction: Column) -> Column:
    """The sequence a caption-number field counts; null for other fields."""
    return F.when(instruction.rlike(SEQUENCE), F.regexp_extract(instruction, SEQUENCE, 1))


def info_field(instruction: Column) -> Column:
    """PAGE, NUMPAGES, DATE, TIME, AUTHOR or FILENAME; null for other fields."""
    pattern = r"^(PAGE|NUMPAGES|DATE|TIME|AUTHOR|FILENAME)(\s|\\|$)"
    text = F.upper(trim_space(instruction))
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def field_switches(instruction: Column) -> Column:
    """The switches after the field's name, or an empty string."""
    rest = F.trim(F.regexp_replace(F.trim(instruction), r"^\S+\s*", ""))
    return F.when(rest.startswith("\\"), rest).otherwise("")


def field_kind(instruction: Column) -> Column:
    """xref, seq, an information field's name, or null for anything kept as it is."""
    return (
        F.when(instruction.rlike(REFERENCE), "xref").when(instruction.rlike(SEQUENCE), "seq")
        .otherwise(info_field(instruction))
    )


def eq_ruby(instruction: Column) -> Column:
    """STRUCT(base, reading) of an EQ field that draws a phonetic guide; null for other fields."""
    pattern = r"\\up\s*\d+\s*\(([^)]*)\)\s*,\s*([^)]*)\)"
    found = instruction.rlike(r"\bEQ\b") & instruction.rlike(pattern)
    return F.when(found, F.struct(
        F.regexp_extract(instruction, pattern, 2).alias("base"), F.regexp_extract(instruction, pattern, 1).alias("reading")))


def page_number(n: Column, fmt: Column) -> Column:
    """A 1-based page number as decimal, Roman or letters (a..z, aa, ab, ...); below 1 always decimal."""
    n = n.cast("long")
    digit = lambda names, power: F.element_at(
        F.array(*[F.lit(x) for x in names]), (F.floor(n / power) % 10 + 1).cast("int"))
    roman = F.concat(
        F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")),
        digit(ROMAN_HUNDREDS, 100), digit(ROMAN_TENS, 10), digit(ROMAN_UNITS, 1))
    # Letters are bijective base 26; ten places hold every long.
    step = lambda s, _: F.when(
        s["left"] > 0,
        F.struct(
            F.floor((s["left"] - 1) / 26).cast("long").alias("left"),
            F.concat(F.char((F.lit(97) + (s["left"] - 1) % 26).cast("int")), s["text"]).alias("text")),
    ).otherwise(s)
    letters = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)), F.struct(n.alias("left"), F.lit("").alias("text")), step)["text"]
    return (
        F.when((n < 1) | fmt.isNull(), n.cast("string"))
        .when(fmt == "lowerRoman", roman).when(fmt == "upperRoman", F.upper(roman))
        .when(fmt == "lowerLetter", letters).when(fmt == "upperLetter", F.upper(letters))
        .otherwise(n.cast("string"))
    )


def caption_kind(sequence: Column) -> Column:
    """table, equation or figure, by the caption's sequence name; null when there is no sequence."""
    return (
        F.when(sequence.isNull(), F.lit(None).cast("string"))
        .when(F.lower(sequence) == "table", "table").when(F.lower(sequence) == "equation", "equation")
        .otherwise("figure")
    )


def caption_kind_odt(sequence: Column) -> Column:
    """As ``caption_kind`` for sequence names that merely contain the word."""
    return (
        F.when(sequence.isNull(), F.lit(None).cast("string"))
        .when(sequence.rlike("[Tt]able"), "table").when(sequence.rlike("[Ee]quation"), "equation").otherwise("figure")
    )


def caption_text(after_number: Column) -> Column:
    """The caption proper: the text after the number without its leading colon."""
    return trim_space(F.regexp_replace(after_number, r"^\s*:\s*", ""))


# What a list item copied as plain text starts with.
BULLET_MARKER = "^\t?[•▪◦‣·]\t"
NUMBER_MARKER = "^\t?\\d+[.)]\t"


def list_marker(text: Column) -> Column:
    """STRUCT(kind ul/ol, rest) of a paragraph that starts with a typed list marker; null otherwise."""
    rest = F.regexp_replace(text, "^(\t?)([•▪◦‣·]|\\d+[.)])(\t)", "")
    return (
        F.when(text.rlike(BULLET_MARKER), F.struct(F.lit("ul").alias("kind"), rest.alias("rest")))
        .when(text.rlike(NUMBER_MARKER), F.struct(F.lit("ol").alias("kind"), rest.alias("rest")))
    )


def normalise_target(target: Column, base: str = "word/") -> Column:
    """A relationship target as a part path: "/x" is absolute, "./x" and "x" are relative to ``base``."""
    clean = F.regexp_replace(target, r"^\./", "")
    return F.when(clean.startswith("/"), F.substr(clean, F.lit(2))).otherwise(F.concat(F.lit(base), clean))
