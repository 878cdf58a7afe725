"""Page setup edits, and what each file format can store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round_half_up

# Which features each format can store.
FEATURES = {
    "comments": "docx odt doc", "commentReplies": "docx", "commentReactions": "docx", "trackChanges": "docx odt doc",
    "images": "docx odt doc", "tables": "docx odt doc", "headerFooter": "docx odt doc", "pageBreak": "docx doc",
    "textColor": "docx odt doc", "fontControls": "docx odt doc", "alignment": "docx odt doc", "verticalText": "docx odt doc",
    "fields": "docx odt doc", "equations": "docx odt", "sections": "docx odt doc", "pageNumbering": "docx odt",
    "lineNumbering": "docx odt", "pageVAlign": "docx",
}
# How far a format goes where it is not yes or no.
MODES = {
    ("docx", "sections"): "trailing", ("odt", "sections"): "leading", ("doc", "sections"): "trailing",
    ("docx", "pageNumbering"): "full", ("odt", "pageNumbering"): "format",
    ("docx", "lineNumbering"): "full", ("odt", "lineNumbering"): "basic",
}


def capabilities(spark: SparkSession) -> DataFrame:
    """(format, feature, supported, mode): a dimension of 54 rows, small enough to broadcast anywhere."""
    rows = [(fmt, f, fmt in have.split(), MODES.get((fmt, f))) for f, have in FEATURES.items() for fmt in ("docx", "odt", "doc")]
    return spark.createDataFrame(rows, "format string, feature string, supported boolean, mode string")


def apply_page_setup(sections: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Change the geometry of sections: an edited section takes its size, columns, border and numbering from the edit.

    Orientation follows from width and height. Custom (unequal) columns survive while their number stays the same, else
    columns become equal. Settings the edit leaves unset are removed, not kept. Border widths become eighths of a point
    (at least 2), the border's distance is held to 0..31 points. Sections without an edit only get their orientation.
    """
    e = edits.select(*keys, F.lit(True).alias("_e"), *[F.col(c).alias(f"_{c}") for c in edits.columns if c not in keys])
    both = sections.join(e, keys, "left")
    have = set(edits.columns)
    hit = F.coalesce("_e", F.lit(False))
    w, h = F.when(hit, F.col("_w")).otherwise(F.col("w")), F.when(hit, F.col("_h")).otherwise(F.col("h"))
    count = F.when(hit, F.greatest(F.coalesce("_cols", F.lit(1)), F.lit(1))).otherwise(F.col("cols"))
    kept = (F.col("columns") == "custom") & (count == F.col("cols"))
    border = lambda c: F.when(hit, F.col(f"_{c}")) if c in have else F.lit(None)
    unset = [c for c in ("page_start", "page_format", "line_interval", "line_restart", "line_start", "v_align") if c in sections.columns or c in have]
    settings = [F.when(hit, F.col(f"_{c}") if c in have else F.lit(None)).otherwise(F.col(c) if c in sections.columns else F.lit(None)).alias(c) for c in unset]
    return both.select(
        *keys, w.alias("w"), h.alias("h"), F.when(w > h, "landscape").otherwise("portrait").alias("orient"), count.alias("cols"),
        F.when(~hit | kept, F.col("columns")).otherwise("equal").alias("columns"),
        F.when(border("border_px").isNotNull(), F.greatest(F.lit(2).cast("long"), round_half_up(
            border("border_px").cast("double") * 6))).alias("border_eighths"),
        F.when(border("border_px").isNotNull(), F.least(F.lit(31).cast("long"), F.greatest(F.lit(0).cast("long"), round_half_up(
            F.coalesce(border("border_space_pt").cast("double"), F.lit(24.0)))))).alias("border_space"), *settings)
