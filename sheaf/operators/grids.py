"""Tables inside documents: grid columns, spans, shapes, widths and borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from .scan import extent, last_row, running_max, running_sum, scan, spread



def place_cells(cells: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Add ``col`` (0-based) where every grid position is written out: the sum of the spans before the cell in its row.

    The formats bound the width of a row, so a row of cells never needs to be split.
    """
    return scan(cells, [*keys, "row_no"], "cell_no", longest=0, col=running_sum(F.col("colspan"), inclusive=False))


def vmerge_to_rowspan(placed: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Cells with ``rowspan``: a restart cell spans the unbroken ``cont`` cells below it at its grid column.

    Continuation cells are dropped, being covered. Expects ``col`` from ``place_cells``.
    """
    keys = [*keys, "col"]
    longest = extent(placed, "row_no")
    prev = scan(placed, keys, "row_no", longest=longest, _prev=last_row(inclusive=False))
    linked = (F.col("vmerge") == "cont") & (F.col("_prev.at") == F.col("row_no") - 1)
    islands = scan(prev.withColumn("_head", ~F.coalesce(linked, F.lit(False))), keys, "row_no", longest=longest, _top=last_row(F.col("_head")))
    # Islands lie within a column, so this window needs no further shuffle.
    size = F.count("*").over(Window.partitionBy(*keys, "_top.at"))
    return islands.withColumn("_span", size).filter(~F.col("vmerge").eqNullSafe("cont")).select(
        *placed.columns, F.when(F.col("vmerge") == "restart", F.col("_span")).otherwise(1).cast("long").alias("rowspan"))


def place_spanned_cells(cells: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Add ``col`` where covered positions are not written: the first free column given the row spans from above.

    Which columns are free depends on the rows above only as far as their cells reach down. A table is therefore cut
    into bands at the rows no earlier cell reaches, and each band is filled on its own, so a long table spans many tasks.
    """
    keys = list(keys)
    # Column spans and row spans are bounded by the formats, hence so is the work of one band row.
    rows = cells.groupBy(*keys, "row_no").agg(F.max(F.col("row_no") + F.col("rowspan")).alias("_reach"))
    size = cells.agg(F.max("row_no").alias("longest"), F.count("*").alias("rows")).first()
    longest = int(size["longest"] or 0)
    bands = scan(
        scan(rows, keys, "row_no", longest=longest, _open=running_max(F.col("_reach"), inclusive=False))
        .withColumn("_cut", F.coalesce(F.col("_open") <= F.col("row_no"), F.lit(True)).cast("long")),
        keys, "row_no", longest=longest, band=running_sum(F.col("_cut"))).select(*keys, "row_no", "band")

    fields = [f.name for f in cells.schema.fields]
    group = [*keys, "band"]

    def fill(batches):
        now, row, col, taken = None, None, 0, {}
        for pdf in batches:
            cols = []
            for *band, r, width, height in zip(*(pdf[c] for c in (*group, "row_no", "colspan", "rowspan"))):
                if band != now:
                    now, row, taken = band, None, {}
                if r != row:
                    taken = {c: end for c, end in taken.items() if end > r}
                    row, col = r, 0
                while col in taken and taken[col] > r:
                    col += 1
                # A covered column is free again from the row after the span that covers it.
                for c in range(col, col + int(width)):
                    taken[c] = max(taken.get(c, 0), r + int(height))
                cols.append(col)
                col += int(width)
            yield pdf[fields].assign(col=cols)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    by_row = lambda df: spread(df, [*keys, "row_no"], size["rows"])
    banded = by_row(cells).join(by_row(bands), [*keys, "row_no"]).select(*cells.columns, "band")
    ordered = spread(banded, group, size["rows"], always=True).sortWithinPartitions(*group, "row_no", "cell_no")
    return ordered.mapInPandas(fill, f"{schema}, col bigint")


def expand_grid(placed: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """(keys, row, column, anchor_row, anchor_col, text): a cell repeated at every position it covers."""
    return placed.select(
        *keys, F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.col("rowspan") - 1)).alias("grid_row"),
        "col", "colspan", F.col("row_no").alias("anchor_row"), "text",
    ).select(*keys, "grid_row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("grid_col"),
             "anchor_row", F.col("col").alias("anchor_col"), "text")


def table_shape(placed: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Rows, columns (the widest row counts), cells and header rows of each table."""
    header = F.col("is_header") if "is_header" in placed.columns else F.lit(False)
    # Row by row first: distinct counts would deal every cell anew.
    rows = placed.groupBy(*keys, "row_no").agg(
        F.max(F.col("col") + F.col("colspan")).alias("_width"), F.count("*").alias("_cells"), F.bool_or(header).alias("_header"))
    return rows.groupBy(*keys).agg(
        F.count("row_no").alias("n_rows"), F.max("_width").cast("long").alias("n_cols"), F.sum("_cells").alias("n_cells"),
        F.count(F.when(F.col("_header"), F.col("row_no"))).alias("n_header_rows"))


def column_widths(placed: DataFrame, default_px: float = 64, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """(keys, col, width_px): the widest unspanned cell of each column; columns without one get the average of the rest."""
    keys = list(keys)
    size = placed.groupBy(*keys).agg(F.max(F.col("col") + F.col("colspan")).cast("long").alias("_n"))
    single = placed.filter("colspan = 1").groupBy(*keys, "col").agg(F.max("width_px").alias("_w"))
    average = single.filter("_w > 0").groupBy(*keys).agg(F.avg("_w").alias("_avg"))
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("col"))
    joined = grid.join(single, [*keys, "col"], "left").join(average, keys, "left")
    return joined.select(*keys, "col", round_half_up(
        F.coalesce(F.when(F.col("_w") > 0, F.col("_w")), "_avg", F.lit(float(default_px)))).alias("width_px"))


def resolve_cell_borders(cells: DataFrame, borders: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Add border_top, border_right, border_bottom and border_left.

    A side set on the cell wins, ``off`` included. Otherwise an edge of the table takes the table's outer side and an
    inner edge its inside line. ``cells`` has row_no, col, colspan, rowspan and cell_<side>; ``borders`` has keys and
    top, right, bottom, left, inside_h, inside_v. Rows are numbered from ``first_row``.
    """
    keys = list(keys)
    extent = cells.groupBy(*keys).agg(
        F.min("row_no").alias("_r0"), F.max(F.col("row_no") + F.col("rowspan")).alias("_r1"), F.max(F.col("col") + F.col("colspan")).alias("_c1"))
    edge = {
        "top": (F.col("row_no") == F.col("_r0"), "inside_h"), "bottom": (F.col("row_no") + F.col("rowspan") == F.col("_r1"), "inside_h"),
        "left": (F.col("col") == 0, "inside_v"), "right": (F.col("col") + F.col("colspan") == F.col("_c1"), "inside_v"),
    }
    resolved = []
    for side, (at_edge, inside) in edge.items():
        value = F.coalesce(F.col(f"cell_{side}"), F.when(at_edge, F.col(f"_t.{side}")).otherwise(F.col(f"_t.{inside}")))
        resolved.append(F.when(value != "off", value).alias(f"border_{side}"))
    packed = borders.select(*keys, F.struct("top", "right", "bottom", "left", "inside_h", "inside_v").alias("_t"))
    return cells.join(extent, keys).join(packed, keys, "left").select(*cells.columns, *resolved)
