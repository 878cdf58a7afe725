"""Style inheritance, pickers, edits and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, settle
from .scan import with_positions


def ancestors(styles: DataFrame, keys: tuple[str, ...] = (), id_col: str = "style_id", parent_col: str = "based_on") -> DataFrame:
    """(keys, style_id, ancestor, distance), every style its own ancestor at 0. Cycles are cut, unknown parents end a chain.

    Pointer doubling: round k joins the pairs known so far with the ancestor 2**k steps up, so rounds grow with the
    logarithm of the deepest chain. On a cycle the same pair turns up again farther away; only the nearest is kept, so
    the rounds end when no new pair appears.
    """
    keys = list(keys)
    known = styles.select(*keys, F.col(id_col).alias("ancestor"))
    jump = styles.select(*keys, F.col(id_col).alias("style_id"), F.col(parent_col).alias("ancestor")).join(
        known, [*keys, "ancestor"], "left_semi").select(*keys, "style_id", "ancestor")
    pairs = styles.select(*keys, F.col(id_col).alias("style_id"), F.col(id_col).alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    pairs, jump = settle(pairs), settle(jump)
    step, total = 1, pairs.count()
    while True:
        farther = jump.select(*keys, "style_id", F.col("ancestor").alias("_mid")).join(
            pairs.select(*keys, F.col("style_id").alias("_mid"), "ancestor", (F.col("distance") + step).alias("distance")),
            [*keys, "_mid"]).select(*keys, "style_id", "ancestor", "distance")
        pairs = settle(pairs.unionByName(farther).groupBy(*keys, "style_id", "ancestor").agg(F.min("distance").alias("distance")))
        grown = pairs.count()
        if grown == total:
            return pairs
        total = grown
        jump = settle(jump.select(*keys, "style_id", F.col("ancestor").alias("_mid")).join(
            jump.select(*keys, F.col("style_id").alias("_mid"), "ancestor"), [*keys, "_mid"]).select(*keys, "style_id", "ancestor"))
        step *= 2


def resolve_styles(styles: DataFrame, keys: tuple[str, ...] = (), own_only: bool = False) -> DataFrame:
    """(keys, style_id, prop, value, distance): each style's effective properties, the nearest definition winning.

    ``styles`` has style_id, based_on and props MAP<STRING,STRING>. Text decoration is one property and is overridden
    as a whole. ``own_only`` gives the style's direct properties, as an edit dialog needs them.
    """
    keys = list(keys)
    own = styles.select(*keys, F.col("style_id").alias("ancestor"), F.explode("props").alias("prop", "value")).filter(F.col("value").isNotNull())
    if own_only:
        return own.withColumnRenamed("ancestor", "style_id").withColumn("distance", F.lit(0).cast("long"))
    # Pointer doubling over values: each round a style takes what the ancestor 2**k steps up has found by then, and keeps the
    # nearest value of each property, so there are never more rows than styles times properties. Where some style has its
    # nearest value d steps up, one between them has its own 2**k steps up for each 2**k <= d: a round that finds nothing at
    # 2**k steps or more is the last, on cycles too.
    known = styles.select(*keys, F.col("style_id").alias("ancestor"))
    jump = keep(styles.select(*keys, "style_id", F.col("based_on").alias("ancestor")).join(known, [*keys, "ancestor"], "left_semi").select(*keys, "style_id", "ancestor"), "styles")
    found, step = own.withColumnRenamed("ancestor", "style_id").withColumn("distance", F.lit(0).cast("long")), 1
    while True:
        taken = jump.join(found.withColumnRenamed("style_id", "ancestor"), [*keys, "ancestor"]).select(
            *keys, "style_id", "prop", "value", (F.col("distance") + step).alias("distance"))
        found = keep(found.unionByName(taken).groupBy(*keys, "style_id", "prop").agg(F.min_by(F.struct("value", "distance"), "distance").alias("_v")).select(
            *keys, "style_id", "prop", F.col("_v.value").alias("value"), F.col("_v.distance").alias("distance")), "styles")
        if found.filter(F.col("distance") >= step).isEmpty():
            return found
        jump = keep(jump.withColumnRenamed("ancestor", "_mid").join(
            jump.select(*keys, F.col("style_id").alias("_mid"), "ancestor"), [*keys, "_mid"]).select(*keys, "style_id", "ancestor"), "styles")
        step *= 2


def style_picker(styles: DataFrame) -> DataFrame:
    """Styles offered to a user: no defaults, hidden styles or headings; ``display`` is the name to sort by."""
    heading = F.lower(F.regexp_replace(F.col("style_id").cast("string"), r"\s+|_20_", "")).rlike("^heading[1-9]$")
    hidden = F.coalesce("is_default", F.lit(False)) | F.coalesce("hidden", F.lit(False))
    display = F.replace(F.coalesce("name", F.col("style_id").cast("string")), F.lit("_20_"), F.lit(" "))
    return styles.filter(~hidden & ~heading).withColumn("display", display)


def sorted_picker(styles: DataFrame) -> DataFrame:
    """The picker in display order (one range-partitioned sort)."""
    return style_picker(styles).orderBy(F.lower("display"), "display")


def upsert_styles(styles: DataFrame, edits: DataFrame, modelled: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Apply style edits: a known id has its modelled properties replaced and keeps the rest; an unknown id is added.

    Both tables have keys, style_id, name, based_on and props MAP<STRING,STRING>; ``edits`` has one row per style. An
    edit keeps the name and parent of a known style. Applying the same edits again changes nothing.
    """
    on = [*keys, "style_id"]
    e = edits.select(*on, F.col("name").alias("_name"), F.col("props").alias("_props"), F.lit(True).alias("_hit"))
    both = styles.withColumn("_old", F.lit(True)).join(e, on, "full")
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*modelled))
    new = F.map_filter(F.coalesce("_props", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*modelled) & v.isNotNull())
    edited = F.map_from_entries(F.concat(F.map_entries(kept), F.map_entries(new)))
    return both.select(
        *on, F.when(F.col("_old"), F.col("name")).otherwise(F.col("_name")).alias("name"), "based_on",
        F.when(F.col("_hit"), edited).otherwise(F.col("props")).alias("props"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def effective_style(blocks: DataFrame, named: DataFrame, automatic: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``named_style``: the block's style when it is a named one, else the named parent of its automatic style."""
    keys = list(keys)
    direct = named.select(*keys, "style_id", F.col("style_id").alias("_direct")).distinct()
    parents = automatic.select(*keys, "style_id", F.col("based_on").alias("_auto"))
    return (
        blocks.join(direct, [*keys, "style_id"], "left").join(parents, [*keys, "style_id"], "left")
        .join(direct.select(*keys, F.col("style_id").alias("_auto"), F.col("_direct").alias("_parent")), [*keys, "_auto"], "left")
        .withColumn("named_style", F.coalesce("_direct", "_parent")).drop("_direct", "_auto", "_parent")
    )


def style_signature(props):
    """A style's identity apart from its name: a digest of its sorted properties."""
    return F.sha2(F.array_join(F.array_sort(F.transform(F.map_entries(props), lambda e: F.concat_ws("=", e["key"], e["value"]))), " "), 256)


def reuse_or_mint(targets: DataFrame, existing: DataFrame, target_col: str, id_col: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, target, id, minted): each distinct target reuses the lowest id it already has, or gets the next free one."""
    keys = list(keys)
    have = existing.groupBy(*keys, target_col).agg(F.min(id_col).alias("_id"))
    top = existing.groupBy(*keys).agg(F.max(id_col).alias("_top"))
    wanted = targets.select(*keys, target_col).distinct().join(have, [*keys, target_col], "left")
    fresh = with_positions(wanted.filter(F.col("_id").isNull()), keys, [target_col], name="_n").join(top, keys, "left")
    return wanted.filter(F.col("_id").isNotNull()).select(*keys, target_col, F.col("_id").alias(id_col), F.lit(False).alias("minted")).unionByName(
        fresh.select(*keys, target_col, (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias(id_col), F.lit(True).alias("minted")))
