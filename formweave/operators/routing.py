"""Choosing among the readings of a document: text layer, located box, full page, four corners.

``readings`` has one row per document and stage (text, boxed, full, corner:<zone>) with n_pairs, score, passes (a
plausible title block) and mentions (a requested label stands in it). ``pages`` has doc_id, large, text_chars, zone
(the located one, null or ``unknown`` if there is none), region (of the located box, null if it is of no use), and on
demand found (whether the locating answer saw a block, true unless said) and forced (a zone, or null). Both carry
``request_id`` where a document may be read for several requests. A stage without a row was not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import zone
from formweave.operators.geometry import named_zone

LEAST_TEXT = 200
#: Fixed order in which corners are tried, after the located one.
CORNERS = ("bottom-right", "bottom-left", "top-right", "top-left")


def route(pages: DataFrame, readings: DataFrame, text_layer: bool = True, locate: bool = True, forced: bool = True) -> DataFrame:
    """``doc_id, mode, corner, quality_passed, attempts, stage``: one row per page.

    The switches leave out the text layer, the located box, or the zones forced on pages.
    """
    keys = [c for c in ("request_id", "doc_id") if c in pages.columns]
    optional = {"found": F.lit(True), "forced": F.lit(None).cast("string")}
    pages = pages.withColumns({c: v for c, v in optional.items() if c not in pages.columns})
    off = lambda on, c, kind: F.col(c) if on else F.lit(None).cast(kind)
    pages = pages.withColumns({"zone": zone(off(locate, "zone", "string")), "region": off(locate, "region", pages.schema["region"].dataType), "forced": off(forced, "forced", "string")})
    reading = F.struct("n_pairs", "score", "passes", "mentions")
    of = lambda stage: F.max(F.when(F.col("stage") == stage, reading))
    at = F.regexp_extract("stage", "^corner:(.*)$", 1)
    fixed = F.array_position(F.array(*map(F.lit, CORNERS)), F.col("at")).cast("int")
    corners = readings.withColumn("at", at).where(F.col("at").isin(*CORNERS)).join(pages.select(*keys, F.when(F.col("found"), F.col("zone")).alias("preferred")), keys)
    corners = corners.withColumn("ord", F.when(F.col("at") == F.col("preferred"), -1).otherwise(fixed))
    rank = lambda *by: F.struct(*by, -F.col("ord"))
    picked = corners.groupBy(*keys).agg(
        F.max_by("at", F.when(F.col("passes"), rank(F.col("mentions").cast("int"), "score"))).alias("best"),
        F.max_by(F.struct("at", "n_pairs", "mentions"), rank(F.col("mentions").cast("int"), "n_pairs")).alias("rich"),
    )
    stages = readings.groupBy(*keys).agg(of("text").alias("text"), of("boxed").alias("boxed"), of("full").alias("full"))
    by_zone = readings.withColumn("forced", at).groupBy(*keys, "forced").agg(F.max("passes").alias("forced_passes"))
    rows = pages.join(stages, keys, "left").join(picked, keys, "left").join(by_zone, [*keys, "forced"], "left")

    good = lambda c: F.coalesce(F.col(f"{c}.passes") & F.col(f"{c}.mentions"), F.lit(False))
    boxed = F.col("region").isNotNull() & F.col("boxed").isNotNull()
    order = lambda c: F.struct(F.col(f"{c}.mentions").cast("int"), F.col(f"{c}.n_pairs"))
    richer = F.col("rich").isNull() | (order("boxed") > order("rich"))
    located, crop = named_zone(F.col("zone"), F.col("region")), "TWO_PASS_CROP"
    true, none = F.lit(True), F.lit(None)

    def row(mode: str, corner: Column, passed: Column, attempts: int, stage: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), corner.cast("string").alias("corner"), F.coalesce(passed, F.lit(False)).alias("quality_passed"), F.lit(attempts).alias("attempts"), stage.cast("string").alias("stage"))

    kept_box = row(crop, located, F.col("boxed.passes"), 1, F.lit("boxed"))
    cases = [
        ((F.col("text_chars") >= LEAST_TEXT) & good("text") if text_layer else F.lit(False), row("TEXT_LAYER", none, true, 1, F.lit("text"))),
        (F.col("large") & F.col("forced").isNotNull(), row(crop, F.col("forced"), F.col("forced_passes"), 1, F.concat(F.lit("corner:"), "forced"))),
        (boxed & good("boxed"), row(crop, located, true, 1, F.lit("boxed"))),
        (~F.col("large") & boxed & (F.col("boxed.n_pairs") > F.coalesce("full.n_pairs", F.lit(0))), kept_box),
        (~F.col("large"), row("SINGLE_PAGE", none, true, 1, F.lit("full"))),
        (F.col("best").isNotNull(), row(crop, F.col("best"), true, 4, F.concat(F.lit("corner:"), "best"))),
        (boxed & richer, kept_box),
        (F.col("rich.n_pairs") > 0, row(crop, F.col("rich.at"), F.lit(False), 4, F.concat(F.lit("corner:"), "rich.at"))),
    ]
    choice = row("NEEDS_TILING", F.coalesce("zone", F.lit("unknown")), F.lit(False), 0, none)
    for condition, chosen in reversed(cases):
        choice = F.when(condition, chosen).otherwise(choice)
    return rows.select(*keys, choice.alias("c")).select(*keys, "c.*")
