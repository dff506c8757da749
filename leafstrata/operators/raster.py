"""Raster operators in relational form: one row a pixel, windows for scans, groups for histograms.

This form is the specification that SQL can check. Whole rendered pages go through
``kernels``, which give the same results without exploding pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.currentRow)


def channels(argb: str = "argb") -> tuple[Column, Column, Column]:
    c = F.col(argb)
    return tuple(F.shiftright(c, s).bitwiseAND(255) if s else c.bitwiseAND(255) for s in (16, 8, 0))


def luma(px: DataFrame) -> DataFrame:
    """Integer luma (77 r + 150 g + 29 b) >> 8 of ``argb``, with the channels."""
    r, g, b = channels()
    return px.withColumns({"r": r, "g": g, "b": b}).withColumn("gray", F.shiftright(77 * F.col("r") + 150 * F.col("g") + 29 * F.col("b"), 8))


def tile_histogram(px: DataFrame, tile: int) -> DataFrame:
    """Counts of each gray value per tile; edge tiles are partial."""
    return px.groupBy("page_no", F.expr(f"y div {tile}").cast("int").alias("ty"), F.expr(f"x div {tile}").cast("int").alias("tx"), "gray").agg(F.count("*").alias("n"))


def tile_percentile(hist: DataFrame, share: float) -> DataFrame:
    """Per tile the smallest value whose cumulative count reaches trunc(count * share); 0 where that is 0."""
    of = Window.partitionBy("page_no", "ty", "tx")
    cum = hist.withColumn("cum", F.sum("n").over(of.orderBy("gray").rowsBetween(*ALL))).withColumn("target", F.floor(F.sum("n").over(of) * F.lit(share)))
    return cum.groupBy("page_no", "ty", "tx").agg(
        F.when(F.first("target") == 0, 0).otherwise(F.min(F.when(F.col("cum") >= F.col("target"), F.col("gray")))).cast("int").alias("bg")
    )


def background_surface(px: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Bilinear background level of each pixel from its four tiles, in integers.

    The sample position is displaced by half a tile, as in the original computation. Each
    tile carries its neighbours, so that pixels join tiles once.
    """
    right, down = Window.partitionBy("page_no", "ty").orderBy("tx"), Window.partitionBy("page_no", "tx").orderBy("ty")
    near = tiles.withColumn("b00", F.col("bg")).withColumn("b01", F.coalesce(F.lead("bg").over(right), F.col("bg")))
    near = near.withColumn("b10", F.coalesce(F.lead("b00").over(down), F.col("b00"))).withColumn("b11", F.coalesce(F.lead("b01").over(down), F.col("b01")))
    last = tiles.groupBy("page_no").agg(F.max("ty").alias("last_ty"), F.max("tx").alias("last_tx"))
    near = near.join(last, "page_no").drop("bg")
    # a pixel samples the tile its displaced position lies in; positions beyond the last tile stay with it
    at = px
    for a in ("y", "x"):
        at = at.withColumn(f"s{a}", F.col(a) + tile // 2)
    edge = at.join(last, "page_no")
    for a in ("y", "x"):
        edge = edge.withColumn(f"t{a}", F.least(F.expr(f"s{a} div {tile}"), F.col(f"last_t{a}")).cast("int"))
        edge = edge.withColumn(f"f{a}", F.least(F.col(f"s{a}") - F.col(f"t{a}") * tile, F.lit(tile - 1)))
    got = edge.drop("last_ty", "last_tx").join(near.drop("last_ty", "last_tx"), ["page_no", "ty", "tx"])
    top, bottom = f"(b00 * ({tile} - fx) + b01 * fx)", f"(b10 * ({tile} - fx) + b11 * fx)"
    surface = F.expr(f"({top} * ({tile} - fy) + {bottom} * fy) div {tile * tile}").cast("int")
    return got.select(*px.columns, surface.alias("surface"))


def normalise(surfaced: DataFrame) -> DataFrame:
    """gray * 255 div surface, at most 255; gray itself on a zero surface."""
    return surfaced.withColumn("norm", F.when(F.col("surface") == 0, F.col("gray")).otherwise(F.least(F.lit(255), F.expr("gray * 255 div nullif(surface, 0)"))).cast("int"))


def normalised_pages(px: DataFrame, tile: int, share: float) -> DataFrame:
    return normalise(background_surface(px, tile_percentile(tile_histogram(px, tile), share), tile))


def otsu_threshold(px: DataFrame, value: str = "norm") -> DataFrame:
    """Per page the first value of largest between-class variance of ``value``; 0 if none is positive."""
    hist = px.groupBy("page_no", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    page = Window.partitionBy("page_no")
    run = page.orderBy("v").rowsBetween(*ALL)
    s = hist.select(
        "page_no", "v",
        F.sum("n").over(run).alias("wb"), F.sum("n").over(page).alias("total"),
        F.sum(F.col("v") * F.col("n")).over(run).cast("double").alias("sb"), F.sum(F.col("v") * F.col("n")).over(page).cast("double").alias("s"),
    ).withColumn("wf", F.col("total") - F.col("wb"))
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(F.col("wf") > 0, F.col("wf"))
    scored = s.withColumn("variance", F.col("wb").cast("double") * F.col("wf") * gap * gap)
    best = F.max(F.when(F.col("variance") > 0, F.struct("variance", (-F.col("v")).alias("v"))))
    return scored.groupBy("page_no").agg(best.alias("best")).select("page_no", F.coalesce(-F.col("best.v"), F.lit(0)).cast("int").alias("threshold"))


def otsu_mask(px: DataFrame, tile: int, share: float) -> DataFrame:
    """fg: raw gray at or below the threshold that the normalised plane gives."""
    thr = otsu_threshold(normalised_pages(px, tile, share))
    return px.join(thr, "page_no").select("page_no", "y", "x", "gray", "threshold", (F.col("gray") <= F.col("threshold")).cast("int").alias("fg"))


def integral_image(px: DataFrame, value: str = "gray") -> DataFrame:
    """Inclusive two-dimensional prefix sums of the value and its square."""
    row, col = Window.partitionBy("page_no", "y").orderBy("x").rowsBetween(*ALL), Window.partitionBy("page_no", "x").orderBy("y").rowsBetween(*ALL)
    v = F.col(value).cast("long")
    across = px.select("page_no", "y", "x", F.sum(v).over(row).alias("a"), F.sum(v * v).over(row).alias("b"))
    return across.select("page_no", "y", "x", F.sum("a").over(col).alias("s"), F.sum("b").over(col).alias("s2"))


def box_sum(integral: DataFrame, half: int) -> DataFrame:
    """Sum over the clamped window by its four corners: two of each row, then two of each column, as frames without a join."""
    row, col = Window.partitionBy("page_no", "y").orderBy("x"), Window.partitionBy("page_no", "x").orderBy("y")
    corner = lambda c, w: F.last(c).over(w.rangeBetween(0, half)) - F.coalesce(F.last(c).over(w.rangeBetween(-half - 1, -half - 1)), F.lit(0))
    strip = integral.select("page_no", "y", "x", corner("s", row).alias("strip"))
    return strip.select("page_no", "y", "x", corner("strip", col).cast("long").alias("box"))


def sauvola_threshold(px: DataFrame, value: str, window: int, k: float, r: int) -> DataFrame:
    """Local threshold round(mean * (1 + k * (std / r - 1))) over a clamped square window.

    Two separable frames: along the row, then down the column; frames clamp by themselves.
    """
    half = window // 2
    row = Window.partitionBy("page_no", "y").orderBy("x").rangeBetween(-half, half)
    col = Window.partitionBy("page_no", "x").orderBy("y").rangeBetween(-half, half)
    v = F.col(value).cast("long")
    across = px.withColumns({"_s": F.sum(v).over(row), "_q": F.sum(v * v).over(row), "_n": F.count("*").over(row)})
    box = across.withColumns({"_s": F.sum("_s").over(col), "_q": F.sum("_q").over(col), "_n": F.sum("_n").over(col)})
    mean = F.col("_s").cast("double") / F.col("_n")
    var = F.col("_q").cast("double") / F.col("_n") - F.col("_mean") * F.col("_mean")
    std = F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(F.lit(0.0))
    thr = F.floor(F.col("_mean") * (F.lit(1.0) + F.lit(k) * (std / F.lit(float(r)) - F.lit(1.0))) + F.lit(0.5)).cast("int")
    return box.withColumn("_mean", mean).withColumn("_var", var).select(*px.columns, thr.alias("threshold"))


def sauvola_mask(px: DataFrame, tile: int, share: float, window: int, k: float, r: int) -> DataFrame:
    """fg: normalised value at or below the local threshold."""
    thr = sauvola_threshold(normalised_pages(px, tile, share), "norm", window, k, r)
    return thr.select("page_no", "y", "x", "gray", "norm", "threshold", (F.col("norm") <= F.col("threshold")).cast("int").alias("fg"))


def mask_colour(fg: str = "fg") -> Column:
    """Opaque black for foreground, opaque white for background."""
    return F.when(F.col(fg) == 1, F.lit(-16777216)).otherwise(F.lit(-1)).alias("colour")


def mask_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs of foreground: page_no, y, x0, x1 (inclusive)."""
    order = Window.partitionBy("page_no", "y").orderBy("x")
    island = mask.where("fg = 1").withColumn("g", F.col("x") - F.row_number().over(order))
    return island.groupBy("page_no", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


FAR = (2**31 - 1) // 2


def inpaint_distance(mask: DataFrame) -> DataFrame:
    """L1 distance of each pixel to the nearest background pixel; FAR on a page without any.

    Prefix and suffix extrema along rows, then down columns: linear in pixels.
    """
    row, col = Window.partitionBy("page_no", "y").orderBy("x"), Window.partitionBy("page_no", "x").orderBy("y")
    before, after = (lambda w: w.rowsBetween(Window.unboundedPreceding, 0)), (lambda w: w.rowsBetween(0, Window.unboundedFollowing))
    bg = F.when(F.col("fg") == 0, F.col("x"))
    side = mask.select("page_no", "y", "x", "fg", (F.col("x") - F.max(bg).over(before(row))).alias("l"), (F.min(bg).over(after(row)) - F.col("x")).alias("r"))
    flat = side.withColumn("g", F.least("l", "r"))  # least skips nulls
    up, down = F.min(F.col("g") - F.col("y")).over(before(col)) + F.col("y"), F.min(F.col("g") + F.col("y")).over(after(col)) - F.col("y")
    return flat.select("page_no", "y", "x", "fg", F.coalesce(F.least(up, down), F.lit(FAR)).cast("int").alias("dist"))
