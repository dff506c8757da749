"""Connected components of page masks: labels, statistics, the size filter and the symbol dictionary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstrata.operators import group4, kernels


def _planes(pdf: pd.DataFrame, *names: str) -> list[np.ndarray]:
    """Dense planes of a page's pixels; pixels that are missing count as 0."""
    h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
    out = []
    for n in names:
        plane = np.zeros((h, w), np.int64)
        plane[pdf.y, pdf.x] = pdf[n]
        out.append(plane)
    return out


def components(mask: DataFrame) -> DataFrame:
    """page_no, y, x, root of foreground pixels; root is the component's smallest y * width + x.

    A page is the unit of work: it is gathered and labelled by the run-based kernel.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        root = kernels.components(_planes(pdf, "fg")[0])
        y, x = np.nonzero(root >= 0)
        return pd.DataFrame({"page_no": pdf.page_no.iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "root": root[y, x]})

    return mask.select("page_no", "y", "x", "fg").groupBy("page_no").applyInPandas(label, "page_no long, y int, x int, root long")


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("page_no", "root").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )


def page_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("page_no").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def dropped_components(stats: DataFrame, sizes: DataFrame, max_area: float, max_dim: float) -> DataFrame:
    """Components over trunc(page area * max_area) pixels or trunc(longer side * max_dim) in a side; 0 turns a rule off."""
    s = stats.join(sizes, "page_no")
    rules = []
    if max_area:
        rules.append(F.col("area") > F.floor(F.col("h") * F.col("w") * F.lit(max_area)))
    if max_dim:
        side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 1
        rules.append(side > F.floor(F.greatest("h", "w") * F.lit(max_dim)))
    if not rules:
        return s.where("false").select("page_no", "root")
    return s.where(rules[0] if len(rules) == 1 else rules[0] | rules[1]).select("page_no", "root")


def component_filter(mask: DataFrame, max_area: float, max_dim: float) -> DataFrame:
    """Foreground pixels without those of dropped components: page_no, y, x."""
    lab = components(mask)
    drop = dropped_components(component_stats(lab), page_sizes(mask), max_area, max_dim)
    return lab.join(drop, ["page_no", "root"], "left_anti").select("page_no", "y", "x")


def symbols(mask: DataFrame) -> DataFrame:
    """page_no, root, symbol, area, y, x of each component: its bitmap and where the bitmap's corner lies.

    A symbol is named by its pixels relative to the bounding box, in reading order.
    """
    lab = components(mask)
    box = component_stats(lab).select("page_no", "root", "min_x", "min_y")
    at = lab.join(box, ["page_no", "root"]).select("page_no", "root", F.struct((F.col("y") - F.col("min_y")).alias("y"), (F.col("x") - F.col("min_x")).alias("x")).alias("p"))
    shape = F.expr("array_join(transform(array_sort(collect_list(p)), p -> concat(p.y, ':', p.x)), ' ')")
    shapes = at.groupBy("page_no", "root").agg(shape.alias("symbol"), F.count("*").alias("area"))
    return shapes.join(box, ["page_no", "root"]).select("page_no", "root", "symbol", "area", F.col("min_y").alias("y"), F.col("min_x").alias("x"))


def symbol_dictionary(mask: DataFrame) -> DataFrame:
    """Distinct component bitmaps with their numbers of references and pages."""
    return symbols(mask).groupBy("symbol").agg(F.count("*").alias("uses"), F.countDistinct("page_no").alias("pages"), F.max("area").alias("area"))


def inpaint_fill(mask: DataFrame, radius: int = 0) -> DataFrame:
    """page_no, y, x, dist, filled: gray of each pixel after filling the foreground; beyond a positive radius 255."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        gray, fg = _planes(pdf, "gray", "fg")
        dist, out = kernels.inpaint(gray, fg, 0)
        if radius > 0:
            out[dist > radius] = 255
        return pd.DataFrame({"page_no": pdf.page_no, "y": pdf.y, "x": pdf.x, "dist": dist[pdf.y, pdf.x].astype(np.int32), "filled": out[pdf.y, pdf.x].astype(np.int32)})

    return mask.select("page_no", "y", "x", "gray", "fg").groupBy("page_no").applyInPandas(fill, "page_no long, y int, x int, dist int, filled int")


def gaussian_blur(px: DataFrame, sigma: float) -> DataFrame:
    """page_no, y, x, blurred."""

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernels.gaussian_blur(_planes(pdf, "gray")[0], sigma)
        return pd.DataFrame({"page_no": pdf.page_no, "y": pdf.y, "x": pdf.x, "blurred": out[pdf.y, pdf.x].astype(np.int32)})

    return px.select("page_no", "y", "x", "gray").groupBy("page_no").applyInPandas(blur, "page_no long, y int, x int, blurred int")


def coded_masks(mask: DataFrame) -> DataFrame:
    """page_no, height, width, data: each page's foreground as a Group 4 stream."""

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = _planes(pdf, "fg")[0]
        return pd.DataFrame({"page_no": [pdf.page_no.iloc[0]], "height": [plane.shape[0]], "width": [plane.shape[1]], "data": [group4.encode(plane)]})

    return mask.select("page_no", "y", "x", "fg").groupBy("page_no").applyInPandas(code, "page_no long, height int, width int, data binary")


def decoded_masks(coded: DataFrame) -> DataFrame:
    """page_no, height, width, bits (rows padded to bytes) of coded_masks()."""

    def run(batches):
        for pdf in batches:
            bits = [np.packbits(group4.decode(d, h, w), axis=1).tobytes() for d, h, w in zip(pdf.data, pdf.height, pdf.width, strict=True)]
            yield pdf.assign(bits=bits)[["page_no", "height", "width", "bits"]]

    return coded.mapInPandas(run, "page_no long, height int, width int, bits binary")


def planes(mask: DataFrame, scale: float, sigma: float, colour_scale: float) -> DataFrame:
    """page_no, height, width, ink, background, colour: the planes of each page as bytes, before a codec sees them.

    ``mask`` has gray and fg. With foreground the background is downscaled, then blurred
    with sigma / scale, and the colour plane is downscaled by its own scale; a page without
    foreground keeps its background whole and has no colour plane.
    """

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        gray, fg = _planes(pdf, "gray", "fg")
        ink = int((fg == 1).sum())
        back, colour = gray, None
        if ink:
            back = kernels.gaussian_blur(kernels.downscale(gray, scale) if scale < 1 else gray, sigma / scale)
            colour = kernels.downscale(gray, colour_scale) if colour_scale < 1 else gray
        size = [gray.shape[0], gray.shape[1], back.shape[0], back.shape[1], *(colour.shape if ink else (0, 0))]
        data = [x.astype(np.uint8).tobytes() if x is not None else None for x in (back, colour)]
        return pd.DataFrame([[pdf.page_no.iloc[0], *size, ink, *data]], columns=names)

    names = ["page_no", "height", "width", "back_h", "back_w", "colour_h", "colour_w", "ink", "background", "colour"]
    return mask.select("page_no", "y", "x", "gray", "fg").groupBy("page_no").applyInPandas(
        made, "page_no long, height int, width int, back_h int, back_w int, colour_h int, colour_w int, ink long, background binary, colour binary"
    )


def background_layer(px: DataFrame, scale: float, sigma: float) -> DataFrame:
    """page_no, y, x, level: the page downscaled and then blurred with sigma / scale, as before encoding."""

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        small = kernels.gaussian_blur(kernels.downscale(_planes(pdf, "gray")[0], scale), sigma / scale)
        y, x = np.mgrid[0 : small.shape[0], 0 : small.shape[1]]
        return pd.DataFrame({"page_no": pdf.page_no.iloc[0], "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "level": small.ravel().astype(np.int32)})

    return px.select("page_no", "y", "x", "gray").groupBy("page_no").applyInPandas(shrink, "page_no long, y int, x int, level int")
