"""Layers of pages: alignment by position, stacking, sizes, and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("doc_id", "page_no")


def page_zip(backgrounds: DataFrame, masks: DataFrame, colours: DataFrame, texts: DataFrame, mrc: bool = True) -> DataFrame:
    """Layers of each page side by side: background and text must exist, mask and colour may lack.

    With ``mrc`` off the mask branches are not in the plan at all.
    """
    base = backgrounds.join(texts, list(KEYS))
    if not mrc:
        return base
    return base.join(masks, list(KEYS), "left").join(colours, list(KEYS), "left")


def page_dims(pages: DataFrame) -> DataFrame:
    """Output width and height: sides swap for odd quarter turns."""
    turned = F.col("rotation") % 180 != 0
    return pages.withColumns({"width": F.when(turned, F.col("crop_h")).otherwise(F.col("crop_w")), "height": F.when(turned, F.col("crop_w")).otherwise(F.col("crop_h"))})


def format_size(n: Column) -> Column:
    """Bytes as B, rounded KB (halves up) or MB with one decimal (halves to even, as SQL's printf has them)."""
    kb, mb = n / F.lit(1024.0), n / F.lit(1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.0f KB", kb)).otherwise(F.format_string("%.1f MB", F.bround(mb, 1)))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def layer_rows(mask: DataFrame, colour: bool = False, pdfa: bool = False) -> DataFrame:
    """Layer rows of each page, bottom first: background, then stencil, or soft mask over a colour plane.

    A page without foreground has no mask layer. The colour plane is off under PDF/A.
    """
    soft = colour and not pdfa
    size = mask.groupBy("page_no").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum("fg").alias("ink"))
    row = lambda z, kind, codec, n, of: of.selectExpr("page_no", f"{z} AS z", f"'{kind}' AS kind", f"'{codec}' AS codec", "width", "height", f"CAST({n} AS BIGINT) AS bytes")
    inked = size.where("ink > 0")
    bits = "height * ((width + 7) div 8)"
    out = row(0, "background", "raw", "3 * width * height", size)
    if soft:
        return out.unionByName(row(1, "colour", "raw", "3 * width * height", inked)).unionByName(row(2, "smask", "bits", bits, inked))
    return out.unionByName(row(1, "stencil", "bits", bits, inked))


def symbol_layers(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masks as references into one dictionary a document, from symbols() with doc_id.

    The dictionary (doc_id, globals, symbols) holds a document's bitmaps once, in order, and is
    joined to the pages of the document by doc_id: each page (page_no, data, globals) refers
    to it by its digest and to a bitmap by the bitmap's digest and place.
    """
    dictionary = shapes.groupBy("doc_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    dictionary = dictionary.select("doc_id", F.md5(F.array_join("symbols", "|").cast("binary")).alias("globals"), "symbols")
    at = F.struct("root", F.concat(F.md5(F.col("symbol").cast("binary")), F.lit("@"), F.col("y"), F.lit(","), F.col("x")).alias("ref"))
    pages = shapes.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda r: r["ref"]), " ").cast("binary").alias("data"))
    return dictionary, pages.join(dictionary.select("doc_id", "globals"), "doc_id")


def assemble(planes: DataFrame, masks: DataFrame, soft: Column, codec: str = "symbols") -> DataFrame:
    """The layers of documents with their data: doc_id, page_no, z, kind, codec, height, width, globals, data.

    ``planes`` has doc_id beside the columns of components.planes(), ``masks`` doc_id,
    page_no, data and globals (null where a mask stands alone). From the bottom: the
    background; then, where there is foreground, the mask as a black stencil, or a colour
    plane under the mask as its soft mask where ``soft`` holds.
    """
    back = planes.select("doc_id", "page_no", F.lit(0).alias("z"), F.lit("background").alias("kind"), F.lit("raw").alias("codec"), F.col("back_h").alias("height"), F.col("back_w").alias("width"), F.lit(None).cast("string").alias("globals"), F.col("background").alias("data"))
    inked = planes.where("ink > 0")
    colour = inked.where(soft).select("doc_id", "page_no", F.lit(1).alias("z"), F.lit("colour").alias("kind"), F.lit("raw").alias("codec"), F.col("colour_h").alias("height"), F.col("colour_w").alias("width"), F.lit(None).cast("string").alias("globals"), F.col("colour").alias("data"))
    over = inked.select("doc_id", "page_no", "height", "width").join(masks, ["doc_id", "page_no"])
    z, kind = F.when(soft, 2).otherwise(1), F.when(soft, F.lit("smask")).otherwise(F.lit("stencil"))
    mask = over.select("doc_id", "page_no", z.alias("z"), kind.alias("kind"), F.lit(codec).alias("codec"), "height", "width", "globals", "data")
    return back.unionByName(colour).unionByName(mask)


def run_report(pages: DataFrame, words: DataFrame, layers: DataFrame, preserved: DataFrame, seconds: Column) -> DataFrame:
    """What a run tells of each document: pages, words, bytes in and out with their ratio, seconds, and what was preserved.

    ``pages`` has doc_id, n_pages and bytes, ``words`` doc_id and words, ``layers`` doc_id and
    bytes, ``preserved`` the columns of preserve_counts().
    """
    out = layers.groupBy("doc_id").agg(F.sum("bytes").alias("bytes_out"))
    got = pages.join(words, "doc_id", "left").join(out, "doc_id", "left").join(preserved, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    share = F.floor(F.coalesce("bytes_out", F.lit(0)) * 1000 / F.when(F.col("bytes") > 0, F.col("bytes")) + 0.5).cast("long")
    return got.select("doc_id", "n_pages", zero("words"), F.col("bytes").alias("bytes_in"), zero("bytes_out"), share.alias("permille"), seconds.alias("seconds"), zero("outlines"), zero("annotations"), zero("embedded_files"))


def layer_report(layers: DataFrame) -> DataFrame:
    """Per page: number of layers, bytes, whole KB, and the kinds from bottom to top."""
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "kind"))), lambda s: s["kind"]), ">")
    return layers.groupBy("page_no").agg(F.count("*").alias("layers"), F.sum("bytes").alias("bytes"), F.expr("sum(bytes) div 1024").alias("kb"), kinds.alias("stack"))
