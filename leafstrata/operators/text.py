"""Text layer: lines and words from positioned glyphs, word boxes, and comparison of two layouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: CJK ranges of the baseline and font rules, as a character class (fixed values).
CJK = "[\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af\u3400-\u4dbf]"
PAGE = ("doc_id", "page_no")


def page_median_height(glyphs: DataFrame) -> DataFrame:
    """Per page the upper median of glyph heights: the sorted value at n div 2."""
    rank = Window.partitionBy(*PAGE).orderBy("height", "seq")
    n = Window.partitionBy(*PAGE)
    at = glyphs.select(*PAGE, "height", F.row_number().over(rank).alias("i"), F.count("*").over(n).alias("n"))
    return at.where("i = n div 2 + 1").select(*PAGE, "height")


def cluster_lines(y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Line number of each glyph, in float32 arithmetic; glyphs must come sorted by y, ties in order. The plain form of line_clusters().

    A line keeps running means of baseline and height. A glyph that lies further from the
    mean baseline than half the larger of the page's median height and the line's mean
    height opens the next line.
    """
    return fold_lines(y, height, np.float32(np.sort(height)[len(height) // 2]))


def fold_lines(y: np.ndarray, height: np.ndarray, median: np.float32) -> np.ndarray:
    """cluster_lines() of glyphs of a page with that median height."""
    f = np.float32
    out, line = np.zeros(len(y), np.int32), 0
    mean_y, mean_h, n = f(y[0]), f(height[0]), 1
    for i in range(1, len(y)):
        if abs(f(y[i]) - mean_y) > f(0.5) * max(median, mean_h):
            line += 1
            mean_y, mean_h, n = f(y[i]), f(height[i]), 1
        else:
            mean_y, mean_h = (mean_y * f(n) + f(y[i])) / f(n + 1), (mean_h * f(n) + f(height[i])) / f(n + 1)
            n += 1
        out[i] = line
    return out


def page_lines(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, g: the lines of each page, from 0 downwards, as arrays of their glyphs in reading order.

    cluster_lines() as a fold inside the JVM: a page's glyphs are one array, sorted by
    (y, seq); the fold keeps running means in float32 and the places where lines start.
    """
    g = F.struct("y", "seq", "x", "text", "width", "height")
    pages = glyphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(g)).alias("g"))
    # the median rides in the fold's state: Spark would inline a column of it into the lambda, and sort once a glyph
    opens = "acc.n = 0 OR abs(c.y - acc.y) > CAST(0.5 AS FLOAT) * greatest(acc.m, acc.h)"
    mean = "CAST((acc.{0} * CAST(acc.n AS FLOAT) + c.{1}) / CAST(acc.n + 1 AS FLOAT) AS FLOAT)"
    start = "named_struct('starts', CAST(array() AS ARRAY<INT>), 'i', 1, 'y', CAST(0 AS FLOAT), 'h', CAST(0 AS FLOAT), 'n', 0, 'm', element_at(array_sort(g.height), CAST(size(g) div 2 + 1 AS INT)))"
    fold = f"""aggregate(g, {start},
      (acc, c) -> IF({opens}, named_struct('starts', array_append(acc.starts, acc.i), 'i', acc.i + 1, 'y', c.y, 'h', c.height, 'n', 1, 'm', acc.m),
        named_struct('starts', acc.starts, 'i', acc.i + 1, 'y', {mean.format("y", "y")}, 'h', {mean.format("h", "height")}, 'n', acc.n + 1, 'm', acc.m)),
      acc -> acc.starts)"""
    order = "array_sort(transform({0}, c -> named_struct('x', c.x, 'y', c.y, 'seq', c.seq, 'text', c.text, 'width', c.width, 'height', c.height)))"
    cut = f"transform(starts, (s, k) -> {order.format('slice(g, s, IF(k + 1 = size(starts), size(g) + 1, starts[k + 1]) - s)')})"
    return pages.select(*PAGE, "g", F.expr(fold).alias("starts")).select(*PAGE, F.posexplode(F.expr(cut)).alias("line_no", "g"))


def line_clusters(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no and the glyph of each glyph."""
    return page_lines(glyphs).select(*PAGE, "line_no", F.inline("g"))


def word_split(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, word_no, g: the words of page_lines(), from 0 in each line. A gap over max(0.3 * previous height, 2) opens a word."""
    gap = "g[i].x - (g[i - 1].x + g[i - 1].width)"
    limit = "greatest(g[i - 1].height * CAST(0.3 AS FLOAT), CAST(2.0 AS FLOAT))"
    starts = F.expr(f"filter(sequence(0, size(g) - 1), i -> i = 0 OR {gap} > {limit})")
    cut = "transform(starts, (s, k) -> slice(g, s + 1, IF(k + 1 = size(starts), size(g), starts[k + 1]) - s))"
    return lines.withColumn("starts", starts).select(*PAGE, "line_no", F.posexplode(F.expr(cut)).alias("word_no", "g"))


def word_text(g: str = "g"):
    """The characters of a word's glyphs."""
    return F.array_join(F.col(f"{g}.text"), "")


def word_boxes(words: DataFrame, dpi: float) -> DataFrame:
    """One row a word: text, pixel box (at least 1 x 1), confidence 100 and glyph positions in pixels, all in float32."""
    scale = F.lit(dpi / 72).cast("float")
    px = lambda c: F.floor(c.cast("float").cast("double") + 0.5).cast("int")
    ends = words.select(
        *PAGE, "line_no", "word_no", "g",
        F.array_min("g.x").alias("x0"), F.array_min("g.y").alias("y0"),
        F.array_max(F.transform("g", lambda c: c["x"] + c["width"])).alias("x1"), F.array_max(F.transform("g", lambda c: c["y"] + c["height"])).alias("y1"),
    )
    return ends.select(
        *PAGE, "line_no", "word_no", word_text().alias("word"),
        F.struct(
            px(F.col("x0") * scale).alias("x"), px(F.col("y0") * scale).alias("y"),
            F.greatest(F.lit(1), px((F.col("x1") - F.col("x0")) * scale)).alias("w"), F.greatest(F.lit(1), px((F.col("y1") - F.col("y0")) * scale)).alias("h"),
        ).alias("bbox"),
        F.lit(100.0).alias("confidence"),
        F.transform("g", lambda c: F.struct((c["x"] * scale).alias("x"), (c["y"] * scale).alias("y"), (c["width"] * scale).alias("w"), (c["height"] * scale).alias("h"))).alias("chars"),
    )


def baseline_ratio(word: str = "word", bbox: str = "bbox", chars: str = "chars"):
    """Baseline inside the box, 0 .. 1: the upper median of the glyphs' baselines; without glyphs 0.85 for CJK, else 0.75."""
    ys = F.array_sort(F.transform(chars, lambda c: c["y"]))
    known = ratio_inside(F.element_at(ys, (F.floor(F.size(ys) / 2) + 1).cast("int")), bbox)
    guess = F.when(F.col(word).rlike(CJK), F.lit(0.85)).otherwise(F.lit(0.75)).cast("float")
    return F.when(F.coalesce(F.size(chars), F.lit(0)) > 0, known).otherwise(guess)


def ratio_inside(baseline, bbox: str = "bbox"):
    """A baseline's place inside the box, 0 .. 1."""
    ratio = (baseline - F.col(f"{bbox}.y").cast("float")).cast("float").cast("double") / F.col(f"{bbox}.h").cast("float").cast("double")
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), ratio.cast("float")))


def has_cjk(text: DataFrame, column: str) -> DataFrame:
    """Per document whether any text holds a CJK character."""
    return text.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col(column), F.lit("")).rlike(CJK)).alias("cjk"))


def first_font(candidates: DataFrame, builtin: str = "Helvetica") -> DataFrame:
    """doc_id, path, font: of each document's candidates (doc_id, rank, path, readable, fonts) the first that is readable.

    A collection gives its first font. Where none is readable, or the chosen file holds no
    font, the built-in one serves and the path is null.
    """
    best = F.min(F.when(F.col("readable"), F.struct("rank", "path", F.try_element_at("fonts", F.lit(1)).alias("font")))).alias("b")
    got = candidates.groupBy("doc_id").agg(best)
    known = F.col("b.font").isNotNull()
    return got.select("doc_id", F.when(known, F.col("b.path")).alias("path"), F.when(known, F.col("b.font")).otherwise(F.lit(builtin)).alias("font"))


def common_pages(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, pages: how many pages both layouts (doc_id, page_no from 0) have, the smaller of the two counts."""
    n = lambda df, c: df.groupBy("doc_id").agg((F.max("page_no") + 1).alias(c))
    return n(left, "a").join(n(right, "b"), "doc_id").select("doc_id", F.least("a", "b").cast("long").alias("pages"))


#: Characters of which the placement rule knows advances, as a class; others make a word's width a guess.
MEASURED = "[ -~]"
#: The guess: this share of the size a character.
GUESSED_ADVANCE = 0.5
#: Advances of the placement rule in thousandths of the size, by character class (a simple stand-in for font metrics).
ADVANCES = (("[0-9]", 556), ("[A-Z]", 667), ("[a-z]", 500))
OTHER_ADVANCE = 333
#: Characters that the built-in single-byte font can write, as a class.
ENCODABLE = "[ -~¡-ÿ]"


def natural_advance(word: str) -> str:
    """SQL for a word's advance in thousandths."""
    counted = [f"(length({word}) - length(regexp_replace({word}, '{c}', '')))" for c, _ in ADVANCES]
    rest = f"(length({word}) - {' - '.join(counted)})"
    return " + ".join([*(f"{n} * {k}" for n, (_, k) in zip(counted, ADVANCES, strict=True)), f"{rest} * {OTHER_ADVANCE}"])


def encodable_text(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with safe_word (what the font can write) and skipped (characters left out; a pair counts two)."""
    safe = F.regexp_replace(word, f"[^{ENCODABLE[1:]}", "")
    units = lambda c: F.length(c) + F.length(F.regexp_replace(c, "[^\U00010000-\U0010ffff]", ""))
    return words.withColumn("safe_word", safe).withColumn("skipped", units(F.col(word)) - units(F.col("safe_word")))


def text_placement(words: DataFrame, scale_x: float, scale_y: float, page_h: float, min_font: float, ratio=None, advance=None) -> DataFrame:
    """Where and how large a word is drawn: place_x, place_y, size and stretch, in points.

    size = max(box height * scale, min_font); stretch = target width / natural width, 1
    where there is none; the drawn size is their product. A word with a character of unknown
    advance takes half its size a character. ``ratio`` is the baseline's place in the
    box and ``advance`` the natural one in thousandths (null: unknown), where they are known already.
    """
    t = encodable_text(words).withColumn("ratio", (baseline_ratio() if ratio is None else ratio).cast("double"))
    t = t.withColumn("size", F.greatest(F.col("bbox.h") * F.lit(scale_y), F.lit(min_font)))
    if advance is None:
        advance = F.when(~F.col("safe_word").rlike(f"[^{MEASURED[1:]}"), F.expr(natural_advance("safe_word")))
    known = advance / F.lit(1000.0) * F.col("size")
    t = t.withColumn("natural", F.coalesce(known, F.length("safe_word") * F.col("size") * F.lit(GUESSED_ADVANCE)))
    stretch = F.when(F.col("natural") > 0, F.col("bbox.w") * F.lit(scale_x) / F.col("natural")).otherwise(F.lit(1.0))
    return t.select(
        *PAGE, "line_no", "word_no", "safe_word",
        (F.col("bbox.x") * F.lit(scale_x)).alias("place_x"),
        (F.lit(page_h) - (F.col("bbox.y") + F.col("bbox.h") * F.col("ratio")) * F.lit(scale_y)).alias("place_y"),
        "size", stretch.alias("stretch"), (F.col("size") * stretch).alias("drawn"),
    )


def diff_words(chars: DataFrame) -> DataFrame:
    """Words of the comparison tool: sorted by (y, x), a glyph off by half the previous height, or past half the previous width, opens a word."""
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "seq")
    dy, gap = F.abs(F.col("y") - F.lag("y").over(order)), F.col("x") - (F.lag("x").over(order) + F.lag("width").over(order))
    opens = (dy >= F.lag("height").over(order) * 0.5) | (gap > F.lag("width").over(order) * 0.5)
    numbered = chars.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(0))).withColumn("word_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    g = F.struct("y", "x", "seq", "text")
    return numbered.groupBy(*PAGE, "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(g)), lambda c: c["text"]), "").alias("word"),
        F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("h"),
    )


def match_boxes(left: DataFrame, right: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Each left word with the nearest right word of its page and text, and how they compare.

    A candidate lies within 1.5 average heights; the smallest horizontal distance wins, the
    first in order among equals. Right words may serve several left ones. status is
    matched, differing (a side off by more than ``tolerance``) or missing. Both sides have
    doc_id, page_no, word_no, word, x, y, w, h.
    """
    r = right.select(*PAGE, "word", *[F.col(c).alias(f"r_{c}") for c in ("word_no", "x", "y", "w", "h")])
    near = F.abs(F.col("r_y") - F.col("y")) <= (F.col("r_h") + F.col("h")) / 2 * 1.5
    joined = left.join(r, [*PAGE, "word"]).where(near)
    best = joined.groupBy(*PAGE, "word_no").agg(F.min(F.struct(F.abs(F.col("r_x") - F.col("x")).alias("d"), "r_word_no", "r_x", "r_y", "r_w", "r_h")).alias("m"))
    got = left.join(best, [*PAGE, "word_no"], "left")
    off = F.greatest(*[F.abs(F.col(f"m.r_{c}") - F.col(c)) for c in "xywh"])
    status = F.when(F.col("m").isNull(), "missing").when(off > tolerance, "differing").otherwise("matched")
    return got.select(*PAGE, "word_no", "word", F.col("m.r_word_no").alias("match_no"), status.alias("status"))


def truncate(column: str, most: int = 18):
    """The first ``most`` characters and an ellipsis; shorter texts as they are, null as empty."""
    c = F.coalesce(F.col(column), F.lit(""))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def sampled_word_count(pages: DataFrame, pages_read: int = 10) -> DataFrame:
    """doc_id, words: counted on the first pages and scaled up, truncated, where a document has more.

    ``pages`` has doc_id, page_no (from 0) and text; blank texts hold no words.
    """
    n = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    counted = pages.groupBy("doc_id").agg(F.sum(F.when(F.col("page_no") < pages_read, n).otherwise(0)).alias("n"), (F.max("page_no") + 1).alias("total"))
    scaled = F.floor(F.col("n").cast("double") / pages_read * F.col("total"))
    return counted.select("doc_id", F.when(F.col("total") <= pages_read, F.col("n")).otherwise(scaled).cast("long").alias("words"))
