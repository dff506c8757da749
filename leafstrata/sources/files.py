"""Page images and documents as files: reading them into rows, and committing results."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.operators import kernels
from leafstrata.sources.settings import PageConfig


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Whole files as rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """Rendered pages: origin, height, width, n_channels, data (rows from the top, blue first)."""
    return spark.read.format("image").option("dropInvalid", True).load(path).selectExpr("image.origin", "image.height", "image.width", "image.nChannels AS n_channels", "image.data")


def bmp_bytes(rgb: np.ndarray) -> bytes:
    """A 24-bit BMP file of a page."""
    h, w = rgb.shape[:2]
    stride = (3 * w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def segment_pages(images: DataFrame, config: PageConfig | None = None) -> DataFrame:
    """Mask and filled background of page images by the dense kernels; a page is one row and is never exploded.

    Gives origin, height, width, ink (foreground pixels), mask (bits, rows padded to bytes)
    and background (bytes, red first). Set spark.sql.execution.arrow.maxRecordsPerBatch to
    a few rows for large pages. Null or empty rasters give null layers.
    """
    c = config or PageConfig()
    rows = images.select("origin", "height", "width", "n_channels", "data")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["data"]:
                    out.append((r["origin"], r["height"], r["width"], None, None, None))
                    continue
                raw = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                rgb = raw[..., 2::-1] if r["n_channels"] >= 3 else np.repeat(raw[..., :1], 3, 2)
                mask, background = kernels.segment(
                    rgb, c.tile_size, c.percentile, c.threshold_mode, c.sauvola_window, c.sauvola_k, c.sauvola_r, c.max_component_area, c.max_component_dim, c.inpaint_radius
                )
                out.append((r["origin"], r["height"], r["width"], int(mask.sum()), np.packbits(mask, axis=1).tobytes(), background.astype(np.uint8).tobytes()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["origin", "height", "width", "ink", "mask", "background"]) if out else b.slice(0, 0)

    return rows.mapInArrow(run, "origin string, height int, width int, ink long, mask binary, background binary")


def write_layers(layers: DataFrame, path: str) -> None:
    """Commit layer rows under ``path``: all of them or none.

    They are written beside it and renamed when complete; only then does an earlier output go.
    """
    spark = layers.sparkSession
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    fs = name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        layers.write.parquet(beside)
        replaced = fs.exists(name(path))
        if replaced:
            fs.rename(name(path), name(old))
        if not fs.rename(name(beside), name(path)):
            if replaced:
                fs.rename(name(old), name(path))
            raise OSError(f"{beside} could not be renamed to {path}")
        if replaced:
            fs.delete(name(old), True)
    finally:
        fs.delete(name(beside), True)


def append_report(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append rows of a run's report (file, pages, bytes, seconds) with whole KB, as the benchmark log keeps them."""
    rows.withColumn("kb", F.expr("bytes div 1024")).write.mode("append").json(path)
