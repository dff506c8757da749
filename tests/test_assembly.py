"""Group 4 coding, layers with their data, external programs and folders of a run."""

import hashlib
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafstrata.functions import process
from leafstrata.operators import components as comp
from leafstrata.operators import group4, kernels, layers, text
from leafstrata.plans.lineage import run_folder
from leafstrata.plans.registry import ORACLE_SQL, QUERIES
from tests.check import same

rng = np.random.default_rng(11)


def masks():
    yield np.zeros((1, 1), np.uint8)
    for shape in ((1, 8), (5, 1), (17, 33), (40, 300)):
        for share in (0, 0.02, 0.5, 0.95, 1):
            yield (rng.random(shape) < share).astype(np.uint8)
    runs = np.zeros((2700, 2700), np.uint8)[:120]
    for i in range(120):  # run lengths of all sizes, of both colours
        runs[i, i : i + 23 * i] = 1
    yield runs


def test_group4_code_words_are_prefix_free():
    for words in (group4.WHITE, group4.BLACK):
        every = words + group4.LONG
        assert len(words) == 91 and len(group4.LONG) == 13
        assert not [(a, b) for a in every for b in every if a is not b and b.startswith(a)]


def test_group4_round_trip():
    for m in masks():
        assert (group4.decode(group4.encode(m), *m.shape) == m).all()


def tiff(data, h, w):
    """A one-strip bilevel file around a Group 4 stream; white is zero."""
    tags = [(256, 4, w), (257, 4, h), (258, 3, 1), (259, 3, 4), (262, 3, 0), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data))]
    body = data + b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)


def test_group4_is_read_by_the_jdk(spark):
    jvm = spark._jvm
    for m in masks():
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(tiff(group4.encode(m), *m.shape)))
        packed = bytes(image.getRaster().getDataBuffer().getData())
        got = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(m.shape[0], -1), axis=1)[:, : m.shape[1]]
        assert (got == m).all() or (got == 1 - m).all() and (image.getRGB(0, 0) & 0xFFFFFF == 0) == bool(m[0, 0])


def pixels(spark, pages):
    rows = [(n, int(y), int(x), int(g[y, x]), int(f[y, x])) for n, (g, f) in enumerate(pages) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "page_no long, y int, x int, gray int, fg int")


PAGES = [(rng.integers(0, 256, (24, 31)), (rng.random((24, 31)) < s).astype(int)) for s in (0.2, 0.0, 0.4)]


def test_masks_come_back_from_the_shared_dictionary(spark):
    mask = pixels(spark, PAGES)
    dictionary, pages = layers.symbol_layers(comp.symbols(mask).withColumn("doc_id", F.lit(5)))
    (d,) = dictionary.collect()
    of = {hashlib.md5(s.encode()).hexdigest(): s for s in d.symbols}
    assert len(of) == len(d.symbols) and {r.page_no for r in pages.collect()} == {0, 2}
    for r in pages.collect():
        assert r.globals == d.globals
        out = np.zeros((24, 31), int)
        for ref in bytes(r.data).decode().split():
            name, at = ref.split("@")
            y0, x0 = map(int, at.split(","))
            for p in of[name].split():
                y, x = map(int, p.split(":"))
                out[y0 + y, x0 + x] = 1
        assert (out == PAGES[r.page_no][1]).all()


def test_layers_of_pages_with_and_without_foreground(spark):
    planes = comp.planes(pixels(spark, PAGES), 0.33, 0.8, 0.5).withColumn("doc_id", F.col("page_no") % 2)
    masks_ = comp.coded_masks(pixels(spark, PAGES)).select((F.col("page_no") % 2).alias("doc_id"), "page_no", "data", F.lit(None).cast("string").alias("globals"))
    for soft, want in ((True, ["background", "colour", "smask"]), (False, ["background", "stencil"])):
        made = layers.assemble(planes, masks_, F.lit(soft), codec="g4").orderBy("page_no", "z").collect()
        assert [r.kind for r in made if r.page_no == 0] == want and [r.kind for r in made if r.page_no == 1] == ["background"]
        by = {(r.page_no, r.kind): r for r in made}
        gray, fg = PAGES[0]
        small = kernels.gaussian_blur(kernels.downscale(gray, 0.33), 0.8 / 0.33)
        assert bytes(by[0, "background"].data) == small.astype(np.uint8).tobytes() and (by[0, "background"].height, by[0, "background"].width) == small.shape
        assert bytes(by[1, "background"].data) == PAGES[1][0].astype(np.uint8).tobytes()  # neither scaled nor blurred
        if soft:
            assert bytes(by[0, "colour"].data) == kernels.downscale(gray, 0.5).astype(np.uint8).tobytes()
        assert (group4.decode(bytes(by[0, want[-1]].data), 24, 31) == fg).all()


def test_without_mrc_no_mask_is_planned(spark):
    base = spark.createDataFrame([(1, 0, "b")], "doc_id long, page_no int, background string")
    words = spark.createDataFrame([(1, 0, "t")], "doc_id long, page_no int, text string")
    assert layers.page_zip(base, None, None, words, mrc=False).collect()[0].asDict() == {"doc_id": 1, "page_no": 0, "background": "b", "text": "t"}


def test_width_of_unknown_characters_is_guessed(spark):
    df = spark.sql("SELECT 1L AS doc_id, 0 AS page_no, 0 AS line_no, i AS word_no, w AS word, named_struct('x', 0, 'y', 10, 'w', 30, 'h', 20) AS bbox, CAST(array() AS array<struct<x:float,y:float,w:float,h:float>>) AS chars FROM VALUES (0, 'ab'), (1, 'aé'), (2, '漢') AS t(i, w)")
    got = [r.stretch for r in text.text_placement(df, 1.0, 1.0, 100.0, 1.0).orderBy("word_no").collect()]
    assert got == [30 / (2 * 0.5 * 20), 30 / (2 * 20 * 0.5), 1.0]


def test_fonts_fall_back(spark):
    rows = [(1, 2, "b", True, ["b1", "b2"]), (1, 1, "a", False, ["a1"]), (2, 1, "a", False, ["a1"]), (3, 1, "c", True, [])]
    got = text.first_font(spark.createDataFrame(rows, "doc_id long, rank int, path string, readable boolean, fonts array<string>"))
    assert sorted(map(tuple, got.collect())) == [(1, "b", "b1"), (2, None, "Helvetica"), (3, None, "Helvetica")]


def test_programs(spark, tmp_path):
    done = process.run_process(["sh", "-c", "cat; echo bad >&2; exit 3"], given=b"in" * 100_000)
    assert done == (3, b"in" * 100_000, b"bad\n")
    with pytest.raises(OSError, match="longer than"):
        process.run_process(["sleep", "5"], timeout=0.1)
    own = tmp_path / "coder"
    own.write_text("#!/bin/sh\n")
    assert process.locate("coder", str(tmp_path)) is None  # it may not be run
    own.chmod(0o755)
    assert process.locate("coder", "/nowhere", str(tmp_path)) == str(own) and process.locate("sh")
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "k long, v binary")
    assert [(r.k, r.code, r.out and bytes(r.out)) for r in process.pipe_values(rows, "k", "v", ["tr", "a-z", "A-Z"]).orderBy("k").collect()] == [(1, 0, b"ABC"), (2, None, None)]


def test_run_folder_goes_however_the_run_ends(spark):
    seen = []
    with pytest.raises(ValueError):
        with run_folder(spark, "stages") as path:
            spark.range(3).write.parquet(f"{path}/mask")
            seen.append(path.removeprefix("file:"))
            assert os.path.isdir(seen[0])
            raise ValueError
    assert not os.path.exists(seen[0])


def test_sizes_halfway_between_tenths_match_sql(spark, tmp_path):
    # 1000 * 32768 bytes are 31.25 MB, three times that 93.75 MB; 1536 bytes are 1.5 KB
    rows = [(1, "x" * 32768, "web"), (2, "x" * 98304, "a.b"), (3, "x" * 1536, "web"), (4, None, "web")]
    pd.DataFrame(rows, columns=["doc_id", "text", "source"]).to_parquet(tmp_path / "documents.parquet")
    same(QUERIES["size_format"], ORACLE_SQL["size_format"], spark, str(tmp_path))
