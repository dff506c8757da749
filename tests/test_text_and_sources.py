import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafstrata.operators import metadata, pagetext, text
from leafstrata.plans.registry import ORACLE_SQL, QUERIES
from leafstrata.sources import files
from leafstrata.sources.settings import PageConfig, get, parse_jsonc
from leafstrata.streaming.ingest import ingest
from tests.check import same

GLYPH = "doc_id long, page_no int, seq long, text string, x float, y float, width float, height float"


def words(spark, glyphs):
    df = spark.createDataFrame([(1, 0, i, *g) for i, g in enumerate(glyphs)], GLYPH)
    boxes = text.word_boxes(text.word_split(text.page_lines(df)), 72.0)
    return [r.word for r in boxes.orderBy("line_no", "word_no").collect()]


def test_drifting_baseline_is_one_word(spark):
    assert words(spark, [(chr(97 + i), 12.0 * i, 100 + 1.2 * i, 12.0, 20.0) for i in range(14)]) == ["abcdefghijklmn"]


def test_mixed_sizes_are_three_words(spark):
    big = [("T", 20.0 * i, 100 + 3.0 * i, 20.0, 30.0) for i in range(5)]
    small = [(c, 14.0 * i, y, 12.0, 10.0) for y, c in ((150.0, "u"), (190.0, "v")) for i in range(5)]
    assert words(spark, big + small) == ["TTTTT", "uuuuu", "vvvvv"]


def test_superscript_stays_in_its_line(spark):
    assert words(spark, [*[(c, 12.0 * i, 100.0, 12.0, 20.0) for i, c in enumerate("Hello")], ("2", 60.0, 94.0, 10.0, 10.0)]) == ["Hello2"]


def test_line_fold_equals_plain_form(spark):
    rng = np.random.default_rng(8)
    y = np.sort(rng.choice(np.arange(0, 60, 0.7), 400)).astype(np.float32)
    h = rng.choice([6.0, 7.3, 9.1, 14.0], 400).astype(np.float32)
    df = spark.createDataFrame([(1, 0, i, "x", 0.0, float(a), 1.0, float(b)) for i, (a, b) in enumerate(zip(y, h, strict=True))], GLYPH)
    got = {r.seq: r.line_no for r in text.line_clusters(df).collect()}
    assert [got[i] for i in range(400)] == text.cluster_lines(y, h).tolist() and got[399] > 3
    assert text.line_clusters(df.where("false")).count() == 0


def test_baseline_ratio_without_glyphs(spark):
    df = spark.sql("SELECT w AS word, named_struct('x', 0, 'y', 10, 'w', 5, 'h', 20) AS bbox, CAST(array() AS array<struct<x:float,y:float,w:float,h:float>>) AS chars FROM VALUES ('漢'), ('a') AS t(w)")
    assert [round(r[0], 2) for r in df.orderBy(F.desc("word")).select(text.baseline_ratio()).collect()] == [0.85, 0.75]


def test_unsupported_characters_are_dropped_and_counted(spark):
    (r,) = text.encodable_text(spark.createDataFrame([("AB\U0001f600CD",)], "word string")).collect()
    assert (r.safe_word, r.skipped) == ("ABCD", 2)


def test_matching_ties_and_missing(spark):
    box = "doc_id long, page_no int, word_no int, word string, x double, y double, w double, h double"
    left = spark.createDataFrame([(1, 0, 0, "a", 10.0, 0.0, 5.0, 10.0), (1, 0, 1, "b", 0.0, 0.0, 5.0, 10.0), (1, 0, 2, "a", 30.0, 100.0, 5.0, 10.0)], box)
    right = spark.createDataFrame([(1, 0, 0, "a", 12.0, 0.0, 5.0, 10.0), (1, 0, 1, "a", 8.0, 0.0, 5.0, 10.0), (1, 0, 2, "a", 30.25, 100.0, 5.0, 10.0)], box)
    got = {r.word_no: (r.status, r.match_no) for r in text.match_boxes(left, right).collect()}
    assert got == {0: ("differing", 0), 1: ("missing", None), 2: ("matched", 2)}


def test_settings_reader():
    s = parse_jsonc('/* a\n*/ { "a": "x // y", // c\n "b": 0.50, "c": true, "d": null, "e": "q\\"q", "f": [1], "g": 2 }')
    assert s == {"a": "x // y", "b": "0.50", "c": "true", "d": "null", "e": 'q\\"q'}
    assert parse_jsonc("[1]") == {} and parse_jsonc("") == {}
    assert get(s, "b", 1.0) == 0.5 and get(s, "a", 3) == 3 and get(s, "c", False) is True and get(s, "b", 1.0, chosen=2.0) == 2.0


def test_config_clamps():
    c = PageConfig.of({"pipeline.mrc.backgroundScale": "9", "segmenter.sauvolaWindow": "0", "segmenter.thresholdMode": "x", "pdf.pdfa.enabled": "TRUE", "pipeline.mrc.foregroundColor": "true"})
    assert (c.background_scale, c.sauvola_window, c.threshold_mode, c.pdfa, c.foreground_colour) == (1.0, 1, "sauvola", True, False)


def test_cyclic_graph_is_visited_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (4, 1)], "src long, dst long")
    got = metadata.reachable(edges, spark.createDataFrame([(1,), (9,)], "root long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 3), (9, 9)]


def test_a_copy_of_another_kind_is_made_anew(spark):
    nodes = spark.createDataFrame([(1, n, "array", f"v{n}") for n in range(4)], "doc_id long, node int, kind string, value string")
    edges = spark.createDataFrame([(1, 0, 1, "array"), (1, 1, 0, "dictionary"), (1, 1, 2, "array"), (1, 2, 1, "stream"), (2, 0, 3, "array")], "doc_id long, src int, dst int, dst_kind string")
    got = metadata.copy_graph(nodes, edges, nodes.where("node = 0").select("doc_id", "node", "kind")).collect()
    assert sorted((r.node, r.kind, r.value) for r in got) == [(0, "array", "v0"), (0, "dictionary", "v0"), (1, "array", "v1"), (1, "stream", "v1"), (2, "array", "v2")]


def test_xmp_merge():
    wrap = lambda x: metadata.PACKET_BEGIN + x + metadata.PACKET_END
    own = f'xmlns:pdfaid="{metadata.PDFA}"'
    both = "<pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>"
    for body in ("/>", "></rdf:Description>"):
        got = metadata.identified(f'{metadata.XMP_OPEN}<rdf:Description rdf:about="x"{body}{metadata.XMP_CLOSE}')
        assert got == wrap(f'{metadata.XMP_OPEN}<rdf:Description rdf:about="x" {own}>{both}</rdf:Description>{metadata.XMP_CLOSE}')
    kept = metadata.identified(f'<?xpacket?>{metadata.XMP_OPEN}<rdf:Description {own}><pdfaid:part>3</pdfaid:part></rdf:Description><rdf:Description/>{metadata.XMP_CLOSE}tail')
    assert kept.count("<pdfaid:part>") == 1 and "<pdfaid:part>3</pdfaid:part><pdfaid:conformance>B" in kept
    assert metadata.identified(None) == metadata.identified("<x:xmpmeta><rdf:RDF></x:xmpmeta>") == metadata.static_packet()
    assert metadata.identified("<other/>") == "<other/>" and metadata.identified("") == ""
    assert metadata.identified(f"{metadata.XMP_OPEN}{metadata.XMP_CLOSE}") == wrap(metadata.XMP_OPEN.replace("#\">", "#\"/></x:xmpmeta>"))


def test_cjk_is_found_in_each_range(spark):
    rows = [(1, "ab漢"), (2, "カナ"), (3, "한글"), (4, "latin"), (5, "ひら"), (6, "㐀"), (7, None)]
    got = {r.doc_id: r.cjk for r in text.has_cjk(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert got == {i: i not in (4, 7) for i, _ in rows}


def test_characters_beyond_the_font(spark):
    rows = spark.createDataFrame([("AB\U0001f600CD",), ("漢x",)], "word string")
    assert [(r.safe_word, r.skipped) for r in text.encodable_text(rows).collect()] == [("ABCD", 2), ("x", 1)]


def test_layers_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "layers")
    files.write_layers(spark.range(3), path)
    with pytest.raises(Exception, match="no more"):
        files.write_layers(spark.range(9).selectExpr("IF(id = 8, raise_error('no more'), id) AS id"), path)
    assert spark.read.parquet(path).count() == 3
    files.write_layers(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["layers"]


def test_outline_paths_of_many_siblings(spark):
    items = spark.createDataFrame([(1, 0, None, 0, "top")] + [(1, i, 0, i, "x") for i in (3, 9_999, 10_000, 100_000)], "doc_id long, item_id int, parent_id int, ordinal int, title string")
    tree = metadata.outline_tree(items).orderBy("path").collect()
    assert [r.item_id for r in tree] == [0, 3, 9_999, 10_000, 100_000]


@pytest.mark.parametrize(("before", "want"), [(None, "P"), ("", "P"), ("  ", "P"), ("X", "X -> P")])
def test_producer_chain(spark, before, want):
    assert spark.createDataFrame([(before,)], "p string").select(metadata.producer_chain(F.col("p"), F.lit("P"))).first()[0] == want


def test_stream_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.sql("SELECT id % 5 AS event_id, timestamp'2024-01-01' AS ts FROM range(10)").repartition(3).write.parquet(path)
    assert ingest(spark, path, "event_id", "ts", files_per_batch=1).count() == 5


def test_stream_keeps_rows_of_files_out_of_time_order(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    for i in range(20):  # the newest file comes first, and each file repeats a key of the first one
        rows = f"SELECT {i} AS event_id, timestamp'2024-12-31' - make_dt_interval({30 * i}) AS ts UNION ALL SELECT 0, timestamp'2024-12-31'"
        spark.sql(rows).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.event_id for r in ingest(spark, path, "event_id", "ts").collect()) == list(range(20))
    assert sorted(r.event_id for r in ingest(spark, path, "event_id", "ts", files_per_batch=3).collect()) == list(range(20))


def pages_of(rng, n, ties):
    """Glyph arrays of pages with drifting lines, mixed heights, words, long stretches that need the fold and, with ties, repeated places."""
    size = rng.integers(1, 60, n)
    page, total = np.repeat(np.arange(n), size), size.sum()
    f = np.float32
    seq = np.concatenate([rng.permutation(k) // (2 if ties else 1) for k in size])
    x, y = rng.choice(np.arange(0, 90, 0.5), total).astype(f), rng.choice(np.arange(0, 40, 0.7), total).astype(f)
    char = rng.choice([97, 98, 0xE9, 0x6F22, 0x1F600], total)
    return pagetext.Glyphs(page, seq, char, x, y, rng.choice([3, 6.5], total).astype(f), rng.choice([4, 7.3, 12], total).astype(f))


def as_rows(spark, g):
    rows = zip(g.page.tolist(), g.seq.tolist(), map(chr, g.char), *(c.tolist() for c in (g.x, g.y, g.width, g.height)), strict=True)
    return spark.createDataFrame([(p, 0, *r) for p, *r in rows], GLYPH)


@pytest.mark.parametrize("ties", [False, True])
def test_dense_words_and_boxes_equal_rows_of_glyphs(spark, ties):
    g = pages_of(np.random.default_rng(5 + ties), 60, ties)
    words = text.word_boxes(text.word_split(text.page_lines(as_rows(spark, g))), 150.0)
    ours = words.select("doc_id", "line_no", "word_no", "word", F.size("chars"), "bbox.x", "bbox.y", "bbox.w", "bbox.h", F.sort_array("chars.y")[F.expr("size(chars) div 2")])
    dense = [c.to_pylist() if hasattr(c, "to_pylist") else c.tolist() for c in pagetext.word_rows(g, 150.0)[:-1]]
    assert sorted(zip(*dense, strict=True)) == sorted(map(tuple, ours.collect()))
    lines = text.line_clusters(as_rows(spark, g)).groupBy("doc_id", "line_no").agg(F.count("*"), F.min("seq"), F.max("seq"))
    assert sorted(zip(*[c.tolist() for c in pagetext.line_rows(g)], strict=True)) == sorted(map(tuple, lines.collect()))


def test_dense_comparison_equals_rows_of_glyphs(spark):
    rng = np.random.default_rng(3)
    g, at = pagetext.diff_starts(pages_of(rng, 40, False))
    page, word = g.page[at], pagetext.word_strings(g.char, at)
    dense = sorted(zip(page.tolist(), pagetext.numbers(page).tolist(), word.to_pylist(), *(c.tolist() for c in pagetext.diff_boxes(g, at)), strict=True))
    assert dense == sorted(map(tuple, text.diff_words(as_rows(spark, g)).select("doc_id", "word_no", "word", *"xywh").collect()))
    # many equal words, at equal distances on both sides, on lines that are near and that are not
    names = ["doc_id", "page_no", "word_no", "word", *"xywh"]
    sides = [pd.DataFrame({"doc_id": rng.integers(0, 4, 300), "page_no": 0, "word_no": np.arange(300), "word": rng.choice(["a", "b"], 300)} | {c: rng.choice(v, 300) for c, v in zip("xywh", (np.arange(0, 30, 0.5), [0.0, 12, 24], [6.0, 6.25], [8.0, 10]), strict=True)}) for _ in "lr"]
    sides[1] = sides[1][(sides[1].doc_id != 3) | (sides[1].word != "b")]
    left, right = ([c.to_numpy() for _, c in s[list("xywh")].items()] for s in sides)
    key, r_key = ((s.doc_id * 2 + (s.word == "b")).to_numpy() for s in sides)
    best = pagetext.nearest(key, left, r_key, sides[1].word_no.to_numpy(), right)
    match = [None if b < 0 else n for b, n in zip(best, sides[1].word_no.to_numpy()[best], strict=True)]
    rows = text.match_boxes(*(spark.createDataFrame(s[names]) for s in sides)).orderBy("word_no").collect()
    assert [(r.match_no, r.status) for r in rows] == list(zip(match, pagetext.statuses(left, right, best).to_pylist(), strict=True))
    assert {r.status for r in rows} == {"matched", "differing", "missing"}


TEXTS = ["Zoë 7,Q é\nÿ¡A\xa0b ~x", "one two\n\n漢字 a\tb\r\nlast", None, "", " \n ", "a  b\n" * 12 + "end", "\x0b\x85  x\U0001f600y", "same same same\nsame\nsame same"]


@pytest.mark.parametrize("name", ["line_clusters", "word_split", "word_boxes", "word_count_exact", "baseline_ratio", "text_placement", "bbox_match", "bbox_summary"])
def test_text_queries_shuffle_texts_not_glyphs(spark, tmp_path, name):
    docs = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    docs.to_parquet(tmp_path / "documents.parquet")
    same(QUERIES[name], ORACLE_SQL[name], spark, str(tmp_path))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "seq#" not in plan


def test_words_are_counted_row_by_row_without_a_shuffle_of_texts(spark, tmp_path):
    """Rows with one doc_id, null among them, lie on pages of their own; only counts are shuffled."""
    ids = pd.array([7, 7, 7, None, 8, None, 7, 9], "Int64")
    pd.DataFrame({"doc_id": ids, "text": TEXTS}).to_parquet(tmp_path / "documents.parquet")
    same(QUERIES["word_count_exact"], ORACLE_SQL["word_count_exact"], spark, str(tmp_path))
    plan = QUERIES["word_count_exact"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan and "partial_sum(words" in plan


def test_counted_words_are_those_of_the_split(spark):
    g = pages_of(np.random.default_rng(11), 60, True)
    g.char[np.random.default_rng(12).random(len(g.char)) < 0.4] = ord(" ")  # some words are spaces only
    page, _, _, word = pagetext.word_rows(g)
    want = pd.Series([w.strip(" ") != "" for w in word.to_pylist()]).groupby(page).sum()
    got = dict(zip(*[c.tolist() for c in pagetext.word_counts(g)], strict=True))
    assert got == want[want > 0].to_dict() and sum(got.values()) < len(word)
    assert [len(c) for c in pagetext.word_counts(g.take(np.zeros(0, int)))] == [0, 0]


def test_words_of_very_long_lines_are_counted(spark, tmp_path):
    """Beyond 2 ** 25 points float32 holds multiples of four only, and a column is six points wide."""
    pd.DataFrame({"doc_id": [1], "text": [" " * 5_600_000 + "abc de " * 1000]}).to_parquet(tmp_path / "documents.parquet")
    assert [tuple(r) for r in QUERIES["word_count_exact"](spark, str(tmp_path)).collect()] == [(1, 2000)]
