"""SQL that says the same as the queries, for DuckDB on the same tables."""

from __future__ import annotations

from leafstrata.operators.metadata import PACKET_BEGIN, PACKET_END, PDFA, XMP_CLOSE, XMP_OPEN, static_packet
from leafstrata.plans.queries import AREA, DIM, DPI, K, R, SHARE, TILE, WINDOW
from leafstrata.sources.derive import GLYPH_SQL, GRAY_SQL, LINES_A_PAGE

HALF = WINDOW // 2

PX = f"px AS MATERIALIZED ({GRAY_SQL})"
HIST = f"hist AS (SELECT page_no, CAST(y // {TILE} AS INT) AS ty, CAST(x // {TILE} AS INT) AS tx, gray, count(*) AS n FROM px GROUP BY ALL)"
TILES = f"""cum AS (SELECT *, sum(n) OVER (PARTITION BY page_no, ty, tx ORDER BY gray) AS cum, floor(sum(n) OVER (PARTITION BY page_no, ty, tx) * {SHARE}::DOUBLE) AS target FROM hist),
tiles AS MATERIALIZED (SELECT page_no, ty, tx, CAST(CASE WHEN min(target) = 0 THEN 0 ELSE min(gray) FILTER (WHERE cum >= target) END AS INT) AS bg FROM cum GROUP BY ALL)"""
SURFACE = f"""ends AS (SELECT page_no, max(ty) AS my, max(tx) AS mx FROM tiles GROUP BY ALL),
pos AS (SELECT px.*, my, mx, least((y + {TILE // 2}) // {TILE}, my) AS t, least((x + {TILE // 2}) // {TILE}, mx) AS u FROM px JOIN ends USING (page_no)),
frac AS (SELECT *, least(y + {TILE // 2} - t * {TILE}, {TILE - 1}) AS fy, least(x + {TILE // 2} - u * {TILE}, {TILE - 1}) AS fx FROM pos),
surf AS MATERIALIZED (SELECT f.page_no, f.y, f.x, f.gray, CAST(((a.bg * ({TILE} - fx) + b.bg * fx) * ({TILE} - fy) + (c.bg * ({TILE} - fx) + d.bg * fx) * fy) // {TILE * TILE} AS INT) AS surface
  FROM frac f JOIN tiles a ON a.page_no = f.page_no AND a.ty = t AND a.tx = u
  JOIN tiles b ON b.page_no = f.page_no AND b.ty = t AND b.tx = least(u + 1, mx)
  JOIN tiles c ON c.page_no = f.page_no AND c.ty = least(t + 1, my) AND c.tx = u
  JOIN tiles d ON d.page_no = f.page_no AND d.ty = least(t + 1, my) AND d.tx = least(u + 1, mx))"""
NORM = "norm AS MATERIALIZED (SELECT *, CAST(CASE WHEN surface = 0 THEN gray ELSE least(255, gray * 255 // surface) END AS INT) AS norm FROM surf)"
OTSU = """oh AS (SELECT page_no, norm AS v, count(*) AS n FROM norm GROUP BY ALL),
os AS (SELECT page_no, v, sum(n) OVER w AS wb, sum(n) OVER p - sum(n) OVER w AS wf, CAST(sum(v * n) OVER w AS DOUBLE) AS sb, CAST(sum(v * n) OVER p AS DOUBLE) AS s
  FROM oh WINDOW p AS (PARTITION BY page_no), w AS (PARTITION BY page_no ORDER BY v)),
og AS (SELECT *, sb / wb - (s - sb) / nullif(wf, 0) AS gap FROM os),
ov AS (SELECT *, CAST(wb AS DOUBLE) * wf * gap * gap AS variance FROM og),
thr AS (SELECT p.page_no, coalesce((SELECT v FROM ov WHERE ov.page_no = p.page_no AND variance > 0 ORDER BY variance DESC, v LIMIT 1), 0)::INT AS threshold FROM (SELECT DISTINCT page_no FROM px) p)"""
OMASK = "om AS (SELECT page_no, y, x, gray, threshold, CAST(gray <= threshold AS INT) AS fg FROM px JOIN thr USING (page_no))"


def sauvola(value: str, of: str) -> str:
    return f"""sr AS (SELECT *, sum({value}) OVER w AS s1, sum({value} * {value}) OVER w AS q1, count(*) OVER w AS n1 FROM {of} WINDOW w AS (PARTITION BY page_no, y ORDER BY x RANGE BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING)),
sb2 AS (SELECT *, sum(s1) OVER w AS s2, sum(q1) OVER w AS q2, sum(n1) OVER w AS n2 FROM sr WINDOW w AS (PARTITION BY page_no, x ORDER BY y RANGE BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING)),
sm AS (SELECT *, CAST(s2 AS DOUBLE) / n2 AS mean, CAST(q2 AS DOUBLE) / n2 - (CAST(s2 AS DOUBLE) / n2) * (CAST(s2 AS DOUBLE) / n2) AS var FROM sb2),
st AS MATERIALIZED (SELECT * EXCLUDE (s1, q1, n1, s2, q2, n2, mean, var), CAST(floor(mean * (1.0::DOUBLE + {K}::DOUBLE * (CASE WHEN var > 0 THEN sqrt(var) ELSE 0 END / {float(R)}::DOUBLE - 1.0::DOUBLE)) + 0.5::DOUBLE) AS INT) AS threshold FROM sm)"""


SMASK = sauvola("norm", "norm") + ", mask AS MATERIALIZED (SELECT page_no, y, x, gray, norm, threshold, CAST(norm <= threshold AS INT) AS fg FROM st)"
TO_NORM = ",\n".join((PX, HIST, TILES, SURFACE, NORM))
TO_MASK = f"{TO_NORM},\n{SMASK}"
COMPONENTS = """fgp AS MATERIALIZED (SELECT page_no, y, x, CAST(y AS BIGINT) * (max(x) OVER (PARTITION BY page_no) + 1) + x AS p, fg FROM mask),
fg AS MATERIALIZED (SELECT page_no, y, x, p FROM fgp WHERE fg = 1),
nb AS MATERIALIZED (SELECT a.page_no, a.p, b.p AS q FROM fg a JOIN fg b ON a.page_no = b.page_no AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.p <> b.p),
cc(page_no, p, root) USING KEY (page_no, p) AS (
  SELECT page_no, p, p FROM fg
  UNION
  SELECT nb.page_no, nb.q, min(cc.root) FROM cc JOIN nb ON nb.page_no = cc.page_no AND nb.p = cc.p
  JOIN recurring.cc AS old ON old.page_no = nb.page_no AND old.p = nb.q
  WHERE cc.root < old.root GROUP BY nb.page_no, nb.q),
lab AS MATERIALIZED (SELECT fg.page_no, fg.y, fg.x, cc.root FROM fg JOIN cc USING (page_no, p))"""
TO_LAB = f"{TO_MASK},\n{COMPONENTS}"
STATS = "stats AS (SELECT page_no, root, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM lab GROUP BY ALL)"

#: Four pixels of a row as a hexadecimal digit, rows padded to whole bytes.
NIBBLES = """wide AS (SELECT *, max(x) OVER (PARTITION BY page_no) + 1 AS width FROM {0}),
cells AS (SELECT page_no, y, x, width, fg FROM wide UNION ALL SELECT page_no, y, width + i, width, 0 FROM (SELECT DISTINCT page_no, y, width FROM wide), unnest(range(0, (8 - width % 8) % 8)) AS t(i)),
nibbles AS (SELECT page_no, y, x // 4 AS n, width, substr('0123456789ABCDEF', CAST(1 + sum(fg << (3 - x % 4)::INT) AS INT), 1) AS h FROM cells GROUP BY page_no, y, x // 4, width)"""
GLYPHS = f"glyph AS MATERIALIZED ({GLYPH_SQL})"
#: By construction glyph lines are the lines of the text that show anything, and words their tokens.
LINED = "lined AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line) - 1 AS INT) AS line_no FROM glyph)"
WORDED = """opened AS (SELECT *, CASE WHEN col - lag(col) OVER w > 1 THEN 1 ELSE 0 END AS opens FROM lined WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY col)),
worded AS MATERIALIZED (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY col) AS INT) AS word_no FROM opened)"""
SCALE = f"CAST({DPI / 72}::DOUBLE AS FLOAT)"
BOXES = f"""boxed AS (SELECT doc_id, page_no, line_no, word_no, string_agg(text, '' ORDER BY col) AS word, count(*) AS n,
  min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1, list(y ORDER BY y) AS ys FROM worded GROUP BY ALL),
boxes AS MATERIALIZED (SELECT *, CAST(floor(CAST(x0 * {SCALE} AS DOUBLE) + 0.5::DOUBLE) AS INT) AS px, CAST(floor(CAST(y0 * {SCALE} AS DOUBLE) + 0.5::DOUBLE) AS INT) AS py,
  greatest(1, CAST(floor(CAST((x1 - x0) * {SCALE} AS DOUBLE) + 0.5::DOUBLE) AS INT)) AS pw, greatest(1, CAST(floor(CAST((y1 - y0) * {SCALE} AS DOUBLE) + 0.5::DOUBLE) AS INT)) AS ph FROM boxed)"""
RATIO = f"""ratio AS (SELECT *, CAST(greatest(0, least(1, CAST(CAST(CAST(ys[len(ys) // 2 + 1] * {SCALE} AS FLOAT) - CAST(py AS FLOAT) AS FLOAT) AS DOUBLE) / ph)) AS FLOAT) AS ratio FROM boxes)"""
TO_BOXES = ",\n".join((GLYPHS, LINED, WORDED, BOXES))
DIFF = """dg AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) >= lag(height) OVER w * 0.5 OR x - (lag(x) OVER w + lag(width) OVER w) > lag(width) OVER w * 0.5 THEN 1 ELSE 0 END AS opens
  FROM (SELECT * REPLACE (CAST(floor(y / 12) * 12 AS FLOAT) AS y) FROM glyph) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y, x, seq)),
dn AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_no ORDER BY y, x, seq) AS INT) AS word_no FROM dg),
dw AS MATERIALIZED (SELECT doc_id, page_no, word_no, string_agg(text, '' ORDER BY y, x, seq) AS word, CAST(min(x) AS INT) AS x, CAST(min(y) AS INT) AS y,
  CAST(max(x + width) - min(x) AS INT) AS w, CAST(max(y + height) - min(y) AS INT) AS h FROM dn GROUP BY ALL)"""
MATCH = """a AS (SELECT doc_id, page_no, word_no, word, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM dw),
b AS (SELECT * REPLACE (x + word_no % 5 * 0.25::DOUBLE AS x) FROM a WHERE word_no % 17 <> 0),
cand AS (SELECT a.doc_id, a.page_no, a.word_no, b.word_no AS match_no, greatest(abs(b.x - a.x), abs(b.y - a.y), abs(b.w - a.w), abs(b.h - a.h)) AS off,
  row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.word_no ORDER BY abs(b.x - a.x), b.word_no) AS r
  FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.word = b.word AND abs(b.y - a.y) <= (b.h + a.h) / 2 * 1.5),
matched AS (SELECT a.*, match_no, CASE WHEN match_no IS NULL THEN 'missing' WHEN off > 0.5 THEN 'differing' ELSE 'matched' END AS status
  FROM a LEFT JOIN (SELECT * FROM cand WHERE r = 1) c USING (doc_id, page_no, word_no))"""
LINKS = """links AS MATERIALIZED (SELECT page_id AS doc_id, CAST(i - 1 AS INT) AS ordinal, regexp_extract_all(html, '<a href="([^"]*)"', 1)[i] AS uri
  FROM pages, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) + 1)) AS t(i))"""
INFO = """info AS (SELECT page_id AS doc_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<meta name="author" content="([^"]*)"', 1), '') AS author,
  nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS subject, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS keywords, nullif(regexp_extract(html, '&copy; ([^ ]*) ', 1), '') AS creator,
  CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END AS producer FROM pages)"""
ITEMS = f"""{LINKS}, items AS MATERIALIZED (SELECT page_id AS doc_id, 0 AS item_id, NULL::INT AS parent_id, 0 AS ordinal, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS title, 0 AS dest_page FROM pages
  UNION ALL SELECT doc_id, ordinal + 1, ordinal // 2, ordinal % 2, substr(uri, 2), CAST(length(uri) % 8 AS INT) FROM links)"""


def _size(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN CAST(floor({n} / 1024.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) || ' KB' ELSE printf('%.1f MB', {n} / 1048576.0::DOUBLE) END"


_TOKENS = "SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\s+')) AS word FROM documents"

ORACLE_SQL = {
    "luma": """WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor(128 + 256 * CAST(v AS DOUBLE)))) AS INT)) AS q FROM embeddings),
c AS (SELECT vec_id // 64 AS page_no, vec_id * 21 + i AS pixel_id, q[3 * i + 1] AS r, q[3 * i + 2] AS g, q[3 * i + 3] AS b FROM q, unnest(range(0, len(q) // 3)) AS t(i))
SELECT page_no, pixel_id, r, g, b, CAST((77 * r + 150 * g + 29 * b) >> 8 AS INT) AS gray FROM c""",
    "tile_histogram": f"WITH {PX}, {HIST} SELECT * FROM hist",
    "tile_percentile": f"WITH {PX}, {HIST}, {TILES} SELECT * FROM tiles",
    "background_surface": f"WITH {PX}, {HIST}, {TILES}, {SURFACE} SELECT * FROM surf",
    "background_normalize": f"WITH {TO_NORM} SELECT * FROM norm",
    "otsu_threshold": f"WITH {TO_NORM}, {OTSU} SELECT * FROM thr",
    "otsu_mask": f"WITH {TO_NORM}, {OTSU}, {OMASK} SELECT page_no, min(threshold) AS threshold, CAST(sum(fg) AS BIGINT) AS ink, count(*) AS pixels FROM om GROUP BY page_no",
    "otsu_pixels": f"WITH {TO_NORM}, {OTSU}, {OMASK} SELECT page_no, y, x, fg, CASE fg WHEN 1 THEN -16777216 ELSE -1 END AS colour FROM om",
    "integral_image": f"""WITH {PX}, a AS (SELECT page_no, y, x, sum(gray) OVER w AS a, sum(gray * gray) OVER w AS b FROM px WINDOW w AS (PARTITION BY page_no, y ORDER BY x))
SELECT page_no, y, x, CAST(sum(a) OVER w AS BIGINT) AS s, CAST(sum(b) OVER w AS BIGINT) AS s2 FROM a WINDOW w AS (PARTITION BY page_no, x ORDER BY y)""",
    "box_sum": f"""WITH {PX}, a AS (SELECT *, sum(gray) OVER (PARTITION BY page_no, y ORDER BY x RANGE BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS a FROM px)
SELECT page_no, y, x, CAST(sum(a) OVER (PARTITION BY page_no, x ORDER BY y RANGE BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS BIGINT) AS box FROM a""",
    "sauvola_threshold": f"WITH {PX}, {sauvola('gray', 'px')} SELECT * FROM st",
    "sauvola_mask": f"WITH {TO_MASK} SELECT * FROM mask",
    "components": f"WITH RECURSIVE {TO_LAB} SELECT * FROM lab",
    "component_stats": f"WITH RECURSIVE {TO_LAB}, {STATS} SELECT * FROM stats",
    "component_filter": f"""WITH RECURSIVE {TO_LAB}, {STATS}, dims AS (SELECT page_no, max(y) + 1 AS h, max(x) + 1 AS w FROM mask GROUP BY page_no)
SELECT lab.page_no, lab.y, lab.x FROM lab JOIN stats USING (page_no, root) JOIN dims USING (page_no)
WHERE NOT (area > floor(h * w * {AREA}::DOUBLE) OR greatest(max_x - min_x, max_y - min_y) + 1 > floor(greatest(h, w) * {DIM}::DOUBLE))""",
    "symbol_dictionary": f"""WITH RECURSIVE {TO_LAB}, {STATS}, s AS (SELECT lab.page_no, lab.root, count(*) AS area, string_agg((lab.y - min_y) || ':' || (lab.x - min_x), ' ' ORDER BY lab.y, lab.x) AS symbol
  FROM lab JOIN stats USING (page_no, root) GROUP BY lab.page_no, lab.root)
SELECT symbol, count(*) AS uses, count(DISTINCT page_no) AS pages, max(area) AS area FROM s GROUP BY symbol""",
    "inpaint_distance": f"""WITH {TO_MASK}, bg AS (SELECT * FROM mask WHERE fg = 0)
SELECT m.page_no, m.y, m.x, m.fg, CAST(coalesce(min(abs(m.y - bg.y) + abs(m.x - bg.x)), 1073741823) AS INT) AS dist FROM mask m LEFT JOIN bg ON bg.page_no = m.page_no GROUP BY ALL""",
    "page_layers": f"""WITH RECURSIVE {TO_LAB}, {STATS}, s AS (SELECT lab.page_no, lab.root, min_y, min_x, string_agg((lab.y - min_y) || ':' || (lab.x - min_x), ' ' ORDER BY lab.y, lab.x) AS symbol
  FROM lab JOIN stats USING (page_no, root) GROUP BY ALL),
g AS (SELECT page_no // 4 AS doc_id, md5(string_agg(DISTINCT symbol, '|' ORDER BY symbol)) AS globals FROM s GROUP BY ALL),
r AS (SELECT page_no, string_agg(md5(symbol) || '@' || min_y || ',' || min_x, ' ' ORDER BY root) AS refs FROM s GROUP BY page_no),
p AS (SELECT page_no, page_no // 4 AS doc_id, max(y) + 1 AS height, max(x) + 1 AS width, sum(fg) AS ink, md5(string_agg(printf('%02X', gray), '' ORDER BY y, x)) AS data_md5 FROM mask GROUP BY page_no)
SELECT doc_id, page_no, 0 AS z, 'background' AS kind, 'raw' AS codec, height, width, NULL AS globals, data_md5 FROM p
UNION ALL SELECT doc_id, page_no, 1, 'colour', 'raw', height, width, NULL, data_md5 FROM p WHERE ink > 0 AND doc_id % 2 = 1
UNION ALL SELECT doc_id, page_no, CASE doc_id % 2 WHEN 1 THEN 2 ELSE 1 END, CASE doc_id % 2 WHEN 1 THEN 'smask' ELSE 'stencil' END, 'symbols', height, width, globals, md5(upper(hex(refs))) FROM p JOIN r USING (page_no) JOIN g USING (doc_id)""",
    "mask_g4": f"""WITH {TO_MASK}, {NIBBLES.format("mask")}
SELECT page_no, max(y) + 1 AS height, any_value(width) AS width, md5(string_agg(h, '' ORDER BY y, n)) AS bits_md5 FROM nibbles GROUP BY page_no""",
    "dense_pages": f"""WITH RECURSIVE {TO_LAB}, {STATS}, dims AS (SELECT page_no, max(y) + 1 AS h, max(x) + 1 AS w FROM mask GROUP BY page_no),
kept AS (SELECT lab.page_no, lab.y, lab.x FROM lab JOIN stats USING (page_no, root) JOIN dims USING (page_no)
  WHERE NOT (area > floor(h * w * {AREA}::DOUBLE) OR greatest(max_x - min_x, max_y - min_y) + 1 > floor(greatest(h, w) * {DIM}::DOUBLE))),
clean AS (SELECT m.page_no, m.y, m.x, CAST(k.x IS NOT NULL AS INT) AS fg FROM mask m LEFT JOIN kept k ON k.page_no = m.page_no AND k.y = m.y AND k.x = m.x), {NIBBLES.format("clean")},
i AS (SELECT page_no, CAST(sum(fg) AS BIGINT) AS ink FROM clean GROUP BY page_no)
SELECT page_no, CAST(max(y) + 1 AS INT) AS height, CAST(any_value(width) AS INT) AS width, any_value(ink) AS ink, md5(string_agg(h, '' ORDER BY y, n)) AS mask_md5 FROM nibbles JOIN i USING (page_no) GROUP BY page_no""",
    "font_choice": """WITH c AS (SELECT s_nationkey AS doc_id, s_name AS path, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '-1' WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS font,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_suppkey) AS n, s_acctbal > 0 AS readable FROM supplier)
SELECT doc_id, CASE WHEN readable AND font IS NOT NULL THEN path END AS path, CASE WHEN readable AND font IS NOT NULL THEN font ELSE 'Helvetica' END AS font FROM c WHERE n = 1""",
    "diff_pages": f"""WITH n AS (SELECT doc_id, (len(string_split(coalesce(text, ''), chr(10))) - 1) // {LINES_A_PAGE} AS last FROM documents)
SELECT doc_id, CAST(CASE WHEN last % 3 = 2 THEN last ELSE last + 1 END AS BIGINT) AS pages FROM n""",
    "run_report": f"""WITH {LINKS}, a AS (SELECT doc_id, count(*) AS n FROM links GROUP BY doc_id),
f AS (SELECT *, regexp_extract_all(html, '<style>(.*?)</style>', 1) || regexp_extract_all(html, '<script>(.*?)</script>', 1) AS c FROM pages),
o AS (SELECT *, CAST(greatest(1, ceil(len(regexp_extract_all(html, '<p>')) / 5)) AS INT) AS n_pages, CAST(strlen(html) AS BIGINT) AS bytes_in,
  CAST(coalesce(list_sum(list_transform(c, lambda x: strlen(x))), 0) AS BIGINT) AS bytes_out FROM f)
SELECT page_id AS doc_id, n_pages, CAST(len(regexp_extract_all(html, '[a-z]+')) AS BIGINT) AS words, bytes_in, bytes_out, CAST(floor(bytes_out * 1000 / bytes_in + 0.5) AS BIGINT) AS permille,
  CAST(n_pages * 4 AS BIGINT) AS seconds, CAST(regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '' AS BIGINT) AS outlines, coalesce(n, 0) AS annotations, CAST(len(c) AS BIGINT) AS embedded_files FROM o LEFT JOIN a ON a.doc_id = page_id""",
    "mask_runs": f"""WITH {TO_MASK}, g AS (SELECT *, x - row_number() OVER (PARTITION BY page_no, y ORDER BY x) AS g FROM mask WHERE fg = 1)
SELECT page_no, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY page_no, y, g""",
    "glyph_table": f"""WITH {GLYPHS} SELECT doc_id, page_no, count(*) AS n, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS sx, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS sy,
CAST(sum(CAST(height AS BIGINT)) AS BIGINT) AS sh, max(seq) AS last FROM glyph GROUP BY ALL""",
    "page_median_height": f"WITH {GLYPHS}, r AS (SELECT doc_id, page_no, list(height ORDER BY height) AS h FROM glyph GROUP BY ALL) SELECT doc_id, page_no, CAST(h[len(h) // 2 + 1] AS INT) AS height FROM r",
    "line_clusters": f"WITH {GLYPHS}, {LINED} SELECT doc_id, page_no, line_no, count(*) AS n, min(seq) AS first, max(seq) AS last FROM lined GROUP BY ALL",
    "word_split": f"WITH {TO_BOXES} SELECT doc_id, page_no, line_no, word_no, word FROM boxes",
    "word_boxes": f"WITH {TO_BOXES} SELECT doc_id, page_no, line_no, word_no, px, py, pw, ph, CAST(n AS INT) AS n FROM boxes",
    "word_count_exact": f"SELECT doc_id, count(*) AS words FROM ({_TOKENS}) WHERE word <> '' GROUP BY doc_id",
    "word_count_sampled": f"""WITH l AS (SELECT doc_id, (i - 1) // {LINES_A_PAGE} AS page_no, string_split(coalesce(text, ''), chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
n AS (SELECT doc_id, max(page_no) + 1 AS total, sum(CASE WHEN page_no < 10 THEN len(regexp_extract_all(s, '\\S+')) ELSE 0 END) AS n FROM l GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN total <= 10 THEN n ELSE floor(CAST(n AS DOUBLE) / 10 * total) END AS BIGINT) AS words FROM n""",
    "cjk_pages": "SELECT doc_id, bool_or(regexp_matches(coalesce(text, ''), '[\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af\u3400-\u4dbf]')) AS cjk FROM documents GROUP BY doc_id",
    "encodable_text": f"""WITH t AS (SELECT * FROM ({_TOKENS}) WHERE word <> ''), c AS (SELECT doc_id, unnest(string_split(word, '')) AS ch FROM t)
SELECT doc_id, CAST(sum(CASE WHEN unicode(ch) BETWEEN 32 AND 126 OR unicode(ch) BETWEEN 161 AND 255 THEN 0 WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END) AS BIGINT) AS skipped,
CAST(sum(CASE WHEN unicode(ch) BETWEEN 32 AND 126 OR unicode(ch) BETWEEN 161 AND 255 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM c GROUP BY doc_id""",
    "baseline_ratio": f"WITH {TO_BOXES}, {RATIO} SELECT doc_id, page_no, line_no, word_no, CAST(floor(CAST(ratio AS DOUBLE) * 10000 + 0.5::DOUBLE) AS INT) AS ratio FROM ratio",
    "text_placement": f"""WITH {TO_BOXES}, {RATIO},
n AS (SELECT *, greatest(ph * 0.48::DOUBLE, 1.0::DOUBLE) AS size, regexp_replace(word, '[^ -~¡-ÿ]', '', 'g') AS safe FROM ratio),
k AS (SELECT *, regexp_matches(safe, '[^ -~]') AS guessed, len(regexp_extract_all(safe, '[0-9]')) AS d, len(regexp_extract_all(safe, '[A-Z]')) AS u, len(regexp_extract_all(safe, '[a-z]')) AS l FROM n),
m AS (SELECT *, CASE WHEN guessed THEN length(safe) * size * 0.5::DOUBLE ELSE (d * 556 + u * 667 + l * 500 + (length(safe) - d - u - l) * 333) / 1000.0::DOUBLE * size END AS nat FROM k)
SELECT doc_id, page_no, line_no, word_no, CAST(floor(px * 0.48::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS place_x,
CAST(floor((792.0::DOUBLE - (py + ph * CAST(ratio AS DOUBLE)) * 0.48::DOUBLE) * 1000 + 0.5::DOUBLE) AS BIGINT) AS place_y, CAST(floor(size * 1000 + 0.5::DOUBLE) AS BIGINT) AS size,
CAST(floor(CASE WHEN nat > 0 THEN pw * 0.48::DOUBLE / nat ELSE 1.0::DOUBLE END * 1000 + 0.5::DOUBLE) AS BIGINT) AS stretch FROM m""",
    "bbox_words": f"WITH {GLYPHS}, {DIFF} SELECT * FROM dw",
    "bbox_match": f"WITH {GLYPHS}, {DIFF}, {MATCH} SELECT doc_id, page_no, word_no, CASE WHEN length(word) <= 18 THEN word ELSE substr(word, 1, 18) || '…' END AS word, match_no, status FROM matched",
    "bbox_summary": f"WITH {GLYPHS}, {DIFF}, {MATCH} SELECT doc_id, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'differing') AS differing, count(*) FILTER (WHERE status = 'missing') AS missing FROM matched GROUP BY doc_id",
    "event_gaps": """WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM o)
SELECT user_id, session_no, count(*) AS events, min(event_id) AS first_event FROM n GROUP BY ALL""",
    "doc_info": f"WITH {INFO} SELECT doc_id, field, value FROM (UNPIVOT info ON title, author, subject, keywords, creator, producer INTO NAME field VALUE value)",
    "producer_chain": f"WITH {INFO} SELECT doc_id, CASE WHEN producer IS NULL OR trim(producer) = '' THEN 'leafstrata' ELSE producer || ' -> leafstrata' END AS producer FROM info",
    "outline_tree": f"""WITH RECURSIVE {ITEMS}, tree AS (SELECT doc_id, item_id, 0 AS depth, lpad(CAST(ordinal AS VARCHAR), 10, '0') AS path, coalesce(title, '') AS title FROM items WHERE parent_id IS NULL
UNION ALL SELECT i.doc_id, i.item_id, depth + 1, path || '/' || lpad(CAST(i.ordinal AS VARCHAR), 10, '0'), coalesce(i.title, '') FROM tree JOIN items i ON i.doc_id = tree.doc_id AND i.parent_id = tree.item_id) SELECT * FROM tree""",
    "outline_dest": f"""WITH {ITEMS}, n AS (SELECT page_id AS doc_id, greatest(1, ceil(len(regexp_extract_all(html, '<p>')) / 5)) AS n_pages FROM pages)
SELECT doc_id, item_id, CASE WHEN dest_page < n_pages THEN dest_page END AS dest_page FROM items LEFT JOIN n USING (doc_id)""",
    "annotations": f"""WITH {LINKS}, n AS (SELECT page_id AS doc_id, greatest(1, ceil(len(regexp_extract_all(html, '<p>')) / 5)) - page_id % 2 AS n FROM pages)
SELECT doc_id, CAST(ordinal // 2 AS INT) AS page_no, ordinal, 'Link' AS subtype, uri, 'Subtype,URI' AS keys FROM links JOIN n USING (doc_id) WHERE ordinal // 2 < n""",
    "attachments": """WITH f AS (SELECT page_id, 'style' AS subtype, regexp_extract_all(html, '<style>(.*?)</style>', 1) AS c FROM pages UNION ALL SELECT page_id, 'script', regexp_extract_all(html, '<script>(.*?)</script>', 1) FROM pages)
SELECT page_id AS doc_id, subtype || '-' || (i - 1) AS name, subtype, CAST(strlen(c[i]) AS INT) AS size, sha256(c[i]) AS sha256 FROM f, unnest(range(1, len(c) + 1)) AS t(i)""",
    "preserve_counts": f"""WITH {LINKS}, a AS (SELECT doc_id, count(*) AS n FROM links GROUP BY doc_id)
SELECT page_id AS doc_id, CAST(regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '' AS BIGINT) AS outlines, coalesce(n, 0) AS annotations,
CAST(len(regexp_extract_all(html, '<style>(.*?)</style>')) + len(regexp_extract_all(html, '<script>(.*?)</script>')) AS BIGINT) AS embedded_files FROM pages LEFT JOIN a ON a.doc_id = page_id""",
    "graph_copy": f"""WITH RECURSIVE {LINKS}, a AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM links),
e AS MATERIALIZED (SELECT doc_id, ordinal AS src, CAST((ordinal * 31 + length(uri)) % n AS INT) AS dst, 0 AS k FROM a UNION ALL SELECT doc_id, ordinal, CAST((ordinal + 1) % n AS INT), length(uri) FROM a),
r AS (SELECT doc_id, 0 AS node, 0 AS kind FROM links WHERE ordinal = 0
  UNION SELECT e.doc_id, e.dst, CAST((e.dst + e.k // 5) % 3 AS INT) FROM r JOIN e ON e.doc_id = r.doc_id AND e.src = r.node)
SELECT doc_id, node, ['dictionary', 'array', 'stream'][kind + 1] AS kind, uri AS value FROM r JOIN links USING (doc_id) WHERE ordinal = node""",
    "pdfa_identification": f"""WITH k AS (SELECT page_id, page_id % 6 AS kind, '<rdf:Description rdf:about="' || regexp_replace(url, '[<>&"]', '', 'g') || '" xmlns:pdfaid="{PDFA}">' AS about FROM pages)
SELECT page_id AS doc_id, CASE WHEN kind = 2 THEN '<other/>' WHEN kind IN (3, 5) THEN '{static_packet()}' ELSE '{PACKET_BEGIN}{XMP_OPEN}' || about ||
  CASE kind WHEN 1 THEN '<pdfaid:part xmlns:pdfaid="{PDFA}">1</pdfaid:part>' ELSE '<pdfaid:part>2</pdfaid:part>' END || '<pdfaid:conformance>B</pdfaid:conformance></rdf:Description>{XMP_CLOSE}{PACKET_END}' END AS xmp FROM k""",
    "settings_map": """SELECT key, value, TRY_CAST(CASE WHEN regexp_full_match(value, '[-+]?[0-9]+') THEN value END AS INT) AS as_int, TRY_CAST(value AS DOUBLE) AS as_double, lower(value) = 'true' AS as_boolean
FROM (VALUES ('rendering.dpi', '300'), ('segmenter.percentile', '0.95'), ('jbig2enc.flags', '-p // -s'), ('pdf.pdfa.enabled', 'true')) AS t(key, value)""",
    "page_zip": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CAST(l_quantity AS BIGINT) AS background, l_returnflag, l_linestatus FROM lineitem),
m AS (SELECT doc_id, page_no, 1 AS mask FROM l WHERE l_returnflag = 'R'), c AS (SELECT doc_id, page_no, 1 AS colour FROM l WHERE l_linestatus = 'O'),
t AS (SELECT doc_id, page_no, o_orderpriority AS text FROM l JOIN orders ON o_orderkey = doc_id)
SELECT doc_id, page_no, background, text, mask, colour FROM l JOIN t USING (doc_id, page_no) LEFT JOIN m USING (doc_id, page_no) LEFT JOIN c USING (doc_id, page_no)""",
    "page_dims": """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 IN (1, 3) THEN 200 + p_size ELSE 100 + p_size END AS width, CASE WHEN p_partkey % 4 IN (1, 3) THEN 100 + p_size ELSE 200 + p_size END AS height FROM part""",
    "size_format": f"""WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, 'd.' || source AS stem FROM documents)
SELECT doc_id, {_size("n")} AS size, {_size("(n * 1000)")} AS size_k, stem FROM d""",
    "layer_report": f"""WITH {TO_MASK}, s AS (SELECT page_no, max(y) + 1 AS h, max(x) + 1 AS w, sum(fg) AS ink FROM mask GROUP BY page_no),
l AS (SELECT page_no, 0 AS z, 'background' AS kind, 3 * w * h AS bytes FROM s UNION ALL SELECT page_no, 1, 'colour', 3 * w * h FROM s WHERE ink > 0 UNION ALL SELECT page_no, 2, 'smask', h * ((w + 7) // 8) FROM s WHERE ink > 0)
SELECT page_no, count(*) AS layers, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) // 1024 AS BIGINT) AS kb, string_agg(kind, '>' ORDER BY z) AS stack FROM l GROUP BY page_no""",
    "stream_ingest": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
}
