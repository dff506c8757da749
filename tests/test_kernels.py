import math

import numpy as np
import pandas as pd
import pytest

from leafstrata.operators import components as comp
from leafstrata.operators import kernels, raster
from leafstrata.sources.files import bmp_bytes, read_page_images, segment_pages

rng = np.random.default_rng(5)


def frame(spark, *planes: np.ndarray, name="gray"):
    rows = [(n, int(y), int(x), int(p[y, x])) for n, p in enumerate(planes) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, f"page_no long, y int, x int, {name} int")


def plane(df, name, page=0):
    p = df.where(f"page_no = {page}").select("y", "x", name).toPandas()
    out = np.zeros((p.y.max() + 1, p.x.max() + 1), np.int64)
    out[p.y, p.x] = p[name]
    return out


PAGES = [
    rng.integers(0, 256, (30, 41)),  # partial edge tiles
    np.full((5, 7), 0),  # smaller than a tile, all dark
    np.full((5, 7), 255),
    np.array([[7]]),
]


def test_normalisation_and_thresholds_agree_with_relational_form(spark):
    px = frame(spark, *PAGES)
    norm = raster.normalised_pages(px, 16, 0.95).cache()
    thr = {r.page_no: r.threshold for r in raster.otsu_threshold(norm).collect()}
    local = raster.sauvola_threshold(norm, "norm", 15, 0.2, 128).cache()
    for i, p in enumerate(PAGES):
        want = kernels.normalise(p, 16, 0.95)
        assert (plane(norm, "norm", i) == want).all()
        assert thr[i] == kernels.otsu(want)
        assert (plane(local, "threshold", i) == kernels.sauvola(want, 15, 0.2, 128)).all()


def test_displaced_surface():
    assert kernels.surface(np.array([[10, 20, 30, 40]]), 1, 32, 8)[0, 4::8].tolist() == [20, 30, 40, 40]


def flood(mask):
    h, w = mask.shape
    root = np.full((h, w), -1)
    for y in range(h):
        for x in range(w):
            if mask[y, x] and root[y, x] < 0:
                todo = [(y, x)]
                root[y, x] = y * w + x
                while todo:
                    a, b = todo.pop()
                    for c in range(max(a - 1, 0), min(a + 2, h)):
                        for d in range(max(b - 1, 0), min(b + 2, w)):
                            if mask[c, d] and root[c, d] < 0:
                                root[c, d] = y * w + x
                                todo.append((c, d))
    return root


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_components(share):
    for shape in ((1, 1), (1, 9), (9, 1), (23, 31)):
        mask = (rng.random(shape) < share).astype(int)
        assert (kernels.components(mask) == flood(mask)).all()


def scan_fill(colour, mask):
    """The sequential definition: two sweeps in scan order."""
    h, w = mask.shape
    dist, out = np.where(mask == 0, 0, kernels.FAR), colour.copy()
    for ys, xs, steps in ((range(h), range(w), ((-1, 0), (0, -1))), (range(h - 1, -1, -1), range(w - 1, -1, -1), ((1, 0), (0, 1)))):
        for y in ys:
            for x in xs:
                for dy, dx in steps if dist[y, x] else ():
                    a, b = y + dy, x + dx
                    if 0 <= a < h and 0 <= b < w and dist[a, b] + 1 < dist[y, x]:
                        dist[y, x], out[y, x] = dist[a, b] + 1, out[a, b]
    return dist, out


@pytest.mark.parametrize("shape", [(1, 1), (1, 8), (8, 1), (17, 12)])
def test_inpaint_keeps_scan_order(shape):
    for share in (0.3, 0.9, 1.0):
        mask, colour = (rng.random(shape) < share).astype(int), rng.integers(0, 256, shape)
        d, f = kernels.inpaint(colour, mask)
        want_d, want_f = scan_fill(colour, mask)
        assert (d == want_d).all() and (f == want_f).all()


def test_inpaint_distance_relational(spark):
    masks = [(rng.random((9, 11)) < s).astype(int) for s in (0.7, 1.0)]
    got = raster.inpaint_distance(frame(spark, *masks, name="fg"))
    for i, m in enumerate(masks):
        assert (plane(got, "dist", i) == kernels.inpaint(m, m)[0]).all()


def test_bounded_inpaint_whitens_the_core_of_a_thick_stroke():
    gray = np.full((100, 100), 200)
    gray[:, 45:55] = 0
    mask = (gray == 0).astype(int)
    assert kernels.inpaint(gray, mask, 0)[1][50, 50] == 200
    far = kernels.inpaint(np.repeat(gray[..., None], 3, 2), mask, 3)[1]
    assert (far[50, 50] == 255).all() and (far[50, 45] == 200).all()


def test_large_components_are_dropped(spark):
    mask = np.zeros((200, 200), int)
    mask[10:30, 10:30] = 1
    mask[50:130, 50:200] = 1
    out = kernels.drop_large(mask, 0.10, 0.30)
    assert out[20, 20] == 1 and out[90, 120] == 0
    kept = {(r.y, r.x) for r in comp.component_filter(frame(spark, mask, name="fg"), 0.10, 0.30).collect()}
    assert kept == set(zip(*np.nonzero(out), strict=True))
    assert (kernels.drop_large(mask, 0, 0) == mask).all()


def weights(sigma):
    """Weights by plain arithmetic: a single exponent, a double power rounded once, a single sum."""
    f = np.float32
    r = math.ceil(f(2) * f(sigma))
    raw = [f(math.exp(float(f(-(i * i)) / (f(2) * f(sigma) * f(sigma))))) for i in range(-r, r + 1)]
    total = f(0)
    for v in raw:
        total = f(total + v)
    return [f(v / total) for v in raw]


@pytest.mark.parametrize("sigma", [0.3, 0.8, 1.7, 2.4242])
def test_gaussian_weights(sigma):
    assert kernels.gaussian_weights(sigma).tolist() == [float(w) for w in weights(sigma)]


def test_gaussian_blur_against_loops():
    p, k = rng.integers(0, 256, (6, 9)), weights(0.8)
    r = len(k) // 2
    f = np.float32
    mid, out = np.zeros_like(p), np.zeros_like(p)
    for src, dst, axis in ((p, mid, 1), (mid, out, 0)):
        for y in range(6):
            for x in range(9):
                acc = f(0)
                for j in range(-r, r + 1):
                    a, b = (y, min(max(x + j, 0), 8)) if axis else (min(max(y + j, 0), 5), x)
                    acc += k[j + r] * f(src[a, b])
                dst[y, x] = int(acc)
    assert (kernels.gaussian_blur(p, 0.8) == out).all()
    assert kernels.gaussian_blur(p, 0.0) is p


def test_downscale_keeps_flat_planes_and_sizes():
    assert kernels.downscale(np.full((10, 7, 3), 9), 0.33).shape == (3, 2, 3)
    assert (kernels.downscale(np.full((10, 7), 9), 0.33) == 9).all()
    assert kernels.downscale(np.ones((1, 1), int), 0.1).shape == (1, 1)


def test_page_images_are_segmented_whole(spark, tmp_path):
    page = np.full((120, 90, 3), 230, np.uint8)
    page[40:44, 20:24] = 10
    (tmp_path / "p.bmp").write_bytes(bmp_bytes(page))
    (r,) = segment_pages(read_page_images(spark, str(tmp_path))).collect()
    mask = np.unpackbits(np.frombuffer(r.mask, np.uint8).reshape(120, -1), axis=1)[:, :90]
    want, background = kernels.segment(page.astype(int))
    assert (mask == want).all() and mask[41, 21] == 1 and mask[0, 0] == 0 and r.ink == want.sum()
    assert (np.frombuffer(r.background, np.uint8).reshape(120, 90, 3) == background).all()


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_no long, y int, x int, gray int, fg int")
    assert comp.components(none).count() == 0 and comp.symbol_dictionary(none).count() == 0
    assert raster.otsu_mask(none.drop("fg"), 16, 0.95).count() == 0 and raster.mask_runs(none).count() == 0
    assert isinstance(comp.inpaint_fill(none).toPandas(), pd.DataFrame)
