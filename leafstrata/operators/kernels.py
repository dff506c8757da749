"""Dense page kernels in numpy: the fast path for whole rasters, equal to the relational form."""

from __future__ import annotations

import numpy as np

FAR = (2**31 - 1) // 2


def luma(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    return (77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8


def tile_levels(gray: np.ndarray, tile: int, share: float) -> np.ndarray:
    """Background level of each tile: the value at the truncated percentile of its pixels."""
    h, w = gray.shape
    ty, tx = -(-h // tile), -(-w // tile)
    cell = (np.arange(h) // tile)[:, None] * tx + (np.arange(w) // tile)[None]
    hist = np.bincount((cell * 256 + gray).ravel(), minlength=ty * tx * 256).reshape(ty * tx, 256)
    cum = hist.cumsum(1)
    target = np.floor(cum[:, -1] * share).astype(np.int64)
    return (cum >= target[:, None]).argmax(1).reshape(ty, tx)


def surface(levels: np.ndarray, h: int, w: int, tile: int) -> np.ndarray:
    def axis(n, tiles):
        s = np.arange(n) + tile // 2
        t = np.minimum(s // tile, tiles - 1)
        return t, np.minimum(t + 1, tiles - 1), np.minimum(s - t * tile, tile - 1)

    y0, y1, fy = axis(h, levels.shape[0])
    x0, x1, fx = axis(w, levels.shape[1])
    top = levels[y0][:, x0] * (tile - fx) + levels[y0][:, x1] * fx
    bottom = levels[y1][:, x0] * (tile - fx) + levels[y1][:, x1] * fx
    return (top * (tile - fy)[:, None] + bottom * fy[:, None]) // (tile * tile)


def normalise(gray: np.ndarray, tile: int, share: float) -> np.ndarray:
    bg = surface(tile_levels(gray, tile, share), *gray.shape, tile)
    return np.where(bg == 0, gray, np.minimum(255, gray * 255 // np.maximum(bg, 1)))


def otsu(values: np.ndarray) -> int:
    hist = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    wb, sb = hist.cumsum(), (np.arange(256) * hist).cumsum()
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    gap = np.zeros(256)
    gap[ok] = sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]
    variance = wb * wf * gap * gap
    return int(variance.argmax()) if variance.max(initial=0) > 0 else 0


def box_sums(values: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clamped window sums of v and v * v by integral images, and the windows' areas."""
    h, w = values.shape
    y0, y1 = np.maximum(0, np.arange(h) - half), np.minimum(h, np.arange(h) + half + 1)
    x0, x1 = np.maximum(0, np.arange(w) - half), np.minimum(w, np.arange(w) + half + 1)

    def total(v):
        s = np.zeros((h + 1, w + 1), np.int64)
        s[1:, 1:] = v.cumsum(0).cumsum(1)
        return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]

    v = values.astype(np.int64)
    return total(v), total(v * v), (y1 - y0)[:, None] * (x1 - x0)[None]


def sauvola(values: np.ndarray, window: int, k: float, r: int) -> np.ndarray:
    s, q, n = box_sums(values, window // 2)
    mean = s / n
    std = np.sqrt(np.maximum(q / n - mean * mean, 0))
    return np.floor(mean * (1.0 + k * (std / r - 1.0)) + 0.5).astype(np.int64)


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected components: each foreground pixel gets its component's smallest pixel index, others -1.

    Rows are cut into runs; runs that touch in neighbouring rows hook to the smaller one
    until nothing changes, with pointer jumping.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask != 0
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]  # exclusive
    out = np.full((h, w), -1, np.int64)
    if not len(row):
        return out
    # runs of the row above that touch run i (also by a corner) are a stretch lo .. hi
    span = w + 3
    lo = np.searchsorted(row * span + stop, (row - 1) * span + start, side="left")
    hi = np.searchsorted(row * span + start, (row - 1) * span + stop, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), count)
    b = np.arange(len(a)) - np.repeat(count.cumsum() - count, count) + np.repeat(lo, count)
    label = np.arange(len(row))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    first = (row * w + start)[label]
    length = stop - start
    at = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length) + np.repeat(row * w + start, length)
    out.ravel()[at] = np.repeat(first, length)
    return out


def drop_large(mask: np.ndarray, max_area: float, max_dim: float) -> np.ndarray:
    """``mask`` without components of too large an area or side; a limit of 0 is off."""
    h, w = mask.shape
    if not max_area and not max_dim:
        return mask
    root = components(mask)
    y, x = np.nonzero(root >= 0)
    if not len(y):
        return mask
    names, inv = np.unique(root[y, x], return_inverse=True)
    area = np.bincount(inv)
    ends = []
    for v in (y, x):
        lo, hi = np.full(len(names), h + w), np.zeros(len(names), np.int64)
        np.minimum.at(lo, inv, v)
        np.maximum.at(hi, inv, v)
        ends.append(hi - lo + 1)
    drop = np.zeros(len(names), bool)
    if max_area:
        drop |= area > int(h * w * max_area)
    if max_dim:
        drop |= np.maximum(*ends) > int(max(h, w) * max_dim)
    out = mask.copy()
    out[y[drop[inv]], x[drop[inv]]] = 0
    return out


def inpaint(colour: np.ndarray, mask: np.ndarray, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and the plane with foreground filled from the nearest background in scan order.

    Two sweeps over anti-diagonals, which a sweep in scan order can't tell from its own
    order: a pixel depends on its upper and left (then lower and right) neighbours only.
    Ties keep the earlier neighbour. Beyond a positive radius the fill is white.
    """
    h, w = mask.shape
    dist = np.where(mask == 0, 0, FAR).astype(np.int64)
    fill = colour.copy()
    ys, xs = np.mgrid[0:h, 0:w]
    order = np.argsort((ys + xs).ravel(), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount((ys + xs).ravel()))])
    fronts = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    flat_d, flat_f = dist.ravel(), fill.reshape(h * w, -1)
    for steps, sweep in ((((-1, 0), (0, -1)), fronts), (((1, 0), (0, 1)), fronts[::-1])):
        for front in sweep:
            open_ = front[flat_d[front] != 0]
            for dy, dx in steps:
                y, x = open_ // w + dy, open_ % w + dx
                at = open_[(y >= 0) & (y < h) & (x >= 0) & (x < w)]
                source = at + dy * w + dx
                near = flat_d[source] + 1
                better = near < flat_d[at]
                flat_d[at[better]] = near[better]
                flat_f[at[better]] = flat_f[source[better]]
    out = flat_f.reshape(colour.shape).copy()
    if radius > 0:
        out[(dist > radius)] = 255 if colour.ndim == 3 else 0xFFFFFF
    return np.minimum(dist, FAR), out


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised float32 weights over -ceil(2 sigma) .. ceil(2 sigma)."""
    s = np.float32(sigma)
    radius = int(np.ceil(2 * s))
    if radius < 1:
        return np.ones(1, np.float32)
    i = np.arange(-radius, radius + 1)
    k = np.exp((-(i * i).astype(np.float32) / (np.float32(2) * s * s)).astype(np.float64)).astype(np.float32)  # the exponent is single, its power double
    total = np.float32(0)
    for v in k:
        total += v
    return k / total


def gaussian_blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur with clamped edges, float32 sums in tap order, truncated after each pass."""
    k = gaussian_weights(sigma)
    if len(k) < 3:
        return plane
    radius = len(k) // 2
    out = plane
    for axis in (1, 0):
        n = out.shape[axis]
        acc = np.zeros(out.shape, np.float32)
        for j, f in enumerate(k):
            acc += f * np.take(out, np.clip(np.arange(n) + j - radius, 0, n - 1), axis).astype(np.float32)
        out = acc.astype(plane.dtype)
    return out


def downscale(plane: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling to max(1, round(side * scale)), rounded to integers."""
    h, w = plane.shape[:2]
    nh, nw = max(1, int(np.floor(h * scale + 0.5))), max(1, int(np.floor(w * scale + 0.5)))

    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(h, nh)
    x0, x1, fx = axis(w, nw)
    p = plane.astype(np.float64)
    more = (slice(None),) + (None,) * (plane.ndim - 2)
    fx = fx[more] if plane.ndim > 2 else fx
    fy = fy.reshape(-1, *([1] * (plane.ndim - 1)))
    top, bottom = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + bottom * fy + 0.5).astype(plane.dtype)


def segment(rgb: np.ndarray, tile: int = 64, share: float = 0.95, mode: str = "sauvola", window: int = 15, k: float = 0.2, r: int = 128, max_area: float = 0.005, max_dim: float = 0.1, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Foreground mask (1 = text) and filled background of a page."""
    gray = luma(rgb)
    norm = normalise(gray, tile, share)
    fg = (gray <= otsu(norm)) if mode == "otsu" else (norm <= sauvola(norm, window, k, r))
    mask = drop_large(fg.astype(np.uint8), max_area, max_dim)
    return mask, inpaint(rgb, mask, radius)[1]
