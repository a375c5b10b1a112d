"""NumPy kernels on rasters: labelling, morphology and the measures of a region. They hold for one image at a time and know nothing of Spark."""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Connected components of true pixels: (labels from 1 in the order of their first pixels, number); 0 is background.

    Runs of a row are joined with those of the row above that touch them; only runs, not pixels, are looked at one by one.
    """
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    n = len(row)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if eight else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begin[i] < end[j] + reach and begin[j] < end[i] + reach:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    number: dict[int, int] = {}
    for k in range(n):
        r = root(k)
        out[row[k], begin[k] : end[k]] = number.setdefault(r, len(number) + 1)
    return out, len(number)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """With the background that doesn't reach the border, not even across a corner, filled."""
    outside, n = label(np.pad(~np.asarray(mask, bool), 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def shifted(mask: np.ndarray, dy: int, dx: int, fill=False) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets (row, column) within ``radius``."""
    r = int(np.floor(radius))
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= radius * radius]


def dilate(mask: np.ndarray, radius: float) -> np.ndarray:
    """Row by row of the disk: of a run of offsets the union is a difference of running sums."""
    mask = np.asarray(mask, bool)
    r = int(np.floor(radius))
    h, w = mask.shape
    total = np.zeros((h, w + 1), np.int32)
    total[:, 1:] = np.cumsum(mask, 1)
    out = np.zeros((h, w), bool)
    for dy in range(-r, r + 1):
        half = int(np.floor(np.sqrt(radius * radius - dy * dy)))
        x = np.arange(w)
        near = total[:, np.minimum(x + half + 1, w)] > total[:, np.maximum(x - half, 0)]
        out |= shifted(near, dy, 0)
    return out


def erode(mask: np.ndarray, radius: float) -> np.ndarray:
    return ~dilate(~np.asarray(mask, bool), radius)


def grey_dilate(image: np.ndarray, radius: float) -> np.ndarray:
    """The greatest value within the disk; beyond the border is nothing."""
    out = np.array(image, float)
    for y, x in disk(radius):
        np.maximum(out, shifted(np.asarray(image, float), y, x, -np.inf), out)
    return out


def outline(mask: np.ndarray) -> np.ndarray:
    """Background pixels that touch the mask, corners included."""
    mask = np.asarray(mask, bool)
    near = np.zeros_like(mask)
    for y in (-1, 0, 1):
        for x in (-1, 0, 1):
            near |= shifted(mask, y, x)
    return near & ~mask


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, cut at four sigma; the border value goes on beyond the border."""
    r = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def along(a: np.ndarray) -> np.ndarray:
        n = a.shape[1]
        padded = np.pad(a, ((0, 0), (r, r)), "edge")
        size = 1 << (n + 4 * r).bit_length()
        full = np.fft.irfft(np.fft.rfft(padded, size, 1) * np.fft.rfft(kernel, size), size, 1)
        return full[:, 2 * r : 2 * r + n]

    return along(along(np.asarray(image, float)).T).T


def otsu(image: np.ndarray, bins: int = 256) -> float:
    """The threshold between two classes with the greatest variance between them: the middle of a bin."""
    counts, edges = np.histogram(np.asarray(image, float).ravel(), bins)
    centers = (edges[:-1] + edges[1:]) / 2
    low, high = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean_low = np.cumsum(counts * centers) / low
        mean_high = (np.cumsum((counts * centers)[::-1]) / high[::-1])[::-1]
        between = low[:-1] * high[1:] * (mean_low[:-1] - mean_high[1:]) ** 2
    return float(centers[np.nanargmax(between)]) if len(np.unique(image)) > 1 else float(centers[0])


#: Length that a border pixel adds, by the sum of its weighted neighbourhood (itself 1, sides 2, corners 10). Fixed values.
PERIMETER_KERNEL = ((10, 2, 10), (2, 1, 2), (10, 2, 10))
PERIMETER_ONE, PERIMETER_DIAGONAL, PERIMETER_MIXED = (5, 7, 15, 17, 25, 27), (21, 33), (13, 23)


def perimeter(mask: np.ndarray) -> float:
    padded = np.pad(np.asarray(mask, bool), 1)
    inner = padded.copy()
    for y, x in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        inner &= shifted(padded, y, x)
    border = padded & ~inner
    code = np.zeros(border.shape, int)
    for y in (-1, 0, 1):
        for x in (-1, 0, 1):
            code += PERIMETER_KERNEL[y + 1][x + 1] * shifted(border, y, x)
    counts = np.bincount(code[border], minlength=50)
    one, diagonal, mixed = (counts[list(k)].sum() for k in (PERIMETER_ONE, PERIMETER_DIAGONAL, PERIMETER_MIXED))
    return float(one + diagonal * np.sqrt(2) + mixed * (1 + np.sqrt(2)) / 2)


def hull_area(mask: np.ndarray) -> int:
    """Pixels whose middle lies in the convex hull of the middles of all pixel sides."""
    mask = np.asarray(mask, bool)
    rows = np.flatnonzero(mask.any(1))
    if not len(rows):
        return 0
    left, right = mask[rows].argmax(1), mask.shape[1] - 1 - mask[rows][:, ::-1].argmax(1)
    points = sorted({(float(y) + a, float(x) + b) for y, l, r in zip(rows, left, right) for x in (l, r) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))})

    def half(points):
        chain: list = []
        for p in points:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    hull = half(points) + half(points[::-1])
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (ay, ax), (by, bx) in zip(hull, hull[1:] + hull[:1]):
        inside &= (by - ay) * (x - ax) - (bx - ax) * (y - ay) >= -1e-10
    return int(inside.sum())


def measures(mask: np.ndarray, intensity: np.ndarray | None = None, top: int = 0, left: int = 0) -> dict[str, float | None]:
    """The measures of one region, given as the mask of its bounding box (``top``, ``left``: the place of the box).

    What isn't defined (a ratio to zero, intensity without an image) is None.
    """
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    r, c = np.nonzero(mask)
    area = len(r)

    def ratio(a, b):
        return float(a / b) if a is not None and b else None

    if not area:
        raise ValueError("a region has at least one pixel")
    cr, cc = r.mean(), c.mean()
    mrr, mcc, mrc = ((r - cr) ** 2).mean(), ((c - cc) ** 2).mean(), ((r - cr) * (c - cc)).mean()
    mid, spread = (mrr + mcc) / 2, np.sqrt(((mrr - mcc) / 2) ** 2 + mrc**2)
    l1, l2 = max(mid + spread, 0.0), max(mid - spread, 0.0)
    if l2 < 1e-12 * max(l1, 1.0):
        l2 = 0.0
    if np.isclose(mcc, mrr):
        angle = np.pi / 4 if -mrc < 0 else -np.pi / 4
    else:
        angle = 0.5 * np.arctan2(2 * mrc, mrr - mcc)
    filled, length, hull = int(fill_holes(mask).sum()), perimeter(mask), hull_area(mask)
    _, background = label(np.pad(~mask, 1, constant_values=True), eight=False)
    _, objects = label(mask)
    values = None if intensity is None else np.asarray(intensity)[mask].astype(float)
    return {
        "area": float(area),
        "filled_area": float(filled),
        "bbox_area": float(h * w),
        "convex_area": float(hull),
        "centroid_row": float(top + cr),
        "centroid_col": float(left + cc),
        "local_centroid_row": float(cr),
        "local_centroid_col": float(cc),
        "major": float(4 * np.sqrt(l1)),
        "minor": float(4 * np.sqrt(l2)),
        "eccentricity": float(np.sqrt(1 - l2 / l1)) if l1 else 0.0,
        "orientation": float(angle),
        "perimeter": length,
        "euler_number": float(objects - (background - 1)),
        "equivalent_diameter": float(np.sqrt(4 * area / np.pi)),
        "extent": ratio(area, h * w),
        "solidity": ratio(area, hull),
        "min": None if values is None else float(values.min()),
        "max": None if values is None else float(values.max()),
        "mean": None if values is None else float(values.mean()),
    }


def regions(mask: np.ndarray, image: np.ndarray | None = None, min_area: float | None = None, max_area: float | None = None, padding: int = 0):
    """(label, (row from, column from, row to, column to), mask of the box, image of the box) of each component, in order of label.

    ``padding`` widens the box; at the top and left it is cut at the image's border, at the bottom and right the box may go beyond, its
    pixels end with the image. Labels of regions that are too small or too large are left out, not given again.
    """
    labels, n = label(mask)
    if not n:
        return
    order = np.argsort(labels, axis=None, kind="stable")
    flat = labels.reshape(-1)[order]
    cuts = np.searchsorted(flat, np.arange(1, n + 2))
    w = labels.shape[1]
    for k in range(n):
        at = order[cuts[k] : cuts[k + 1]]
        if min_area is not None and len(at) < min_area or max_area is not None and len(at) > max_area:
            continue
        r, c = at // w, at % w
        box = (max(0, int(r.min()) - padding), max(0, int(c.min()) - padding), int(r.max()) + 1 + padding, int(c.max()) + 1 + padding)
        part = (slice(box[0], box[2]), slice(box[1], box[3]))
        yield k + 1, box, labels[part] == k + 1, None if image is None else np.asarray(image)[part]
