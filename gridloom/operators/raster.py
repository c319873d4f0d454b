"""Pixel operators in numpy, for Arrow UDFs over images: thresholds, filters, geometry, ruled lines and grids.

Behaviour is that of the usual operators (grids found, texts kept); pixels need not equal any other library's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig, Profile
from .cluster import peaks

Boxes = list[tuple[int, int, int, int]]


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of BGR bytes; gray images pass."""
    return img if img.ndim == 2 else np.round(img @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def swapped(img: np.ndarray) -> np.ndarray:
    """BGR as RGB and back; gray passes."""
    return img if img.ndim == 2 else img[..., ::-1]


def _windows(img: np.ndarray, k: int, axis: int, mode: str = "edge") -> np.ndarray:
    pad = [(0, 0)] * img.ndim
    pad[axis] = (k // 2, k - 1 - k // 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(img, pad, mode=mode), k, axis=axis)


def dilate(img: np.ndarray, wide: int, high: int) -> np.ndarray:
    return _windows(_windows(img, wide, 1).max(-1), high, 0).max(-1)


def erode(img: np.ndarray, wide: int, high: int) -> np.ndarray:
    return _windows(_windows(img, wide, 1).min(-1), high, 0).min(-1)


def opened(img: np.ndarray, wide: int, high: int) -> np.ndarray:
    small = erode(img, wide, high)
    return dilate(small[::-1, ::-1], wide, high)[::-1, ::-1]


def gauss(img: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    return _windows(_windows(img.astype(np.float64), 2 * r + 1, 1) @ k, 2 * r + 1, 0) @ k


def median(img: np.ndarray, k: int) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(np.pad(img, k // 2, mode="edge"), (k, k))
    return np.stack([np.median(row.reshape(len(row), -1), axis=1) for row in w]).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between the parts."""
    h = np.bincount(img.ravel(), minlength=256).astype(np.float64)
    n, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binary_inverse(img: np.ndarray) -> np.ndarray:
    return np.where(img > otsu(img), 0, 255).astype(np.uint8)


def adaptive_inverse(img: np.ndarray, block: int, c: float) -> np.ndarray:
    """255 where a pixel is not above the Gaussian mean around it, less c."""
    return np.where(img > gauss(img, 0.3 * ((block - 1) * 0.5 - 1) + 0.8) - c, 0, 255).astype(np.uint8)


def binarize(img: np.ndarray) -> np.ndarray:
    return 255 - adaptive_inverse(gray(img), 11, 2)


def clahe(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Equalization by tiles with clipped histograms, blended between tile centers."""
    h, w = img.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(img, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((tiles, tiles, 256))
    most = max(1, clip * th * tw / 256)
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(np.float64)
            over = np.maximum(hist - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, most) + over / 256) * 255 / (th * tw)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, b: maps[a[:, None], b[None], img]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def sharpen(img: np.ndarray) -> np.ndarray:
    return np.clip(np.round(1.5 * img - 0.5 * gauss(img, 3)), 0, 255).astype(np.uint8)


def without_shadows(img: np.ndarray) -> np.ndarray:
    flat = 255.0 - np.abs(img.astype(int) - median(dilate(img, 7, 7), 21).astype(int))
    span = flat.max() - flat.min()
    return np.round((flat - flat.min()) * (255 / span) if span else flat).astype(np.uint8)


def _box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over the k x k pixels around each, the border repeated."""
    r = k // 2
    for axis in (0, 1):
        upto = np.pad(a, [(r + 1, r) if x == axis else (0, 0) for x in (0, 1)], mode="edge").cumsum(axis=axis)
        n = a.shape[axis]
        a = upto[k : k + n] - upto[:n] if axis == 0 else upto[:, k : k + n] - upto[:, :n]
    return a


def denoise(img: np.ndarray, h: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Means of the search x search pixels around each, weighed by how like their patches are."""
    src = img.astype(np.int64)
    r = search // 2
    wide = np.pad(src, r, mode="reflect" if min(img.shape) > r else "edge")
    total, mass = np.zeros(src.shape), np.zeros(src.shape)
    for dy in range(search):
        for dx in range(search):
            moved = wide[dy : dy + src.shape[0], dx : dx + src.shape[1]]
            weight = np.exp(_box_sums((src - moved) ** 2, patch) * (-1 / (patch * patch * h * h)))
            total, mass = total + weight * moved, mass + weight
    return np.clip(np.round(total / mass), 0, 255).astype(np.uint8)


def enhance_lines(img: np.ndarray) -> np.ndarray:
    mask = np.maximum(opened(img, 25, 1), opened(img, 1, 25))
    return np.clip(np.round(0.8 * img + 0.2 * mask), 0, 255).astype(np.uint8)


#: Primaries of sRGB, from linear red, green, blue to X, Y, Z, with the white of daylight. Fixed values.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = XYZ.sum(axis=1)


def to_lab(img: np.ndarray) -> np.ndarray:
    """Lightness (0 to 100) and the two colour axes of BGR pixels."""
    c = img[..., ::-1] / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """BGR pixels of to_lab()."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787)
    linear = (t * WHITE) @ np.linalg.inv(XYZ).T
    c = np.where(linear > 0.0031308, 1.055 * np.maximum(linear, 0) ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.round(c[..., ::-1] * 255), 0, 255).astype(np.uint8)


def lighten(img: np.ndarray) -> np.ndarray:
    """Equalized lightness; colours keep their axes."""
    if img.ndim == 2:
        return clahe(img, 3.0)
    lab = to_lab(img)
    lab[..., 0] = clahe(np.clip(np.round(lab[..., 0] * 2.55), 0, 255).astype(np.uint8), 3.0) / 2.55
    return from_lab(lab)


def without_glare(img: np.ndarray) -> np.ndarray:
    """Gray image whose bright colourless spots, if they cover 100 pixels, take the mean of what surrounds them."""
    g = gray(img)
    top, low = (img.max(2).astype(int), img.min(2).astype(int)) if img.ndim == 3 else (g.astype(int), g.astype(int))
    mask = dilate(((top > 245) & ((top - low) * 255 < 30 * np.maximum(top, 1))).astype(np.uint8), 5, 5) > 0
    if mask.sum() < 100 or mask.all():
        return g
    out = g.astype(np.float64)
    known, filled = (~mask).astype(np.float64), np.where(mask, 0, out)
    for sigma in (2, 5, 15, 45):
        weight = gauss(known, sigma)
        guess = gauss(filled, sigma) / np.maximum(weight, 1e-9)
        hit = mask & (weight > 1e-3)
        out[hit] = guess[hit]
        mask = mask & ~hit
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; outside the border pixels go on."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    fx, fy = x - x0, y - y0
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    out = (1 - fy) * ((1 - fx) * img[y0, x0] + fx * img[y0, x1]) + fy * ((1 - fx) * img[y1, x0] + fx * img[y1, x1])
    return np.round(out).astype(np.uint8)


def resized(img: np.ndarray, high: int) -> np.ndarray:
    h, w = img.shape[:2]
    wide = max(1, int(w * high / h))
    y, x = np.meshgrid((np.arange(high) + 0.5) * h / high - 0.5, (np.arange(wide) + 0.5) * w / wide - 0.5, indexing="ij")
    return sampled(img, x, y)


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    h, w = img.shape[:2]
    a = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    cx, cy = w // 2, h // 2
    return sampled(img, np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy)


def edges(img: np.ndarray, limit: float = 100.0) -> np.ndarray:
    gx = np.abs(np.diff(img.astype(int), axis=1, prepend=img[:, :1].astype(int)))
    gy = np.abs(np.diff(img.astype(int), axis=0, prepend=img[:1].astype(int)))
    return (gx + gy) >= limit


def hough(mask: np.ndarray, degrees: np.ndarray, least: int) -> list[tuple[float, float]]:
    """(rho, theta) of lines with at least so many points, strongest first, one for each cell of the table."""
    y, x = np.nonzero(mask)
    theta = np.radians(degrees)
    reach = int(np.hypot(*mask.shape)) + 1
    votes = np.zeros((len(theta), 2 * reach + 1), np.int64)
    for i, t in enumerate(theta):
        votes[i] = np.bincount(np.round(x * np.cos(t) + y * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1)[: 2 * reach + 1]
    i, r = np.nonzero(votes >= least)
    order = np.argsort(-votes[i, r], kind="stable")
    return [(float(r[k] - reach), float(theta[i[k]])) for k in order]


def skew(img: np.ndarray) -> float:
    """Median tilt in degrees of the near-horizontal lines, 0 without any."""
    lines = hough(edges(img), np.arange(45.5, 135, 0.5), 100)
    tilts = [np.degrees(t) - 90 for _, t in lines if abs(np.degrees(t) - 90) < 45]
    return float(np.median(tilts)) if tilts else 0.0


def deskewed(img: np.ndarray) -> np.ndarray:
    angle = skew(img)
    return rotated(img, angle) if abs(angle) > 0.5 else img


def segments(mask: np.ndarray, least: int, length: int, gap: int = 10) -> list[tuple[int, int, int, int]]:
    """Line segments (x1, y1, x2, y2) of a mask: points of the strongest lines, cut where they are further apart than gap;
    those of enough length stay, and their points vote for no other line."""
    free, out = mask.copy(), []
    for rho, theta in hough(mask, np.arange(0.0, 180.0), least):
        y, x = np.nonzero(free)
        on = np.abs(x * np.cos(theta) + y * np.sin(theta) - rho) <= 0.5
        if on.sum() < least:
            continue
        y, x = y[on], x[on]
        along = np.round(y * np.cos(theta) - x * np.sin(theta)).astype(int)
        order = np.argsort(along, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(along[order]) > gap) + 1):
            if along[part[-1]] - along[part[0]] >= length:
                a, b = part[0], part[-1]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
                free[y[part], x[part]] = False
    return out


def warped(img: np.ndarray, corners: np.ndarray, least: int = 100) -> np.ndarray:
    """The quadrilateral tl, tr, br, bl as an upright image; unchanged where a side is shorter than least."""
    tl, tr, br, bl = (np.asarray(c, np.float64) for c in corners)
    wide, high = max(int(np.hypot(*(br - bl))), int(np.hypot(*(tr - tl)))), max(int(np.hypot(*(tr - br))), int(np.hypot(*(tl - bl))))
    if wide < max(least, 1) or high < max(least, 1):
        return img
    to = [(0, 0), (wide - 1, 0), (wide - 1, high - 1), (0, high - 1)]
    rows, right = [], []
    for (u, v), (x, y) in zip(to, (tl, tr, br, bl), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    m = np.append(np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0], 1).reshape(3, 3)
    v, u = np.mgrid[0:high, 0:wide].astype(np.float64)
    d = m[2, 0] * u + m[2, 1] * v + 1
    return sampled(img, (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / d, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / d)


def cropped(img: np.ndarray, roi: list[tuple[float, float]]) -> np.ndarray:
    """A region of four normalized corners, as an upright image of any size."""
    h, w = img.shape[:2]
    return warped(img, np.array([(int(min(max(x, 0), 1) * w), int(min(max(y, 0), 1) * h)) for x, y in roi]), 1)


def ordered(points: np.ndarray) -> np.ndarray:
    s, d = points.sum(1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def plausible(c: np.ndarray) -> bool:
    """Whether the angles of four ordered corners lie between 60 and 120 degrees."""
    a, b = np.roll(c, 1, 0) - c, np.roll(c, -1, 0) - c
    cos = (a * b).sum(1) / (np.hypot(*a.T) * np.hypot(*b.T) + 1e-10)
    angle = np.degrees(np.arccos(np.clip(cos, -1, 1)))
    return bool(((angle >= 60) & (angle <= 120)).all())


def crossing_corners(img: np.ndarray) -> np.ndarray | None:
    """Corners where the outermost nearly level lines cross the outermost nearly upright ones, if plausible."""
    lines = hough(edges(gauss(img, 1.1), 25), np.arange(0.0, 180.0), 100)
    level = sorted(x for x in lines if 80 < np.degrees(x[1]) < 100)
    turned = [(-r, t - np.pi) if np.degrees(t) > 170 else (r, t) for r, t in lines]  # so that rho tells left from right
    upright = sorted(x for x in turned if np.degrees(x[1]) < 10)
    if len(level) < 2 or len(upright) < 2:
        return None
    met = []
    for r, t in (level[0], level[-1]):
        for q, u in (upright[0], upright[-1]):
            m = np.array([[np.cos(t), np.sin(t)], [np.cos(u), np.sin(u)]])
            if abs(np.linalg.det(m)) >= 1e-10:
                met.append(np.linalg.solve(m, [r, q]))
    corners = ordered(np.array(met)) if len(met) == 4 else None
    return corners if corners is not None and plausible(corners) else None


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole-number points (x, y), in order."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    sides = []
    for run in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def simplified(polygon: np.ndarray, reach: float) -> np.ndarray:
    """The corners of a closed polygon that are further than reach from the line between those kept."""

    def kept(line: np.ndarray) -> list[np.ndarray]:
        (x, y), along = line[0], line[-1] - line[0]
        off = np.abs((line[:, 0] - x) * along[1] - (line[:, 1] - y) * along[0]) / max(np.hypot(*along), 1e-9)
        at = int(off.argmax())
        return kept(line[: at + 1]) + kept(line[at:]) if off[at] > reach else [line[0]]

    if len(polygon) < 3:
        return polygon
    far = np.hypot(*(polygon[:, None] - polygon[None]).transpose(2, 0, 1))
    i, j = sorted(np.unravel_index(far.argmax(), far.shape))
    turned = np.vstack([polygon[j:], polygon[: i + 1]])
    return np.array(kept(polygon[i : j + 1]) + kept(turned))


def page_corners(img: np.ndarray) -> np.ndarray | None:
    """Corners of the largest bright region that covers a tenth of the image and whose outline, within a fiftieth of its
    length, has four corners at plausible angles; else those of the outermost lines, else None."""
    labels = components(img > otsu(img))
    sizes = [(n, label) for label, n in zip(*np.unique(labels[labels > 0], return_counts=True), strict=True)]
    for n, label in sorted(sizes, reverse=True)[:10]:
        if n < 0.1 * img.size:
            break
        inside = labels == label
        rows = np.flatnonzero(inside.any(axis=1))
        ends = np.concatenate([np.stack([inside[rows].argmax(axis=1), rows], 1), np.stack([inside.shape[1] - 1 - inside[rows, ::-1].argmax(axis=1), rows], 1)])
        outline = hull(ends)
        length = np.hypot(*(outline - np.roll(outline, 1, 0)).T).sum()
        corners = simplified(outline, 0.02 * length)
        if len(corners) == 4 and plausible(ordered(corners)):
            return ordered(corners)
    return crossing_corners(img)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected regions, by runs of rows that touch."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    ry, rs = np.nonzero(step == 1)
    _, re = np.nonzero(step == -1)
    parent = list(range(len(ry)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    start = np.searchsorted(ry, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = start[y - 1], start[y]
        while i < start[y] and j < start[y + 1]:
            if rs[i] < re[j] and rs[j] < re[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if re[i] < re[j]:
                i += 1
            else:
                j += 1
    out = np.zeros(mask.shape, np.int32)
    for k in range(len(ry)):
        out[ry[k], rs[k] : re[k]] = find(k) + 1
    return out


def grid_tables(img: np.ndarray, binary: np.ndarray, config: DetectorConfig) -> list[dict]:
    """Ruled tables of a binary image: regions of long lines, the lines of each as peaks of its profiles, the cells
    between them, and as confidence the evenness of the spacing."""
    h, w = img.shape
    wide, high = opened(binary, max(w // 30, 10), 1), opened(binary, 1, max(h // 30, 10))
    labels = components(dilate(np.maximum(wide, high), 3, 3) > 0)
    out = []
    for label in np.unique(labels[labels > 0]):
        y, x = np.nonzero(labels == label)
        x0, y0, bw, bh = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
        if bw * bh < int(h * w * config.min_table_area_ratio):
            continue
        box = np.s_[y0 : y0 + bh, x0 : x0 + bw]
        rows, cols = peaks(wide[box].sum(1, dtype=np.float64)), peaks(high[box].sum(0, dtype=np.float64))
        if len(rows) < 2 or len(cols) < 2:
            continue
        cv = [np.std(np.diff(p)) / (np.mean(np.diff(p)) + 1e-6) for p in (rows, cols)]
        cells = [(x0 + a, y0 + t, b - a, u - t) for t, u in zip(rows[:-1], rows[1:], strict=True) for a, b in zip(cols[:-1], cols[1:], strict=True)]
        out.append({"x": x0, "y": y0, "w": bw, "h": bh, "rows": len(rows) - 1, "cols": len(cols) - 1, "confidence": float(1 - min(sum(cv) / 2, 1)), "cells": cells})
    return out


def binaries(img: np.ndarray, config: DetectorConfig) -> list[np.ndarray]:
    """The binarizations whose detections are united: one global, one for each block size, and two together."""
    first = binary_inverse(img)
    if not config.use_multiple_thresholds:
        return [first]
    local = [adaptive_inverse(img, k, 5) for k in config.adaptive_block_sizes]
    return [first, *local, np.maximum(first, local[len(local) // 2])]


def detect_lines(img: np.ndarray, config: DetectorConfig = DetectorConfig()) -> list[dict]:
    g = gray(img)
    g = clahe(g, config.clahe_clip_limit, config.clahe_tile_size) if config.use_clahe else g
    found = [t | {"pass": i} for i, b in enumerate(binaries(g, config)) for t in grid_tables(g, b, config)]
    return [t | {"det_id": k} for k, t in enumerate(found)]


def detect_segments(img: np.ndarray, config: DetectorConfig = DetectorConfig()) -> list[tuple[int, int, int, int]]:
    g = gray(img)
    g = clahe(g, config.clahe_clip_limit, config.clahe_tile_size) if config.use_clahe else g
    return segments(edges(g), config.hough_threshold, max(config.min_line_length, min(g.shape) // 20))


def preprocess(img: np.ndarray, profile: Profile = Profile()) -> np.ndarray:
    """The steps of a profile, in their fixed order; the result is gray."""
    photo = profile.name == "photo"
    g = without_glare(img) if photo and img.ndim == 3 else gray(img)
    g = without_shadows(g) if profile.shadow_removal else g
    g = lighten(g) if photo else g
    g = denoise(g) if profile.denoise else g
    g = deskewed(g) if profile.deskew else g
    corners = page_corners(g) if profile.perspective_correction else None
    g = warped(g, corners) if corners is not None else g
    g = clahe(g) if profile.contrast_enhance else g
    g = sharpen(g) if photo else g
    return enhance_lines(g) if profile.line_enhancement else g


def for_recognition(img: np.ndarray, least: int = 30, smooth: bool = False) -> np.ndarray:
    """Gray, at least so high, black on white."""
    g = gray(img)
    g = resized(g, least) if g.shape[0] < least else g
    g = denoise(g) if smooth else g
    out = 255 - binary_inverse(g)
    return 255 - out if out.mean() < 127 else out


def pixels(row: dict) -> np.ndarray:
    shape = (row["height"], row["width"], row["channels"])
    img = np.frombuffer(row["data"], np.uint8).reshape(shape)
    return img[..., 0] if row["channels"] == 1 else img[..., :3]


_BOX, _LINE = "x:long,y:long,w:long,h:long", "x1:long,y1:long,x2:long,y2:long"
DETECTED = f"path string, height int, width int, tables array<struct<det_id:long,pass:long,{_BOX},rows:long,cols:long,confidence:double,cells:array<struct<{_BOX}>>>>, segments array<struct<{_LINE}>>"


def detect(images: DataFrame, config: DetectorConfig = DetectorConfig(), profile: Profile | None = None) -> DataFrame:
    """(path, height, width, tables, segments) of each image (path, height, width, channels, data): ruled tables of every
    binarization and line segments, of the image as the profile prepares it. One image is in memory at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img = preprocess(pixels(row), profile) if profile else pixels(row)
                found = [t | {"cells": [dict(zip("xywh", c, strict=True)) for c in t["cells"]]} for t in detect_lines(img, config)]
                lines = [dict(zip(("x1", "y1", "x2", "y2"), s, strict=True)) for s in detect_segments(img, config)]
                made = {"path": row["path"], "height": img.shape[0], "width": img.shape[1], "tables": found, "segments": lines}
                yield pa.RecordBatch.from_pylist([made], _ARROW)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, DETECTED)


_CELLS = pa.list_(pa.struct([(n, pa.int64()) for n in "xywh"]))
_TABLE = pa.struct([*((n, pa.int64()) for n in ("det_id", "pass", "x", "y", "w", "h", "rows", "cols")), ("confidence", pa.float64()), ("cells", _CELLS)])
_SEGMENT = pa.struct([(n, pa.int64()) for n in ("x1", "y1", "x2", "y2")])
_ARROW = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("tables", pa.list_(_TABLE)), ("segments", pa.list_(_SEGMENT))])


def prepared(images: DataFrame, profile: Profile) -> DataFrame:
    """images with gray pixels as the profile prepares them; sizes follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img = preprocess(pixels(row), profile)
                made = {"path": row["path"], "height": img.shape[0], "width": img.shape[1], "channels": 1, "data": img.tobytes()}
                yield pa.RecordBatch.from_pylist([made], pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, height int, width int, channels int, data binary")


def detect_tables(images: DataFrame, config: DetectorConfig = DetectorConfig(), profile: Profile | None = None) -> DataFrame:
    """Ruled tables of images, one row for each and binarization; dedupe.merge() unites them."""
    found = detect(images, config, profile).select("path", F.explode("tables").alias("t"))
    return found.select("path", "t.*")


def measured(images: DataFrame, steps: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(path, step, height, width, mean, crc32) of the pixels that each step makes of each gray image."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img = gray(pixels(row))
                made = [(name, np.ascontiguousarray(step(img))) for name, step in steps.items()]
                rows = [{"path": row["path"], "step": n, "height": m.shape[0], "width": m.shape[1], "mean": round(float(m.mean()), 6), "crc32": zlib.crc32(m.tobytes())} for n, m in made]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("step", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("mean", pa.float64()), ("crc32", pa.int64())]))

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, step string, height int, width int, mean double, crc32 long")


def told(images: DataFrame, questions: dict[str, Callable[[np.ndarray], object]]) -> DataFrame:
    """(path, question, answer as text) of each gray image."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img = gray(pixels(row))
                answers = [str(f(img)) for f in questions.values()]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(answers)), pa.array(list(questions)), pa.array(answers)], ["path", "question", "answer"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, question string, answer string")


def encode_png(img: np.ndarray) -> bytes:
    """A PNG file of gray or BGR pixels, without row filters."""
    lines = img[..., ::-1] if img.ndim == 3 else img
    raw = np.hstack([np.zeros((len(lines), 1), np.uint8), np.ascontiguousarray(lines).reshape(len(lines), -1)])
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    chunks = ((b"IHDR", head), (b"IDAT", zlib.compress(raw.tobytes())), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def as_png(images: DataFrame) -> DataFrame:
    """(path, png) of images."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([encode_png(pixels(row))], pa.binary())], ["path", "png"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, png binary")


def crops(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions (page_id, det_id, x, y, w, h) cut from their images, as images with path {page_id}#{det_id}; regions off the
    page give none."""
    asked = regions.groupBy(F.col("page_id").alias("path")).agg(F.collect_list(F.struct("det_id", "x", "y", "w", "h")).alias("regions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img = pixels(row)
                for r in row["regions"]:
                    part = img[max(0, r["y"]) : max(0, r["y"] + r["h"]), max(0, r["x"]) : max(0, r["x"] + r["w"])]
                    if part.size:
                        made = {"path": f"{row['path']}#{r['det_id']}", "height": part.shape[0], "width": part.shape[1], "channels": part.shape[2] if part.ndim == 3 else 1, "data": part.tobytes()}
                        yield pa.RecordBatch.from_pylist([made], pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    return images.select("path", "height", "width", "channels", "data").join(asked, "path").mapInArrow(run, "path string, height int, width int, channels int, data binary")
