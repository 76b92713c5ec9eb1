"""Image steps that are not relational, as NumPy kernels on one image: run them with on_frames, one task a frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def on_frames(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], value: str = "v") -> DataFrame:
    """frame, r, c and the kernel's output for each frame's image (pixels: frame, r, c, value; gaps are 0)."""

    def apply(key: tuple, group: pa.Table) -> pa.Table:
        r, c, v = (group[x].to_numpy() for x in ("r", "c", value))
        image = np.zeros((int(r.max()) + 1, int(c.max()) + 1))
        image[r, c] = v
        out = kernel(image)
        rows, columns = np.indices(out.shape)
        n = out.size
        return pa.table({"frame": pa.array([key[0].as_py()] * n, pa.int64()), "r": rows.ravel().astype(np.int64), "c": columns.ravel().astype(np.int64), "v": out.ravel().astype(np.float64)})

    return pixels.groupBy("frame").applyInArrow(apply, "frame long, r long, c long, v double")


def components8(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. of the 8-connected regions of a mask in the order of their first pixels; 0 outside."""
    on = mask.astype(bool)
    far = on.size
    label = np.where(on, np.arange(on.size).reshape(on.shape), far)
    while True:
        wide = np.pad(label, 1, constant_values=far)
        least = np.min([wide[y : y + on.shape[0], x : x + on.shape[1]] for y in range(3) for x in range(3)], axis=0)
        least = np.where(on, least, far)
        flat = np.append(least.ravel(), far)
        while (flat[flat] < flat).any():  # follow labels to their own label
            flat = flat[flat]
        now = np.where(on, flat[:-1].reshape(on.shape), far)
        if (now == label).all():
            break
        label = now
    names = np.unique(label[on])
    return np.where(on, np.searchsorted(names, label) + 1, 0)


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) corners of a region's outer border, walked from its first pixel; runs of one direction are one step."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    wide = np.pad(mask.astype(bool), 1)
    places = np.argwhere(wide)
    if not len(places):
        return []
    start = tuple(places[0])
    path, here, back = [start], start, 4  # the pixel to the left is empty
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            there = (here[0] + around[d][0], here[1] + around[d][1])
            if wide[there]:
                break
        else:
            break
        if there == start and len(path) > 1 or len(path) > 4 * wide.size:
            break
        path.append(there)
        here, back = there, (d + 4) % 8
    points = [(x - 1, y - 1) for y, x in path]
    turns = [p for i, p in enumerate(points) if len(points) < 3 or (p[0] - points[i - 1][0], p[1] - points[i - 1][1]) != (points[(i + 1) % len(points)][0] - p[0], points[(i + 1) % len(points)][1] - p[1])]
    return turns


def candidates(amap: np.ndarray, threshold: float, valid: np.ndarray | None = None, morph: int = 5, least_area: float = 64, most_share: float = 0.85) -> list[dict]:
    """Regions of an anomaly map: box, area, peak and mean of the map, and outline."""
    from .raster import ellipse

    scored = amap if valid is None else np.where(nearest(valid, amap.shape), amap, 0.0)
    mask = scored >= threshold
    if morph > 1:
        shape = ellipse(morph)
        for widest in (False, True, True, False):
            mask = shifted(mask, shape, widest)
    labels = components8(mask)
    out = []
    for i in range(1, labels.max() + 1):
        own = labels == i
        area = int(own.sum())
        if least_area <= area <= most_share * amap.size:
            y, x = np.nonzero(own)
            out.append({"x1": int(x.min()), "y1": int(y.min()), "x2": int(x.max()) + 1, "y2": int(y.max()) + 1, "area": area, "peak": float(amap[own].max()), "mean": float(amap[own].mean()), "polygon": outline(own)})
    return out


def least_area(min_px: float, min_m2: float, slant_res: float | None, along_res: float | None) -> float:
    """Pixels of the smallest region: from square metres where both resolutions are known."""
    return min_m2 / (slant_res * along_res) if slant_res and along_res else min_px


def nearest(mask: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A mask at another size, by the nearest pixel."""
    if mask.shape == shape:
        return mask.astype(bool)
    rows, columns = (np.minimum((np.arange(n) * m / n).astype(int), m - 1) for n, m in zip(shape, mask.shape, strict=True))
    return mask.astype(bool)[rows][:, columns]


def shifted(mask: np.ndarray, shape: list[tuple[int, int]], widest: bool) -> np.ndarray:
    half = max(max(abs(y), abs(x)) for y, x in shape)
    wide = np.pad(mask, half, constant_values=not widest)
    parts = [wide[half + y : half + y + mask.shape[0], half + x : half + x + mask.shape[1]] for y, x in shape]
    return np.any(parts, axis=0) if widest else np.all(parts, axis=0)


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny edges: Sobel gradients (sum of sizes), thinning across the gradient, and weak edges joined to strong ones."""
    x = np.pad(image.astype(float), 1, mode="edge")
    gx = x[:-2, 2:] - x[:-2, :-2] + 2 * (x[1:-1, 2:] - x[1:-1, :-2]) + x[2:, 2:] - x[2:, :-2]
    gy = x[2:, :-2] - x[:-2, :-2] + 2 * (x[2:, 1:-1] - x[:-2, 1:-1]) + x[2:, 2:] - x[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    wide = np.pad(size, 1)
    thin = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = (wide[1 + s * dy : 1 + s * dy + size.shape[0], 1 + s * dx : 1 + s * dx + size.shape[1]] for s in (1, -1))
        thin |= (turn == k) & (size > behind) & (size >= ahead)
    weak, strong = thin & (size > low), thin & (size > high)
    labels = components8(weak)
    return np.isin(labels, np.unique(labels[strong])) & weak


def edge_density(image: np.ndarray) -> float:
    return float(edges(image).mean())


def equalized(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalization of 0..255: each block's clipped histogram makes a mapping, and a pixel blends the four nearest."""
    h, w = image.shape
    high, wide = -(-h // grid) * grid, -(-w // grid) * grid
    x = np.pad(image.astype(int), ((0, high - h), (0, wide - w)), mode="reflect" if min(h, w) > grid else "edge")
    bh, bw = high // grid, wide // grid
    limit = max(int(clip * bh * bw / 256), 1)
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            counts = np.bincount(x[i * bh : (i + 1) * bh, j * bw : (j + 1) * bw].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            rest = over % 256
            if rest:
                counts[:: max(256 // rest, 1)][:rest] += 1
            maps[i, j] = np.clip(np.round(counts.cumsum() * 255 / (bh * bw)), 0, 255)
    y, z = (np.arange(h) + 0.5) / bh - 0.5, (np.arange(w) + 0.5) / bw - 0.5
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, grid - 1)[:, None], np.clip(b, 0, grid - 1)[None, :], image.astype(int)]
    blend = (1 - fy) * ((1 - fz) * at(y0, z0) + fz * at(y0, z0 + 1)) + fy * ((1 - fz) * at(y0 + 1, z0) + fz * at(y0 + 1, z0 + 1))
    return np.round(blend)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area interpolation to another size."""

    def weights(n: int, m: int) -> np.ndarray:
        low, high = np.arange(m) * n / m, (np.arange(m) + 1) * n / m
        cell = np.arange(n)
        return np.clip(np.minimum(high[:, None], cell + 1) - np.maximum(low[:, None], cell), 0, None) * m / n

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, mirrored edges; no change for a sigma of 0."""
    if not sigma or sigma <= 0:
        return image
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    taps /= taps.sum()
    for _ in range(2):
        wide = np.pad(image, ((radius, radius), (0, 0)), mode="symmetric")
        image = sum(t * wide[k : k + image.shape[0]] for k, t in enumerate(taps)).T
    return image


def anomaly_map(image: np.ndarray, reconstruct: Callable[[np.ndarray], np.ndarray], size: int = 640, sigma: float = 4.0) -> np.ndarray:
    """Smoothed difference between a resized image in 0..1 and its reconstruction."""
    x = resized(image, size, size) / 255
    return smoothed(np.abs(x - reconstruct(x)), sigma)


def onnx_reconstruction(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A reconstruction by an ONNX file; the session is opened at first use in each worker."""
    held: list = []

    def run(x: np.ndarray) -> np.ndarray:
        if not held:
            import onnxruntime

            held.append(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))
        session = held[0]
        return session.run(None, {session.get_inputs()[0].name: x[None, None].astype(np.float32)})[0][0, 0]

    return run


def unet_input(image: np.ndarray) -> np.ndarray:
    """Three equal channels, first axis, with the usual means and deviations of image nets taken out. Fixed values."""
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    return ((image[None] / 255 - mean[:, None, None]) / deviation[:, None, None]).astype(np.float32)


def unet_mask(logits: np.ndarray) -> np.ndarray:
    """Where the logistic function of the logits is above a half."""
    return 1 / (1 + np.exp(-logits)) > 0.5


def crops(image: np.ndarray, size: int, stride: int) -> list[np.ndarray]:
    """Full crops at the tile offsets; an image smaller than a crop gives none."""
    at = lambda n: [0] if n <= size else sorted({*range(0, n - size + 1, stride), n - size})
    return [x for y in at(image.shape[0]) for z in at(image.shape[1]) if (x := image[y : y + size, z : z + size]).shape == (size, size)]
