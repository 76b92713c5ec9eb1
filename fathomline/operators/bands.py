"""Neighbourhood operators on bands of image rows with a halo, as NumPy kernels in Arrow batches.

A frame is cut into bands of ROWS rows; each band also gets the ``half`` rows above and below it, so a pixel is shuffled
once (few of them twice) whatever the window's size, and no frame has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a band.
ROWS = 512


def on_bands(pixels: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], half: int, out: str, value: str = "v", wrap: bool = False) -> DataFrame:
    """frame, r, c and the kernel's columns (out: their names and types) for every pixel; pixels: frame, r, c, value.

    The kernel gets a band with ``half`` rows and columns around it, and which of its pixels are in the image. What lies
    outside the image repeats the edge, or comes from the opposite side if ``wrap``.
    """
    kind = dict(pixels.dtypes)["frame"]
    size = pixels.groupBy("frame").agg((F.max("r") + 1).cast("int").alias("_h"), (F.max("c") + 1).cast("int").alias("_w"))
    rows = pixels.select("frame", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias("v")).join(size, "frame")
    if wrap:  # rows near one end are also seen beyond the other
        copies = F.array(F.col("r"), F.when(F.col("r") < half, F.col("r") + F.col("_h")), F.when(F.col("r") >= F.col("_h") - half, F.col("r") - F.col("_h")))
        rows = rows.select("frame", F.explode(F.array_compact(copies)).alias("r"), "c", "v", "_h", "_w")
    last = F.floor((F.col("_h") - 1) / ROWS)
    first_band = F.greatest(F.lit(0), F.floor((F.col("r") - half) / ROWS))
    last_band = F.least(last, F.floor((F.col("r") + half) / ROWS))
    banded = rows.select("frame", F.explode(F.sequence(first_band, last_band)).alias("band"), "r", "c", "v", "_h", "_w")
    names = [x.split()[0] for x in out.split(", ")]

    def apply(key: tuple, group: pa.Table) -> pa.Table:
        r, c, v = (group[x].to_numpy() for x in ("r", "c", "v"))
        h, w, top = group["_h"][0].as_py(), group["_w"][0].as_py(), key[1].as_py() * ROWS
        n = min(ROWS, h - top)
        image, inside = np.zeros((n + 2 * half, w + 2 * half)), np.zeros((n + 2 * half, w + 2 * half), bool)
        image[r - top + half, c + half] = v
        inside[r - top + half, c + half] = (r >= 0) & (r < h)
        if not wrap:
            low, high = max(0, top - half), min(h, top + n + half)  # rows that there are
            image[: low - top + half] = image[low - top + half]
            image[high - top + half :] = image[high - top + half - 1]
        if half:
            image[:, :half] = image[:, w : w + half] if wrap else image[:, half : half + 1]
            image[:, w + half :] = image[:, half : 2 * half] if wrap else image[:, w + half - 1 : w + half]
        made = kernel(image, inside)
        rows, columns = np.indices((n, w))
        return pa.table({"frame": pa.array([key[0].as_py()] * (n * w), group["frame"].type), "r": (rows + top).ravel().astype(np.int64), "c": columns.ravel().astype(np.int32), **{x: made[x].ravel() for x in names}})

    return banded.groupBy("frame", "band").applyInArrow(apply, f"frame {kind}, r long, c int, {out}")


def box(image: np.ndarray, win: int) -> np.ndarray:
    """Means of win x win windows."""
    total = np.zeros((image.shape[0] - win + 1, image.shape[1]))
    for k in range(win):
        total += image[k : k + total.shape[0]]
    out = np.zeros((total.shape[0], image.shape[1] - win + 1))
    for k in range(win):
        out += total[:, k : k + out.shape[1]]
    return out / (win * win)


def moments(win: int):
    """A kernel: v, its local mean and variance (not below 0)."""

    def kernel(image: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        half = win // 2
        mean = box(image, win)
        return {"v": image[half : image.shape[0] - half, half : image.shape[1] - half], "mean": mean, "var": np.maximum(box(image * image, win) - mean * mean, 0.0)}

    return kernel


def damped(win: int, damp: float):
    """A kernel: exponentially weighted means whose weights fall off faster where the neighbourhood varies."""

    def kernel(image: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        half = win // 2
        h, w = image.shape[0] - 2 * half, image.shape[1] - 2 * half
        # the neighbourhood's moments repeat the edge, while the weighted mean goes around
        real = np.flatnonzero(inside[:, half])
        near = np.pad(image[real[0] : real[-1] + 1, half : half + w], ((real[0], len(inside) - 1 - real[-1]), (half, half)), mode="edge")
        own = moments(win)(near, inside)
        varies = own["var"] / (own["mean"] * own["mean"] + 1e-6)
        weighted, total = np.zeros((h, w)), np.zeros((h, w))
        for y in range(win):
            for x in range(win):
                weight = np.exp(-damp * varies * np.hypot(y - half, x - half))
                weighted += weight * image[y : y + h, x : x + w]
                total += weight
        return {"v": weighted / (total + 1e-6)}

    return kernel


def reached(offsets: list[tuple[int, int]], half: int, widest: bool):
    """A kernel: the greatest or least value over the offsets; pixels outside the image don't count."""

    def kernel(image: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        h, w = image.shape[0] - 2 * half, image.shape[1] - 2 * half
        seen = np.where(inside, image, -np.inf if widest else np.inf)
        parts = [seen[half + y : half + y + h, half + x : half + x + w] for y, x in offsets]
        return {"v": np.max(parts, axis=0) if widest else np.min(parts, axis=0)}

    return kernel
