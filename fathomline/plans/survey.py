"""The preprocessing plan of a survey: steps in one fixed order, each can be left out, each computed once.

A frame's mask travels with its pings; masked samples are zero after the nadir step only, as later steps work on whole
images. With contrast off, samples are clipped to 0..255 at the end.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import kernels as K
from ..operators import raster as R
from ..operators import series as S
from ..session import materialized

STEPS = ("bottom", "slant", "nadir", "gain", "despeckle", "contrast", "quality", "tiling")
#: Thresholds of the steps. Fixed values.
CONFIG = {
    "bottom": {"smooth": 5, "rise": 0.35, "slope": 0.05, "least": 3, "median": 7, "jump": 15.0},
    "slant": {"fill": 0.0}, "nadir": {"pad": 2}, "gain": {"eps": 1e-6, "band": 0.02}, "despeckle": {"method": "lee", "win": 5, "damp": 2.0},
    "contrast": {"low": 0.01, "high": 0.99, "clip": 2.0, "grid": 8}, "tiling": {"size": 640, "overlap": 0.2, "least_valid": 0.1}, "quality": {"threshold": 0.404},
}


@dataclass
class Result:
    """pings (samples, valid, altitude_px), tiles (pixels of tiles, or none), qualities (a row a tile, or none), steps run,
    seconds that each took, and where each step's images are (snapshots)."""

    pings: DataFrame
    tiles: DataFrame | None = None
    qualities: DataFrame | None = None
    steps: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    snapshots: dict[str, str] = field(default_factory=dict)


def tracked(pings: DataFrame, c: dict) -> DataFrame:
    """pings with altitude_px from the samples: first returns, gaps filled, spikes and jumps taken out."""
    offset = A.bottom_offset(F.col("samples"), smooth=c["smooth"], rise=c["rise"], slope=c["slope"], least=c["least"])
    series = pings.select(F.col("frame").alias("survey"), F.col("ping").cast("long").alias("i"), offset.alias("alt"))
    clamped = S.tracked(series, width=c["median"], limit=c["jump"])
    return pings.drop("altitude_px").join(clamped.select(F.col("survey").alias("frame"), F.col("i").cast("int").alias("ping"), F.col("clamped").alias("altitude_px")), ["frame", "ping"])


def exploded(pings: DataFrame) -> DataFrame:
    """frame, r, c, v, valid of every sample."""
    rows = pings.select("frame", F.col("ping").alias("r"), F.posexplode(F.arrays_zip(F.col("samples").alias("v"), F.col("valid").alias("valid"))).alias("c", "x"))
    return rows.select("frame", "r", "c", "x.v", "x.valid")


def imploded(pings: DataFrame, pixels: DataFrame) -> DataFrame:
    """pings with the samples of the pixels."""
    lists = pixels.groupBy("frame", F.col("r").cast("int").alias("ping")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"].cast("double")).alias("samples"))
    return pings.drop("samples").join(lists, ["frame", "ping"])


def snapshot(pings: DataFrame) -> DataFrame:
    """frame, ping, samples as 0..255: negative ones as 0, then from the frame's least to its greatest."""
    clipped = pings.select("frame", "ping", F.transform("samples", lambda v: F.greatest(v, F.lit(0.0))).alias("samples"))
    ends = clipped.groupBy("frame").agg(F.min(F.array_min("samples")).alias("_lo"), F.max(F.array_max("samples")).alias("_hi"))
    scaled = F.transform("samples", lambda v: F.floor((v - F.col("_lo")) * 255 / (F.col("_hi") - F.col("_lo") + 1e-6)).cast("int"))
    return clipped.join(ends, "frame").select("frame", "ping", scaled.alias("samples"))


def run(pings: DataFrame, config: dict | None = None, enabled: dict[str, bool] | None = None, save_steps: str | None = None) -> Result:
    """Runs the steps that are not switched off. pings: frame, ping, samples (array<double>).

    save_steps: a folder for each step's images (Parquet, see snapshot). A step's seconds count its own work, as its
    result is computed before the next begins; slant is computed with the step after it, quality when it is read.
    """
    c = {k: v | (config or {}).get(k, {}) for k, v in CONFIG.items()}
    on = lambda step: (enabled or {}).get(step, True)
    rows = pings.withColumn("valid", F.transform("samples", lambda v: F.lit(True))).withColumn("altitude_px", F.lit(0.0))
    out = Result(rows)

    began = time.perf_counter()

    def done(step: str, rows: DataFrame) -> DataFrame:
        nonlocal began
        out.steps.append(step)
        rows = rows if step in ("slant", "quality") else materialized(rows)
        out.seconds[step] = time.perf_counter() - began
        if save_steps and step != "quality":
            out.snapshots[step] = f"{save_steps}/{len(out.steps) - 1}_{step}"
            snapshot(rows).write.mode("overwrite").parquet(out.snapshots[step])
        began = time.perf_counter()
        return rows

    if on("bottom"):
        rows = done("bottom", tracked(rows, c["bottom"]))
    if on("slant"):
        ground, valid = A.slant_to_ground(F.col("samples"), F.col("altitude_px"), c["slant"]["fill"])
        rows = done("slant", rows.withColumns({"samples": ground, "valid": valid}))
    if on("nadir"):
        rows = rows.withColumn("valid", A.nadir_mask(F.col("valid"), F.col("altitude_px"), c["nadir"]["pad"]))
        rows = done("nadir", rows.withColumn("samples", A.masked(F.col("samples"), F.col("valid"))))
    if on("gain"):
        rows = done("gain", imploded(rows, R.destriped(R.gain_normalised(exploded(rows), "valid", c["gain"]["eps"]), c["gain"]["band"])))
    if on("despeckle"):
        rows = done("despeckle", imploded(rows, R.despeckled(exploded(rows), **c["despeckle"])))
    if on("contrast"):
        k = c["contrast"]
        flat = materialized(R.stretched(exploded(rows), k["low"], k["high"]))
        clip, grid = k["clip"], k["grid"]
        rows = done("contrast", imploded(rows, K.on_frames(_numbered(flat), lambda x: K.equalized(x, clip, grid)).transform(_named(flat))))
    else:
        rows = rows.withColumn("samples", F.transform("samples", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("double")))
    out.pings = rows
    if on("quality") or on("tiling"):
        out.tiles = materialized(R.tiles(exploded(rows), **c["tiling"]))
    if on("quality"):
        keyed = out.tiles.select(F.concat_ws("#", "frame", "tile").alias("frame"), "r", "c", "v")
        density = K.on_frames(_numbered(keyed), lambda x: np.array([[K.edge_density(x)]])).transform(_named(keyed)).select("frame", F.col("v").alias("edge_density"))
        scored = R.tile_proxies(keyed).join(density, "frame").withColumn("score", R.quality_score())
        out.qualities = done("quality", scored.select(F.col("frame").alias("tile"), "score", R.quality_flag(F.col("score"), c["quality"]["threshold"]).alias("flag")))
    if on("tiling"):
        out.steps.append("tiling")
        out.seconds["tiling"] = time.perf_counter() - began
    return out


def _numbered(pixels: DataFrame) -> DataFrame:
    """pixels with a hash of the frame's name as its number, for kernels."""
    return pixels.withColumn("frame", F.xxhash64("frame"))


def _named(pixels: DataFrame):
    """Gives numbered frames their names back."""
    names = pixels.select("frame").distinct().select(F.col("frame").alias("_name"), F.xxhash64("frame").alias("frame"))
    return lambda df: df.join(names, "frame").drop("frame").withColumnRenamed("_name", "frame")
