"""Image operators on pixels in long form: frame, r, c, v. Row and column statistics are group-bys, neighbourhoods kernels on bands of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import box, damped, moments, on_bands, reached


def box2d(pixels: DataFrame, value: str, win: int, out: str) -> DataFrame:
    """pixels (other columns go) with the mean of win x win neighbours, edge values repeated."""
    kernel = lambda image, inside: {value: image[win // 2 : image.shape[0] - win // 2, win // 2 : image.shape[1] - win // 2], out: box(image, win)}
    return on_bands(pixels, kernel, win // 2, f"{value} double, {out} double", value)


def local_moments(pixels: DataFrame, win: int) -> DataFrame:
    """frame, r, c, v with the local mean and variance (not below 0)."""
    return on_bands(pixels, moments(win), win // 2, "v double, mean double, var double")


def lee(pixels: DataFrame, win: int = 5) -> DataFrame:
    """frame, r, c, v: the mean, moved towards the pixel as far as local variance exceeds the frame's noise."""
    rows = local_moments(pixels, win)
    noise = rows.groupBy("frame").agg(F.avg("var").alias("noise"))
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("var") - F.col("noise")) / (F.col("var") + 1e-6)))
    return rows.join(noise, "frame").select("frame", "r", "c", (F.col("mean") + k * (F.col("v") - F.col("mean"))).alias("v"))


def frost(pixels: DataFrame, win: int = 5, damp: float = 2.0) -> DataFrame:
    """frame, r, c, v: exponential weights that decay faster where the centre pixel's neighbourhood varies; shifts wrap around."""
    return on_bands(pixels, damped(win, damp), win // 2, "v double", wrap=True)


def despeckled(pixels: DataFrame, method: str = "lee", win: int = 5, damp: float = 2.0) -> DataFrame:
    if method not in ("lee", "frost"):
        raise ValueError(f"unknown despeckle method {method}")
    return lee(pixels, win) if method == "lee" else frost(pixels, win, damp)


def column_means(pixels: DataFrame, valid: str | None = None) -> DataFrame:
    """frame, c, m: the mean over valid pixels (0 for a column without one)."""
    ok = F.col(valid).cast("int") if valid else F.lit(1)
    return pixels.groupBy("frame", "c").agg((F.sum(F.col("v") * ok) / F.greatest(F.sum(ok), F.lit(1))).alias("m"))


def column_gain(pixels: DataFrame, valid: str | None = None, eps: float = 1e-6) -> DataFrame:
    """frame, c, gain: the column mean relative to the mean of those above eps; 1 for others."""
    means = column_means(pixels, valid)
    overall = means.groupBy("frame").agg(F.avg(F.when(F.col("m") > eps, F.col("m"))).alias("g"))
    gain = F.when(F.col("m") > eps, F.col("m") / F.col("g")).otherwise(1.0)
    return means.join(overall, "frame").select("frame", "c", F.when(gain < eps, 1.0).otherwise(gain).alias("gain"))


def gain_normalised(pixels: DataFrame, valid: str | None = None, eps: float = 1e-6) -> DataFrame:
    """pixels with v divided by its column's gain."""
    return pixels.join(column_gain(pixels, valid, eps), ["frame", "c"]).withColumn("v", F.col("v") / F.col("gain")).drop("gain")


def column_cv(pixels: DataFrame, valid: str | None = None) -> DataFrame:
    """frame, cv: spread of the positive column means relative to their mean; 0 without any."""
    positive = F.when(F.col("m") > 0, F.col("m"))
    return column_means(pixels, valid).groupBy("frame").agg(F.coalesce(F.try_divide(F.stddev_pop(positive), F.avg(positive)), F.lit(0.0)).alias("cv"))


def low_passed(means: DataFrame, axis: str, band: float) -> DataFrame:
    """frame, axis, low: a profile's (column m) part with frequencies up to max(1, band x length) cycles."""
    size = means.groupBy("frame").agg(F.count("*").alias("n"))
    rows = means.join(size, "frame")
    cycles = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(band) * F.col("n")).cast("int")))
    angle = F.lit(2 * math.pi) * F.col("f") * F.col(axis) / F.col("n")
    waves = rows.select("frame", axis, "m", "n", F.explode(cycles).alias("f"))
    parts = waves.groupBy("frame", "f").agg((F.sum(F.col("m") * F.cos(angle)) * 2 / F.max("n")).alias("a"), (F.sum(F.col("m") * F.sin(angle)) * 2 / F.max("n")).alias("b"))
    summed = waves.join(parts, ["frame", "f"]).groupBy("frame", axis).agg(F.sum(F.col("a") * F.cos(angle) + F.col("b") * F.sin(angle)).alias("wave"))
    level = means.groupBy("frame").agg(F.avg("m").alias("level"))
    return summed.join(level, "frame").select("frame", axis, (F.col("wave") + F.col("level")).alias("low"))


def destriped(pixels: DataFrame, band: float = 0.02) -> DataFrame:
    """pixels without what is constant along one axis and varies quickly along the other.

    Zeroing the two axes of a 2-D spectrum outside a low band takes column and row means' high parts away; as sums of
    waves that needs two group-bys and no transform of the image.
    """
    by_column, by_row = pixels.groupBy("frame", "c").agg(F.avg("v").alias("m")), pixels.groupBy("frame", "r").agg(F.avg("v").alias("m"))
    column = by_column.join(low_passed(by_column, "c", band), ["frame", "c"]).select("frame", "c", (F.col("m") - F.col("low")).alias("_column"))
    row = by_row.join(low_passed(by_row, "r", band), ["frame", "r"]).select("frame", "r", (F.col("m") - F.col("low")).alias("_row"))
    return pixels.join(column, ["frame", "c"]).join(row, ["frame", "r"]).withColumn("v", F.col("v") - F.col("_column") - F.col("_row")).drop("_column", "_row")


def stretched(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """pixels with v between two percentiles of its frame mapped to 0..255 and truncated."""
    ends = pixels.groupBy("frame").agg(F.percentile("v", F.lit(low)).alias("_lo"), F.percentile("v", F.lit(high)).alias("_hi"))
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("_lo")) / (top - F.col("_lo"))))
    return pixels.join(ends, "frame").withColumn("v", F.floor(share * 255).cast("int")).drop("_lo", "_hi")


def tiles(pixels: DataFrame, size: int, overlap: float = 0.2, least_valid: float = 0.1) -> DataFrame:
    """tile, frame, row_off, col_off, r, c (in the tile), v, valid: overlapping crops with enough valid pixels.

    A pixel's tiles are found from the offset lists of its own frame: no join over ranges.
    """
    from ..functions.arrays import tile_offsets

    stride = max(1, round(size * (1 - overlap)))
    extent = pixels.groupBy("frame").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    lists = extent.select("frame", tile_offsets(F.col("h"), size, stride).alias("rows"), tile_offsets(F.col("w"), size, stride).alias("cols"))
    own = lambda offsets, at: F.filter(offsets, lambda o: (o <= at) & (o > at - size))
    rows = pixels.join(lists, "frame").withColumn("row_off", F.explode(own(F.col("rows"), F.col("r")))).withColumn("col_off", F.explode(own(F.col("cols"), F.col("c"))))
    ok = F.col("valid") if "valid" in pixels.columns else F.lit(True)
    named = rows.select(F.format_string("r%d_c%d", F.col("row_off").cast("int"), F.col("col_off").cast("int")).alias("tile"), "frame", "row_off", "col_off", (F.col("r") - F.col("row_off")).alias("r"), (F.col("c") - F.col("col_off")).alias("c"), "v", ok.alias("valid"))
    enough = named.groupBy("frame", "tile").agg(F.avg(F.col("valid").cast("int")).alias("share")).filter(F.col("share") >= least_valid)
    return named.join(enough.select("frame", "tile"), ["frame", "tile"], "left_semi")


#: Weights of the quality score. Fixed values.
WEIGHTS = {"snr": 0.30, "contrast": 0.25, "edge_density": 0.20, "dropout": 0.15, "saturation": 0.10}


def tile_proxies(pixels: DataFrame) -> DataFrame:
    """Per frame: snr, contrast, dropout and saturation (edge density comes from the edge kernel)."""
    smooth = box2d(pixels, "v", 5, "s")
    noise = F.stddev_pop(F.col("v") - F.col("s"))
    whole = smooth.groupBy("frame").agg(
        F.when(noise > 1e-6, F.try_divide(F.stddev_pop("s"), noise)).otherwise(10.0).alias("snr"),
        ((F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))) / 255).alias("contrast"),
        F.avg(((F.col("v") <= 2) | (F.col("v") >= 253)).cast("int")).alias("saturation"),
    )
    dark = lambda axis: pixels.groupBy("frame", axis).agg((F.max("v") <= 1).cast("int").alias("dark")).groupBy("frame").agg(F.avg("dark").alias(f"dark_{axis}"))
    return whole.join(dark("r"), "frame").join(dark("c"), "frame").withColumn("dropout", F.greatest("dark_r", "dark_c")).drop("dark_r", "dark_c")


def quality_score(snr_half: float = 1.0, edge_ref: float = 0.15) -> Column:
    """Weighted score of the columns snr, contrast, edge_density, dropout and saturation."""
    return (
        WEIGHTS["snr"] * F.col("snr") / (F.col("snr") + snr_half)
        + WEIGHTS["contrast"] * F.least(F.lit(1.0), F.col("contrast"))
        + WEIGHTS["edge_density"] * F.least(F.lit(1.0), F.col("edge_density") / edge_ref)
        + WEIGHTS["dropout"] * (1 - F.col("dropout"))
        + WEIGHTS["saturation"] * (1 - F.col("saturation"))
    )


def quality_flag(score: Column, threshold: float = 0.404) -> Column:
    return F.when(score < threshold, "low").otherwise("ok")


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element k wide."""
    half = k // 2
    out = []
    for y in range(-half, half + 1):
        reach = round(half * math.sqrt(max(0.0, 1 - (y / half) ** 2))) if half else 0
        out += [(y, x) for x in range(-reach, reach + 1)]
    return out


def morphology(mask: DataFrame, k: int, widest: bool) -> DataFrame:
    """frame, r, c, on: the greatest (dilation) or least (erosion) of on over the element; outside pixels don't count."""
    return on_bands(mask, reached(ellipse(k), k // 2, widest), k // 2, "v double", "on").select("frame", "r", "c", F.col("v").cast("int").alias("on"))


def opened_closed(mask: DataFrame, k: int = 5) -> DataFrame:
    """Opening, then closing."""
    if k <= 1:
        return mask.select("frame", "r", "c", "on")
    for widest in (False, True, True, False):
        mask = morphology(mask, k, widest)
    return mask
