"""Per-survey series of altitudes: gap filling, spike removal, jump limits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_filled(pings: DataFrame, value: str = "alt", out: str = "filled") -> DataFrame:
    """Linear interpolation over i between known values, constant beyond the ends, 0 without any (survey, i, value)."""
    before = Window.partitionBy("survey").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("survey").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("i").alias("i"), F.col(value).cast("double").alias("v")))
    rows = pings.withColumns({"_low": F.last(known, ignorenulls=True).over(before), "_high": F.first(known, ignorenulls=True).over(after)})
    low, high = F.col("_low"), F.col("_high")
    between = low["v"] + (high["v"] - low["v"]) * (F.col("i") - low["i"]) / F.nullif(high["i"] - low["i"], F.lit(0))
    return rows.withColumn(out, F.coalesce(F.col(value).cast("double"), between, low["v"], high["v"], F.lit(0.0))).drop("_low", "_high")


def median_filtered(pings: DataFrame, value: str = "filled", width: int = 7, out: str = "median") -> DataFrame:
    """Running median, edge values repeated."""
    half = width // 2
    order = Window.partitionBy("survey").orderBy("i")
    every = Window.partitionBy("survey")
    near = F.collect_list(value).over(order.rowsBetween(-half, half))
    at, last = F.row_number().over(order) - 1, F.count("*").over(every) - 1
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = pings.withColumns({"_near": near, "_at": at, "_last": last, "_a": F.first(value).over(ends), "_b": F.last(value).over(ends)})
    left = F.array_repeat(F.col("_a"), F.greatest(F.lit(0), half - F.col("_at")).cast("int"))
    right = F.array_repeat(F.col("_b"), F.greatest(F.lit(0), F.col("_at") + half - F.col("_last")).cast("int"))
    return rows.withColumn(out, F.array_sort(F.concat(left, "_near", right))[half]).drop("_near", "_at", "_last", "_a", "_b")


def jump_clamped(pings: DataFrame, value: str = "median", limit: float = 15.0, out: str = "clamped") -> DataFrame:
    """Each value held within ``limit`` of the one given out before it: a recurrence, so a linear scan of each survey."""
    schema = pings.withColumn(out, F.lit(0.0)).schema

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        done: list[float] = []
        for x in group[value].to_pylist():
            done.append(x if not done else done[-1] + max(-limit, min(limit, x - done[-1])))
        return group.append_column(out, pa.array(done, pa.float64()))

    return pings.groupBy("survey").applyInArrow(scan, schema)


def held(values: np.ndarray, limit: float) -> np.ndarray:
    """Each value within ``limit`` of the one given out before it; only stretches that follow a jump are gone through."""
    out, settled = values.copy(), 0
    for jump in (np.flatnonzero(np.abs(np.diff(values)) > limit) + 1).tolist():
        k = jump
        while settled <= jump and k < len(values):
            out[k] = min(max(values[k], out[k - 1] - limit), out[k - 1] + limit)
            k += 1
            if out[k - 1] == values[k - 1]:
                break
        settled = max(settled, k)
    return out


def tracked(pings: DataFrame, value: str = "alt", width: int = 7, limit: float = 15.0) -> DataFrame:
    """pings with filled, median and clamped at once: gap_filled, median_filtered and jump_clamped in one pass of each survey.

    A survey is sorted once and its steps are array operations; only the jump limit is a loop.
    """
    schema = pings.withColumns({x: F.lit(0.0) for x in ("filled", "median", "clamped")}).schema

    def track(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        i, v = group["i"].to_numpy().astype(float), group[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = ~np.isnan(v)
        filled = np.where(known, v, np.interp(i, i[known], v[known])) if known.any() else np.zeros(len(v))
        near = np.lib.stride_tricks.sliding_window_view(np.pad(filled, width // 2, mode="edge"), width)
        median = np.median(near, axis=1)
        for name, x in (("filled", filled), ("median", median), ("clamped", held(median, limit))):
            group = group.append_column(name, pa.array(x, pa.float64()))
        return group

    return pings.groupBy("survey").applyInArrow(track, schema)


def altitude_summary(pings: DataFrame, recorded: str = "alt", tracked: str = "clamped") -> DataFrame:
    """Per survey: pings, known values, mean absolute difference where both are known, range of the tracked values."""
    return pings.groupBy("survey").agg(
        F.count("*").alias("n_pings"),
        F.count(recorded).alias("n_known"),
        F.avg(F.abs(F.col(recorded) - F.col(tracked))).alias("mae"),
        F.min(tracked).alias("low"),
        F.max(tracked).alias("high"),
    )


def altitude_error(rows: DataFrame, truth: str, estimate: str, by: str = "survey") -> DataFrame:
    """Per survey: pings, mean of the truth, mean absolute error where both are known, and that as a share of the mean."""
    error = F.avg(F.abs(F.col(truth) - F.col(estimate)))
    out = rows.groupBy(by).agg(F.count("*").alias("n_pings"), F.avg(truth).alias("mean"), error.alias("mae"))
    return out.withColumn("share_of_mean", F.try_divide("mae", "mean"))


def altitude_policy(frames: DataFrame, pings: DataFrame) -> DataFrame:
    """altitude_m and its source: recorded metres if a frame has any, else tracked pixels times the slant resolution.

    frames: frame, mode, slant_res; pings: frame, ping, altitude_m, altitude_px.
    """
    has = pings.groupBy("frame").agg((F.count("altitude_m") > 0).alias("recorded"))
    both = pings.join(frames.join(has, "frame"), "frame")
    tracked = F.col("altitude_px") * F.col("slant_res")
    source = F.when(F.col("recorded"), "file").when(F.col("mode") == "degraded", "image_estimate").otherwise("bottom_tracking")
    return both.select("frame", "ping", "altitude_px", F.when(F.col("recorded"), F.col("altitude_m")).otherwise(tracked).alias("altitude_m"), source.alias("altitude_source"))
